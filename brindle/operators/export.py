"""Exports of answers with their sources: JSON, CSV, Markdown, sheets; study and audit exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


FORMATS = ("json", "csv", "markdown", "excel")


def json_rows(answers: DataFrame) -> DataFrame:
    """(query_id, document): each answer with its sources as one JSON text, nulls included."""
    return answers.select("query_id", F.to_json(F.struct(*answers.columns), {"ignoreNullFields": "false"}).alias("document"))


def csv_sources(sources: DataFrame, n_chars: int = 200) -> DataFrame:
    return sources.select("query_id", "rank", "id", F.concat(F.substring("content", 1, n_chars), F.lit("...")).alias("content"), "score")


def markdown(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(query_id, document): question, answer, numbered sources."""
    lines = sources.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id", "content"))), lambda s: F.concat(F.lit("### Source "), s["rank"].cast("string"), F.lit(" ("), s["id"].cast("string"), F.lit(")\n\n"), s["content"])), "\n\n").alias("s"))
    return answers.join(lines, "query_id", "left").select("query_id", F.concat(F.lit("# "), "question", F.lit("\n\n## Answer\n\n"), "answer", F.lit("\n\n## Sources\n\n"), F.coalesce("s", F.lit(""))).alias("document"))


def excel(path: str, **sheets: DataFrame) -> None:
    """One sheet a DataFrame; the caller bounds them. Needs pandas with an Excel writer installed."""
    import pandas as pd

    with pd.ExcelWriter(path) as writer:
        for name, df in sheets.items():
            df.toPandas().to_excel(writer, sheet_name=name, index=False)


def writer(kind: str):
    """The export of a format by name."""
    if kind not in FORMATS:
        raise ValueError(f"unsupported format {kind!r}; there are {', '.join(FORMATS)}")
    return {"json": json_rows, "csv": csv_sources, "markdown": markdown, "excel": excel}[kind]


def study_rows(rows: DataFrame, study_id: str) -> DataFrame:
    return rows.where(F.col("study_id") == study_id)


def audit_log(log: DataFrame, start: Column, end: Column, at: str = "ts") -> DataFrame:
    """Entries between two times, both included, in order."""
    return log.where(F.col(at).between(start, end)).orderBy(at)


def package(tables: dict[str, DataFrame], folder: str, kind: str = "json") -> list[str]:
    """Each table as a folder of files of one kind under ``folder``; the paths."""
    out = []
    for name, df in tables.items():
        path = f"{folder}/{name}"
        w = df.write.mode("overwrite")
        (w.json(path) if kind == "json" else w.option("header", True).csv(path))
        out.append(path)
    return out
