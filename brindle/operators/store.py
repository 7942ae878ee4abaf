"""Chunk and document tables as values: upserts, deletes, filters, statistics, versions of a snapshot folder.

A change takes tables and gives the new table; ``save`` writes it beside the old one and then switches.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from brindle.functions import text as T
from brindle.session import few

CHUNK_COLUMNS = (
    "id string, content string, document_id string, document_title string, document_type string, chunk_index int, start_char int, end_char int, token_count int, "
    "metadata map<string,string>, embedding array<float>, study_id string, content_hash string, access_count bigint, last_accessed timestamp"
)
DOCUMENT_COLUMNS = "id string, title string, content string, document_type string, file_path string, file_size bigint, study_id string, metadata map<string,string>, created_at timestamp, updated_at timestamp"


def not_blank(df: DataFrame, *columns: str) -> DataFrame:
    """Rows whose named texts are more than white space."""
    for c in columns:
        df = df.where(T.strip(c) != "")
    return df


def upsert_chunks(old: DataFrame, new: DataFrame, order: Column | str = "id") -> DataFrame:
    """Rows of ``new`` by id (of repeated ids the one of greatest ``order``) and the old rows of other ids."""
    order = F.col(order) if isinstance(order, str) else order
    latest = new.withColumn("_n", F.row_number().over(W.partitionBy("id").orderBy(order.desc()))).where("_n = 1").select(old.columns)
    return old.join(latest.select("id"), "id", "left_anti").unionByName(latest)


def upsert_by_hash(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """``old`` (id, content, content_hash, access_count, last_accessed) and ``new`` (id, content): one row a content.

    Each further arrival of a content adds one to its access count and touches ``last_accessed``; the
    first row (old before new, then least id) names it. Counts combine before they move.
    """
    came = new.select(T.sha256("content").alias("content_hash"), "id", "content").groupBy("content_hash").agg(F.count("*").alias("n"), F.min(F.struct("id", "content")).alias("f"))
    both = old.join(came, "content_hash", "full_outer")
    known = F.col("access_count").isNotNull()
    again = F.when(known, F.coalesce("n", F.lit(0))).otherwise(F.col("n") - 1)
    return both.select(
        F.coalesce("id", "f.id").alias("id"), F.coalesce("content", "f.content").alias("content"), "content_hash",
        (F.coalesce("access_count", F.lit(0)) + again).cast("bigint").alias("access_count"), F.when(again > 0, now).otherwise(F.col("last_accessed")).alias("last_accessed"),
    )


def vector_records(chunks: DataFrame, most: int = 1000) -> DataFrame:
    """What a vector service stores: id, vector, metadata with the content cut to ``most`` characters."""
    return chunks.select("id", F.col("embedding").alias("values"), F.create_map(F.lit("content"), F.substring("content", 1, most), F.lit("document_id"), F.col("document_id").cast("string")).alias("metadata"))


def delete_document(chunks: DataFrame, document_id) -> tuple[DataFrame, DataFrame]:
    """The chunks of other documents, and the number of deleted ones (one row ``deleted``)."""
    gone = F.col("document_id") == F.lit(document_id)
    return chunks.where(~F.coalesce(gone, F.lit(False))), chunks.where(gone).agg(F.count("*").alias("deleted"))


def by_ids(chunks: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Chunks of a list (pos, id), in its order; unknown ids are dropped."""
    return chunks.join(ids, key).orderBy("pos")


def by_chunk_index(chunks: DataFrame, ids: list) -> DataFrame:
    return chunks.where(F.col("id").isin(ids)).orderBy("chunk_index", "id")


def type_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("document_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "document_type")


def top_studies(chunks: DataFrame, k: int = 10) -> DataFrame:
    return chunks.where("study_id is not null").groupBy("study_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "study_id").limit(k)


def statistics(chunks: DataFrame, approximate: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return chunks.agg(
        F.count("*").alias("total_chunks"), distinct("document_id").alias("documents"), distinct("study_id").alias("studies"),
        F.round(F.avg("access_count"), 6).alias("avg_access"), F.max("access_count").alias("max_access"), F.round(F.avg("token_count"), 6).alias("avg_tokens"),
    )


def recently_accessed(chunks: DataFrame, now: Column, days: int = 30) -> DataFrame:
    return chunks.where(F.col("last_accessed") > now - F.make_dt_interval(F.lit(days)))


#: Pairs of a user and a row (about) that a task makes.
VISIBLE_PAIRS = 4_000_000


def visible(rows: DataFrame, users: DataFrame) -> DataFrame:
    """(user_id, row) that a user may see: rows of its studies, or all for holders of ``admin``. ``users``: user_id, studies, permissions.

    Users, their studies and rows are made distinct before they meet, so pairs never move. A study's users are dealt out by
    the pairs that they make, and its rows go to each part: few studies, or a large one, are many tasks.
    """
    rows = rows.distinct()
    admins = users.where(F.array_contains("permissions", "admin")).select("user_id").distinct()
    own = users.select("user_id", F.explode("studies").alias("study_id")).distinct()
    own = own.join(admins.select(F.col("user_id").alias("_admin")), F.col("user_id").eqNullSafe(F.col("_admin")), "left_anti")
    sizes = own.groupBy("study_id").agg(F.count("*").alias("_users")).join(rows.groupBy("study_id").agg(F.count("*").alias("_rows")), "study_id")
    sizes = sizes.select("study_id", (F.col("_users") * F.col("_rows")).alias("_pairs"))
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-(sizes.agg(F.sum("_pairs")).first()[0] or 0) // VISIBLE_PAIRS))
    sizes = sizes.select("study_id", F.ceil(F.col("_pairs") / VISIBLE_PAIRS).cast("int").alias("_n"))
    own = own.join(sizes, "study_id").select("user_id", "study_id", F.pmod(F.xxhash64("user_id"), F.col("_n")).cast("int").alias("_part"))
    listed = rows.join(sizes, "study_id").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    listed = listed.repartition(parts, "study_id", "_part").hint("shuffle_hash").join(own.repartition(parts, "study_id", "_part"), ["study_id", "_part"])
    return listed.select("user_id", *rows.columns).unionByName(rows.crossJoin(few(admins)).select("user_id", *rows.columns))


# --- ingestion tasks and object stores ---------------------------------------------------------


def newest_tasks(tasks: DataFrame, limit: int = 50) -> DataFrame:
    """The ``limit`` tasks created last, newest first. ``tasks``: id, created_at and what else there is."""
    return tasks.orderBy(F.desc("created_at"), "id").limit(limit)


def task_census(tasks: DataFrame) -> DataFrame:
    """(status, n, first_created, last_created) of all tasks."""
    return tasks.groupBy("status").agg(F.count("*").alias("n"), F.min("created_at").alias("first_created"), F.max("created_at").alias("last_created"))


def insert_objects(rows: DataFrame, send, batch: int = 100) -> DataFrame:
    """(n): how many objects each call of ``send`` took. It gets a list of at most ``batch`` rows as dicts, in the tasks;
    a task that is run again sends its rows again, so ``send`` must insert by id."""

    def run(frames):
        for frame in frames:
            for at in range(0, len(frame), batch):
                yield pd.DataFrame({"n": [int(send(frame.iloc[at : at + batch].to_dict("records")))]})

    return rows.mapInPandas(run, "n bigint")


# --- snapshots ---------------------------------------------------------------------------------


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def save(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write the table's next version, ``path``/v=n, complete when its marker file is there.

    Readers (``load``) take the newest complete version, so none of them ever misses the table and a
    failed write changes nothing. The version before stays, for those who still read it; older ones go.
    """
    spark = df.sparkSession
    before = saved_versions(spark, path)
    number = max(_numbers(spark, path), default=0) + 1
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}/v={number}")
    marker, fs = _fs(spark, f"{path}/_complete_{number}")
    fs.create(marker, True).close()
    for gone in before[:-1]:
        fs.delete(_fs(spark, f"{path}/_complete_{gone}")[0], False)
        fs.delete(_fs(spark, f"{path}/v={gone}")[0], True)


def _numbers(spark: SparkSession, path: str, prefix: str = "v=") -> list[int]:
    p, fs = _fs(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix))


def saved_versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions of a saved table, oldest first."""
    return _numbers(spark, path, "_complete_")


def load(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete version of a table written by ``save``."""
    found = saved_versions(spark, path)
    if not found:
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path}/v={found[-1]}")


def backup(tables: dict[str, DataFrame], folder: str, name: str) -> str:
    """A named snapshot of tables as Parquet; the marker file is written last."""
    for t, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{name}/{t}")
        spark = df.sparkSession
    marker, fs = _fs(spark, f"{folder}/{name}/_COMPLETE")
    fs.create(marker, True).close()
    return f"{folder}/{name}"


def list_backups(spark: SparkSession, folder: str) -> list[str]:
    """Names of complete snapshots, newest name first."""
    p, fs = _fs(spark, folder)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    return sorted((n for n in names if fs.exists(_fs(spark, f"{folder}/{n}/_COMPLETE")[0])), reverse=True)


def restore(spark: SparkSession, folder: str, name: str, tables: list[str]) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{folder}/{name}/{t}") for t in tables}


def cleanup_backups(spark: SparkSession, folder: str, older_than: str) -> list[str]:
    """Delete snapshots whose name (a sortable date) is before ``older_than``; their names."""
    gone = [n for n in list_backups(spark, folder) if n < older_than]
    for n in gone:
        p, fs = _fs(spark, f"{folder}/{n}")
        fs.delete(p, True)
    return gone
