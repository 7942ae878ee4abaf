"""Scans: text, JSON and CSV files as documents. Paths may be of any Hadoop file system."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StructField, StructType

from brindle.functions import text as T
from brindle.operators.blocks import spans
from brindle.session import materialize

EXTENSIONS = ("json", "md", "txt", "csv")
MAX_BYTES = 100 << 20


def allowed(path) -> F.Column:
    return T.file_extension(path).isin(*EXTENSIONS)


def files(spark: SparkSession, paths: str | list[str], recursive: bool = True, extensions: tuple[str, ...] = EXTENSIONS, max_bytes: int = MAX_BYTES, oversize: str = "fail") -> DataFrame:
    """(path, content, modified): whole UTF-8 files of known extensions, up to ``max_bytes``, one row a file.

    The content of larger files is never read (the length is a column of the scan); the scan fails at the first of them, or with
    ``oversize`` "skip" leaves them out. ``rejected`` lists them. A path that isn't there fails.
    """
    if oversize not in ("fail", "skip"):
        raise ValueError(f"oversize is fail or skip, not {oversize!r}")
    listed = _listed(spark, paths, extensions) if recursive else None
    raw = _scan(spark, paths, recursive, extensions) if listed is None else listed
    small = raw.where(F.col("length") <= max_bytes)
    small = (small if listed is None else _read(small)).select("path", F.col("content").cast("string").alias("content"), F.col("modificationTime").alias("modified"))
    if oversize == "skip":
        return small
    message = F.concat(F.lit("file too large: "), "path", F.lit(", bytes: "), F.col("length").cast("string"))
    large = raw.where(F.col("length") > max_bytes).select("path", F.raise_error(message).cast("string").alias("content"), F.col("modificationTime").alias("modified"))
    return small.unionByName(large)


def rejected(spark: SparkSession, paths: str | list[str], recursive: bool = True, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, size, reason) of the files that ``files`` doesn't take: over the cap, or of another extension."""
    listed = _listed(spark, paths, None) if recursive else None
    raw = (_scan(spark, paths, recursive, None) if listed is None else listed).select("path", F.col("length").alias("size"))
    reason = F.when(~F.coalesce(allowed("path"), F.lit(False)), "extension").when(F.col("size") > max_bytes, "size")
    return raw.withColumn("reason", reason).where("reason is not null")


def write_each(rows: DataFrame, path: str) -> int:
    """Each row (name, content) as a file of its own below ``path``, a folder that driver and executors share; how many there are.

    Spark's writers take about 30 ms of a core a file where Hadoop has no native library, as a process is started to
    set each file's mode. Tasks write through Arrow instead; a task that is repeated writes the same files again. A null content
    gives an empty file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        made, n = set(), 0
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                target = f"{root}/{name}"
                folder = target.rpartition("/")[0]
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(target, compression=None) as out:
                    out.write(content or b"")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    written = rows.select("name", F.col("content").cast("binary").alias("content")).mapInArrow(run, "n bigint")
    return written.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _scan(spark: SparkSession, paths: str | list[str], recursive: bool, extensions: tuple[str, ...] | None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return (reader.option("pathGlobFilter", "*.{" + ",".join(extensions) + "}") if extensions else reader).load(paths)


#: Files that a task reads, and bytes of a batch of theirs (about).
_TASK_FILES, _BATCH_BYTES = 10_000, 8 << 20


def _listed(spark: SparkSession, paths: str | list[str], extensions: tuple[str, ...] | None) -> DataFrame | None:
    """(path, modificationTime, length) of all files below folders of the file system that driver and executors share, listed in tasks, level by level, into a written table;
    None for other paths, which Spark lists.

    Spark's scan holds the state of each file in the driver. What it leaves out (hidden and empty files) and how it writes a path is the same.
    """
    folders = []
    for one in [paths] if isinstance(paths, str) else paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(one)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.getScheme() != "file" or any(c in one for c in r"*?[]{}\%") or not fs.exists(at) or not fs.getFileStatus(at).isDirectory():
            return None
        folders.append(fs.makeQualified(at).toString())
    wanted = None if extensions is None else tuple(f".{e}" for e in extensions)
    schema = "path string, modificationTime timestamp, length bigint, folder boolean"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def hidden(name: str) -> bool:
        return name[0] == "." or name.endswith("._COPYING_") or name[0] == "_" and "=" not in name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                rows = []
                with os.scandir(folder.removeprefix("file:")) as found:
                    for x in found:
                        if not hidden(x.name) and ((down := x.is_dir()) or wanted is None or x.name.endswith(wanted)):
                            state = x.stat()
                            if state.st_size or down:
                                rows.append((f"{folder}/{x.name}", state.st_mtime_ns // 1_000_000 * 1000, state.st_size, down))
                for a in range(0, len(rows), 10_000):
                    columns = list(zip(*rows[a : a + 10_000]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    level, levels, cores = spark.createDataFrame([(f.rstrip("/"),) for f in folders], "path string"), [], spark.sparkContext.defaultParallelism
    while True:
        found = materialize(level.repartition(cores, "path").mapInArrow(run, schema), "files")
        levels.append(found.where("not folder").drop("folder"))
        level = found.where("folder").select("path")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, levels)


def _read(listed: DataFrame) -> DataFrame:
    """``listed`` with the files' ``content``, read in tasks of _TASK_FILES files (about) each."""
    out = StructType([*listed.schema, StructField("content", BinaryType())])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in spans(batch.column(2).to_numpy(), _BATCH_BYTES):
                part, held = batch.slice(a, b - a), []
                for path in part.column(0).to_pylist():
                    with open(path.removeprefix("file:"), "rb") as file:
                        held.append(file.read())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(held, pa.binary())], schema=arrow)

    parts = max(listed.sparkSession.sparkContext.defaultParallelism, -(-listed.count() // _TASK_FILES))
    return listed.repartition(parts, "path").mapInArrow(run, out)


def documents(scan: DataFrame) -> DataFrame:
    """Documents of scanned files: id, title, content, type, path, size, study, domains."""
    name = F.substring_index("path", "/", -1)
    kind = T.document_type(name)
    return scan.where(T.strip("content") != "").select(
        T.document_id("path", "content").alias("id"), F.regexp_replace(name, r"\.[^.]+$", "").alias("title"), "content", kind.alias("document_type"), F.col("path").alias("file_path"),
        F.octet_length("content").cast("bigint").alias("file_size"), T.study_id(name, "content").alias("study_id"),
        F.when(kind.isin("sdtm", "adam"), T.domains("content")).alias("domains"),
    )


def csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A CSV with header by a given schema: inference would turn padded ids into numbers. Bad rows fail."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def json(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Multi-line JSON; with a schema, bad files fail."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema).option("mode", "FAILFAST") if schema else reader).json(path)
