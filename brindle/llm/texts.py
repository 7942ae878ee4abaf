"""What the operators share: words, hashes, Arrow loops and bounded samples of labelled rows.

A word is a run of bytes other than the six ASCII white-space characters (space, tab, line
feed, vertical tab, form feed, carriage return); ``bytes.split()`` cuts exactly there.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from brindle.session import materialize

#: Rows of an Arrow batch handled at once, so that memory follows the batch and not the task.
SLICE = 512
#: Distinct words of a generation that a worker remembers at most.
CACHE_WORDS = 150_000
#: Ids that are broadcast to a join at most.
BROADCAST_IDS = 1_000_000


class Remembered(dict):
    """key -> find(key), remembered in two generations of at most ``limit`` keys: what was used lately stays."""

    def __init__(self, find: Callable, limit: int = CACHE_WORDS):
        self.find, self.limit, self.old = find, limit, {}

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        found = self.old.get(key)
        if found is None:
            found = self.find(key)
        self[key] = found
        return found


class WordHashes(Remembered):
    """word -> 8 bytes of its 64-bit hash."""

    def __init__(self):
        super().__init__(xxhash.xxh3_64_digest)

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, words)), np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: each output bit depends on all input bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(words: list[bytes], width: int, hashes: WordHashes) -> np.ndarray:
    """Hashes of the runs of ``width`` words, in text order; of all words together if there are fewer; none without words."""
    if not words:
        return np.empty(0, np.uint64)
    h, width = hashes.of(words), min(width, len(words))
    out = np.zeros(len(h) - width + 1, np.uint64)
    for i in range(width):
        out = mixed(out + h[i : i + len(out)] + np.uint64(i))
    return out


class PartIds:
    """Parts of texts -> their ids, remembered in bulk: the parts lie in one Arrow array, their ids in another.

    ``learn`` gets distinct new parts and returns (the order in which it took them, all their ids in
    that order, their numbers of ids). At most ``limit`` parts and ``LIMIT_BYTES`` bytes of them stay
    from one batch to the next, those that were used last.
    """

    LIMIT_BYTES = 64 << 20

    def __init__(self, learn: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]], limit: int = 600_000):
        self.learn, self.limit = learn, limit
        self.parts = pa.array([], pa.binary())
        self.ids, self.sizes, self.starts = np.empty(0, np.uint32), np.empty(0, np.int32), np.empty(0, np.int64)
        self.used, self.batches = np.empty(0, np.int32), 0

    def __call__(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) of a binary array of parts, one part after the other, and where each part's begin (one number more)."""
        self.batches += 1
        at = self._places(parts)
        self.used[at] = self.batches
        n = self.sizes[at]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(n, dtype=np.int64)])
        kind = np.int32 if ends[-1] < 1 << 31 and len(self.ids) < 1 << 31 else np.int64
        index = np.arange(ends[-1], dtype=kind)
        index += np.repeat((self.starts[at] - ends[:-1]).astype(kind), n)
        return self.ids[index], ends

    def _places(self, parts: pa.Array) -> np.ndarray:
        at = pc.index_in(parts, value_set=self.parts)
        if not at.null_count:
            return at.to_numpy()
        missed = at.is_null()
        self.used[at.drop_null().to_numpy()] = self.batches
        new = parts.filter(missed)
        fresh = new.unique()
        forgot = self._forget(fresh)
        known = len(self.parts)
        order, ids, sizes = self.learn(fresh.to_pylist())
        fresh = fresh.take(pa.array(order))
        self.parts = pa.concat_arrays([self.parts, fresh])
        self.ids = np.concatenate([self.ids, ids])
        self.sizes = np.concatenate([self.sizes, sizes]).astype(np.int32)
        self.starts = np.cumsum(self.sizes, dtype=np.int64) - self.sizes
        self.used = np.concatenate([self.used, np.full(len(fresh), self.batches, np.int32)])
        if forgot:  # places have changed
            return pc.index_in(parts, value_set=self.parts).to_numpy()
        out = at.fill_null(0).to_numpy().copy()
        out[missed.to_numpy(zero_copy_only=False)] = pc.index_in(new, value_set=fresh).to_numpy() + known
        return out

    def _forget(self, fresh: pa.Array) -> bool:
        """Keep what this batch uses, and of the rest what was used last, if ``fresh`` is too much for all to stay."""
        if len(self.parts) + len(fresh) <= self.limit and self.parts.nbytes + fresh.nbytes <= self.LIMIT_BYTES:
            return False
        lengths, last = pc.binary_length(self.parts).to_numpy(), np.argsort(-self.used, kind="stable")
        keep = np.zeros(len(last), bool)
        keep[last] = (np.arange(len(last)) < self.limit // 2) & (np.cumsum(lengths[last], dtype=np.int64) < self.LIMIT_BYTES // 2)
        keep |= self.used == self.batches
        self.parts, self.ids = self.parts.filter(pa.array(keep)), self.ids[np.repeat(keep, self.sizes)]
        self.sizes, self.used = self.sizes[keep], self.used[keep]
        return True


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array without nulls, and where each text begins in them (one number more)."""
    edges = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data is not None else np.empty(0, np.uint8)), edges - edges[0]


def process_cache() -> dict:
    """A dict that lives as long as the Python worker, for what is dear to load."""
    return sys.__dict__.setdefault("_brindle_process_cache", {})


#: Settings of Arrow batches: name, value if nobody set it, value for whole texts.
BATCH_SETTINGS = (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2048"), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8388608b"))


def arrow_map(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], list]], rows: int = SLICE) -> DataFrame:
    """``df.mapInArrow``: ``make()`` is called once a task and gives a function from a slice of
    at most ``rows`` rows to the list of output columns (arrays or lists).

    Texts are long: where the session has Spark's defaults, it gets the bounds of BATCH_SETTINGS, for
    this and later queries (plans read them when they run, so they can't be put back here).
    """
    spark = df.sparkSession
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    for name, usual, most in BATCH_SETTINGS:
        if spark.conf.get(name, usual) == usual:
            spark.conf.set(name, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                step = step or make()
                columns = step(batch.slice(at, rows))
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def fold(remainder: int, divisor: int):
    """Whether a row's ``doc_id`` has this crc32 remainder; a null id has the empty text's, which is 0."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % divisor == remainder


def valid(name: str):
    """A text column as Python can read it: bytes that aren't valid UTF-8 become U+FFFD."""
    return F.make_valid_utf8(F.col(name).cast("string"))


def row_key(documents: DataFrame):
    """A 64-bit key of a row's doc_id and text, null or not."""
    return F.xxhash64(documents["doc_id"], documents["text"].cast("binary"))


def fresh_name(wanted: str, columns: list[str]) -> str:
    """``wanted``, with a number if need be: a name that none of ``columns`` has in any case of letters."""
    taken = {c.lower() for c in columns}
    return next(n for n in (wanted, *(f"{wanted}{i}" for i in range(len(taken) + 1))) if n.lower() not in taken)


def without(documents: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``documents`` that ``gone`` (doc_id, row: distinct, a written table) doesn't name by id, null or not, and key."""
    return _named(documents, gone, "left_anti").select(documents.columns)


def _named(documents: DataFrame, rows: DataFrame, how: str, name: str | None = None) -> DataFrame:
    name = name or fresh_name("_row", documents.columns)
    keyed = documents.withColumn(name, row_key(documents))
    rows = broadcast_if_small(rows.select(F.col("doc_id").alias("_id"), F.col("row").alias("_key")))
    return keyed.join(rows, (keyed[name] == rows["_key"]) & keyed["doc_id"].eqNullSafe(rows["_id"]), how)


def once(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """One row of ``documents`` for each of ``rows`` (doc_id, row: distinct, a written table)."""
    name = fresh_name("_row", documents.columns)
    return _named(documents, rows, "left_semi", name).dropDuplicates(["doc_id", name]).select(documents.columns)


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """(doc_id, text, label) of at most ``bound`` labelled documents: those of least hash of doc_id.

    The bound is on rows and doesn't depend on the table's size or on how often it repeats an id; the chosen ones are therefore
    safe to broadcast. Rows whose label is null are no labels. An id with several labels counts
    with the least, one with several texts with each, as far as the bound goes; rows of equal id and text count once.
    """
    ids = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min(F.col(label).cast("int")).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
    )
    ids = materialize(ids, "labelled")  # read twice
    keyed = documents.select("doc_id", "text", F.xxhash64(F.col("text").cast("binary")).alias("_row"))
    rows = keyed.select("doc_id", "_row").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "_row", "label").agg(F.count("*").alias("n"))
    rows = materialize(rows.orderBy(F.xxhash64("doc_id"), "doc_id", "_row").limit(bound), "chosen")
    found = keyed.join(F.broadcast(rows), ["doc_id", "_row"])
    if not rows.where("n > 1").isEmpty():
        found = found.dropDuplicates(["doc_id", "_row"])
    return found.select("doc_id", "text", "label")


def broadcast_if_small(ids: DataFrame, rows: int = BROADCAST_IDS) -> DataFrame:
    """A written table of ids, with a broadcast hint if it has at most ``rows`` rows; else it is joined by sorting."""
    return F.broadcast(ids) if ids.limit(rows + 1).count() <= rows else ids


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))
