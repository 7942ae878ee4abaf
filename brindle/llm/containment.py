"""Benchmark decontamination: which short items lie inside which long documents.

An item's shingles are its runs of five words, lower-cased from A to Z. A document contains an
item if at least ``threshold`` of the item's distinct shingles occur in it.

Items are partitioned by their number of shingles. Each partition has one MinHash sketch width:
the least ``k`` hashes of an item's shingles, where ``k`` is one more than the number of shingles
that an item of the partition's upper size may miss. At least one of them is then in every
document that contains the item, so the search loses nothing, however long the document is; and
items get few sketch hashes, so few documents are candidates. A candidate is verified by comparing
all of the item's shingles, as words, with those of the whole document.

Up to ``BLOCK_HASHES`` sketch hashes and ``BLOCK_WORDS`` words, the items go to every task, which takes
one pass over the documents. A larger set is never brought together: its sketch hashes become a
bitmap of fixed size, documents send the hashes that it knows, these are joined with the sketches,
and the candidates' documents and items are brought together for the verification. That takes two
passes over the documents, however many items there are.

Edge cases: items without words (null or blank) are in no document; an item of fewer than five
words is one shingle of all its words, looked for among the documents' runs of as many words; null
and empty documents contain nothing; items that repeat an id are told apart by text and the best
containment counts; repeated documents get a row each; empty tables give no rows; columns other than
those asked for are not read, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.texts import WordHashes, arrow_map, mixed, row_key, shingle_hashes, without
from brindle.session import materialize

WIDTH = 5
PERCENT = 80
#: Sketch hashes and words of items that are sent to every task, at most.
BLOCK_HASHES = 200_000
BLOCK_WORDS = 2_000_000
#: The bitmap of a larger set: 2**BITMAP_BITS bits in pieces of 2**PIECE_BITS, and items verified with a document at once.
BITMAP_BITS = 27
PIECE_BITS = 17
TOGETHER = 1_000


def _shingles(words: list[bytes], width: int) -> set[tuple[bytes, ...]]:
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def sketch_width(n: int, percent: int = PERCENT) -> int:
    """Sketch hashes of an item of ``n`` shingles: by its partition, whose sizes share the bit length."""
    upper = (1 << n.bit_length()) - 1
    return min(n, upper - -(-percent * upper // 100) + 1)


def _words(text: bytes | None) -> list[bytes]:
    return bytes(text or b"").lower().split()


def _sketch(words: list[bytes], percent: int, hashes: WordHashes) -> np.ndarray:
    found = np.unique(shingle_hashes(words, WIDTH, hashes))
    return found[: sketch_width(len(found), percent)]


def _one_block(items: DataFrame, percent: int) -> list | None:
    """(item_id, words, sketch) of all items, read one partition at a time; None as soon as they are too many."""
    hashes = WordHashes()
    block, n_hashes, n_words = [], 0, 0
    for item_id, text in items.select("item_id", F.col("text").cast("binary")).where("text is not null").toLocalIterator():
        words = _words(text)
        if not words:
            continue
        sketch = _sketch(words, percent, hashes)
        n_hashes, n_words = n_hashes + len(sketch), n_words + len(words)
        if n_hashes > BLOCK_HASHES or n_words > BLOCK_WORDS:
            return None
        block.append((item_id, words, sketch.tolist()))
    return block


def _search(documents: DataFrame, block: list, percent: int, schema: str) -> DataFrame:
    """``documents``: columns to keep, then the text as binary."""
    shared = documents.sparkSession.sparkContext.broadcast(block)  # bounded by BLOCK_HASHES and BLOCK_WORDS

    def make():
        holders: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))  # width -> hash -> items
        for i, (_, words, sketch) in enumerate(shared.value):
            for h in sketch:
                holders[min(WIDTH, len(words))][h].append(i)
        keys = {width: np.array(sorted(of), np.uint64) for width, of in holders.items()}
        full: list = [None] * len(shared.value)
        hashes = WordHashes()

        def found_in(words: list[bytes]) -> dict:
            best: dict = {}
            for width, sought in keys.items():
                if len(words) < width:
                    continue
                found = shingle_hashes(words, width, hashes)
                hit = sought[np.minimum(np.searchsorted(sought, found), len(sought) - 1)] == found
                candidates = {i for h in set(found[hit].tolist()) for i in holders[width][h]}
                own = _shingles(words, width) if candidates else set()
                for i in candidates:
                    if full[i] is None:
                        full[i] = _shingles(shared.value[i][1], width)
                    _note(best, shared.value[i][0], full[i], own, percent)
            return best

        def step(batch: pa.RecordBatch) -> list:
            row, out = [], []
            for i, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                for item, values in found_in((text or b"").lower().split()).items():
                    row.append(i)
                    out.append((item, *values))
            return _found(batch, row, out)

        return step

    return arrow_map(documents, schema, make)


def _bits(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each hash in the bitmap."""
    mixed_ = mixed(hashes + np.uint64(width))
    return (mixed_ >> np.uint64(64 - BITMAP_BITS)).astype(np.int64), (mixed_ & np.uint64((1 << BITMAP_BITS) - 1)).astype(np.int64)


def _bitmap(sketches: DataFrame) -> np.ndarray:
    """The bitmap of (width, hash) rows: its pieces, of fixed number and size, are made by tasks."""
    import pandas as pd

    def places() -> object:
        def step(batch: pa.RecordBatch) -> list:
            width, h = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            both = np.concatenate([np.concatenate(_bits(h[width == w], int(w))) for w in np.unique(width)] or [np.empty(0, np.int64)])
            both = np.unique(both)
            return [(both >> PIECE_BITS).astype(np.int32), both]

        return step

    def piece(key, frame: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << PIECE_BITS, bool)
        bits[frame["place"].to_numpy() & ((1 << PIECE_BITS) - 1)] = True
        return pd.DataFrame({"piece": [key[0]], "bits": [np.packbits(bits).tobytes()]})

    made = arrow_map(sketches.select("width", "hash"), "piece int, place bigint", places).distinct().groupBy("piece").applyInPandas(piece, "piece int, bits binary")
    out = np.zeros((1 << (BITMAP_BITS - PIECE_BITS), 1 << (PIECE_BITS - 3)), np.uint8)
    for n, bits in made.toLocalIterator():
        out[n] = np.frombuffer(bits, np.uint8)
    return out.ravel()


def _search_many(rows: DataFrame, items: DataFrame, percent: int, schema: str, keep: tuple[str, ...]) -> DataFrame:
    """The search for item sets of any size. ``rows``: columns to keep, then the text as binary."""
    spark = rows.sparkSession
    numbered = items.select(F.monotonically_increasing_id().alias("item_no"), "item_id", F.col("text").cast("binary").alias("item_text"))
    numbered = materialize(numbered.where("item_text is not null"), "items")

    def sketch():
        hashes = WordHashes()

        def step(batch: pa.RecordBatch) -> list:
            found = [(n, min(WIDTH, len(w)), _sketch(w, percent, hashes)) for n, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (w := _words(t))]
            sizes = [len(f[2]) for f in found]
            h = np.concatenate([np.empty(0, np.uint64), *[f[2] for f in found]])
            return [np.repeat(np.array([f[0] for f in found], np.int64), sizes), np.repeat(np.array([f[1] for f in found], np.int32), sizes), h.view(np.int64)]

        return step

    sketches = materialize(arrow_map(numbered.select("item_no", "item_text"), "item_no bigint, width int, hash bigint", sketch), "sketches")
    widths = sorted(r[0] for r in sketches.select("width").distinct().collect())  # WIDTH of them at most
    bitmap = spark.sparkContext.broadcast(_bitmap(sketches))  # 2**BITMAP_BITS bits, whatever the input
    keyed = rows.select("*", F.xxhash64(*[f"`{c}`" for c in rows.columns]).alias("_key"))

    def probe():
        hashes, bits = WordHashes(), bitmap.value

        def step(batch: pa.RecordBatch) -> list:
            keys, width_of, sent = [], [], [np.empty(0, np.uint64)]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = _words(text)
                for width in widths:
                    if len(words) >= width:
                        h = np.unique(shingle_hashes(words, width, hashes))
                        one, two = _bits(h, width)
                        hit = h[(bits[one >> 3] >> (7 - (one & 7)) & 1).astype(bool) & (bits[two >> 3] >> (7 - (two & 7)) & 1).astype(bool)]
                        keys += [key] * len(hit)
                        width_of += [width] * len(hit)
                        sent.append(hit)
            return [keys, width_of, np.concatenate(sent).view(np.int64)]

        return step

    probes = arrow_map(keyed.select("_key", rows.columns[-1]), "_key bigint, width int, hash bigint", probe)
    pairs = materialize(probes.join(sketches, ["width", "hash"]).select("_key", "item_no").distinct(), "candidates")
    # items that repeat an id come together, so that the best containment of each is found in place
    group = F.pmod(F.xxhash64("item_id"), F.greatest(F.lit(1), F.ceil(F.col("n") / TOGETHER))).alias("_group")
    counts = pairs.groupBy("_key").agg(F.count("*").alias("n"))
    asked = pairs.join(counts, "_key").join(numbered, "item_no").select("_key", group, F.struct("item_id", "item_text").alias("item"))
    asked = asked.groupBy("_key", "_group").agg(F.collect_list("item").alias("_items"))
    brought = keyed.join(asked, "_key").drop("_key", "_group")

    def verify():
        def step(batch: pa.RecordBatch) -> list:
            row, out = [], []
            for i, (text, asked_for) in enumerate(zip(batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1).to_pylist())):
                words, own, best = _words(text), {}, {}
                for item in asked_for:
                    wanted = _words(item["item_text"])
                    width = min(WIDTH, len(wanted))
                    if width not in own:
                        own[width] = _shingles(words, width)
                    _note(best, item["item_id"], _shingles(wanted, width), own[width], percent)
                row += [i] * len(best)
                out += [(item, *values) for item, values in best.items()]
            return _found(batch, row, out)

        return step

    return arrow_map(brought, schema, verify)


def _note(best: dict, item, wanted: set, own: set, percent: int) -> None:
    """Keep the best containment of an item's texts in ``best``."""
    n, inside = len(wanted), len(wanted & own)
    if 100 * inside >= percent * n and inside / n > best.get(item, (0, 0, 0.0))[2]:
        best[item] = n, inside, inside / n


def _found(batch: pa.RecordBatch, row: list[int], out: list[tuple]) -> list:
    """Output columns: what is kept of the rows, then item_id, n_shingles, n_inside, containment."""
    kept = [c.take(pa.array(row, pa.int32())) for c in batch.columns[: batch.schema.get_field_index("_text")]]
    return [*kept, *(list(map(list, zip(*out))) if out else [[], [], [], []])]


def find_contained(documents: DataFrame, items: DataFrame, percent: int = PERCENT, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(the columns ``keep``, item_id, n_shingles, n_inside, containment) of every item in every document that contains it."""
    kind = items.schema["item_id"].dataType.simpleString()
    rows = documents.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("binary").alias("_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    schema = f"{kept}, item_id {kind}, n_shingles bigint, n_inside bigint, containment double"
    block = _one_block(items, percent)
    if block is not None:
        return _search(rows, block, percent, schema) if block else documents.sparkSession.createDataFrame([], schema)
    return _search_many(rows, items, percent, schema, keep)


def without_items(documents: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``documents``, with all their columns, that contain no item, by row: null and repeated ids are no matter."""
    rows = documents.select("doc_id", row_key(documents).alias("row"), "text")
    found = find_contained(rows, items, percent, ("doc_id", "row"))
    return without(documents, materialize(found.select("doc_id", "row").distinct(), "contaminated"))
