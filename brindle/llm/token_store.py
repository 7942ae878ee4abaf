"""Token-ID output as ORC: integer run-length encoded stripes, row indexes, Bloom filters on doc_id.

A store is a folder of ORC files, range-partitioned and sorted by doc_id. A row holds a
document's ids, their number and where they start among the ids of its file. The files are read
stripe by stripe in parallel; a filter on doc_id is pushed to the reader, which drops files,
stripes and row groups by their least and greatest doc_id and by the Bloom filters.

Nulls and edge cases: a null text counts as an empty one and has the end id alone; a null doc_id
sorts first; rows that repeat a doc_id are all kept, next to each other; an empty table gives a
store with no rows. Bytes that aren't valid UTF-8 are encoded as U+FFFD. Columns of the input other than doc_id and text are not stored.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from brindle.llm.texts import PartIds, arrow_map, process_cache, text_bytes, valid

#: Appended to each document.
END_ID = 1
ROW_INDEX_STRIDE = 1000
STRIPE_BYTES = 64 << 20
#: Texts encoded at once.
SLICE = 1024
BLOOM_FPP = 0.01
#: Parts whose ids a worker remembers at most, besides those of one batch.
REMEMBERED = 600_000
#: Bytes of lower-cased text by kind: white space, ASCII letters, ASCII digits and symbols other than the apostrophe, the rest.
_SPACE, _LETTER, _SYMBOL, _REST = 0, 1, 2, 3
_KIND = np.full(256, _REST, np.uint8)
_KIND[[*b" \t\n\v\f\r"]] = _SPACE
_KIND[ord("a") : ord("z") + 1] = _LETTER
_KIND[[c for c in range(0x21, 0x7F) if not chr(c).isalpha() and chr(c) != "'"]] = _SYMBOL
#: Parts that are one word of letters, before and after normalization.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: What a vocabulary file must say for texts to be cut into parts (fixed values of the files' format).
_CUTTABLE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pattern": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+",
    "added": "<|",
}


def _cuttable(vocabulary: str) -> bool:
    """Whether a vocabulary lower-cases, drops white space, splits words as _Encoder cuts them and marks their
    ends, and has no added token but such as begin with ``<|``; by what its file says, not by its name."""
    with open(vocabulary, encoding="utf-8") as f:
        rules = json.load(f)
    steps = (rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    return (
        rules.get("normalizer") == _CUTTABLE["normalizer"]
        and steps[0].get("type") == "Split" and steps[0].get("pattern") == {"Regex": _CUTTABLE["pattern"]}
        and steps[0].get("behavior") == "Removed" and steps[0].get("invert") is True
        and all(s.get("type") == "ByteLevel" and not s.get("add_prefix_space") and not s.get("use_regex") for s in steps[1:])
        and bool(rules["model"].get("end_of_word_suffix")) and not rules["model"].get("continuing_subword_prefix") and not rules["model"].get("dropout")
        and rules["model"].get("type") == "BPE" and all(t["content"].startswith(_CUTTABLE["added"]) for t in rules.get("added_tokens") or [])
    )


class _Encoder:
    """texts -> their ids, the library encoding each distinct part once.

    With a vocabulary that ``_cuttable`` accepts, white space never lies inside a token, nor does a
    token span an ASCII letter and an ASCII digit or symbol other than an apostrophe, and the case
    of ASCII letters doesn't matter. So a text's ids are those of the parts between such places. A
    batch's bytes are cut as a whole; Arrow looks the parts up among the remembered ones, which lie
    in one array with their ids in another, and the ids are gathered by index. Texts that may hold
    a special token or a combining mark, and all texts of other vocabularies, are encoded as they are.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary)
        self.by_part = _cuttable(vocabulary)
        tokens = self.library.get_vocab()
        self.ends = np.zeros(max(tokens.values()) + 1, bool)
        if self.by_part:
            suffix = self.library.model.end_of_word_suffix
            self.ends[[i for t, i in tokens.items() if t.endswith(suffix)]] = True
        self.part_ids = PartIds(self._learn, REMEMBERED)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(f.ids, np.uint32) for f in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _word_ids(self, words: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """(ids, sizes) of parts of letters. Joined by spaces, each is one word, whose last token has the suffix."""
        ids, sizes = [], []
        for at in range(0, len(words), 4096):
            group = words[at : at + 4096]
            found = np.concatenate(self._ids([b" ".join(group[i : i + 64]).decode() for i in range(0, len(group), 64)]))
            ids.append(found)
            sizes.append(np.diff(np.flatnonzero(self.ends[found]), prepend=-1))
        return ids, sizes

    def _learn(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        plain = np.fromiter((p.isalpha() or _LETTERS.fullmatch(p) is not None for p in parts), bool, len(parts))
        ids, sizes = self._word_ids([p for p, w in zip(parts, plain) if w])
        rest = self._ids([p.decode() for p, w in zip(parts, plain) if not w])
        order = np.argsort(~plain, kind="stable")  # words first
        return order, np.concatenate([np.empty(0, np.uint32), *ids, *rest]), np.concatenate([*sizes, [len(x) for x in rest]])

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All parts of lower-cased texts, and where each text's parts begin (one number more than texts)."""
        b, edges = text_bytes(texts)
        kind = _KIND[b]
        begins = np.empty(len(b), bool)
        begins[:1] = True
        np.equal(kind[1:] * kind[:-1], _LETTER * _SYMBOL, out=begins[1:])
        begins[1:] |= kind[:-1] == _SPACE
        begins[edges[:-1][edges[:-1] < len(b)]] = True
        inside = kind != _SPACE
        begins &= inside
        first = np.flatnonzero(begins)
        last = np.flatnonzero(inside & np.append(begins[1:] | ~inside[1:], True))
        offsets = np.concatenate([np.zeros(1, np.int32), np.cumsum(last - first + 1, dtype=np.int32)])
        parts = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(b[inside])])
        return parts, np.searchsorted(first, edges)

    def _whole(self, texts: pa.Array) -> np.ndarray:
        """Which texts the library gets as they are."""
        if not self.by_part:
            return np.ones(len(texts), bool)
        # the marks U+0300 to U+036F may join with the letter before them before that is lower-cased
        return pc.match_substring_regex(texts, r"<\||[\x{300}-\x{36f}]").to_numpy(zero_copy_only=False)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) of a string array, one text after the other, and each text's number of ids."""
        texts = texts.fill_null("")
        whole = self._whole(texts)
        own = self._ids(texts.filter(pa.array(whole)).to_pylist()) if whole.any() else []
        if whole.all():
            return np.concatenate([np.empty(0, np.uint32), *own]), np.array([len(x) for x in own], np.int64)
        parts, text_parts = self._cut(pc.ascii_lower(pc.if_else(pa.array(whole), "", texts)))
        gathered, ends = self.part_ids(parts)
        ends = ends[text_parts]
        if not own:
            return gathered, np.diff(ends)
        found = [gathered[a:b] for a, b in zip(ends, ends[1:])]
        for i, x in zip(np.flatnonzero(whole), own):
            found[i] = x
        return np.concatenate(found), np.array([len(x) for x in found], np.int64)


def _encoder(vocabulary: str) -> _Encoder:
    """The encoder of this Python worker."""
    kept = process_cache()
    if vocabulary not in kept:
        kept[vocabulary] = _Encoder(vocabulary)
    return kept[vocabulary]


def write_store(documents: DataFrame, path: str, vocabulary: str, end_id: int = END_ID) -> None:
    """Encode every text and write the store; files follow each other in ascending doc_id order."""

    def make():
        encode, start = _encoder(vocabulary), 0

        def step(batch: pa.RecordBatch) -> list:
            nonlocal start
            ids, counts = encode(batch.column(1))
            counts = counts.astype(np.int64) + 1
            ends = np.cumsum(counts)
            tokens, inner = np.full(ends[-1], end_id, np.int32), np.ones(ends[-1], bool)
            inner[ends - 1] = False
            tokens[inner] = ids
            rows = pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), pa.array(tokens))
            starts, start = start + ends - counts, start + int(ends[-1])
            return [batch.column(0), starts, counts, rows]

        return step

    ordered = documents.select("doc_id", valid("text").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.crc32(F.col("text").cast("binary")))
    rows = arrow_map(ordered, "doc_id bigint, start_in_file bigint, n_tokens bigint, tokens array<int>", make, SLICE)
    (
        rows.write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", str(BLOOM_FPP))
        .option("orc.row.index.stride", str(ROW_INDEX_STRIDE)).option("orc.stripe.size", str(STRIPE_BYTES))
        .option("compression", "snappy").mode("errorifexists").orc(path)
    )


def read_store(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, n_tokens, tokens); with ``doc_ids``, only those, found by metadata pruning."""
    rows = spark.read.orc(path).select("doc_id", "n_tokens", "tokens")
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def store_digest(spark: SparkSession, path: str) -> DataFrame:
    """Per stored document: doc_id, start among all ids of the store, n_tokens, crc32 of its ids.

    Only one row a file is summed across the store; a document's start is its file's plus the
    start in the file that its row holds.
    """
    rows = spark.read.orc(path)

    def make():
        def step(batch: pa.RecordBatch) -> list:
            tokens = batch.column(3)
            values, offsets = memoryview(tokens.values.to_numpy().astype("<u4", copy=False)).cast("B"), tokens.offsets.to_numpy()
            crcs = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(offsets, offsets[1:])]
            return [batch.column(0), batch.column(1), batch.column(2), np.diff(offsets).astype(np.int64), np.array(crcs, np.int64)]

        return step

    digest = arrow_map(rows.select("doc_id", "start_in_file", F.col("_metadata.file_name").alias("file"), "tokens"), "doc_id bigint, start_in_file bigint, file string, n_tokens bigint, ids_crc32 bigint", make)
    files = rows.select("start_in_file", "n_tokens", F.col("_metadata.file_name").alias("file")).groupBy("file").agg(F.sum("n_tokens").alias("file_tokens"), F.min("start_in_file").alias("first"))
    # part-00000-..., as Spark names them: by number, since from 100,000 files on the names' order is another; one row a file
    so_far = F.sum("file_tokens").over(W.orderBy(F.regexp_extract("file", r"^part-(\d+)", 1).cast("bigint"), "file"))
    bases = files.select("file", (so_far - F.col("file_tokens") - F.col("first")).alias("base"))
    return digest.join(bases, "file").select("doc_id", (F.col("base") + F.col("start_in_file")).alias("start"), "n_tokens", "ids_crc32")
