"""SentencePiece encoding and decoding by one sweep of an Aho-Corasick automaton.

The automaton holds all pieces; at each position of a text its output links name every piece that
ends there. The sweep keeps the best segmentation of each prefix. For a unigram model that is
Viterbi: the piece that gives the greatest sum of scores. A BPE model's segmentation is decided
by merges and not by such a sum; there a piece may end a prefix only if it stands beside the last
piece of the prefix before it exactly as merging would leave them, and the longest such piece is
the right one. Both relax the same positions in the same single pass.

A batch's bytes are cut as a whole where no piece holds the two characters that meet (as before a
space mark that follows another character); each distinct part is swept once and remembered per
worker, and ids and decoded bytes are gathered by index. Characters that no piece has become their
UTF-8 bytes' pieces, or the unknown piece.

Edge cases: null and empty texts give no ids and decode to the empty text; bytes that aren't
valid UTF-8 are encoded as U+FFFD; equal texts give equal ids; an empty table gives no rows.
"""

from __future__ import annotations

import operator
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.texts import PartIds, Remembered, arrow_map, process_cache, text_bytes, valid

SPACE = "▁"
#: Parts, runs inside them and pairs of pieces that a worker remembers at most.
REMEMBERED = 500_000
CACHE_RUNS = 50_000
CACHE_PAIRS = 300_000
#: Texts encoded at once.
SLICE = 1024
#: How far below the worst score an unknown character lies in a unigram model (fixed value of the format).
UNKNOWN_PENALTY = 10.0
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value, shift, at = value | (b & 127) << shift, shift + 7, at + 1
        if b < 128:
            return value, at


def _fields(data: bytes):
    """(number, value) of each field of a serialized protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            n = 4 if kind == 5 else 8
            value, at = data[at : at + n], at + n
        yield key >> 3, value


class PieceModel:
    """A model file: pieces, scores and kinds, and the automaton over the pieces."""

    def __init__(self, data: bytes, kind: int | None = None):
        """``kind``: UNIGRAM or BPE; by default what the file says."""
        import ahocorasick

        self.text, self.score, self.kind = [], [], []
        self.model, self.prefix, unknown = UNIGRAM, True, 0
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.text.append(piece[1].decode())
                self.score.append(float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]))
                self.kind.append(piece.get(3, NORMAL))
            elif number == 2:
                self.model = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                rules = dict(_fields(value))
                self.prefix = bool(rules.get(3, 1))
                if rules.get(2) or rules.get(4, 1):
                    raise ValueError("models that normalize characters or white space are not supported")
        self.model = kind or self.model
        self.unknown = self.kind.index(UNKNOWN) if UNKNOWN in self.kind else unknown
        self.id = {t: i for i, (t, k) in enumerate(zip(self.text, self.kind)) if k in (NORMAL, USER)}
        self.bytes = {int(t[1:-1], 16): i for i, (t, k) in enumerate(zip(self.text, self.kind)) if k == BYTE}
        self.value = {i: bytes([b]) for b, i in self.bytes.items()}
        self.letters = {c for t in self.id for c in t}
        self.automaton = ahocorasick.Automaton()
        for t, i in self.id.items():
            self.automaton.add_word(t, (len(t), i))
        self.automaton.make_automaton()
        if any(SPACE in t.lstrip(SPACE) or "\n" in t and t != "\n" for t in self.id):
            raise ValueError("pieces with a space mark or a line feed inside are not supported")
        self.segment = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
        self.inside = {t[i : i + 2] for t in self.id for i in range(len(t) - 1)}
        self.least = min((self.score[i] for i in self.id.values()), default=0.0) - UNKNOWN_PENALTY
        # pairs of bytes between which a text is cut: those of ASCII characters (the space as a mark) that no piece holds
        self.cuts = np.zeros((256, 256), bool)
        self.cuts[:128, :128] = True
        for x, y in (pair.replace(SPACE, " ").encode() for pair in self.inside if pair.replace(SPACE, " ").isascii()):
            self.cuts[x, y] = False
        self.cuts[128:, ord(" ")] = self.cuts[128:, ord("\n")] = self.cuts[ord("\n"), 128:] = True
        self.runs = Remembered(self._run_ids, CACHE_RUNS)
        self.part_ids = PartIds(self._learn, REMEMBERED)
        self.beside: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        raw = [self.value.get(i, b"" if k == CONTROL else t.replace(SPACE, " ").encode()) for i, (t, k) in enumerate(zip(self.text, self.kind))]
        self.raw, self.raw_size = np.frombuffer(b"".join(raw), np.uint8), np.array([len(x) for x in raw], np.int32)
        self.raw_start = np.cumsum(self.raw_size, dtype=np.int32) - self.raw_size

    def _merge(self, text: str, keep_last: bool = False) -> list[str]:
        """Pieces that merging leaves of a short text: always the neighbours of best score, leftmost first.

        ``keep_last`` stops before the merge that would leave one piece.
        """
        parts = list(text)
        while len(parts) > 1 + keep_last:
            joined = [self.id.get(a + b) for a, b in zip(parts, parts[1:])]
            best = max((i for i in joined if i is not None), key=self.score.__getitem__, default=None)
            if best is None:
                break
            i = joined.index(best)
            parts[i : i + 2] = [self.text[best]]
        return parts

    def _halves(self, i: int) -> tuple[int, int] | None:
        """The two pieces whose merge makes a piece; () for a single character, None if merging never makes it."""
        found = self.halves.get(i, False)
        if found is False:
            parts = self._merge(self.text[i], keep_last=True)
            if len(self.text[i]) == 1:
                found = ()
            elif len(parts) == 2 and all(p in self.id and self._halves(self.id[p]) is not None for p in parts):
                found = self.id[parts[0]], self.id[parts[1]]
            else:
                found = None
            self.halves[i] = found
        return found

    def _spine(self, i: int, side: int) -> list[int]:
        """The pieces at one edge of a piece, from its outermost character to itself."""
        out = [i]
        while half := self._halves(out[-1]):
            out.append(half[side])
        return out[::-1]

    def _stays(self, left: int, right: int) -> bool:
        """Whether merging the joined text of two pieces leaves just these two.

        The pieces that meet at the border grow along the left piece's right edge and the right
        piece's left edge, by falling scores. They must never merge with each other: not as soon as
        both are there and their union's turn comes, which is before either grows on. Of equal
        scores the leftmost comes first.
        """
        if self._halves(right) is None or self._halves(left) is None:
            return False
        a, b, i, j = self._spine(left, 1), self._spine(right, 0), 0, 0
        score, last = self.score, -np.inf
        while True:
            up_a = score[a[i + 1]] if i + 1 < len(a) else last
            up_b = score[b[j + 1]] if j + 1 < len(b) else last
            union = self.id.get(self.text[a[i]] + self.text[b[j]])
            if union is not None:
                turn = min(score[union], score[a[i]] if i else np.inf, score[b[j]] if j else np.inf)
                if turn > up_a and turn >= up_b:
                    return False
            if up_a == up_b == last:
                return True
            if up_a >= up_b:
                i += 1
            else:
                j += 1

    def _sweep(self, text: str) -> list[int]:
        """Ids of a text all of whose characters are pieces."""
        n = len(text)
        last: list[tuple[int, int] | None] = [None] * (n + 1)  # length and id of the piece that ends a prefix
        if self.model == BPE:
            beside = self.beside
            if len(beside) >= CACHE_PAIRS:
                beside.clear()
            for at, found in self.automaton.iter(text):  # of the pieces that end here, the longest first
                start = at + 1 - found[0]
                if last[at + 1] is not None or start and last[start] is None:
                    continue
                key = (last[start][1] + 1 if start else 0) << 32 | found[1]
                good = beside.get(key)
                if good is None:
                    good = beside[key] = self._stays(last[start][1], found[1]) if start else self._halves(found[1]) is not None
                if good:
                    last[at + 1] = found
        else:
            best, ready = [0.0] + [-np.inf] * n, 0

            def unknowns(end: int) -> None:
                nonlocal ready
                while ready < end:  # a character that is no piece by itself may always stand for one
                    if text[ready] not in self.id and best[ready] + self.least > best[ready + 1]:
                        best[ready + 1], last[ready + 1] = best[ready] + self.least, (1, -1)
                    ready += 1

            for at, found in self.automaton.iter(text):
                unknowns(at)
                start = at + 1 - found[0]
                score = best[start] + self.score[found[1]]
                if score > best[at + 1]:
                    best[at + 1], last[at + 1] = score, found
            unknowns(n)
        ids = []
        while n:
            size, i = last[n]
            ids += [i] if i >= 0 else self._unknown(text[n - 1])[::-1]
            n -= size
        return ids[::-1]

    def _unknown(self, character: str) -> list[int]:
        return [self.bytes[b] for b in character.encode()] if len(self.bytes) == 256 else [self.unknown]

    def _run_ids(self, run: str) -> bytes:
        known = run in self.id or self.letters.issuperset(run)
        return np.array(self._sweep(run) if known else self._unknown(run), "<i4").tobytes()

    def _segment_ids(self, segment: str) -> bytes:
        """Ids of a segment as bytes: it is cut where no piece holds the two characters that meet."""
        cuts = [i for i, pair in enumerate(map(operator.add, segment, segment[1:]), 1) if pair not in self.inside]
        return b"".join([self.runs[segment[a:b]] for a, b in zip([0, *cuts], [*cuts, len(segment)])])

    def encode(self, text: str) -> np.ndarray:
        """Ids (int32) of one text."""
        if not text:
            return np.empty(0, np.int32)
        marked = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        ids = np.frombuffer(b"".join(map(self._segment_ids, self.segment.findall(marked))), np.int32)
        return self._once(ids, np.array([0, len(ids)]))[0]

    def _once(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Without byte pieces, a run of unknown characters of a text is one unknown piece."""
        if len(self.bytes) == 256 or not len(ids):
            return ids, ends
        again = np.r_[False, (ids[1:] == self.unknown) & (ids[:-1] == self.unknown)]
        again[ends[:-1][ends[:-1] < len(ids)]] = False
        return ids[~again], ends - np.concatenate([[0], np.cumsum(again)])[ends]

    def _learn(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        # parts of ASCII characters are cut already, and new: nothing to look up
        found = [self._run_ids(p.decode().replace(" ", SPACE)) if p.isascii() else self._segment_ids(p.decode().replace(" ", SPACE)) for p in parts]
        return np.arange(len(parts)), np.frombuffer(b"".join(found), np.uint32), np.array([len(x) // 4 for x in found], np.int32)

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (int32) of a string array, one text after the other, and where each text's ids begin (one number more)."""
        texts = texts.fill_null("")
        marked = pc.match_substring(texts, SPACE).to_numpy(zero_copy_only=False)  # the mark itself: no byte for it
        own = [self.encode(t) for t in texts.filter(pa.array(marked)).to_pylist()] if marked.any() else []
        plain = pc.if_else(pa.array(marked), "", texts) if own else texts
        if self.prefix:
            plain = pc.if_else(pc.equal(plain, ""), "", pc.binary_join_element_wise(" ", plain, ""))
        b, edges = text_bytes(plain)
        begins = np.empty(len(b), bool)
        begins[:1] = True
        begins[1:] = self.cuts[b[:-1], b[1:]]
        begins[edges[:-1][edges[:-1] < len(b)]] = True
        first = np.flatnonzero(begins)
        parts = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(np.append(first, len(b)).astype(np.int32)), pa.py_buffer(b)])
        ids, ends = self.part_ids(parts)
        ids, ends = self._once(ids.view(np.int32), ends[np.searchsorted(first, edges)])
        if not own:
            return ids, ends
        found = [ids[x:y] for x, y in zip(ends, ends[1:])]
        for i, x in zip(np.flatnonzero(marked), own):
            found[i] = x
        return np.concatenate(found), np.concatenate([[0], np.cumsum([len(x) for x in found])])

    def decode_batch(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts of ids, one text after the other; ``ends`` says where each begins (one number more)."""
        n = self.raw_size[ids]
        so_far = np.concatenate([np.zeros(1, np.int64), np.cumsum(n, dtype=np.int64)])
        index = np.arange(so_far[-1], dtype=np.int32 if so_far[-1] < 1 << 31 else np.int64)
        index += np.repeat((self.raw_start[ids] - so_far[:-1]).astype(index.dtype), n)
        b, edges = self.raw[index], so_far[ends]
        texts = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(b)])
        try:
            texts = texts.cast(pa.string())
        except pa.ArrowInvalid:  # ids that no text gives
            texts = pa.array([x.decode(errors="replace") for x in texts.to_pylist()], pa.string())
        return pc.replace_substring_regex(texts, "^ ", "", max_replacements=1) if self.prefix else texts


def model(path: str, data: bytes, kind: int | None = None) -> PieceModel:
    """The model of a worker, read once."""
    kept = process_cache()
    key = path, len(data), zlib.crc32(data), kind
    if key not in kept:
        kept[key] = PieceModel(data, kind)
    return kept[key]


def _shared_model(df: DataFrame, path: str):
    with open(path, "rb") as f:  # the driver's file; tasks get its bytes
        return df.sparkSession.sparkContext.broadcast(f.read())


def _lists(ids: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(ids, pa.int32()))


def encode(documents: DataFrame, model_path: str, kind: int | None = None) -> DataFrame:
    """(doc_id, ids array<int>) for each row of ``documents``. With ``kind`` UNIGRAM the pieces' scores are summed
    by Viterbi, whatever the file says."""
    shared = _shared_model(documents, model_path)

    def make():
        m = model(model_path, shared.value, kind)
        return lambda batch: [batch.column(0), _lists(*m.encode_batch(batch.column(1)))]

    return arrow_map(documents.select("doc_id", valid("text")), "doc_id bigint, ids array<int>", make, SLICE)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids, text) from (doc_id, ids). Null ids are none; ids that the model lacks are an error."""
    shared = _shared_model(encoded, model_path)

    def make():
        m = model(model_path, shared.value)

        def step(batch: pa.RecordBatch) -> list:
            sizes = pc.list_value_length(batch.column(1)).fill_null(0).to_numpy()
            ids = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int32)
            return [batch.column(0), batch.column(1), m.decode_batch(ids, np.concatenate([[0], np.cumsum(sizes)]))]

        return step

    return arrow_map(encoded.select("doc_id", "ids"), "doc_id bigint, ids array<int>, text string", make, SLICE)


def round_trip(documents: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids, text): ``encode`` and ``decode`` in one pass, with one automaton a worker."""
    shared = _shared_model(documents, model_path)

    def make():
        m = model(model_path, shared.value)

        def step(batch: pa.RecordBatch) -> list:
            ids, ends = m.encode_batch(batch.column(1))
            return [batch.column(0), _lists(ids, ends), m.decode_batch(ids, ends)]

        return step

    return arrow_map(documents.select("doc_id", valid("text")), "doc_id bigint, ids array<int>, text string", make, SLICE)
