"""Quality rules: counted rules first, then hashed n-gram logistic regression against a threshold.

Words, pairs of words and runs of three characters are hashed into three blocks of one weight vector;
a text's margin is the mean weight of its words, of its pairs and of its runs. The weights are fitted
on at most ``TRAINING_ROWS`` labelled rows, those of least hash, and no more of them than hold
``TRAINING_SHARES`` hashed shares together; each third is left out to calibrate the margin (a slope
and an offset on the log-odds scale). The verdict compares the probability with ``THRESHOLD``.

Edge cases: a null text has no words and fails the base rules, like any text of under
``MIN_WORDS`` words; without labels, or with one class only, the model keeps what passes the base
rules; bytes that aren't valid UTF-8 are read as U+FFFD; repeated rows get equal results; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from brindle.llm.texts import WordHashes, arrow_map, labelled_sample, mixed, sigmoid, valid
from brindle.session import materialize

TRAINING_ROWS = 3_000
TRAINING_SHARES = 6_000_000
HASH_BITS = 15
THRESHOLD = 0.5
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
STEPS = 120
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_SPACES = np.frombuffer(b" \t\n\v\f\r", np.uint8)


def repeated_words(words: list[bytes]) -> int:
    """Words inside 8-word windows that occur twice or more, the first occurrence included.

    Windows get exact numbers by doubling: numbers of pairs, then of pairs of pairs, then of those.
    """
    n = len(words)
    if n <= WINDOW:
        return 0
    seen: dict[bytes, int] = {}
    code = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    for step in (1, 2, 4):
        code = np.unique(code[:-step] * (n + 1) + code[step:], return_inverse=True)[1]
        if code.max() == len(code) - 1:
            return 0  # no shorter window occurs twice
    again = np.bincount(code)[code] >= 2
    edge = np.zeros(n + 1, np.int64)
    edge[: len(again)] += again
    edge[WINDOW : WINDOW + len(again)] -= again
    return int((np.cumsum(edge) > 0).sum())


def base_counts(text: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    text = text or b""
    words = text.split()
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    points = len(text) - int(hist[128:192].sum())  # bytes that don't continue a character
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), points - int(hist[_SPACES].sum()), int(hist[_SYMBOLS].sum()), len(lines) - len(set(lines)), repeated_words(words)


def hashed_terms(text: bytes, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices of a text's words, pairs of words and runs of three characters into the weight vector."""
    shift, block = np.uint64(64 - HASH_BITS), 1 << HASH_BITS
    w = hashes.of(text.split())
    pairs = mixed(w[:-1] * np.uint64(3) + w[1:])
    c = np.frombuffer(text.decode().encode("utf-32-le"), np.uint32) * np.uint32(2654435761)
    c ^= c >> np.uint32(15)
    grams = (c[:-2] * np.uint32(0x85EBCA6B) + c[1:-1] * np.uint32(0xC2B2AE35) + c[2:]) * np.uint32(2654435761) >> np.uint32(32 - HASH_BITS)
    return (w >> shift).astype(np.int64), (pairs >> shift).astype(np.int64) + block, grams.astype(np.int64) + 2 * block


@dataclass
class NgramModel:
    weights: np.ndarray
    offset: float = 35.0
    slope: float = 1.0

    def margin(self, text: bytes | None, hashes: WordHashes) -> float:
        return sum(float(self.weights[ix].mean()) for ix in hashed_terms(text or b"", hashes) if len(ix))


def _vector(text: bytes | None, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct indices of a text and the share that each has in its block."""
    at, share = [], []
    for ix in hashed_terms(text or b"", hashes):
        if len(ix):
            found, n = np.unique(ix, return_counts=True)
            at.append(found)
            share.append(n / len(ix))
    return (np.concatenate(at).astype(np.int32), np.concatenate(share).astype(np.float32)) if at else (np.empty(0, np.int32), np.empty(0, np.float32))


def _descend(index, value, row, y, scale, n_rows) -> tuple[np.ndarray, float]:
    """Logistic regression with L2 by accelerated full-batch steps on scaled features."""
    v = value * scale[index]
    w, bias, m, s = np.zeros(len(scale)), 0.0, np.zeros(len(scale)), np.zeros(len(scale))
    for t in range(1, STEPS + 1):
        p = sigmoid(np.bincount(row, v * w[index], n_rows) + bias)
        e = (p - y) / n_rows
        g = np.bincount(index, v * e[row], len(scale)) + 1e-4 * w
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
        bias -= 2.0 * e.sum()
    return w * scale, bias


def fit(vectors: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> NgramModel:
    """Weights from two thirds of the rows, calibration from the third third."""
    size = 3 << HASH_BITS
    held = np.arange(len(y)) % 3 == 2
    if len(y) < 12 or len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        return NgramModel(np.zeros(size))
    rows = np.flatnonzero(~held)
    row = np.repeat(np.arange(len(rows)), [len(vectors[i][0]) for i in rows])
    index = np.concatenate([vectors[i][0] for i in rows])
    value = np.concatenate([vectors[i][1] for i in rows]).astype(float)
    spread = np.sqrt(np.bincount(index, value**2, size) / len(rows))
    weights, _ = _descend(index, value, row, y[~held], np.where(spread > 0, 1 / (spread + 1e-3), 0), len(rows))
    margin = np.array([float((weights[vectors[i][0]] * vectors[i][1]).sum()) for i in np.flatnonzero(held)])
    slope, offset = 1.0, 0.0
    for _ in range(50):  # Newton steps, slightly damped, on a slope and an offset
        p = sigmoid(slope * margin + offset)
        h, e = p * (1 - p) + 1e-6, y[held] - p
        a = np.array([[(h * margin**2).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-3]])
        d = np.linalg.solve(a, [(e * margin).sum(), e.sum()])
        slope, offset = slope + 0.5 * d[0], offset + 0.5 * d[1]
    return NgramModel(weights, float(offset), float(slope))


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", training_rows: int = TRAINING_ROWS, training_shares: int = TRAINING_SHARES) -> NgramModel:
    """Fit on at most ``training_rows`` labelled documents; at most ``training_shares`` hashed shares of 8 bytes
    reach the driver: of the rows in order of hash, those with which the sum stays within the bound."""
    sample = labelled_sample(documents, labels, label, training_rows).select("doc_id", "label", valid("text").cast("binary").alias("text"))

    def make():
        hashes = WordHashes()

        def step(batch: pa.RecordBatch) -> list:
            found = [_vector(t, hashes) for t in batch.column(2).to_pylist()]
            return [batch.column(0), batch.column(1), [len(f[0]) for f in found], [f[0].tobytes() for f in found], [f[1].tobytes() for f in found]]

        return step

    vectors = materialize(arrow_map(sample, "doc_id bigint, label int, n int, at binary, share binary", make), "vectors")
    # at most training_rows thin rows in one place
    order = W.orderBy(F.xxhash64("doc_id"), "doc_id", "label", "part").rowsBetween(W.unboundedPreceding, 0)
    thin = vectors.select("doc_id", "label", "n", F.xxhash64("at", "share").alias("part")).withColumn("so_far", F.sum("n").over(order))
    kept = thin.where(F.col("so_far") <= training_shares).select("doc_id", "part").distinct()
    rows = vectors.withColumn("part", F.xxhash64("at", "share")).join(F.broadcast(kept), ["doc_id", "part"]).select("doc_id", "label", "at", "share").collect()
    rows = sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3]))
    return fit([(np.frombuffer(r[2], np.int32), np.frombuffer(r[3], np.float32)) for r in rows], np.array([r[1] for r in rows], float))


def apply_rules(documents: DataFrame, model: NgramModel, threshold: float = THRESHOLD) -> DataFrame:
    """Per document the base counts, ``base_failed``, ``probability`` and ``kept``."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast((model.weights, model.offset, model.slope))  # three blocks of 2**HASH_BITS weights, whatever the input

    def make():
        hashes, m = WordHashes(), NgramModel(*shared.value)

        def step(batch: pa.RecordBatch) -> list:
            texts = batch.column(1).to_pylist()
            base = np.array([base_counts(t) for t in texts], np.int64)
            failed = (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > MAX_REPEAT_PERCENT * base[:, 0])
            p = sigmoid(m.slope * np.array([m.margin(t, hashes) for t in texts]) + m.offset)
            return [batch.column(0), *base.T, failed, p, ~failed & (p >= threshold)]

        return step

    counts = ", ".join(f"{c} bigint" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    return arrow_map(documents.select("doc_id", valid("text").cast("binary")), f"doc_id bigint, {counts}, base_failed boolean, probability double, kept boolean", make)
