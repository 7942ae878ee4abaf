"""Toxicity: a factorization machine over hashed terms.

Terms are words and their leading parts of five to seven letters, hashed to 64 bits. Features are
those whose document counts differ most between the two classes of the training rows, and those
that differ most among the rows with a doubtful term: a group mention that means nothing alone, but
much beside an insult. A feature's value grows with the logarithm of its count in the text. The
machine gives each a weight and a vector, and the products of vectors weigh pairs of terms - an
insult beside a group mention, or two doubtful terms together - that single weights miss.

Counts over the training rows (``TRAINING_ROWS`` at most, those of least hash) are summed by
Spark; the driver gets the chosen terms, ``TERMS`` of either kind at most, and the few that each
training row holds.

Edge cases: a null text scores like an empty one; without labels, or with a single class, every
score is the share of 1 (0.5 with none); bytes that aren't valid UTF-8 are read as U+FFFD; repeated rows score equally; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.texts import Remembered, arrow_map, labelled_sample, sigmoid, valid
from brindle.session import materialize

TRAINING_ROWS = 12_000
TERMS = 512
MIN_DOCS = 4
MIN_Z = 5.0
#: From where on a term counts as doubtful.
DOUBTFUL_Z = 3.0
FACTORS = 6
STEPS = 400
PREFIXES = (5, 6, 7)
_EDGES = ".,;:!?\"'()[]{}<>|*#$%&-_/\\"


def terms(word: str) -> list[int]:
    """Hashes of a word and of its leading parts; none for what has no letters."""
    word = word.strip(_EDGES)
    if not word:
        return []
    found = [word, *(f"^{word[:k]}" for k in PREFIXES if len(word) >= k)]
    return [xxhash.xxh3_64_intdigest(t) - (1 << 63) for t in found]


@dataclass
class Machine:
    base: float
    known: dict[int, int]
    weights: np.ndarray
    factors: np.ndarray

    def margins(self, at: np.ndarray, value: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
        linear = np.bincount(row, self.weights[at] * value, n_rows).astype(float)  # of no terms at all, bincount counts in integers
        v = self.factors[at] * value[:, None]
        for k in range(v.shape[1]):
            linear += 0.5 * (np.bincount(row, v[:, k], n_rows) ** 2 - np.bincount(row, v[:, k] ** 2, n_rows))
        return self.base + linear


class KnownTerms(Remembered):
    """word -> bytes of the 2-byte numbers of the features that it holds."""

    def __init__(self, known: dict[int, int]):
        super().__init__(lambda word: np.array([known[t] for t in terms(word) if t in known], np.uint16).tobytes())

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        got = np.frombuffer(b"".join(map(self.__getitem__, (text or "").lower().split())), np.uint16)
        at, n = np.unique(got, return_counts=True)
        return at.astype(np.int64), 1 + np.log(n)


def _flat(found: list[tuple[np.ndarray, np.ndarray]]):
    row = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
    return np.concatenate([f[0] for f in found] or [np.empty(0, np.int64)]), np.concatenate([f[1] for f in found] or [np.empty(0)]), row


def fit(at, value, row, y: np.ndarray, known: dict[int, int]) -> Machine:
    """Full-batch accelerated descent on the logistic loss with L2 on weights and vectors."""
    n, size = len(y), len(known)
    share = float(y.mean()) if n else 0.5
    base = float(np.clip(np.log(max(share, 1e-9) / max(1 - share, 1e-9)), -35, 35))
    rng = np.random.default_rng(5)
    m = Machine(base, known, np.zeros(size), rng.normal(0, 0.05, (size, FACTORS)))
    if share in (0.0, 1.0) or not n or not size:
        m.factors[:] = 0
        return m
    w_m, w_s, v_m, v_s = np.zeros(size), np.zeros(size), np.zeros((size, FACTORS)), np.zeros((size, FACTORS))
    for t in range(1, STEPS + 1):
        e = (sigmoid(m.margins(at, value, row, n)) - y) / n
        ev = e[row] * value
        gw = np.bincount(at, ev, size) + 2e-5 * m.weights
        v = m.factors[at] * value[:, None]
        gv = np.empty_like(m.factors)
        for k in range(FACTORS):
            rest = np.bincount(row, v[:, k], n)[row] - v[:, k]
            gv[:, k] = np.bincount(at, ev * rest, size)
        gv += 1e-4 * m.factors
        for x, g, a, b, rate in ((m.weights, gw, w_m, w_s, 0.05), (m.factors, gv, v_m, v_s, 0.01)):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            x -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)
        m.base -= 0.5 * e.sum()
    return m


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic", training_rows: int = TRAINING_ROWS) -> Machine:
    sample = materialize(labelled_sample(documents, labels, label, training_rows).select("doc_id", "label", valid("text").alias("text")), "sample")  # read three times

    def count(doubtful: frozenset[int] | None = None):
        """Rows of each class with a term, of those with a doubtful term if given; a null term stands for all of these rows."""

        def step(batch: pa.RecordBatch) -> list:
            pos, neg = Counter(), Counter()
            for y, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                held = {t for w in set((text or "").lower().split()) for t in terms(w)}
                if doubtful is None or not doubtful.isdisjoint(held):
                    (pos if y else neg).update(held)
                    (pos if y else neg)[None] += 1
            both = list(pos.keys() | neg.keys())
            return [both, [pos[t] for t in both], [neg[t] for t in both]]

        return step

    def chosen(make) -> list[tuple[int, float]]:
        """(term, how far it is from the rows' share of 1) of the terms that are farthest."""
        seen = arrow_map(sample, "term bigint, pos bigint, neg bigint", make).groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        seen = materialize(seen.where((F.col("pos") + F.col("neg") >= MIN_DOCS) | F.col("term").isNull()), "terms")
        whole = seen.where("term is null").first()
        if whole is None or not whole["pos"] or not whole["neg"]:
            return []
        docs, share = F.col("pos") + F.col("neg"), whole["pos"] / (whole["pos"] + whole["neg"])
        z = (F.col("pos") - docs * share) / F.sqrt(docs * share * (1 - share))
        far = seen.where(F.col("term").isNotNull() & (docs >= MIN_DOCS) & (F.abs(z) >= DOUBTFUL_Z))
        return [tuple(r) for r in far.select("term", z.alias("z")).orderBy(F.abs("z").desc(), "term").limit(4 * TERMS).collect()]

    alone = chosen(count)
    doubtful = frozenset(t for t, z in alone if z > 0)
    beside = chosen(lambda: count(doubtful)) if doubtful else []
    picked = [t for t, z in alone if abs(z) >= MIN_Z][:TERMS]
    picked += [t for t, z in beside if abs(z) >= MIN_Z and t not in set(picked)][:TERMS]
    known = {t: i for i, t in enumerate(picked)}

    def find():
        lookup = KnownTerms(known)

        def step(batch: pa.RecordBatch) -> list:
            found = [lookup.counts(t) for t in batch.column(2).to_pylist()]
            return [batch.column(0), batch.column(1), [f[0].tolist() for f in found], [f[1].tolist() for f in found]]

        return step

    rows = sorted(arrow_map(sample, "doc_id bigint, label int, at array<bigint>, value array<double>", find).collect())
    at, value, row = _flat([(np.array(r[2], np.int64), np.array(r[3])) for r in rows])
    return fit(at, value, row, np.array([r[1] for r in rows], float), known)


def score(documents: DataFrame, model: Machine, keep: list[str], name: str = "score") -> DataFrame:
    """The columns ``keep`` of ``documents`` with ``name``, the probability that the text is toxic."""
    kept = [c for c in keep if c.lower() != name.lower()]  # the score takes the place of a column of its name

    def make():
        lookup = KnownTerms(model.known)

        def step(batch: pa.RecordBatch) -> list:
            at, value, row = _flat([lookup.counts(t) for t in batch.column(0).to_pylist()])
            return [*batch.columns[1:], sigmoid(model.margins(at, value, row, batch.num_rows))]

        return step

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*[f"`{c}`" for c in kept]).schema)
    return arrow_map(documents.select(valid("text").alias("_0"), *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(kept, 1)]), f"{kinds}, `{name}` double", make)
