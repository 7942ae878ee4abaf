"""Quality classifier: a generalised additive model with pairwise interactions.

Trees of two splits at most are boosted in turn over the features; each adds to its feature's
lookup table, one value a bin. Then the pairs of features that explain most of what is left get
tables of their own, boosted by trees that split one feature and then the other. A score is the
sum of looked-up values: one ``searchsorted`` and one gather for each feature and batch.

The features describe a text's bytes and words only. Fitting takes at most ``TRAINING_ROWS``
labelled rows (those of least hash), reduced to one vector of features each; scoring covers
every row.

Edge cases: a null text scores like an empty one; other columns of the input are never read;
rows without a label train nothing; with no label at all, or a single class, every score is the
share of 1 among them (0.5 with none); an empty table gives no rows. Equal texts score equally.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.texts import arrow_map, labelled_sample, sigmoid

TRAINING_ROWS = 6_000
BINS = 32
PAIR_BINS = 8
PAIRS = 6
ROUNDS = 150
RATE = 0.1
SMOOTH = 5.0

FEATURES = (
    "log words", "bytes a word", "distinct words", "words equal to the one before", "symbols", "bars", "upper case",
    "exclamation marks", "digits", "repeated lines", "share of the commonest word", "lines a word", "bytes beyond ASCII",
    "repeated word pairs", "sentence ends",
)
_SYMBOLS = np.frombuffer(b"#*$%&<>", np.uint8)


def features(text: bytes | None) -> list[float]:
    text = text or b""
    words = text.split()
    n, size = len(words), max(1, len(text))
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    if not n:
        return [0.0] * len(FEATURES)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x]
    letters = max(1, int(hist[65:91].sum() + hist[97:123].sum()))
    pairs = set(zip(words, words[1:]))
    return [
        np.log1p(n), size / n, len(counts) / n, sum(map(operator.eq, words, words[1:])) / n, hist[_SYMBOLS].sum() / size,
        hist[124] / size, hist[65:91].sum() / letters, hist[33] / size, hist[48:58].sum() / size, 1 - len(set(lines)) / max(1, len(lines)),
        max(counts.values()) / n, len(lines) / n, hist[128:].sum() / size, 1 - len(pairs) / max(1, n - 1), hist[46] / n,
    ]


@dataclass
class Gam:
    """Lookup tables: ``single[f][bin]`` and ``pair[(f, g)][bin of f, bin of g]``."""

    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    single: list[np.ndarray] = field(default_factory=list)
    pair: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def probability(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for f, (cuts, values) in enumerate(zip(self.cuts, self.single)):
            out += values[np.searchsorted(cuts, x[:, f], "right")]
        for (f, g), values in self.pair.items():
            out += values[np.searchsorted(self.coarse[f], x[:, f], "right"), np.searchsorted(self.coarse[g], x[:, g], "right")]
        return sigmoid(out)


def _quantile_cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _best_split(grad: np.ndarray, hess: np.ndarray) -> tuple[float, int]:
    """(gain, size of the left part) of the best cut of a row of bins; size 0: none."""
    g, h = np.cumsum(grad)[:-1], np.cumsum(hess)[:-1]
    if not len(g):
        return 0.0, 0
    gain = g**2 / (h + SMOOTH) + (grad.sum() - g) ** 2 / (hess.sum() - h + SMOOTH) - grad.sum() ** 2 / (hess.sum() + SMOOTH)
    at = int(np.argmax(gain))
    return (float(gain[at]), at + 1) if gain[at] > 1e-9 else (0.0, 0)


def _step(grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
    """One shallow tree over a row of bins: the best cut, then the better cut of its two parts."""
    edges = [0, len(grad)]
    for _ in range(2):
        found = max(((*_best_split(grad[a:b], hess[a:b]), a) for a, b in zip(edges, edges[1:])), key=lambda s: s[0])
        if not found[1]:
            break
        edges = sorted({*edges, found[2] + found[1]})
    out = np.zeros(len(grad))
    for a, b in zip(edges, edges[1:]):
        out[a:b] = grad[a:b].sum() / (hess[a:b].sum() + SMOOTH)
    return out


def _pair_step(grad: np.ndarray, hess: np.ndarray) -> tuple[np.ndarray, float]:
    """One tree over a grid: a cut along the better axis, then one along the other in each half; and its gain."""
    if _best_split(grad.sum(0), hess.sum(0))[0] > _best_split(grad.sum(1), hess.sum(1))[0]:
        out, gain = _pair_step_rows(grad.T, hess.T)
        return out.T, gain
    return _pair_step_rows(grad, hess)


def _pair_step_rows(grad: np.ndarray, hess: np.ndarray) -> tuple[np.ndarray, float]:
    out, gain = np.zeros(grad.shape), 0.0
    cut = _best_split(grad.sum(1), hess.sum(1))[1]
    for rows in (slice(0, cut), slice(cut, None)):
        g, h = grad[rows].sum(0), hess[rows].sum(0)
        side = _best_split(g, h)[1]
        for cols in (slice(0, side), slice(side, None)):
            value = g[cols].sum() / (h[cols].sum() + SMOOTH)
            out[rows, cols] = value
            gain += value * g[cols].sum()
    return out, gain


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """Cyclic boosting on the logistic loss, singles first, then the pairs of greatest gain."""
    share = float(y.mean()) if len(y) else 0.5
    if share in (0.0, 1.0) or len(y) < 2:
        return Gam(base=float(np.clip(np.log(max(share, 1e-9) / max(1 - share, 1e-9)), -35, 35)))
    n_features = x.shape[1]
    model = Gam(base=float(np.log(share / (1 - share))), cuts=[_quantile_cuts(x[:, f], BINS) for f in range(n_features)], coarse=[_quantile_cuts(x[:, f], PAIR_BINS) for f in range(n_features)])
    bins = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(model.cuts)]
    model.single = [np.zeros(len(c) + 1) for c in model.cuts]
    margin = np.full(len(y), model.base)
    for _ in range(ROUNDS):
        for f in range(n_features):
            p = sigmoid(margin)
            n = len(model.single[f])
            move = RATE * _step(np.bincount(bins[f], y - p, n), np.bincount(bins[f], p * (1 - p), n))
            model.single[f] += move
            margin += move[bins[f]]
    coarse = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(model.coarse)]
    shape = [len(c) + 1 for c in model.coarse]

    def grid(f: int, g: int):
        p, cell = sigmoid(margin), coarse[f] * shape[g] + coarse[g]
        return (np.bincount(cell, w, shape[f] * shape[g]).reshape(shape[f], shape[g]) for w in (y - p, p * (1 - p)))

    gains = {(f, g): _pair_step(*grid(f, g))[1] for f in range(n_features) for g in range(f + 1, n_features)}
    model.pair = {k: np.zeros((shape[k[0]], shape[k[1]])) for k in sorted(gains, key=gains.get, reverse=True)[:PAIRS]}
    for _ in range(ROUNDS // 3):
        for (f, g), values in model.pair.items():
            move = RATE * _pair_step(*grid(f, g))[0]
            values += move
            margin += move[coarse[f], coarse[g]]
    return model


def _vectors(df: DataFrame, columns: str) -> DataFrame:
    def make():
        return lambda batch: [*batch.columns[1:], [features(t) for t in batch.column(0).to_pylist()]]

    return arrow_map(df, f"{columns}, x array<double>", make)


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", training_rows: int = TRAINING_ROWS) -> Gam:
    """Fit on at most ``training_rows`` labelled documents; only their feature vectors reach the driver."""
    sample = labelled_sample(documents, labels, label, training_rows).select(F.col("text").cast("binary"), "label", "doc_id")
    rows = sorted(_vectors(sample, "label int, doc_id bigint").collect(), key=lambda r: (r[1], r[2]))
    x = np.array([r[2] for r in rows]).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r[0] for r in rows], float))


def score(documents: DataFrame, model: Gam, keep: list[str], name: str = "score") -> DataFrame:
    """The columns ``keep`` of ``documents`` with ``name``, the probability that the text is good."""
    kept = [c for c in keep if c.lower() != name.lower()]  # the score takes the place of a column of its name
    rows = documents.select(F.col("text").cast("binary").alias("_0"), *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(kept, 1)])

    def make():
        def step(batch: pa.RecordBatch) -> list:
            x = np.array([features(t) for t in batch.column(0).to_pylist()])
            return [*batch.columns[1:], model.probability(x)]

        return step

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*[f"`{c}`" for c in kept]).schema)
    return arrow_map(rows, f"{kinds}, `{name}` double", make)
