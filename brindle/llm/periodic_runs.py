"""Runs: stretches of consecutive words that repeat with a small period, and the text without the repeats.

A run is a stretch of words with smallest period q (words q apart are identical) and at least
``max(least, exponent * q)`` words that no neighbouring word extends keeping the period.

All texts of a slice are laid behind each other as word numbers. For every period q a grid of
points ``exponent - 1`` periods apart is laid over each text: the places whose word equals the one q
later are a stretch of ``(exponent - 1) * q`` or more in any run of that period, so a grid point lies in it. There are about
``n * ln(n) / (exponent - 1)`` pairs of a period and a grid point. How far the text agrees with
itself q words later is found for all pairs at once, forwards and backwards, by binary search over
prefix hashes; the ends found are then verified word by word, and runs that several grid points or multiples
of their period have found are kept once, with the smallest period.

Null and empty texts have no words and no runs; rows are handled one by one, so repeated ids and
ties are no matter. Words are compared as bytes, so text that isn't valid UTF-8 is no matter either.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.texts import arrow_map, fresh_name

#: Pairs of a period and a grid point that are searched at once, so that memory follows this and not the text.
PAIRS = 1 << 18
#: Bytes of text that a task lays out at once (at least one text).
BYTES = 4 << 20
_PRIME, _BASE = np.uint64((1 << 31) - 1), np.uint64(1_304_159_827)

RUN = "struct<start: bigint, length: bigint, period: bigint>"

#: From the rows' doc_ids and numbers of words: per row None or the original place of each word that it shall have.
Order = Callable[[list, list[int]], list["np.ndarray | None"]]


class _Prefixes:
    """Prefix hashes of a word sequence: whether two stretches of equal length may be equal, for many pairs at once.

    Equal stretches always have equal hashes.
    """

    def __init__(self, words: np.ndarray):
        powers = np.ones(1, np.uint64)
        step = _BASE
        while len(powers) <= len(words):
            powers = np.concatenate([powers, powers * step % _PRIME])
            step = step * step % _PRIME
        self.powers = powers
        value = (words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(34)
        sums = np.cumsum(value * powers[: len(words)] % _PRIME)  # below 2^63 for 2^32 words
        self.sums = np.concatenate([np.zeros(1, np.uint64), sums]) % _PRIME

    def same(self, at: np.ndarray, later: np.ndarray, length: np.ndarray) -> np.ndarray:
        a = self.sums[at + length] + _PRIME - self.sums[at]
        b = self.sums[later + length] + _PRIME - self.sums[later]
        return a % _PRIME * self.powers[later - at] % _PRIME == b % _PRIME


def _agreement(prefixes: _Prefixes, at: np.ndarray, period: np.ndarray, most: np.ndarray, forwards: bool) -> np.ndarray:
    """For each pair, the longest length up to ``most`` on which the text and the text a period later agree,
    from ``at`` on or up to ``at`` (binary search for all at once)."""
    low, high = np.zeros_like(most), most.copy()
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        middle = (low[open_] + high[open_] + 1) >> 1
        start = at[open_] if forwards else at[open_] - middle
        same = prefixes.same(start, start + period[open_], middle)
        low[open_] = np.where(same, middle, low[open_])
        high[open_] = np.where(same, high[open_], middle - 1)


def _ranges(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts 2, 0, 3: the owners 0 0 2 2 2 and the numbers 0 1 0 1 2."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def _verified(words: np.ndarray, at: np.ndarray, period: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The claimed stretches low..high around ``at``, cut at words that differ from the one a period later (a collision of hashes)."""
    low, high = low.copy(), high.copy()
    sizes = high - low
    ends = np.cumsum(sizes)
    first = 0
    while first < len(at):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] - sizes[first] + PAIRS, "right")))
        owner, n = _ranges(sizes[first:last])
        place = low[first:last][owner] + n
        for i in np.flatnonzero(words[place] != words[place + period[first:last][owner]]):
            k = first + owner[i]
            if place[i] < at[k]:
                low[k] = max(low[k], place[i] + 1)
            else:
                high[k] = min(high[k], place[i])
        first = last
    return low, high


def runs_of(words: np.ndarray, starts: np.ndarray, least: int = 6, exponent: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, length, period) of all runs in texts laid behind each other: word numbers and where each text begins (one number more)."""
    sizes = np.diff(starts)
    prefixes = _Prefixes(words)
    step = exponent - 1
    owner, q = _ranges(sizes // exponent)  # every text with each period that fits ``exponent`` times
    q = q + 1
    points = (sizes[owner] - q - 1) // (step * q) + 1
    ends = np.cumsum(points)
    found = [np.empty((0, 3), np.int64)]
    first = 0
    while first < len(q):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] - points[first] + PAIRS, "right")))
        pair, n = _ranges(points[first:last])
        text, period = owner[first:last][pair], q[first:last][pair]
        at = starts[text] + n * step * period
        agrees = words[at] == words[at + period]  # elsewhere the agreement has length 0
        text, period, at = text[agrees], period[agrees], at[agrees]
        high = at + _agreement(prefixes, at, period, starts[text + 1] - period - at, True)
        low = at - _agreement(prefixes, at, period, at - starts[text], False)
        long = high - low + period >= np.maximum(least, exponent * period)
        at, period, low, high = at[long], period[long], low[long], high[long]
        # of claims to one stretch, the smallest period implies the others, if its words hold
        sorted_ = np.lexsort((period, high + period, low))
        at, period, low, high = at[sorted_], period[sorted_], low[sorted_], high[sorted_]
        lead = np.ones(len(at), bool)
        lead[1:] = (low[1:] != low[:-1]) | ((high + period)[1:] != (high + period)[:-1])
        group = np.cumsum(lead) - 1
        low_, high_ = _verified(words, at[lead], period[lead], low[lead], high[lead])
        doubtful = ~lead & ((low_ != low[lead]) | (high_ != high[lead]))[group]
        more = _verified(words, at[doubtful], period[doubtful], low[doubtful], high[doubtful])
        low, high = np.concatenate([low_, more[0]]), np.concatenate([high_, more[1]])
        period = np.concatenate([period[lead], period[doubtful]])
        length = high - low + period
        long = length >= np.maximum(least, exponent * period)
        found.append(np.stack([low[long], length[long], period[long]], 1))
        if len(found) > 64:
            found = [_distinct(np.concatenate(found))]
        first = last
    runs = _distinct(np.concatenate(found))
    return runs[:, 0], runs[:, 1], runs[:, 2]


def _distinct(runs: np.ndarray) -> np.ndarray:
    """One row for each place and length: that of smallest period, sorted by place, then period."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    runs = runs[new]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _greatest(lengths: np.ndarray, periods: np.ndarray) -> int:
    """Which run has the greatest exact ratio of length to period; the first of several."""
    ratio = lengths / periods
    near = np.flatnonzero(ratio >= ratio.max() * (1 - 1e-12))
    return int(near[0]) if len(near) == 1 else int(max(near, key=lambda i: (Fraction(int(lengths[i]), int(periods[i])), -i)))


class _Finder:
    def __init__(self, least: int, exponent: int, order: Order | None):
        self.least, self.exponent, self.order = least, exponent, order

    def __call__(self, batch: pa.RecordBatch) -> list:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        out: list[list] = [[], [], [], [], []]
        first = held = 0
        for i in range(len(texts)):
            size = len(texts[i].as_buffer() or b"") if texts[i].is_valid else 0
            if i > first and held + size > BYTES:
                self._some(ids[first:i], texts[first:i], out)
                first, held = i, 0
            held += size
        self._some(ids[first:], texts[first:], out)
        return out

    def _some(self, ids: list, texts: pa.Array, out: list[list]) -> None:
        words = [(t or b"").split() for t in texts.to_pylist()]
        if self.order is not None:
            for i, places in enumerate(self.order(ids, [len(w) for w in words])):
                if places is not None:
                    words[i] = [words[i][k] for k in places.tolist()]
        sizes = np.array([len(w) for w in words], np.int64)
        starts = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        numbers = pa.array([x for w in words for x in w], pa.binary()).dictionary_encode().indices.to_numpy()
        start, length, period = runs_of(numbers, starts, self.least, self.exponent)
        repeats = np.zeros(len(numbers) + 1, np.int64)
        np.add.at(repeats, start + period, 1)
        np.add.at(repeats, start + length, -1)
        kept = np.cumsum(repeats[:-1]) == 0
        edges = np.searchsorted(start, starts)
        for i, w in enumerate(words):
            a, b = edges[i], edges[i + 1]
            s, n, p = start[a:b] - starts[i], length[a:b], period[a:b]
            runs = [{"start": x, "length": y, "period": z} for x, y, z in zip(s.tolist(), n.tolist(), p.tolist())]
            out[0].append(ids[i])
            out[1].append(len(w))
            out[2].append(runs)
            out[3].append(runs[_greatest(n, p)] if runs else None)
            out[4].append(b" ".join(w if not runs else [x for x, k in zip(w, kept[starts[i] : starts[i + 1]].tolist()) if k]))


def find_runs(documents: DataFrame, least: int = 6, exponent: int = 4, order: Order | None = None) -> DataFrame:
    """(doc_id, n_words, runs, greatest, collapsed): per row the runs of its text by start, then period, the one of
    greatest length / period (ties: smallest start, then period; null without runs), and the UTF-8 text of the words that
    remain when in every run only its first period stays, joined by blanks.

    ``exponent`` (2 at least) is how often a period fits into a run at least. ``order`` may put a text's words
    into another order first.
    """
    if exponent < 2 or least < 1:
        raise ValueError("a run holds its period twice at least")
    id_type = dict(documents.dtypes)["doc_id"]
    schema = f"doc_id {id_type}, n_words bigint, runs array<{RUN}>, greatest {RUN}, collapsed binary"
    return arrow_map(documents.select("doc_id", F.col("text").cast("binary").alias("text")), schema, lambda: _Finder(least, exponent, order))


def collapsed(documents: DataFrame, least: int = 6, exponent: int = 4) -> DataFrame:
    """``documents`` with one more column ``collapsed`` (another name if there is one): each text without the repeats of its runs."""
    name = fresh_name("collapsed", documents.columns)
    key = fresh_name("_place", documents.columns)
    numbered = documents.withColumn(key, F.struct(F.col("doc_id"), F.xxhash64(F.col("text").cast("binary"))))
    found = find_runs(documents.select(F.struct(F.col("doc_id"), F.xxhash64(F.col("text").cast("binary"))).alias("doc_id"), "text").dropDuplicates(["doc_id"]), least, exponent)
    return numbered.join(found.select(F.col("doc_id").alias("_found"), F.col("collapsed").cast("string").alias(name)), F.col("_found").eqNullSafe(numbered[key]), "left").drop("_found", key)
