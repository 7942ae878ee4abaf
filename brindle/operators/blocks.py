"""What scoring by matrix products shares: in each Arrow batch all rows meet a block of stated queries, and the best rows of each query go on."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Scores that a task holds at once, about.
CELLS = 1 << 22


def best_rows(scores: np.ndarray, k: int | None, slack: float, most: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """(row, query) of the scores of a batch (rows x queries; -inf: no hit) that can be among the best ``k`` of their query.

    Scores are rounded and ties are broken later, so all within ``slack`` of the k-th stay, and all from ``most`` on, where scores are cut.
    """
    if k is not None and len(scores) > k:
        least = np.partition(scores, len(scores) - k, 0)[len(scores) - k]
        hit = (scores >= np.minimum(least, most) - slack) & (scores > -np.inf)
    else:
        hit = scores > -np.inf
    query, row = np.nonzero(hit.T)
    return row, query


class Best:
    """What a task has seen of the scores of each of ``queries`` so far: the k greatest, and no rows.

    A row goes on only if it can be among the best ``k`` of all rows up to it, so that of n rows about k ln(n / k) of a query
    do, instead of k of each batch. ``floor``: scores of each query that k rows are known to reach.
    """

    def __init__(self, k: int, queries: int, slack: float, most: float = np.inf, floor: np.ndarray | None = None):
        self.k, self.slack, self.most = k, slack, most
        self.held = np.full((queries, k), -np.inf)
        self.floor = np.full(queries, -np.inf) if floor is None else floor

    def least(self, of: np.ndarray) -> np.ndarray:
        """What a row must score to go on, for the queries ``of``."""
        return np.minimum(np.maximum(self.held[of, 0], self.floor[of]), self.most) - self.slack

    def kept(self, scores: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Which of ``scores`` of the queries at their places go on."""
        hit = scores >= self.least(query)
        if hit.any():
            self._keep(scores[hit], query[hit])
            hit &= scores >= self.least(query)  # of what has come together, too
        return hit

    def rows(self, scores: np.ndarray, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row, query) of scores (rows x queries; -inf: no hit) as ``best_rows`` gives them. ``of``: the places of the columns among all queries."""
        of = np.arange(scores.shape[1]) if of is None else of
        found = scores > -np.inf
        hit = found & (scores >= np.minimum(self.held[of, 0], self.most) - self.slack)
        if len(scores) > self.k and np.count_nonzero(hit) > 8 * self.k * len(of):  # as of the first rows
            least = np.maximum(np.partition(scores, len(scores) - self.k, 0)[len(scores) - self.k], self.held[of, 0])
            hit = found & (scores >= np.minimum(least, self.most) - self.slack)
        row, query = np.nonzero(hit)
        if len(row):
            self._keep(scores[row, query], of[query])
        return row, query

    def _keep(self, scores: np.ndarray, query: np.ndarray) -> None:
        at, place = np.unique(query, return_inverse=True)
        every = np.concatenate([scores, self.held[at].ravel()])
        owner = np.concatenate([place, np.repeat(np.arange(len(at)), self.k)])
        every = every[np.lexsort((-every, owner))]
        first = np.concatenate([[0], np.cumsum(np.bincount(owner))[:-1]])
        self.held[at] = every[first[:, None] + np.arange(self.k)][:, ::-1]


def passing(scores: np.ndarray, low: np.ndarray, k: int | None = None, absolute: float = 0.0, relative: float = 0.0, most: np.ndarray | float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """(row, query) of scores (rows x queries, in single precision) that reach ``low``, before their exact scores are taken.

    Where that are many, as of the first rows, all go that can't be among the best ``k`` of the batch: ``absolute`` and ``relative`` are the errors of the scores, from ``most`` on they count alike.
    """
    hit = scores >= low
    if k is not None and len(scores) > k and np.count_nonzero(hit) > 8 * k * scores.shape[1]:
        least = np.minimum(np.partition(scores, len(scores) - k, 0)[len(scores) - k].astype(np.float64), most)
        hit = scores >= np.maximum(low, under(least - np.abs(least) * 2 * relative - 2 * absolute))
    return np.divmod(np.flatnonzero(hit), scores.shape[1])


def under(x: np.ndarray) -> np.ndarray:
    """The single-precision numbers just below."""
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def tasks(rows: int, blocks: int, cores: int) -> int:
    """Into how many tasks to deal rows that meet ``blocks`` of queries: two a core, of 1,024 to 8,192 rows, as each keeps the best of all its queries."""
    return max(1, rows // 8192, min(rows // 1024, -(-2 * cores // blocks)))


def slices(rows: int, width: int) -> list[tuple[int, int]]:
    """Where to cut ``rows`` so that each part times ``width`` has at most CELLS cells."""
    step = max(1, CELLS // max(width, 1))
    return [(at, min(rows, at + step)) for at in range(0, rows, step)]


def spans(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Where to cut rows of ``sizes`` so that each part has about ``most`` in all; a row is never cut."""
    edges = np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1
    ends = [0, *edges.tolist(), len(sizes)]
    return [(a, b) for a, b in zip(ends, ends[1:]) if a < b]


def taken(columns: list[pa.Array], rows: np.ndarray) -> list[pa.Array]:
    index = pa.array(rows)
    return [c.take(index) for c in columns]
