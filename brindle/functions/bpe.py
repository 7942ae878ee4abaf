"""Token counts by byte-pair merges over a given vocabulary of ranks, in Arrow batches.

The vocabulary is a file of lines ``base64 rank``, the smaller rank merged first; its path and the
pattern that cuts texts into pieces before merging are parameters.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(4)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece: adjacent parts of least rank merge first, the leftmost of equals, until none can.

    A heap of pairs and links between parts keep the time near the piece's length, however long it is.
    """
    if piece in ranks:
        return [ranks[piece]]
    ends = list(range(1, len(piece) + 1))  # where the part that begins here ends; 0: merged into the one before
    before = list(range(-1, len(piece) - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(at: int) -> None:
        middle = ends[at]
        if middle < len(piece):
            rank = ranks.get(piece[at : ends[middle]])
            if rank is not None:
                heapq.heappush(heap, (rank, at, ends[middle]))

    for at in range(len(piece) - 1):
        offer(at)
    while heap:
        _, at, end = heapq.heappop(heap)
        middle = ends[at]
        if not middle or middle >= len(piece) or ends[middle] != end:
            continue  # one of its parts has been merged meanwhile
        ends[at], ends[middle] = end, 0
        if end < len(piece):
            before[end] = at
        offer(at)
        if before[at] >= 0:
            offer(before[at])
    return [ranks[piece[at:end]] for at, end in enumerate(ends) if end]


def counter(path: str, pattern: str) -> Callable[[str], int]:
    """The number of tokens of a text; pieces are remembered per worker."""
    import regex

    ranks, cut = _ranks(path), regex.compile(pattern)

    @lru_cache(200_000)
    def size(piece: str) -> int:
        return len(merge(piece.encode(), ranks))

    return lambda text: sum(map(size, cut.findall(text)))


def token_count(text: Column | str, path: str, pattern: str) -> Column:
    """How many tokens a text has; 0 for null. Every executor must see the file at ``path``. Bytes that aren't valid UTF-8 count as U+FFFD."""
    made: list[Callable[[str], int]] = []

    @F.arrow_udf("int")
    def run(batch: pa.Array) -> pa.Array:
        if not made:
            made.append(counter(path, pattern))
        return pa.array([made[0](t) for t in batch.to_pylist()], pa.int32())

    return run(F.coalesce(F.make_valid_utf8(F.col(text) if isinstance(text, str) else text), F.lit("")))
