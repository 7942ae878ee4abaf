"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard has ``virtual_nodes`` points on a ring of 64-bit hashes. A row belongs to the arc that
its key's hash falls into, and to the shard whose point ends that arc, as long as that shard has
room; from a full shard it continues clockwise to the next point whose shard has room. With the
capacities used here - the row count divided by the shards, one more for the first of them while
there is a remainder - every shard ends exactly full, so counts differ by one at most.

Who overflows is decided by hash order inside an arc, so the assignment is a pure function of the
rows. Only counts per cell of the ring reach the driver: ``CELLS`` of them, whatever the table
holds. Cells cut the arcs finer, so that ranking rows inside a cell is many small sorts.

Edge cases: null keys hash like any other value; repeated keys share a cell and are told apart
by the tie-break columns only; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

CELL_BITS = 12
CELLS = 1 << CELL_BITS
VIRTUAL_NODES = 64


def ring_points(n_shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """(cell, shard) of each virtual node, clockwise. A point stands at the start of its cell."""
    return sorted((xxhash.xxh64_intdigest(f"shard {s} point {v}") >> (64 - CELL_BITS), s) for s in range(n_shards) for v in range(virtual_nodes))


def place(counts: dict[int, int], n_shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, first slot): which ranks of a cell go to which shard.

    In round t the rows that are left of each cell try the t-th point clockwise; a shard takes
    them in clockwise order of cells until it is full.
    """
    total, points = sum(counts.values()), ring_points(n_shards, virtual_nodes)
    room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    slot, out = [0] * n_shards, []
    starts = [p[0] for p in points]
    left = [(cell, 0, n, bisect.bisect_left(starts, cell)) for cell, n in sorted(counts.items()) if n]
    while left:
        again = []
        for cell, lo, hi, at in left:
            shard = points[at % len(points)][1]
            if take := min(room[shard], hi - lo):
                out.append((cell, lo, lo + take, shard, slot[shard]))
                room[shard] -= take
                slot[shard] += take
            if lo + take < hi:
                again.append((cell, lo + take, hi, at + 1))
        left = again
    return out


def assign(df: DataFrame, key: Column, ties: list[Column], n_shards: int, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """``df`` with ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 in each shard), in place of columns of these names.

    One shuffle of the rows given, by cell; the plan of at most CELLS + shards x points intervals
    is broadcast.
    """
    spark, kept = df.sparkSession, [F.col(f"`{c}`") for c in df.columns if c.lower() not in ("shard", "slot")]
    hashed = df.select(F.struct(*kept).alias("row"), F.xxhash64(key).alias("h"), F.struct(*ties).alias("ties")).withColumn("cell", F.shiftrightunsigned("h", 64 - CELL_BITS).cast("int"))
    counts = {r[0]: r[1] for r in hashed.groupBy("cell").count().collect()}
    plan = spark.createDataFrame(place(counts, n_shards, virtual_nodes) or [(-1, 0, 0, 0, 0)], "cell int, lo bigint, hi bigint, shard int, first bigint")
    ranked = hashed.withColumn("n", F.row_number().over(W.partitionBy("cell").orderBy("h", "ties")).cast("bigint") - 1)
    hit = (ranked["cell"] == plan["cell"]) & (ranked["n"] >= plan["lo"]) & (ranked["n"] < plan["hi"])
    return ranked.join(F.broadcast(plan), hit).select("row.*", "shard", (F.col("first") + F.col("n") - F.col("lo")).alias("slot"))
