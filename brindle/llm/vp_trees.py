"""Nearest neighbours by cosine: vantage-point trees per shard, pruned by a relaxed triangle inequality.

Nearness is the distance of unit vectors, a metric: the greatest cosine is the smallest distance. A node of a tree holds a
vantage point and a radius; what lies within it is on the left, the rest on the right. A query at distance d of the
vantage point can have neighbours on the other side only if ``|d - radius| <= t``, t the distance of the
worst neighbour that it still needs. The search goes there only if ``|d - radius| <= factor * t``: with factor 1
nothing is lost; smaller factors prune more.

Index: equal vectors become one point with its least ids. A tree over a bounded sample of points cuts space into
regions; every point goes to its region, and regions are dealt into trees (the shards) of bounded size, each built by
one task and stored as one row. Search: every query looks first in its own region, then, with the distance
known from there, in the regions that pruning leaves. Queries go to regions in blocks of bounded size, so neither a region that
many queries ask for nor one that holds many points becomes one task's work.

Vectors that are null, zero or hold null or non-finite components, and rows without vec_id, take no part.
Shorter vectors count as if zeros followed. Equal rows are candidates of each other; a query leaves out one row, its own.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.texts import arrow_map
from brindle.session import materialize

#: Points from which regions are made (those of least hash; all points are indexed), and regions at most.
SAMPLE, REGIONS = 4096, 256
#: Points of a tree and of its leaves, about; queries of a block, about.
TREE_POINTS, LEAF_POINTS, BLOCK = 8192, 256, 1024
#: How far distances of rounded unit vectors may be off.
SLACK = 1e-7


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part, with two hashes that name the vector."""
    v = vectors.select("vec_id", "embedding").where("vec_id is not null and embedding is not null")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(finite & F.exists("embedding", lambda x: x != 0))
    return v.select("vec_id", "embedding", F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(7), "embedding").alias("k2"))


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """The vectors of an Arrow list array as rows of doubles, scaled by powers of two (which rounds nothing), zeros after short ones."""
    sizes = lists.value_lengths().to_numpy()
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == dim).all():
        out = flat.reshape(len(sizes), dim)
    else:
        out = np.zeros((len(sizes), dim))
        out[np.arange(dim) < sizes[:, None]] = flat
    top = np.frexp(np.abs(out).max(1, initial=1e-300))[1]
    return np.ldexp(out, -top[:, None])


def _units(vectors: np.ndarray) -> np.ndarray:
    return vectors / _norms(vectors)[:, None]


def _norms(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors * vectors).sum(1))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


@dataclass
class Tree:
    """Inner nodes (vantage point, radius, left, right); a child below 0 is leaf ``-1 - child``. Leaves hold places in ``order``."""

    points: np.ndarray
    radius: np.ndarray
    children: np.ndarray
    edges: np.ndarray  # where each leaf begins in order
    order: np.ndarray

    @classmethod
    def grown(cls, units: np.ndarray, leaf: int) -> Tree:
        """Halves at the median distance from the vantage point, of eight the one whose distances differ most. Points at equal distance stay together."""
        rng = np.random.default_rng(len(units))
        points, radius, children, leaves = [], [], [], []

        def grow(rows: np.ndarray) -> int:
            if len(rows) > leaf:
                tried = units[rng.choice(rows, min(8, len(rows)), replace=False)]
                spread = _distances(units[rng.choice(rows, min(256, len(rows)), replace=False)], tried).std(0)
                vantage = tried[spread.argmax()]
                d = _distances(units[rows], vantage[None])[:, 0]
                r = np.median(d)
                if (d > r).any():
                    node = len(points)
                    points.append(vantage)
                    radius.append(r)
                    children.append([0, 0])
                    children[node] = [grow(rows[d <= r]), grow(rows[d > r])]
                    return node
            leaves.append(rows)
            return -len(leaves)

        grow(np.arange(len(units)))
        dim = units.shape[1]
        return cls(np.array(points).reshape(-1, dim), np.array(radius), np.array(children, np.int64).reshape(-1, 2), np.cumsum([0, *map(len, leaves)]), np.concatenate(leaves))

    @property
    def root(self) -> int:
        return 0 if len(self.radius) else -1

    def homes(self, units: np.ndarray) -> np.ndarray:
        """The leaf on each vector's own side of every node."""
        out = np.zeros(len(units), np.int64)
        todo = [(self.root, np.arange(len(units)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -1 - node
            elif len(rows):
                left = _distances(units[rows], self.points[node][None])[:, 0] <= self.radius[node]
                todo += [(int(self.children[node, 0]), rows[left]), (int(self.children[node, 1]), rows[~left])]
        return out

    def visit(self, units: np.ndarray, reach, look) -> None:
        """Calls ``look(leaf, rows)`` for all leaves that the rows of ``units`` may not leave out, each row's own side first.
        ``reach(rows)``: how far beyond a radius these rows look now."""

        def go(node: int, rows: np.ndarray) -> None:
            if not len(rows):
                return
            if node < 0:
                look(-1 - node, rows)
                return
            beyond = _distances(units[rows], self.points[node][None])[:, 0] - self.radius[node]
            left, right = (int(c) for c in self.children[node])
            own_left = beyond <= 0
            go(left, rows[own_left])
            go(right, rows[~own_left])
            near = np.abs(beyond) <= reach(rows)
            go(right, rows[own_left & near])
            go(left, rows[~own_left & near])

        go(self.root, np.arange(len(units)))


@dataclass
class Index:
    trees: DataFrame
    regions: Tree
    dim: int
    ids: int


def _plan(points: DataFrame) -> tuple[Tree, int, int]:
    """The regions, the greatest number of components, and the number of points."""
    n, dim = points.agg(F.count("*"), F.max(F.size("embedding"))).first()
    sample = points.orderBy("k1", "k2").limit(SAMPLE).select("embedding").toArrow()["embedding"].combine_chunks()
    units = _units(_matrix(sample, dim or 1))
    leaf = max(1, math.ceil(len(units) / min(REGIONS, math.ceil(max(n, 1) / TREE_POINTS))))
    return Tree.grown(units, leaf), dim or 1, n


def _counted(column: str, counts: dict[int, int], most: int, regions: int):
    """A literal look-up: how many parts of ``most`` rows a region's rows need."""
    return F.element_at(F.array(*(F.lit(max(1, math.ceil(counts.get(r, 0) / most))) for r in range(regions))), (F.col(column) + 1).cast("int"))


def build(vectors: DataFrame, ids: int = 6) -> Index:
    """An index of all usable rows of ``vectors`` (vec_id, embedding); of equal vectors the ``ids`` least vec_ids are kept, so it answers for up to ``ids - 1`` neighbours beside a query's own row."""
    found = usable(vectors)
    least = found.withColumn("n", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("vec_id"))).where(F.col("n") <= ids)
    points = materialize(least.groupBy("k1", "k2").agg(F.first("embedding").alias("embedding"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "points")
    regions, dim, _ = _plan(points)
    kind = dict(points.dtypes)["embedding"]

    def route():
        return lambda batch: [*(batch.column(c) for c in range(4)), regions.homes(_units(_matrix(batch.column(2), dim)))]

    placed = materialize(arrow_map(points, f"k1 bigint, k2 bigint, embedding {kind}, ids array<{dict(points.dtypes)['ids'][6:-1]}>, region bigint", route), "placed")
    counts = dict(placed.groupBy("region").count().collect())
    shard = F.pmod("k2", _counted("region", counts, TREE_POINTS, len(regions.edges) - 1))
    schema = f"region bigint, shard bigint, k1 array<bigint>, k2 array<bigint>, vectors array<{kind}>, ids array<{dict(points.dtypes)['ids']}>, points binary, radius binary, children binary, edges binary"

    def grow(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        vectors = group["embedding"].combine_chunks()
        tree = Tree.grown(_units(_matrix(vectors, dim)), LEAF_POINTS)
        group = group.take(pa.array(tree.order))
        whole = lambda c: pa.ListArray.from_arrays(pa.array([0, len(group)], pa.int32()), group[c].combine_chunks())
        packed = [pa.array([x.tobytes()], pa.binary()) for x in (tree.points, tree.radius, tree.children, tree.edges)]
        columns = [group["region"].combine_chunks()[:1], group["shard"].combine_chunks()[:1], whole("k1"), whole("k2"), whole("embedding"), whole("ids"), *packed]
        return pa.table(columns, names=["region", "shard", "k1", "k2", "vectors", "ids", "points", "radius", "children", "edges"])

    trees = placed.withColumn("shard", shard.cast("bigint")).groupBy("region", "shard").applyInArrow(grow, schema)
    return Index(materialize(trees, "trees"), regions, dim, ids)


class _Best:
    """The ``k`` nearest points of each query so far: cosines, places and, for ties, least ids."""

    def __init__(self, units: np.ndarray, k: int, bound: np.ndarray):
        self.units, self.k, self.bound = units, k, bound
        self.score, self.place, self.first = np.full((len(units), k), -np.inf), np.full((len(units), k), -1), np.zeros((len(units), k), np.int64)

    def reach(self, rows: np.ndarray) -> np.ndarray:
        """Distance of the worst neighbour still needed, here or as known from elsewhere."""
        worst = np.sqrt(np.maximum(2 - 2 * np.maximum(self.score[rows, -1], -1), 0))
        return np.minimum(worst, self.bound[rows])

    def look(self, rows: np.ndarray, units: np.ndarray, places: np.ndarray, first: np.ndarray) -> None:
        score = np.concatenate([self.score[rows], self.units[rows] @ units.T], 1)
        if score.shape[1] <= self.k:
            return
        place = np.concatenate([self.place[rows], np.broadcast_to(places, (len(rows), len(places)))], 1)
        ids = np.concatenate([self.first[rows], np.broadcast_to(first, (len(rows), len(first)))], 1)
        top = np.argpartition(-score, self.k - 1, 1)[:, : self.k]
        worst = np.take_along_axis(score, top, 1).min(1)
        for i in np.flatnonzero((score >= worst[:, None]).sum(1) > self.k):  # ties: smaller ids stay
            tied = np.flatnonzero(score[i] >= worst[i])
            top[i] = tied[np.lexsort((ids[i, tied], -score[i, tied]))[: self.k]]
        at = np.argsort(-np.take_along_axis(score, top, 1), 1, kind="stable")
        top = np.take_along_axis(top, at, 1)
        self.score[rows], self.place[rows], self.first[rows] = (np.take_along_axis(x, top, 1) for x in (score, place, ids))


def _searcher(dim: int, k: int, factor: float):
    """From a row of a tree and a block of queries to the queries' nearest points there."""

    def step(batch: pa.RecordBatch) -> list:
        out: list[list] = [[], [], [], [], []]
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i] for c in batch.schema.names}
            block, lists = row["block"].values, row["vectors"].values
            vectors, asked = _matrix(lists, dim), _matrix(block.field("embedding"), dim)
            floats, ints = (lambda c: np.frombuffer(row[c].as_py(), np.float64)), (lambda c: np.frombuffer(row[c].as_py(), np.int64))
            tree = Tree(floats("points").reshape(-1, dim), floats("radius"), ints("children").reshape(-1, 2), ints("edges"), np.arange(len(vectors)))
            units, ids = _units(vectors), row["ids"].values
            first = ids.flatten().to_numpy()[np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())[:-1]])]
            best = _Best(_units(asked), k, block.field("bound").to_numpy())

            def look(leaf: int, rows: np.ndarray) -> None:
                part = slice(tree.edges[leaf], tree.edges[leaf + 1])
                best.look(rows, units[part], tree.order[part], first[part])

            tree.visit(best.units, lambda rows: factor * best.reach(rows) + SLACK, look)
            query, rank = np.nonzero(best.place >= 0)
            place = best.place[query, rank]
            a, b = asked[query], vectors[place]
            out[0] += block.field("k1").to_numpy()[query].tolist()
            out[1] += block.field("k2").to_numpy()[query].tolist()
            out[2] += ((a * b).sum(1) / (_norms(a) * _norms(b))).tolist()
            out[3] += ((row["k1"].values.to_numpy()[place] == block.field("k1").to_numpy()[query]) & (row["k2"].values.to_numpy()[place] == block.field("k2").to_numpy()[query])).tolist()
            out[4] += ids.take(pa.array(place)).to_pylist()
        return out

    return step


def _visited(index: Index, visits: DataFrame, k: int, factor: float) -> DataFrame:
    """(k1, k2, score, own, ids) from visits (region, k1, k2, embedding, bound), a written table: block by block, tree by tree."""
    counts = dict(visits.groupBy("region").count().collect())
    block = F.pmod(F.xxhash64("k2", F.lit(1)), _counted("region", counts, BLOCK, len(index.regions.edges) - 1))
    blocks = visits.groupBy("region", block.alias("_block")).agg(F.collect_list(F.struct("k1", "k2", "embedding", "bound")).alias("block"))
    met = index.trees.withColumnsRenamed({"k1": "t1", "k2": "t2"}).join(blocks, "region").select(F.col("t1").alias("k1"), F.col("t2").alias("k2"), "vectors", "ids", "points", "radius", "children", "edges", "block")
    ids, dim = dict(index.trees.dtypes)["ids"][6:-1], index.dim
    return arrow_map(met, f"k1 bigint, k2 bigint, score double, own boolean, ids {ids}", lambda: _searcher(dim, k, factor), rows=1)


def search(index: Index, queries: DataFrame, k: int = 5, factor: float = 0.2) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest rows other than the query's own, ties to smaller ids, for the usable rows of ``queries``
    (vec_id, embedding). ``factor`` 1 is exact."""
    if k >= index.ids:
        raise ValueError(f"the index keeps {index.ids} ids of equal vectors, enough for {index.ids - 1} neighbours")
    need = k + 1
    rows = materialize(usable(queries), "queries")
    kind = dict(rows.dtypes)["embedding"]
    asked = rows.groupBy("k1", "k2").agg(F.first("embedding").alias("embedding"))
    regions, dim = index.regions, index.dim

    def home():
        return lambda batch: [regions.homes(_units(_matrix(batch.column(2), dim))), *(batch.column(c) for c in range(3)), [math.inf] * batch.num_rows]

    def others():
        def step(batch: pa.RecordBatch) -> list:
            units, bound = _units(_matrix(batch.column(3), dim)), batch.column(4).to_numpy()
            own = batch.column(0).to_numpy()
            at, to = [], []

            def look(leaf: int, rows: np.ndarray) -> None:
                rows = rows[own[rows] != leaf]
                at.append(rows)
                to.append(np.full(len(rows), leaf))

            regions.visit(units, lambda r: factor * bound[r] + SLACK, look)
            at, to = (np.concatenate([np.empty(0, np.int64), *x]) for x in (at, to))
            return [to, *(batch.column(c).take(pa.array(at)) for c in range(1, 5))]

        return step

    schema = f"region bigint, k1 bigint, k2 bigint, embedding {kind}, bound double"
    at_home = materialize(arrow_map(asked.select("k1", "k2", "embedding"), schema, home), "home")
    near = materialize(_visited(index, at_home, need, factor), "near")
    bounds = near.groupBy("k1", "k2").agg(F.try_element_at(F.sort_array(F.collect_list("score"), asc=False), F.lit(need)).alias("worst"))
    bound = F.coalesce(F.sqrt(F.greatest(2 - 2 * F.col("worst"), F.lit(0.0))), F.lit(math.inf))
    known = at_home.drop("bound").join(bounds, ["k1", "k2"], "left").select("region", "k1", "k2", "embedding", bound.alias("bound"))
    beyond = materialize(arrow_map(known, schema, others), "beyond")
    found = near.unionByName(_visited(index, beyond, need, factor)).select("k1", "k2", "score", "own", F.explode("ids").alias("vec_id"))

    ranked = found.withColumn("n", F.row_number().over(Window.partitionBy("k1", "k2").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= need)
    lists = ranked.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score", "own"))).alias("near"))
    met = rows.select(F.col("vec_id").alias("query_id"), "k1", "k2").join(lists, ["k1", "k2"])
    own = F.try_element_at(F.filter("near", lambda x: x["own"] & (x["vec_id"] == F.col("query_id"))), F.lit(1))["n"]
    rest = met.withColumn("own_n", F.coalesce(own, F.lit(0))).select("query_id", F.slice(F.filter("near", lambda x: x["n"] != F.col("own_n")), 1, k).alias("near"))
    return rest.select("query_id", F.posexplode("near").alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score")
