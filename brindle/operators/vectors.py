"""Exact vector search and the IVF index over array columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from brindle.operators import blocks
from brindle.session import materialize

#: Queries (about) whose vectors go to every task at once; more are searched in blocks of this size.
QUERY_BLOCK = 16_000
#: Queries that meet a batch in one product.
ASKED = 2048
#: Queries times results from which on some rows are scored first, so that only what can be among the best of all leaves a task.
SEEDED = 100_000
#: Rows of which one is scored first.
SEED_SHARE = 16


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double; 0 if a vector has norm 0, null if one is null."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def normalized(a: Column | str) -> Column:
    """The vector at length 1; a zero vector stays as it is. The norm is bound once for all elements."""
    a = F.col(a) if isinstance(a, str) else a
    once = F.array(F.struct(a.alias("v"), norm(a).alias("n")))
    return F.element_at(F.transform(once, lambda s: F.transform(s["v"], lambda x: F.when(s["n"] == 0, x.cast("double")).otherwise(x.cast("double") / s["n"]))), 1)


def rounded(x: Column, places: int) -> Column:
    """``round`` that keeps the sign of what becomes zero: -0.000001 gives -0.0."""
    r = F.round(x, places)
    return F.when(r == 0, x * 0.0).otherwise(r)


def search(chunks: DataFrame, queries: DataFrame, k: int | None, threshold: float = 0.7, strict: bool = False, tie_breaks: tuple[str, ...] = (), exclude_self: bool = False, written: bool = False) -> DataFrame:
    """Best ``k`` chunks (id, embedding) of each query (query_id, query_embedding), as (query_id, id, score, rank).

    The queries are a stated set, taken in blocks of bounded size; every batch of chunks is multiplied with the block's
    matrix in single precision, what can be among the best is then scored exactly, and rows move only if they can be among the best k of those that their task has seen.
    Of many queries a share of the chunks is scored first: what k of these reach is the least that others must score to leave their task. A vector of norm 0 has cosine 0; null vectors and
    those of another length than the query's are not found.
    Of equal scores the columns ``tie_breaks`` (descending) and then the least id decide. ``written``: the chunks are a written table, so reading them again costs little.
    """
    if queries.limit(QUERY_BLOCK + 1).count() > QUERY_BLOCK:
        return search_blocks(chunks, queries, k, QUERY_BLOCK, threshold, strict, tie_breaks, exclude_self, written)
    return _search(chunks, [queries], k, threshold, strict, tie_breaks, exclude_self, written)


def _matrix(lists: pa.Array) -> np.ndarray:
    """Rows of doubles from vectors of one length."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _search(chunks: DataFrame, parts: list[DataFrame], k: int | None, threshold: float, strict: bool, tie_breaks: tuple[str, ...], exclude_self: bool, written: bool) -> DataFrame:
    """Blocks of queries: products with every batch of chunks, of which each keeps what can be among the best ``k``."""
    context = chunks.sparkSession.sparkContext
    rows = chunks.where("size(embedding) > 0").select("embedding", "id", *tie_breaks)
    out = chunks.select("id", *tie_breaks).schema
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out)
    query_type = parts[0].schema["query_id"]
    schema = f"query_id {query_type.dataType.simpleString()}, {kinds}, score double"
    arrow = to_arrow_schema(StructType([query_type, *out, StructField("score", DoubleType())]))
    most = None if k is None else k + exclude_self

    def asked(queries: DataFrame):
        mine = queries.select("query_id", "query_embedding").where("query_embedding is not null").toArrow()
        vector = mine["query_embedding"].combine_chunks()
        lengths = vector.value_lengths().to_numpy()
        # queries by their number of components: only vectors of as many have a cosine with them
        units = {int(n): (np.flatnonzero(lengths == n), _unit(_matrix(vector.filter(pa.array(lengths == n))))) for n in np.unique(lengths) if n}
        return context.broadcast((mine["query_id"].combine_chunks(), units)), len(lengths)

    def scored(rows: DataFrame, shared, floors, b: int | None) -> DataFrame:
        """What can be among the best of a block's queries; with ``b``, the best scores alone, as (block, query, scores)."""

        def run(batches):
            names, units = shared.value
            best = None if most is None else blocks.Best(most, len(names), 2e-6, floor=None if floors is None else floors.value)
            groups = {n: [(at[a : a + ASKED], exact[a : a + ASKED], exact[a : a + ASKED].T.astype(np.float32)) for a in range(0, len(at), ASKED)] for n, (at, exact) in units.items()}
            for batch in batches:
                sizes = batch.column(0).value_lengths().to_numpy()
                for n in units:
                    found = np.flatnonzero(sizes == n)
                    error = 1e-6 + (n + 4) * 1.2e-7
                    for a, z in blocks.slices(len(found), min(ASKED, len(units[n][0]))):
                        part = batch.take(pa.array(found[a:z]))
                        mine = _unit(_matrix(part.column(0)))
                        near = mine.astype(np.float32)
                        for at, exact, single in groups[n]:
                            least = np.full(len(at), threshold - 1e-6) if best is None else np.maximum(best.least(at), threshold - 1e-6)
                            row, query = blocks.passing(near @ single, blocks.under(least - error), most, error + 2e-6)
                            for c, d in blocks.slices(len(row), n):
                                r, q = row[c:d], query[c:d]
                                score = np.einsum("ij,ij->i", mine[r], exact[q])
                                go = score >= threshold - 1e-6
                                if best is not None:
                                    go[go] = best.kept(score[go], at[q[go]])
                                if b is None and go.any():
                                    yield pa.RecordBatch.from_arrays([names.take(pa.array(at[q[go]])), *blocks.taken(part.columns[1:], r[go]), pa.array(score[go])], schema=arrow)
            if b is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), b, np.int32)), pa.array(np.arange(len(names), dtype=np.int32)), pa.array(list(best.held), pa.list_(pa.float64()))], names=["block", "query", "scores"])

        return rows.mapInArrow(run, schema if b is None else "block int, query int, scores array<double>")

    blocks_ = [asked(q) for q in parts]
    floors = [None] * len(blocks_)
    if k is not None and sum(n for _, n in blocks_) * k >= SEEDED:
        if not written:  # what makes the vectors runs once
            rows = materialize(rows, "vectors")
        n_rows = rows.count()
        if n_rows >= SEED_SHARE * k:
            seeds = materialize(rows.where(F.pmod(F.xxhash64("id"), F.lit(SEED_SHARE)) == 0).repartition(blocks.tasks(n_rows // SEED_SHARE, len(blocks_), context.defaultParallelism)), "seeds")
            heads = reduce(DataFrame.unionByName, [scored(seeds, shared, None, b) for b, (shared, _) in enumerate(blocks_)])
            heads = heads.groupBy("block", "query").agg(F.get(F.sort_array(F.flatten(F.collect_list("scores")), False), F.lit(most - 1)).alias("least")).toArrow()  # a row a query
            block, query, least = (heads[c].to_numpy() for c in ("block", "query", "least"))
            for b, (_, n) in enumerate(blocks_):
                floor = np.full(n, -np.inf)
                floor[query[block == b]] = least[block == b]
                floors[b] = context.broadcast(floor)
    found = reduce(DataFrame.unionByName, [scored(rows, shared, floors[b], None) for b, (shared, _) in enumerate(blocks_)])
    pairs = found.withColumn("score", F.round("score", 6))
    pairs = pairs.where(F.col("score") > threshold if strict else F.col("score") >= threshold)
    if exclude_self:
        pairs = pairs.where(F.col("id") != F.col("query_id"))
    ranked = pairs.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), *map(F.desc, tie_breaks), "id")))
    return (ranked if k is None else ranked.where(F.col("rank") <= k)).select("query_id", "id", "score", "rank")


def search_blocks(
    chunks: DataFrame, queries: DataFrame, k: int | None, block: int = QUERY_BLOCK, threshold: float = 0.7, strict: bool = False, tie_breaks: tuple[str, ...] = (), exclude_self: bool = False, written: bool = False
) -> DataFrame:
    """``search`` for any number of queries: as many scans of the chunks as there are blocks of about ``block`` queries."""
    queries = materialize(queries.select("query_id", "query_embedding"), "queries")
    n = max(1, -(-queries.count() // block))
    if n > 1 and not written:  # each block reads the vectors; what makes them runs once
        chunks, written = materialize(chunks.select("id", "embedding", *tie_breaks), "vectors"), True
    return _search(chunks, [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b) for b in range(n)], k, threshold, strict, tie_breaks, exclude_self, written)


def with_filters(chunks: DataFrame, study_id: str | None = None, document_types: list[str] | None = None) -> DataFrame:
    """Both filters where given; they reach the scan."""
    if study_id is not None:
        chunks = chunks.where(F.col("study_id") == study_id)
    return chunks.where(F.col("document_type").isin(document_types)) if document_types else chunks


def ivf_index(chunks: DataFrame, n_lists: int = 32, sample: int = 20_000, seed: int = 42):
    """(chunks with ``list_id``, centroids): an inverted file over k-means lists.

    k-means is fitted on at most ``sample`` rows of least hash; every row is put into a list.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = chunks.withColumn("_unit", array_to_vector(normalized("embedding")))
    model = KMeans(k=n_lists, seed=seed, featuresCol="_unit", predictionCol="list_id").fit(rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("_unit"))
    centroids = chunks.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "list_id int, centroid array<double>")
    return model.transform(rows).drop("_unit"), centroids


def ivf_search(indexed: DataFrame, centroids: DataFrame, queries: DataFrame, k: int, probes: int = 8) -> DataFrame:
    """Approximate ``search`` over the ``probes`` nearest lists of each query, which are taken in blocks: a batch's rows of a list meet the queries that probe it in one product."""
    near = queries.crossJoin(F.broadcast(centroids)).withColumn("_n", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(cosine(F.col("query_embedding"), F.col("centroid"))), "list_id")))
    near = near.where(F.col("_n") <= probes).groupBy("query_id").agg(F.first("query_embedding").alias("query_embedding"), F.collect_list("list_id").alias("lists"))
    near = materialize(near, "probes")
    n = max(1, -(-near.count() // QUERY_BLOCK))
    if n > 1:
        indexed = materialize(indexed.select("list_id", "embedding", "id"), "lists")
    out = None
    for b in range(n):
        part = _ivf_block(indexed, near.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b), k)
        out = part if out is None else out.unionByName(part)
    return out.withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def _ivf_block(indexed: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score) of what can be among the best ``k`` of a block of queries (query_id, query_embedding, lists)."""
    kinds = {c: f.schema[c] for c, f in (("query_id", near), ("id", indexed))}
    asked = near.where("query_embedding is not null").toArrow()
    vector, names = asked["query_embedding"].combine_chunks(), asked["query_id"].combine_chunks()
    lengths = vector.value_lengths().to_numpy()
    probed = asked["lists"].combine_chunks()
    owner, lists = np.repeat(np.arange(len(probed)), probed.value_lengths().to_numpy()), probed.flatten().to_numpy()
    groups = {(int(c), int(n)): owner[(lists == c) & (lengths[owner] == n)] for c in np.unique(lists) for n in np.unique(lengths) if n}
    units = {int(n): _unit(_matrix(vector.filter(pa.array(lengths == n)))) for n in np.unique(lengths) if n}
    place = {int(n): np.cumsum(lengths == n) - 1 for n in units}
    arrow = to_arrow_schema(StructType([kinds["query_id"], kinds["id"], StructField("score", DoubleType())]))

    def run(batches):
        best = blocks.Best(k, len(lengths), 2e-6)
        for batch in batches:
            sizes, mine = batch.column(1).value_lengths().to_numpy(), batch.column(0).to_numpy()
            for (c, n), at in groups.items():
                rows = np.flatnonzero((sizes == n) & (mine == c)) if len(at) else []
                for a, b in blocks.slices(len(rows), len(at)):
                    part = batch.take(pa.array(rows[a:b]))
                    row, query = best.rows(scores := _unit(_matrix(part.column(1))) @ units[n][place[n][at]].T, at)
                    if len(row):
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(at[query])), part.column(2).take(pa.array(row)), pa.array(scores[row, query])], schema=arrow)

    types = {c: f.dataType.simpleString() for c, f in kinds.items()}
    return indexed.where("size(embedding) > 0").select("list_id", "embedding", "id").mapInArrow(run, f"query_id {types['query_id']}, id {types['id']}, score double")


def hashed_words(texts, dimension: int = 64) -> list[list[float]]:
    """A deterministic stand-in for a model: signed counts of hashed words, at length 1."""
    import zlib

    import numpy as np

    out = []
    for t in texts:
        h = np.array([zlib.crc32(w.encode()) for w in (t or "").lower().split()], np.int64)
        v = np.bincount(h % dimension, np.where(h >> 31, -1.0, 1.0), dimension).astype(float)
        n = np.sqrt(v @ v)
        out.append((v / n if n else v).tolist())
    return out


def embed(rows: DataFrame, text: str, provider: Callable | None = None, dimension: int = 64, name: str = "embedding") -> DataFrame:
    """``rows`` with a vector of ``text``, made in Arrow batches.

    ``provider`` is a function from a pandas Series of texts to a list of vectors: the seam for a
    model. Without one the hashed stand-in is used.
    """

    @F.pandas_udf("array<double>")
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series([list(map(float, v)) for v in (hashed_words(batch, dimension) if provider is None else provider(batch))], dtype=object)

    return rows.withColumn(name, run(text))


def embed_missing(texts: DataFrame, cache: DataFrame, text: str, provider: Callable | None = None, dimension: int = 64) -> DataFrame:
    """Vectors of texts: those of the cache (content_hash, embedding) by hash, computed once for each distinct miss."""
    from brindle.functions.text import sha256

    keyed = texts.withColumn("content_hash", sha256(text))
    missing = keyed.join(cache, "content_hash", "left_anti").dropDuplicates(["content_hash"]).select("content_hash", text)
    known = cache.select("content_hash", "embedding").unionByName(embed(missing, text, provider, dimension).select("content_hash", "embedding"))
    return keyed.join(known, "content_hash")
