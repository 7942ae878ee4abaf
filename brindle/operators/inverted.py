"""Stored inverted index: postings by term and region of documents, with bounds, for BM25 of the best k.

Layout below a folder: segments, each with

* ``docs``: one row a document (docno, id, hash of the content, dl, its sorted terms);
* ``blocks``: one row for each term and region of ``REGION`` documents that has it: number of postings, greatest term
  frequency, least document length - all that a bound on the block's scores needs;
* ``postings``: the same rows with the postings (offset in the region, tf, dl), which Parquet delta-codes and packs; both go by regions, and by terms within one;
* ``dead`` and ``lost``: documents of earlier segments that this one replaces or deletes, and how many of them each term loses;

and a manifest of the segments, saved by versions, that holds the collection's counts. A change writes one more
segment with the changed documents only; ``compact`` writes the living ones together, from the stored terms.

Search reads blocks first. The sum of a query's bounds in a region is what a document there can
reach at most. Regions of greatest bounds are scored first; their k-th score is a threshold, and of the
other regions only those whose bound reaches it are scored. Results equal ``lexical.bm25`` over the living documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from brindle.functions import vocabulary as V
from brindle.operators import blocks, lexical, store
from brindle.session import few, materialize

#: Documents of a region.
REGION = 1024
#: Regions of each query that are scored before there is a threshold.
SEEDS = 4
#: Queries whose scores of a region a task holds at once; more are taken in blocks, each of which reads the postings again.
ASKED = 1024
#: Rows of ids or places that are sent to every task, so that texts and terms don't move.
SENT = 1_000_000
_MANIFEST = "segment int, n_docs bigint, n_texts bigint, sum_dl bigint, dead_docs bigint, dead_texts bigint, dead_dl bigint"
#: Delta coding, of integers and of sorted terms, comes with the second version of Parquet's pages.
_PACKED = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false", "compression": "zstd", "parquet.bloom.filter.enabled#term": "true"}


def _write(df: DataFrame, path: str) -> DataFrame:
    df.write.options(**_PACKED).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _segment(path: str, number: int, table: str) -> str:
    return f"{path}/segments/{number}/{table}"


def _segments(spark: SparkSession, path: str) -> list[int]:
    return [r["segment"] for r in store.load(spark, f"{path}/manifest").select("segment").collect()]


def _read(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One table of all segments, with ``segment``."""
    numbers = _segments(spark, path)
    return reduce(DataFrame.unionByName, [spark.read.parquet(_segment(path, n, table)).withColumn("_segment", F.lit(n)) for n in numbers])


def living(spark: SparkSession, path: str) -> DataFrame:
    """(_segment, docno, id, hash, dl, terms) of the documents that no later segment replaces or deletes."""
    dead = _read(spark, path, "dead").select(F.col("segment").alias("_segment"), "docno")
    return _read(spark, path, "docs").join(few(dead, SENT), ["_segment", "docno"], "left_anti")


def _region_postings(docs: DataFrame) -> DataFrame:
    """(term, region, n, max_tf, min_dl, off, tf, dl) of documents (docno, dl, terms) in the order of docno: a region's postings are sorted once, where its documents are.

    Nothing moves. Where files are read in parts, a region that is cut has a row of a term for each of its parts: their counts add up, and their
    bounds add up to no less than that of the whole.
    """
    rows = docs.where("dl > 0").select(F.expr(f"docno div {REGION}").alias("region"), (F.col("docno") % REGION).cast("int").alias("off"), "dl", "terms")
    schema = "term string, region bigint, n int, max_tf int, min_dl int, off array<int>, tf array<int>, dl array<int>"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def packed(region: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(parts).combine_chunks()
        off, dl = whole["off"].to_numpy(), whole["dl"].to_numpy()
        row, term, tf = lexical.counted(whole["terms"].combine_chunks())
        coded = term.dictionary_encode()
        order = np.lexsort((off[row], coded.indices.to_numpy()))
        row, tf, at = row[order], tf[order].astype(np.int32), coded.indices.to_numpy()[order]
        first = np.flatnonzero(np.diff(at, prepend=-1))
        edges = np.concatenate([first, [len(at)]]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(edges), pa.array(x.astype(np.int32))) for x in (off[row], tf, dl[row])]
        sums = [np.diff(edges), np.maximum.reduceat(tf, first), np.minimum.reduceat(dl[row], first)]
        return pa.RecordBatch.from_arrays([coded.dictionary, pa.array(np.full(len(first), region)), *(pa.array(x.astype(np.int32)) for x in sums), *lists], schema=arrow)

    def run(batches):
        held, of = [], None
        for batch in batches:
            region = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(region)) + 1).tolist(), len(region)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and of != region[a]:
                    yield packed(of, held)
                    held = []
                held, of = [*held, batch.slice(a, b - a)], region[a]
        if held:
            yield packed(of, held)

    return rows.mapInArrow(run, schema)


def _write_postings(docs: DataFrame, folder: str) -> None:
    postings = _write(_region_postings(docs), f"{folder}/postings")
    _write(postings.select("term", "region", "n", "max_tf", "min_dl"), f"{folder}/blocks")


def _counts(docs: DataFrame) -> tuple[int, int, int]:
    r = docs.agg(F.count("*"), F.count("dl"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    return int(r[0]), int(r[1]), int(r[2])


def _add_segment(spark: SparkSession, path: str, number: int, rows: DataFrame, gone: DataFrame | None, before: DataFrame | None) -> None:
    """``rows`` (id, hash, dl, terms) and the replaced documents (_segment, docno, dl, terms) become segment ``number``."""
    folder = f"{path}/segments/{number}"
    # documents of like length share regions, so that a block's least length says much
    docs = _write(rows.sortWithinPartitions("dl").select(F.monotonically_increasing_id().alias("docno"), "id", "hash", "dl", "terms"), f"{folder}/docs")
    _write_postings(docs, folder)
    if gone is None:
        gone = spark.createDataFrame([], "_segment int, docno bigint, dl int, terms array<string>")
    gone = materialize(gone.select("_segment", "docno", "dl", "terms"), "gone")
    _write(gone.select(F.col("_segment").alias("segment"), "docno"), f"{folder}/dead")
    _write(gone.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("n")), f"{folder}/lost")
    entry = spark.createDataFrame([(number, *_counts(docs), *_counts(gone))], _MANIFEST)
    store.save((before.unionByName(entry) if before is not None else entry).coalesce(1), f"{path}/manifest")


def _analysed(docs: DataFrame, analyze: Callable[[str], Column]) -> DataFrame:
    rows = docs.select("id", F.md5("content").alias("hash"), analyze("content").alias("terms"))
    return rows.select("id", "hash", F.size("terms").alias("dl"), F.array_sort("terms").alias("terms"))


def build(docs: DataFrame, path: str, analyze: Callable[[str], Column] = lexical.tokens) -> str:
    """An index of ``docs`` (id, content) in the new folder ``path``. A null content has no terms and no length."""
    _add_segment(docs.sparkSession, path, 1, _analysed(docs, analyze), None, None)
    return path


def update(path: str, changed: DataFrame, deleted: DataFrame | None = None, analyze: Callable[[str], Column] = lexical.tokens) -> str:
    """Put ``changed`` (id, content) in the place of what these ids were, and take ``deleted`` (id) out. Only these documents are read and analysed."""
    spark = changed.sparkSession
    manifest = store.load(spark, f"{path}/manifest")
    ids = changed.select("id")
    ids = (ids.unionByName(deleted.select("id")) if deleted is not None else ids).distinct()
    gone = living(spark, path).join(few(materialize(ids, "ids"), SENT), "id", "left_semi")
    _add_segment(spark, path, max(_segments(spark, path)) + 1, _analysed(changed, analyze), gone, manifest)
    return path


def refresh(path: str, docs: DataFrame, analyze: Callable[[str], Column] = lexical.tokens) -> str:
    """Bring the index to the state of ``docs`` (id, content): documents are compared by hash, and only new and changed ones are analysed."""
    spark = docs.sparkSession
    known = living(spark, path).select("id", F.col("hash").alias("_known"), F.lit(True).alias("_there"))
    now = docs.select("id", F.md5("content").alias("_hash"), F.lit(True).alias("_here"))
    met = materialize(now.join(known, "id", "full_outer").where(~F.col("_hash").eqNullSafe(F.col("_known")) | F.col("_here").isNull() | F.col("_there").isNull()).select("id", "_here"), "changes")
    changed = docs.select("id", "content").join(few(met.where("_here").select("id"), SENT), "id", "left_semi")
    return update(path, changed, met.where("_here is null").select("id"), analyze)


def compact(path: str, spark: SparkSession, into: str) -> str:
    """The living documents as one segment in the new folder ``into``, from their stored terms."""
    _add_segment(spark, into, 1, living(spark, path).select("id", "hash", "dl", "terms"), None, None)
    return into


def _part(tf, dl, avg_dl: float) -> Column:
    return F.col("idf") * tf * (V.BM25_K1 + 1) / (tf + V.BM25_K1 * (1 - V.BM25_B + V.BM25_B * dl / F.lit(avg_dl)))


class Search:
    """BM25 search of an index for a stated set of queries (query_id, query_text)."""

    def __init__(self, spark: SparkSession, path: str, queries: DataFrame, clip: float | None = 10.0, analyze: Callable[[str], Column] = lexical.tokens):
        self.spark, self.path, self.clip = spark, path, clip
        sums = [int(x or 0) for x in store.load(spark, f"{path}/manifest").agg(*(F.sum(c) for c in ("n_docs", "n_texts", "sum_dl", "dead_docs", "dead_texts", "dead_dl"))).first()]
        n_docs, texts, length = (sums[i] - sums[i + 3] for i in range(3))
        self.avg_dl = length / texts if length else 1.0
        terms = materialize(lexical.query_terms(queries, analyze).select("query_id", "term"), "terms")
        wanted = few(terms.select("term").distinct())
        # rows of each region: where a task has met so many it has all of the region
        self.sizes = _read(spark, path, "blocks").groupBy("_segment", "region").agg(F.count("*").alias("n")).toArrow().sort_by([("_segment", "ascending"), ("region", "ascending")])
        asked = materialize(_read(spark, path, "blocks").join(wanted, "term"), "blocks")
        lost = _read(spark, path, "lost").join(wanted, "term").groupBy("term").agg(F.sum("n").alias("lost"))
        df = asked.groupBy("term").agg(F.sum("n").alias("n")).join(lost, "term", "left").select("term", (F.col("n") - F.coalesce("lost", F.lit(0))).alias("df")).where("df > 0")
        idf = F.ln(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        self.weights = materialize(terms.join(df, "term").select("query_id", "term", idf.alias("idf")), "weights")
        self.dead = _read(spark, path, "dead").select(F.col("segment").alias("_segment"), "docno")
        bound = F.sum(_part(F.col("max_tf"), F.col("min_dl"), self.avg_dl)).alias("bound")
        self.bounds = materialize(asked.join(few(self.weights), "term").groupBy("query_id", "_segment", "region").agg(bound), "bounds")

    def _final(self, score: Column) -> Column:
        return F.round(F.least(score / self.clip, F.lit(1.0)) if self.clip else score, 6)

    def score(self, regions: DataFrame, k: int) -> DataFrame:
        """(query_id, _segment, docno, score) of those living documents of (query_id, _segment, region) that can be among the best ``k`` of a query.

        A region's postings lie together, so its scores are summed where they are read. Only of regions that are cut between two tasks all sums move.
        """
        names = self.weights.select("query_id").distinct().toArrow()["query_id"].combine_chunks()
        parts = [self._scored(names.slice(at, ASKED), regions, k) for at in range(0, len(names), ASKED)]
        if not parts:
            return self.spark.createDataFrame([], StructType([self.weights.schema["query_id"], *StructType.fromDDL("_segment int, docno bigint, score double")]))
        found = reduce(DataFrame.unionByName, parts)
        cut = found.where("not whole").groupBy("query_id", "_segment", "docno").agg(F.sum("score").alias("score"))
        return found.where("whole").drop("whole").unionByName(cut).withColumn("score", self._final(F.col("score")))

    def _scored(self, names: pa.Array, regions: DataFrame, k: int) -> DataFrame:
        kind = self.weights.schema["query_id"]
        mine = few(self.spark.createDataFrame(pa.table({"query_id": names})).select(F.col("query_id").cast(kind.dataType)))
        weights = self.weights.join(mine, "query_id").toArrow()
        term = weights["term"].combine_chunks().dictionary_encode()
        query = pc.index_in(weights["query_id"].combine_chunks(), value_set=names).to_numpy()
        order = np.argsort(term.indices.to_numpy(), kind="stable")
        first = np.searchsorted(term.indices.to_numpy()[order], np.arange(len(term.dictionary) + 1))
        idf = weights["idf"].to_numpy()[order][first[:-1]]
        known = {(s, r): (i, n) for i, (s, r, n) in enumerate(zip(*(self.sizes[c].to_pylist() for c in ("_segment", "region", "n"))))}
        pairs = regions.join(mine, "query_id").toArrow()  # ASKED for each region at most
        at = np.array([known[x][0] for x in zip(pairs["_segment"].to_pylist(), pairs["region"].to_pylist())], np.int64)
        asks = pc.index_in(pairs["query_id"].combine_chunks(), value_set=names).to_numpy()[np.argsort(at, kind="stable")]
        edges = np.searchsorted(np.sort(at), np.arange(len(known) + 1))
        width, mean, clip = REGION, self.avg_dl, self.clip
        gone = self.dead.groupBy("_segment", F.expr(f"docno div {width}").alias("region")).agg(F.collect_list((F.col("docno") % width).cast("int")).alias("off")).toArrow()
        gone = {(s, r): np.packbits(np.isin(np.arange(width), off)) for s, r, off in zip(*(gone[c].to_pylist() for c in ("_segment", "region", "off")))}
        shared = self.spark.sparkContext.broadcast((names, term.dictionary, idf, first, query[order], known, edges, asks, gone))
        out = StructType([kind, *StructType.fromDDL("_segment int, docno bigint, score double, whole boolean")])
        arrow = to_arrow_schema(out)

        def run(batches):
            names, words, idf, first, query, known, edges, asks, gone = shared.value
            best = blocks.Best(k, len(names), 2e-6, 1.0 if clip else np.inf)
            of, rows, sums, ours = None, 0, None, None

            def scores():
                whole = rows == known[of][1]
                if whole and of in gone:
                    sums[:, np.unpackbits(gone[of])[:width].astype(bool)] = 0
                place, off = np.nonzero(sums)
                score, asked = sums[place, off], ours[place]
                if whole:
                    go = best.kept(score / (clip or 1.0), asked)
                    score, asked, off = score[go], asked[go], off[go]
                columns = [np.full(len(off), of[0], np.int32), of[1] * width + off.astype(np.int64), score, np.full(len(off), whole)]
                return pa.RecordBatch.from_arrays([names.take(pa.array(asked)), *map(pa.array, columns)], schema=arrow)

            for batch in batches:
                segment, region = batch.column(1).to_numpy(), batch.column(2).to_numpy()
                code = pc.index_in(batch.column(0), value_set=words).fill_null(-1).to_numpy()
                cuts = [0, *(np.flatnonzero((np.diff(region) != 0) | (np.diff(segment) != 0)) + 1).tolist(), len(region)]
                for a, b in zip(cuts, cuts[1:]):
                    if a == b:
                        continue
                    if of != (here := (int(segment[a]), int(region[a]))):
                        if of is not None and len(ours):
                            yield scores()
                        of, rows = here, 0
                        i = known[of][0]
                        ours = asks[edges[i] : edges[i + 1]]
                        sums, place = np.zeros((len(ours), width)), np.full(len(names), -1)
                        place[ours] = np.arange(len(ours))
                    rows += b - a
                    hit = np.flatnonzero(code[a:b] >= 0)
                    if not len(ours) or not len(hit):
                        continue
                    some = batch.slice(a, b - a).take(pa.array(hit))
                    n = some.column(3).value_lengths().to_numpy()
                    off, tf, dl = (some.column(c).flatten().to_numpy() for c in (3, 4, 5))
                    t = np.repeat(code[a:b][hit], n)
                    part = idf[t] * tf * (V.BM25_K1 + 1) / (tf + V.BM25_K1 * (1 - V.BM25_B + V.BM25_B * dl / mean))
                    many = first[t + 1] - first[t]
                    for c, d in blocks.spans(many, 1 << 20):
                        m = many[c:d]
                        to = place[query[np.repeat(first[t[c:d]] - np.cumsum(m) + m, m) + np.arange(m.sum())]]
                        met = to >= 0
                        np.add.at(sums.reshape(-1), to[met] * width + np.repeat(off[c:d], m)[met], np.repeat(part[c:d], m)[met])
            if of is not None and len(ours):
                yield scores()

        found = _read(self.spark, self.path, "postings").select("term", "_segment", "region", "off", "tf", "dl").mapInArrow(run, out)
        dead = self.dead.withColumn("whole", F.lit(False))
        return found.join(few(dead, SENT), ["_segment", "docno", "whole"], "left_anti").select("query_id", "_segment", "docno", "score", "whole")

    def top(self, k: int) -> DataFrame:
        """(query_id, id, score, rank), ties to smaller ids."""
        by_bound = W.partitionBy("query_id").orderBy(F.desc("bound"), "_segment", "region")
        seeds = self.seeds = materialize(self.bounds.withColumn("n", F.row_number().over(by_bound)).where(F.col("n") <= SEEDS).drop("n"), "seeds")
        first = materialize(self.score(seeds, k), "first")
        best = first.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("n") == k).select("query_id", F.col("score").alias("least"))
        # a bound is rounded up, as scores are rounded
        left = self.bounds.join(few(seeds), ["query_id", "_segment", "region"], "left_anti").join(few(best), "query_id", "left").where(F.coalesce(self._final(F.col("bound")) + 2e-6 >= F.col("least"), F.lit(True)))
        self.rest = materialize(left.select("query_id", "_segment", "region"), "rest")
        found = first.unionByName(self.score(self.rest, k))
        ids = _read(self.spark, self.path, "docs").select("_segment", "docno", "id")
        # ties at the k-th score are kept until their ids are known
        near = materialize(found.withColumn("n", F.rank().over(W.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("n") <= k).drop("n"), "near")
        return lexical.top(ids.join(few(near), ["_segment", "docno"]).select("query_id", "id", "score"), k)

    def pruning(self) -> tuple[int, int]:
        """How many (query, region) pairs hold a term of the query, and how many of them ``top`` scored."""
        return self.bounds.count(), self.seeds.count() + self.rest.count()


def bm25(spark: SparkSession, path: str, queries: DataFrame, k: int, clip: float | None = 10.0, analyze: Callable[[str], Column] = lexical.tokens) -> DataFrame:
    """The best ``k`` documents of each query, as ``lexical.top(lexical.bm25(...), k)`` gives them."""
    return Search(spark, path, queries, clip, analyze).top(k)
