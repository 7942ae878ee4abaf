"""Lexical search over postings: term, document, positions.

Matching is a join of the query's terms with the postings, so only postings of asked terms are
read. A popular term's postings spread over partitions by document where that matters: scores are
summed map-side before they move.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from brindle.functions import text as T
from brindle.functions import vocabulary as V
from brindle.functions.stemming import stems
from brindle.operators import blocks, substrings
from brindle.session import few, materialize


def tokens(c: Column | str) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(T.col(c)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def english(c: Column | str) -> Column:
    """``tokens`` without English function words, stemmed: to be given as ``analyze`` for documents and queries alike."""
    return stems(F.filter(tokens(c), lambda t: ~t.isin(V.ENGLISH_STOP_WORDS)))


def postings(docs: DataFrame, id_column: str = "id", content: str = "content", stop_words: list[str] | None = None, analyze: Callable[[str], Column] = tokens) -> DataFrame:
    """(id, term, tf, positions): one row for each distinct term of a document; the refreshable search table."""
    rows = docs.select(F.col(id_column).alias("id"), F.posexplode(analyze(content)).alias("pos", "term"))
    if stop_words:
        rows = rows.where(~F.col("term").isin(stop_words))
    return rows.groupBy("id", "term").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))


#: Tokens that a task counts at once, about.
TOKENS = 1 << 20


def counted(lists: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(row, term, tf) of the distinct terms of each list, by rows: one sort of all tokens, however many a list has."""
    sizes = lists.value_lengths().fill_null(0).to_numpy()
    coded = lists.flatten().dictionary_encode()
    cell, tf = np.unique(np.repeat(np.arange(len(lists)), sizes) * max(len(coded.dictionary), 1) + coded.indices.to_numpy(), return_counts=True)
    row, term = np.divmod(cell, max(len(coded.dictionary), 1))
    return row, coded.dictionary.take(pa.array(term)), tf


def term_rows(docs: DataFrame, id_column: str = "id", content: str = "content") -> DataFrame:
    """(id, term, tf, dl) without positions and without a shuffle: terms are counted where the row is."""
    rows = docs.select(F.col(id_column).alias("id"), tokens(content).alias("t"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, term string, tf int, dl int"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            sizes = batch.column(1).value_lengths().fill_null(0)
            for a, b in blocks.spans(sizes.to_numpy(), TOKENS):
                row, term, tf = counted(batch.column(1).slice(a, b - a))
                at = pa.array(row + a)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), term, pa.array(tf.astype(np.int32)), sizes.take(at).cast(pa.int32())], schema=arrow)

    return rows.mapInArrow(run, schema)


def query_terms(queries: DataFrame, analyze: Callable[[str], Column] = tokens) -> DataFrame:
    """(query_id, term, n_terms) of (query_id, query_text)."""
    t = F.array_distinct(analyze("query_text"))
    return queries.select("query_id", F.explode(t).alias("term"), F.size(t).alias("n_terms"))


def asked_counts(docs: DataFrame, terms: DataFrame, id_column: str = "id", content: str = "content", analyze: Callable[[str], Column] = tokens, mark_all: bool = False) -> DataFrame:
    """(id, dl, term, tf) of the asked terms only: a document's tokens meet the distinct terms
    first; adaptive execution broadcasts these while they are small.

    With ``mark_all`` every document has the empty term besides, so that counts of all documents
    come from the same pass over the texts.
    """
    wanted, found = terms.select("term").distinct(), F.col("_t")
    if mark_all:
        wanted, found = wanted.unionByName(wanted.sparkSession.createDataFrame([("",)], "term string")), F.array_append(F.coalesce("_t", F.array().cast("array<string>")), F.lit(""))
    rows = docs.select(F.col(id_column).alias("id"), analyze(content).alias("_t")).select("id", F.size("_t").alias("dl"), F.explode(found).alias("term"))
    return rows.join(wanted, "term").groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))


def match(counts: DataFrame, terms: DataFrame, mode: str = "all") -> DataFrame:
    """(query_id, id, n_matched, tf): documents with all terms of a query, or with any of them."""
    hits = counts.join(terms, "term").groupBy("query_id", "id").agg(F.count("*").alias("n_matched"), F.sum("tf").alias("tf"), F.first("n_terms").alias("n_terms"))
    return (hits.where("n_matched = n_terms") if mode == "all" else hits).drop("n_terms")


def ts_rank(counts: DataFrame, terms: DataFrame, mode: str = "all") -> DataFrame:
    """(query_id, id, score): like a full-text engine's frequency rank, over unstemmed tokens:
    each term adds the sum of 1/i**2 for its i-th occurrence, scaled to 0..1 over the query's terms."""
    first = F.aggregate(F.sequence(F.lit(1), F.least("tf", F.lit(50)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / (i * i))
    n = F.col("tf").cast("double")  # of more than 50 occurrences, Euler and Maclaurin's sum is exact to 13 digits
    weight = F.lit(0.1) * F.when(F.col("tf") <= 50, first).otherwise(F.lit(math.pi**2 / 6) - 1 / n + 1 / (2 * n**2) - 1 / (6 * n**3) + 1 / (30 * n**5)) / F.lit(1.64493406685)
    hits = counts.withColumn("w", weight).join(terms, "term").groupBy("query_id", "id").agg(F.sum("w").alias("w"), F.count("*").alias("n"), F.first("n_terms").alias("n_terms"))
    hits = hits.where("n = n_terms") if mode == "all" else hits
    return hits.select("query_id", "id", F.round(F.col("w") / F.col("n_terms"), 6).alias("score"))


def cover_density(post: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, id, score): cover density of documents with all terms, scaled r / (r + 1).

    A cover is a shortest run of positions with every term of the query; a cover of n terms over a
    run of length l adds n / l. Covers are found from the sorted positions inside one row per hit.
    """
    hits = post.join(terms, "term").groupBy("query_id", "id").agg(F.count("*").alias("n"), F.first("n_terms").alias("n_terms"), F.collect_list(F.struct("term", "positions")).alias("p")).where("n = n_terms")
    latest = lambda e: F.transform("p", lambda t: F.array_max(F.filter(t["positions"], lambda x: x <= e)))
    start = lambda e: F.when(F.size(F.filter(latest(e), lambda x: x.isNull())) == 0, F.array_min(latest(e)))
    ends = F.array_sort(F.flatten(F.transform("p", lambda t: t["positions"])))
    covers = F.filter(F.transform(ends, lambda e: F.struct(start(e).alias("s"), e.alias("e"))), lambda c: c["s"].isNotNull())
    shortest = hits.withColumn("c", covers).withColumn("c", F.filter("c", lambda c, i: (i == 0) | (c["s"] > F.element_at("c", F.greatest(i, F.lit(1)))["s"])))
    r = F.aggregate("c", F.lit(0.0), lambda a, c: a + F.col("n") / (c["e"] - c["s"] + 1))
    return shortest.select("query_id", "id", F.round(r / (r + 1), 6).alias("score"))


def best_covers(docs: DataFrame, queries: DataFrame, k: int, analyze: Callable[[str], Column] = tokens) -> DataFrame:
    """(query_id, id, score, rank): the best ``k`` of ``cover_density`` over all ``docs`` (id, content), for a stated set of queries (query_id, query_text).

    Covers are found where the tokens are, so neither tokens nor hits move: a task sends on what can be among the best of its rows.
    Rows that share an id count together and go through ``postings``.
    """
    docs = docs.where("id is not null")
    terms = materialize(query_terms(queries, analyze), "terms")
    shared = materialize(docs.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "shared")
    rest = None
    if not shared.isEmpty():
        shared = few(shared)
        rest = cover_density(postings(docs.join(shared, "id", "left_semi"), analyze=analyze), terms)
        docs = docs.join(shared, "id", "left_anti")
    rows = docs.select("id", analyze("content").alias("t"))
    out = StructType([queries.select("query_id").schema[0], rows.schema["id"], StructField("score", DoubleType())])
    schema, arrow = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out), to_arrow_schema(out)
    n_blocks = -(-terms.count() // max(1, TABLE_CELLS >> 4))

    def block(b: int) -> DataFrame:
        mine = terms.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == b).toArrow()
        coded, known = mine["query_id"].combine_chunks().dictionary_encode(), mine["term"].combine_chunks().dictionary_encode()
        asked = [known.indices.to_numpy()[np.flatnonzero(coded.indices.to_numpy() == q)] for q in range(len(coded.dictionary))]
        given = rows.sparkSession.sparkContext.broadcast((coded.dictionary, known.dictionary, asked))

        def run(batches):
            names, words, asked = given.value
            seen = blocks.Best(k, len(asked), 2e-6)
            for batch in batches:
                for a, b in blocks.spans(batch.column(1).value_lengths().fill_null(0).to_numpy(), TOKENS):
                    lists = batch.column(1).slice(a, b - a)
                    sizes = lists.value_lengths().fill_null(0).to_numpy()
                    code = pc.index_in(lists.flatten(), value_set=words).fill_null(-1).to_numpy()
                    row, start = np.repeat(np.arange(len(lists)), sizes), np.cumsum(sizes) - sizes
                    order = np.argsort(code, kind="stable")
                    edges = np.searchsorted(code[order], np.arange(len(words) + 1))
                    found, of, score = [], [], []
                    for q, its in enumerate(asked):
                        places = [order[edges[t] : edges[t + 1]] for t in its]
                        if all(map(len, places)):
                            at, r = _covers(places, row, start)
                            found.append(at)
                            of.append(np.full(len(at), q))
                            score.append(r / (r + 1))
                    if found:
                        found, of, score = map(np.concatenate, (found, of, score))
                        go = seen.kept(score, of)
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(of[go])), batch.column(0).take(pa.array(found[go] + a)), pa.array(score[go])], schema=arrow)

        return rows.mapInArrow(run, schema)

    found = reduce(DataFrame.unionByName, [block(b) for b in range(n_blocks)], rows.sparkSession.createDataFrame([], schema)).withColumn("score", F.round("score", 6))
    return top(found if rest is None else found.unionByName(rest), k)


def _covers(places: list[np.ndarray], row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, sum of n / length over its covers) of the rows that hold all n terms. ``places``: of each term, in rising order, among all tokens; ``row``: of each token, ``start``: of each row's tokens."""
    ends = np.concatenate(places)
    order = np.argsort(ends, kind="stable")
    term, ends = np.repeat(np.arange(len(places)), list(map(len, places)))[order], ends[order]
    since = ends
    for t in range(len(places)):
        since = np.minimum(since, np.maximum.accumulate(np.where(term == t, ends, -1)))
    whole = since >= start[row[ends]]
    since, ends = since[whole], ends[whole]
    at = row[ends]
    # a cover that starts where the one before does is longer
    short = np.append(True, (at[1:] != at[:-1]) | (since[1:] > since[:-1]))[: len(at)]
    rows, place = np.unique(at[short], return_inverse=True)
    return rows, np.bincount(place, len(places) / (ends[short] - since[short] + 1), len(rows))


def bm25(docs: DataFrame, queries: DataFrame, id_column: str = "id", content: str = "content", clip: float | None = 10.0) -> DataFrame:
    """(query_id, id, score) for every document with a term of the query; divided by ``clip`` and at most 1 if given.

    Collection statistics cover all documents; they and the asked terms' counts come from one pass over the texts.
    """
    terms = query_terms(queries)
    counts = asked_counts(docs, terms, id_column, content, mark_all=True)
    # tf is used by all three, so that they read one exchange
    each = F.when(F.col("term") == "", F.col("tf"))
    size = counts.agg(F.sum(each).alias("n_docs"), (F.sum(each * F.col("dl")) / F.sum(F.when(F.col("dl").isNotNull(), each))).alias("avg_dl"))
    df = counts.groupBy("term").agg(F.sum(F.when(F.col("tf") > 0, 1)).alias("df"))
    idf = F.ln(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (V.BM25_K1 + 1) / (F.col("tf") + V.BM25_K1 * (1 - V.BM25_B + V.BM25_B * F.col("dl") / F.col("avg_dl")))
    weights = df.crossJoin(F.broadcast(size))  # one row of statistics
    scored = counts.join(weights, "term").withColumn("part", part)
    summed = scored.join(terms, "term").groupBy("query_id", "id").agg(F.sum("part").alias("score"))
    return summed.withColumn("score", F.round(F.least(F.col("score") / clip, F.lit(1.0)) if clip else F.col("score"), 6))


#: Terms of queries in a block at most, times 16; more queries are taken in several blocks, each of which reads the counts again.
TABLE_CELLS = 1 << 24
#: Queries whose scores a task holds at once.
ASKED = 2048
#: Common terms of a block of queries at most that meet the rows in a product; of the others each posting goes to its queries.
COMMON = 1024
#: Queries times results from which on some rows are scored first, so that only what can be among the best of all leaves a task.
SEEDED = 100_000
#: Rows of which one is scored first.
SEED_SHARE = 16


def asked_vectors(docs: DataFrame, names: list[str], id_column: str = "id", content: str = "content", analyze: Callable[[str], Column] = tokens) -> DataFrame:
    """(id, dl, at, tf): per document which of the terms ``names`` it has, by their places, and how often. Tokens are looked up inside the row; nothing moves."""
    known = pa.array(names, pa.string())
    rows = docs.select(F.col(id_column).alias("id"), analyze(content).alias("t"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, dl int, at array<int>, tf array<int>"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for a, b in blocks.spans(batch.column(1).value_lengths().fill_null(0).to_numpy(), TOKENS):
                lists = batch.column(1).slice(a, b - a)
                sizes = lists.value_lengths()
                found = pc.index_in(lists.flatten(), value_set=known).fill_null(-1).to_numpy()
                row = np.repeat(np.arange(len(lists)), sizes.fill_null(0).to_numpy())
                hit = found >= 0
                cell, tf = np.unique(row[hit] * len(known) + found[hit], return_counts=True)
                row, at = np.divmod(cell, max(len(known), 1))
                edges = pa.array(np.searchsorted(row, np.arange(len(lists) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(edges, pa.array(x.astype(np.int32))) for x in (at, tf)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), sizes.cast(pa.int32()), *lists], schema=arrow)

    return rows.mapInArrow(run, schema)


class Counts:
    """Which of the terms of ``queries`` (query_id, query_text) each of ``docs`` has and how often, written once for any searches of these queries or of some of them."""

    def __init__(self, docs: DataFrame, queries: DataFrame, id_column: str = "id", content: str = "content", analyze: Callable[[str], Column] = tokens):
        self.terms = materialize(query_terms(queries, analyze), "terms")
        self.names = sorted(self.terms.select("term").distinct().toArrow()["term"].to_pylist())
        self.rows = materialize(asked_vectors(docs, self.names, id_column, content, analyze), "counts")


class _Asked:
    """Some of a block's queries, from ``first`` to ``last``, as a task holds them: which of them have a term, and the table of common terms."""

    def __init__(self, term: np.ndarray, query: np.ndarray, n_terms: int, first: int, last: int, df: np.ndarray, rows: int):
        here = (query >= first) & (query < last)
        order = np.argsort(term[here], kind="stable")
        self.first, self.last = first, last
        self.queries = query[here][order] - first
        self.sizes = np.bincount(term[here], minlength=n_terms)
        self.starts = np.cumsum(self.sizes) - self.sizes
        # a term costs a product about 1/1000 of what a posting's way to a query costs
        shared = self.sizes * df
        common = np.argsort(-shared, kind="stable")[:COMMON]
        common = common[shared[common] * 1000 > rows * (last - first)]
        self.place = np.full(n_terms, -1)
        self.place[common] = np.arange(len(common))
        self.table = np.zeros((len(common), last - first), np.float32)
        at = self.place[term[here]]
        self.table[at[at >= 0], query[here][at >= 0] - first] = 1.0

    def sums(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
        """rows x queries: the sum of the values of a row's terms (row, column) that the query has, in single precision."""
        at = self.place[column]
        weights = np.zeros((rows, len(self.table)), np.float32)
        weights[row[at >= 0], at[at >= 0]] = value[at >= 0]
        out = weights @ self.table if len(self.table) else np.zeros((rows, self.last - self.first), np.float32)
        rare = np.flatnonzero((at < 0) & (self.sizes[column] > 0))
        for a, b in blocks.spans(self.sizes[column[rare]], 1 << 20):
            some = rare[a:b]
            n = self.sizes[column[some]]
            query = self.queries[np.repeat(self.starts[column[some]] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            np.add.at(out.reshape(-1), np.repeat(row[some], n) * out.shape[1] + query, np.repeat(value[some].astype(np.float32), n))
        return out


def best(
    docs: DataFrame, queries: DataFrame, k: int, by: str = "bm25", mode: str = "any", clip: float | None = 10.0, id_column: str = "id", content: str = "content",
    analyze: Callable[[str], Column] = tokens, counts: Counts | None = None,
) -> DataFrame:
    """(query_id, id, score, rank): the best ``k`` of ``bm25`` or of ``ts_rank`` (``by`` "rank", ``mode`` "any" or "all"), with equal rows, for a stated set of queries.

    The asked terms of each document become a sparse row of weights. In a task a batch's rows meet a block of queries: terms that many have in
    a product, the others posting by posting, both in single precision; what can be among the best is then summed exactly. So postings
    don't multiply with the queries that ask for them. Of many queries a share of the rows is scored first: what k of these reach is the
    least that others must score to leave their task. ``counts`` of these queries and more saves the pass over the texts.
    """
    whole = counts or Counts(docs, queries, id_column, content, analyze)
    names, rows = whole.names, whole.rows
    terms = whole.terms if counts is None else materialize(query_terms(queries, analyze), "terms")
    n_pairs, n_asked = terms.agg(F.count("*"), F.count_distinct("query_id")).first()
    n_blocks = -(-n_pairs // max(1, TABLE_CELLS >> 4))
    weight, mean = np.ones(len(names)), 1.0
    if by == "bm25":
        n_docs, mean = rows.agg(F.count("*"), F.avg("dl")).first()
        for t, df in rows.select(F.explode("at").alias("t")).groupBy("t").count().collect():  # as many rows as asked terms at most
            weight[t] = math.log(1 + (n_docs - df + 0.5) / (df + 0.5))
    id_type = rows.schema["id"].dataType
    arrow = to_arrow_schema(StructType([*queries.select("query_id").schema, StructField("id", id_type), StructField("score", DoubleType())]))
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {id_type.simpleString()}, score double"
    squares = np.concatenate([[0.0], np.cumsum(1.0 / np.arange(1, 51) ** 2)])
    context = rows.sparkSession.sparkContext
    weights = context.broadcast(weight)
    most = 1.0 if by == "bm25" and clip else np.inf

    def part(at: np.ndarray, tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
        if by == "bm25":
            return weights.value[at] * tf * (V.BM25_K1 + 1) / (tf + V.BM25_K1 * (1 - V.BM25_B + V.BM25_B * dl / (mean or 1.0)))
        n = tf.astype(np.float64)
        return 0.1 * np.where(tf <= 50, squares[np.minimum(tf, 50)], math.pi**2 / 6 - 1 / n + 1 / (2 * n**2) - 1 / (6 * n**3) + 1 / (30 * n**5)) / 1.64493406685

    def asked(b: int):
        """A block of queries for its tasks, TABLE_CELLS / 16 pairs of a query and a term (about)."""
        mine = terms.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == b).select("query_id", "term", "n_terms").toArrow()
        ids = mine["query_id"].combine_chunks().dictionary_encode()
        term = pc.index_in(mine["term"].combine_chunks(), value_set=pa.array(names, pa.string())).to_numpy()
        many = np.zeros(len(ids.dictionary), np.int64)
        many[ids.indices.to_numpy()] = mine["n_terms"].to_numpy()
        query, term = np.divmod(np.unique(ids.indices.to_numpy().astype(np.int64) * len(names) + term), max(len(names), 1))
        used, term = np.unique(term, return_inverse=True)
        return context.broadcast((ids.dictionary, many, query, term, used)), len(many)

    n_names = len(names)

    def scored(rows: DataFrame, shared, floors, b: int | None) -> DataFrame:
        """What can be among the best of a block's queries; with ``b``, the best scores alone, as (block, query, scores)."""

        def run(batches):
            ids, many, query, term, used = shared.value
            place = np.full(n_names, -1)
            place[used] = np.arange(len(used))
            starts = np.searchsorted(query, np.arange(len(many)))  # each query has a term
            sizes = np.diff(np.append(starts, len(query)))
            unit = many.astype(np.float64) if by != "bm25" else np.full(len(many), clip or 1.0)
            error = (int(sizes.max(initial=0)) + 4) * 1.2e-7
            seen = None if k >= blocks.CELLS // max(len(many), 1) and k >= ASKED else blocks.Best(k, len(many), 2e-6, most, None if floors is None else floors.value)
            groups: list[_Asked] = []
            for batch in batches:
                lists = batch.column(2)
                row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
                at, tf = lists.flatten().to_numpy(), batch.column(3).flatten().to_numpy()
                column = place[at]
                ours = column >= 0
                row, column = row[ours], column[ours]
                value = part(at[ours], tf[ours], batch.column(1).to_numpy(zero_copy_only=False)[row])
                cells = row * len(used) + column  # in order
                if not groups:
                    groups = [_Asked(term, query, len(used), a, min(a + ASKED, len(many)), np.bincount(column, minlength=len(used)), len(lists)) for a in range(0, len(many), ASKED)]
                for a, z in blocks.slices(len(lists), min(ASKED, len(many))):
                    i, j = np.searchsorted(row, [a, z])
                    for g in groups:
                        of = np.arange(g.first, g.last)
                        if mode == "all":
                            sums = g.sums(row[i:j] - a, column[i:j], np.ones(j - i), z - a)
                            hit, at_ = blocks.passing(sums, many[of] - np.float32(0.5))
                        else:
                            sums = g.sums(row[i:j] - a, column[i:j], value[i:j], z - a)
                            low = np.full(len(of), -np.inf) if seen is None else seen.least(of) * unit[of] * (1 - error)
                            low = np.maximum(blocks.under(low), np.float32(1e-30))
                            hit, at_ = blocks.passing(sums, low, None if seen is None else k, 4e-6 * float(unit[of].max(initial=1)), error, most * unit[of])
                        at_ = at_ + g.first
                        for c, d in blocks.spans(sizes[at_], 1 << 20):
                            h, q = hit[c:d] + a, at_[c:d]
                            n = sizes[q]
                            edges = np.cumsum(n) - n
                            wanted = np.repeat(h, n) * len(used) + term[np.repeat(starts[q] - edges, n) + np.arange(n.sum())]
                            found = np.minimum(np.searchsorted(cells, wanted), len(cells) - 1)
                            score = np.add.reduceat(np.where(cells[found] == wanted, value[found], 0.0), edges) / unit[q]
                            go = np.ones(len(q), bool) if seen is None else seen.kept(score, q)
                            if b is None and go.any():
                                yield pa.RecordBatch.from_arrays([ids.take(pa.array(q[go])), batch.column(0).take(pa.array(h[go])), pa.array(score[go])], schema=arrow)
            if b is not None and groups:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(many), b, np.int32)), pa.array(np.arange(len(many), dtype=np.int32)), pa.array(list(seen.held), pa.list_(pa.float64()))], names=["block", "query", "scores"])

        return rows.mapInArrow(run, schema if b is None else "block int, query int, scores array<double>")

    parts = [asked(b) for b in range(n_blocks)]
    floors = [None] * n_blocks
    n_rows = rows.count()
    if n_asked * k >= SEEDED and mode == "any" and n_rows >= SEED_SHARE * k:
        # long documents have most terms, so they say most of ranks
        cut = rows.agg(F.percentile_approx("dl", 1 - 1 / SEED_SHARE)).first()[0] if by == "rank" else None
        seeds = rows.where(F.col("dl") > cut) if by == "rank" and cut is not None else rows.where(F.pmod(F.xxhash64("id"), F.lit(SEED_SHARE)) == 0)
        seeds = materialize(seeds.repartition(blocks.tasks(n_rows // SEED_SHARE, n_blocks, context.defaultParallelism)), "seeds")
        heads = reduce(DataFrame.unionByName, [scored(seeds, shared, None, b) for b, (shared, _) in enumerate(parts)])
        heads = heads.groupBy("block", "query").agg(F.get(F.sort_array(F.flatten(F.collect_list("scores")), False), F.lit(k - 1)).alias("least")).toArrow()  # a row a query
        block, query, least = (heads[c].to_numpy() for c in ("block", "query", "least"))
        for b, (_, n) in enumerate(parts):
            floor = np.full(n, -np.inf)
            floor[query[block == b]] = least[block == b]
            floors[b] = context.broadcast(floor)
    found = [scored(rows, shared, floors[b], None) for b, (shared, _) in enumerate(parts)]
    found = reduce(DataFrame.unionByName, found) if found else rows.sparkSession.createDataFrame([], schema)
    return top(found.withColumn("score", F.round(F.least("score", F.lit(1.0)) if by == "bm25" and clip else F.col("score"), 6)), k)


def holding_all(docs: DataFrame, queries: DataFrame, analyze: Callable[[str], Column] = tokens) -> DataFrame:
    """The rows of ``docs`` (id, content) that can have all terms of a query: found inside the row, so that the tokens of the others don't move.

    Rows that share an id all stay, as their terms count together.
    """
    hits = best(docs, queries, (1 << 31) - 1, "rank", "all", analyze=analyze).select("id")
    shared = docs.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    return docs.join(few(materialize(hits.unionByName(shared).distinct(), "holding")), "id", "left_semi")


def contains_search(docs: DataFrame, queries: DataFrame, id_column: str = "id", content: str = "content") -> DataFrame:
    """(query_id, id, score) of documents that hold a word of the query as a substring, by term frequency relevance. One pass over the texts for all words."""
    words = queries.select("query_id", F.explode(T.words(F.lower("query_text"))).alias("pattern")).groupBy("query_id", "pattern").agg(F.count("*").alias("times"))
    rows = docs.select(F.col(id_column).alias("id"), F.lower(content).alias("_low"), T.word_count(content).alias("_n")).where("_n > 0")
    found = substrings.occurrences(rows, "_low", words).select("id", "_n", "pattern", "n")
    hits = found.join(few(words), "pattern").groupBy("query_id", "id").agg(F.sum(F.col("n") * F.col("times")).alias("hits"), F.first("_n").alias("_n"))
    return hits.select("query_id", "id", F.round(F.least(F.lit(1.0), F.col("hits") / F.col("_n")), 6).alias("score")).where("score > 0")


def top(scored: DataFrame, k: int) -> DataFrame:
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k)
