"""Search by blocks against plain loops: products, kept rows, substrings, quantised codes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import blocks, lexical, quantized, substrings, vectors


def test_substrings_like_replace(spark):
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("ab "), 30)) for _ in range(40)] + [None, "", "aaaa", "éaé😀a"]
    patterns = sorted({"".join(rng.choice(list("ab"), rng.integers(1, 4))) for _ in range(12)} | {"é", "😀a"})
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    given = spark.createDataFrame([(p,) for p in [*patterns, "", None, "a"]], "pattern string")
    want = {(i, p, (len(t) - len(t.replace(p, ""))) // len(p)) for i, t in enumerate(texts) for p in {*patterns, "a"} if t and p in t}
    assert {(r["id"], r["pattern"], r["n"]) for r in substrings.occurrences(frame, "t", given).collect()} == want
    assert substrings.occurrences(frame, "t", given.limit(0)).count() == 0


def test_substrings_in_blocks(spark, monkeypatch):
    frame = spark.createDataFrame([(1, "one two three")], "id int, t string")
    given = spark.createDataFrame([("one",), ("two",), ("e",), ("four",)], "pattern string")
    whole = sorted(substrings.occurrences(frame, "t", given).collect())
    monkeypatch.setattr(substrings, "BLOCK_CHARS", 4)
    assert sorted(substrings.occurrences(frame, "t", given).collect()) == whole and len(whole) == 3


def test_best_rows_keeps_ties():
    scores = np.array([[1.0, -np.inf], [0.5, 0.2], [0.5 + 1e-7, -np.inf], [0.4, -np.inf]])
    row, query = blocks.best_rows(scores, 2, 2e-6)
    assert sorted(zip(query.tolist(), row.tolist())) == [(0, 0), (0, 1), (0, 2), (1, 1)]
    row, query = blocks.best_rows(np.array([[3.0], [2.0], [5.0]]), 1, 1e-9, 1.0)
    assert row.tolist() == [0, 1, 2]


def plain_cosine(a, b):
    n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return 0.0 if n == 0 else round(sum(x * y for x, y in zip(a, b)) / n, 6)


@pytest.mark.parametrize("cells", [1, 1 << 22])
def test_vector_search_against_loops(spark, monkeypatch, cells):
    monkeypatch.setattr(blocks, "CELLS", cells)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)], i % 3) for i in range(60)] + [(100, None, 0), (101, [], 1), (102, [1.0, 2.0], 2), (103, [0.0] * 4, 0)]
    frame = spark.createDataFrame(rows, "id int, embedding array<double>, hits int").repartition(3)
    asked = [r for r in rows if r[0] % 10 == 0 or r[0] == 102]
    queries = spark.createDataFrame([(r[0], r[1]) for r in asked], "query_id int, query_embedding array<double>")
    for k, exclude in ((5, False), (3, True), (None, False)):
        got = sorted(map(tuple, vectors.search(frame, queries, k, 0.1, tie_breaks=("hits",), exclude_self=exclude).collect()))
        want = []
        for q, v, _ in asked:
            if v:
                near = [(-plain_cosine(v, w), -h, i) for i, w, h in rows if w and len(w) == len(v) and plain_cosine(v, w) >= 0.1 and not (exclude and i == q)]
                want += [(q, i, -s, n + 1) for n, (s, _, i) in enumerate(sorted(near)[:k])]
        assert got == sorted(want)


@pytest.mark.parametrize(("by", "mode"), [("bm25", "any"), ("rank", "any"), ("rank", "all")])
def test_best_equals_joins(spark, monkeypatch, by, mode):
    """Products give the rows of the joins, also in several blocks; nulls, empty texts and queries, words that nobody has."""
    rng = np.random.default_rng(4)
    docs = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.6, rng.integers(1, 90)) % 40)) for i in range(80)] + [(200, None), (201, ""), (202, "w1 " * 120)]
    asked = [(i, " ".join(f"w{int(x)}" for x in rng.integers(0, 12, rng.integers(1, 4)))) for i in range(20)] + [(50, ""), (51, None), (52, "nobody"), (53, "w1 nobody")]
    frame, queries = spark.createDataFrame(docs, "id int, content string"), spark.createDataFrame(asked, "query_id int, query_text string")
    terms = lexical.query_terms(queries)
    want = lexical.bm25(frame, queries) if by == "bm25" else lexical.ts_rank(lexical.asked_counts(frame, terms), terms, mode)
    want = sorted(map(tuple, lexical.top(want, 7).collect()))
    for cells, table in ((1 << 22, 1 << 24), (30, 20)):
        monkeypatch.setattr(blocks, "CELLS", cells)
        monkeypatch.setattr(lexical, "TABLE_CELLS", table)
        assert sorted(map(tuple, lexical.best(frame, queries, 7, by, mode).collect())) == want
    assert lexical.best(frame.limit(0), queries, 7, by, mode).count() == lexical.best(frame, queries.limit(0), 7, by, mode).count() == 0


def test_quantized_recall_and_edges(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    queries = frame.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    index = quantized.build(frame)
    assert index.codes.where("length(code) <> 16").count() == 0 and index.codes.count() == frame.count()
    got = {(r["query_id"], r["id"]): r["score"] for r in quantized.search(index, frame, queries, 10, candidates=200).collect()}
    exact = {(r["query_id"], r["id"]): r["score"] for r in vectors.search(frame, queries, 10, -1.0).collect()}
    assert len(got.keys() & exact.keys()) >= 0.95 * len(exact) and all(exact[k] == got[k] for k in got.keys() & exact.keys())
    odd = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0])], "id int, embedding array<double>")
    asked = spark.createDataFrame([(9, [1.0, 0.1, 0.0]), (8, None)], "query_id int, query_embedding array<double>")
    assert [(r["query_id"], r["id"]) for r in quantized.search(quantized.build(odd), odd, asked, 1).collect()] == [(9, 1)]
    assert quantized.search(quantized.build(odd), odd, asked.limit(0), 1).count() == 0
