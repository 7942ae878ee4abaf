"""The stored index: rows equal to direct BM25 after every kind of change, pruning that loses nothing."""

import pytest
from pyspark.sql import functions as F

from brindle.operators import inverted, lexical, store
from brindle.session import scratch_path

SMALL = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.select("query_id", "id", "score", "rank").collect()))


@pytest.fixture
def few_documents(monkeypatch):
    monkeypatch.setattr(inverted, "REGION", 8)
    monkeypatch.setattr(inverted, "SEEDS", 1)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))


@pytest.fixture(scope="module")
def asked(spark):
    return spark.read.parquet(f"{SMALL}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


def test_changes_one_after_the_other(spark, docs, asked, few_documents):
    odd = spark.createDataFrame([(9001, None), (9002, ""), (9003, "alpha alpha beta")], "id bigint, content string")
    state = docs.where("id < 150").unionByName(odd)
    path = inverted.build(state, scratch_path(spark, "index"))
    direct = lambda s, q: rows(lexical.top(lexical.bm25(s, q), 5))
    assert rows(inverted.bm25(spark, path, asked, 5)) == direct(state, asked)
    new = spark.createDataFrame([(9002, "beta gamma"), (9004, "alpha")], "id bigint, content string")
    inverted.update(path, new, spark.createDataFrame([(9003,), (10,), (77777,)], "id bigint"))
    state = state.where("id not in (9002, 9003, 10)").unionByName(new)
    greek = asked.unionByName(spark.createDataFrame([(-1, "alpha beta"), (-2, ""), (-3, "nowhere to be found at all qqqq")], "query_id bigint, query_text string"))
    assert rows(inverted.bm25(spark, path, greek, 5)) == direct(state, greek)
    inverted.refresh(path, docs)
    assert rows(inverted.bm25(spark, path, asked, 5)) == direct(docs, asked)
    entries = {r["segment"]: r for r in store.load(spark, f"{path}/manifest").collect()}
    assert entries[2]["n_docs"] == 2 and entries[2]["dead_docs"] == 3 and entries[3]["n_docs"] == docs.where("id >= 150 or id = 10").count()
    inverted.refresh(path, docs)
    assert store.load(spark, f"{path}/manifest").where("segment = 4").first()["n_docs"] == 0
    whole = inverted.compact(path, spark, scratch_path(spark, "compacted"))
    assert rows(inverted.bm25(spark, whole, asked, 5)) == direct(docs, asked)


def test_regions_are_left_out(spark, few_documents):
    """Passages that one document holds: other regions' bounds don't reach its score."""
    texts = [(i, " ".join(f"w{(i * 31 + k) % 400}" for k in range(30))) for i in range(400)]
    docs = spark.createDataFrame(texts, "id bigint, content string")
    search = inverted.Search(spark, inverted.build(docs, scratch_path(spark, "index")), docs.where("id % 40 = 0").select(F.col("id").alias("query_id"), F.col("content").alias("query_text")), clip=None)
    assert rows(search.top(1)) == [(i, i, s, 1) for i, _, s, _ in rows(search.top(1))]
    there, scored = search.pruning()
    assert scored < 0.6 * there


def test_delta_coded_pages(spark, docs):
    import pyarrow.parquet as pq

    path = inverted.build(docs, scratch_path(spark, "index"))
    folder = inverted._segment(path, 1, "postings").removeprefix("file:").replace("//", "/")
    coded = {e for f in pq.ParquetDataset(folder).files for c in range(8) for e in pq.ParquetFile(f).metadata.row_group(0).column(c).encodings if pq.ParquetFile(f).metadata.num_rows}
    assert "DELTA_BINARY_PACKED" in coded
    assert set(spark.read.parquet(f"{path}/segments/1/blocks").columns) == {"term", "region", "n", "max_tf", "min_dl"}
