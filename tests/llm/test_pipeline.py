"""The pipeline: stages' columns, decisions, and each stage against a plain version of it."""

import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from brindle.llm import queries
from brindle.llm.texts import labelled_sample
from brindle.session import materialize
from test_operators import brute_components, brute_contained

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, docs
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        after = materialize(stage(spark, before, SMALL), name)
        assert after.columns == columns and after.join(before, "doc_id", "left_anti").count() == 0
        kept[name] = before, after
        before = after
    rows = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]
    given, left = kept["near_duplicates"]
    assert {d for d, _ in rows(left)} == {c for _, _, c in brute_components(rows(given), 5)}
    given, left = kept["decontamination"]
    leaks = {d for d, _ in brute_contained(rows(given), [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()])}
    assert {d for d, _ in rows(left)} == {d for d, _ in rows(given)} - leaks
    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)
    last = pipeline.run(spark, SMALL).collect()
    assert {r["doc_id"]: r["ids"] for r in last} == {d: library.encode(t) for d, t in rows(before)}


def test_clean_documents_stay(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    good = docs.join(labels.where("quality = 1 and toxic = 0"), "doc_id")
    for name, stage in pipeline.STAGES[:2]:
        share = stage(spark, docs, SMALL).join(good.select("doc_id"), "doc_id").count() / good.count()
        assert share > 0.97, name


def test_odd_and_empty_rows(spark, odd, empty, broken):
    for docs in (odd, empty, broken):
        before = docs
        for name, stage in pipeline.STAGES[:-1]:
            before = materialize(stage(spark, before, SMALL), name)
            assert before.columns == docs.columns
        assert pipeline.STAGES[-1][1](spark, before, SMALL).count() == before.count()
    once = pipeline.near_duplicates(spark, odd.where(F.col("doc_id") == 10), SMALL)
    assert once.count() == 1


def test_broken_bytes_by_stage(spark, broken):
    """Each stage on texts that aren't valid UTF-8, whatever the one before kept: bytes stay as they are, equal ones are one."""
    bad = broken.where("doc_id in (20, 21, 22, 23)")
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, bad, SMALL).columns == bad.columns, name
    left = pipeline.near_duplicates(spark, bad, SMALL)
    assert {r["doc_id"] for r in left.collect()} == {20, 21, 22}
    assert left.selectExpr("hex(cast(text as binary)) h").where("h = 'FF'").count() == 1
    assert pipeline.encoding(spark, bad, SMALL).count() == 4


def test_training_rows_of_repeated_ids_are_bounded(spark):
    """A table that repeats its ids trained on each copy: the rows that reach the driver grew with it."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = lambda d, bound: sorted(map(tuple, labelled_sample(d, labels, "toxic", bound).collect()))
    once = rows(docs, 50)
    assert len(once) == len({r[0] for r in once}) == 50
    assert rows(docs.unionByName(docs).unionByName(docs), 50) == once
    other = docs.unionByName(docs.withColumn("text", F.concat("text", F.lit(" more"))))
    assert len(rows(other, 50)) == 50 and len(rows(other, 5_000)) == 2 * len(rows(docs, 5_000))
