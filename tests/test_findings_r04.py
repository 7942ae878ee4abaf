"""What the findings of round 4 said, in small."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import blocks, inverted, lexical, vectors
from brindle.plans import catalog, queries_search, retrieval
from brindle.session import scratch_path
from brindle.sources import files


def test_router_reads_the_texts_once(spark, monkeypatch):
    """Each strategy made its own counts of all texts."""
    seen, whole = [], lexical.asked_vectors
    monkeypatch.setattr(lexical, "asked_vectors", lambda *args: seen.append(1) or whole(*args))
    docs = spark.createDataFrame([(i, f"w{i % 7} trial of w{i % 3} safety") for i in range(40)], "id bigint, content string")
    asked = ["w1 AB1234 trial", "adverse event safety of the trial w2", "what is w3", "w4 w5", "trial of w1 w2 w3 w4 w5 w6 and of w1 w2 w3"]
    queries = queries_search.hashed(spark.createDataFrame(list(enumerate(asked)), "query_id int, query_text string"))
    chunks = vectors.embed(docs, "content")
    got = sorted(map(tuple, retrieval.route(chunks, queries, 3, queries_search.hashed, 0.1).collect()))
    assert len(seen) == 1 and {r[1] for r in got} == {"keyword", "semantic", "hybrid", "adaptive"}
    alone = {
        "keyword": retrieval.keyword(docs, queries.where("query_id = 0"), 3), "semantic": retrieval.semantic(chunks, queries.where("query_id = 1"), 3, queries_search.hashed, 0.1),
        "hybrid": retrieval.hybrid_adaptive(chunks, queries.where("query_id = 2"), 3, 0.1), "adaptive": retrieval.adaptive(chunks, queries.where("query_id > 2"), 3, queries_search.hashed, 0.1),
    }
    assert got == sorted((r["query_id"], n, r["id"], r["score"], r["rank"]) for n, found in alone.items() for r in found.collect())


@pytest.mark.parametrize(("by", "clip"), [("bm25", 10.0), ("bm25", None), ("rank", None)])
def test_many_queries_send_few_rows(spark, monkeypatch, by, clip):
    """Each task sent the best of its own rows; now what k of all rows reach is known before. The terms that most have and the others meet the rows in two ways."""
    rng = np.random.default_rng(11)
    text = lambda n: " ".join(f"w{int(x)}" for x in rng.zipf(1.4, n) % 300)
    docs = spark.createDataFrame([(i, text(rng.integers(1, 60))) for i in range(900)], "id bigint, content string").repartition(6)
    queries = spark.createDataFrame([(i, text(rng.integers(1, 8))) for i in range(150)], "query_id bigint, query_text string")
    terms = lexical.query_terms(queries)
    want = lexical.bm25(docs, queries, clip=clip) if by == "bm25" else lexical.ts_rank(lexical.asked_counts(docs, terms), terms, "any")
    want = sorted(map(tuple, lexical.top(want, 5).collect()))
    sent = {}
    monkeypatch.setattr(lexical, "ASKED", 64)
    monkeypatch.setattr(lexical, "COMMON", 6)
    whole = lexical.top
    for seeded in (1, 1 << 40):
        monkeypatch.setattr(lexical, "SEEDED", seeded)
        monkeypatch.setattr(lexical, "top", lambda found, k: sent.setdefault(seeded, found.count()) and whole(found, k))
        assert sorted(map(tuple, lexical.best(docs, queries, 5, by, clip=clip).collect())) == want
    assert sent[1] < sent[1 << 40]


def test_vector_search_starts_from_what_others_reach(spark, monkeypatch):
    """The same for vectors, whose products are of single precision before the best are scored exactly; copies of vectors tie."""
    rng = np.random.default_rng(12)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(1500, 16)))]
    rows += [(2000 + i, v) for i, v in rows[:40]]
    frame = spark.createDataFrame(rows, "id bigint, embedding array<double>").repartition(6)
    asked = frame.where("id % 7 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    plain = np.array([v for _, v in rows])
    plain /= np.sqrt((plain**2).sum(1, keepdims=True))
    want = []
    for at, (q, _) in enumerate(rows):
        if q % 7 == 0:
            near = sorted((-round(float(s), 6), i) for (i, _), s in zip(rows, plain @ plain[at]) if i != q)[:5]
            want += [(q, i, -s, n + 1) for n, (s, i) in enumerate(near)]
    monkeypatch.setattr(vectors, "SEEDED", 1)
    monkeypatch.setattr(vectors, "ASKED", 50)
    for block in (1 << 20, 60):
        found = vectors.search_blocks(frame, asked, 5, block, threshold=-1.0, exclude_self=True)
        got = sorted(map(tuple, found.collect()))
        assert [r[:2] + r[3:] for r in got] == [r[:2] + r[3:] for r in sorted(want)] and [r[2] for r in got] == pytest.approx([r[2] for r in sorted(want)], abs=1.1e-6)


def test_passing_keeps_what_exact_scores_could():
    rng = np.random.default_rng(13)
    exact = rng.normal(size=(500, 3))
    single = exact.astype(np.float32)
    row, query = blocks.passing(single, np.full(3, -np.inf, np.float32), 4, 1e-6)
    for q in range(3):
        assert set(np.argsort(-exact[:, q])[:4]) <= set(row[query == q].tolist()) and (query == q).sum() < 20
    best = blocks.Best(2, 1, 1e-9, floor=np.array([0.5]))
    assert best.kept(np.array([0.4, 0.6, 0.5]), np.zeros(3, int)).tolist() == [False, True, True] and best.least(np.zeros(1, int))[0] == pytest.approx(0.5)
    assert best.kept(np.array([0.7, 0.55, 0.8]), np.zeros(3, int)).tolist() == [True, False, True]


def test_covers_are_found_where_the_tokens_are(spark, monkeypatch):
    """All tokens and all hits moved."""
    rng = np.random.default_rng(14)
    docs = [(i, " ".join(f"w{int(x)}" for x in rng.integers(0, 9, rng.integers(0, 40)))) for i in range(80)] + [(100, None), (101, ""), (102, "w1"), (None, "w1 w2")]
    asked = spark.createDataFrame([(1, "w1"), (2, "w1 w2"), (3, "w3 w4 w5"), (4, "w1 nobody"), (5, ""), (6, None), (7, "w2 w2 w7")], "query_id int, query_text string")
    terms = lexical.query_terms(asked)
    for rows in (docs, [*docs, (3, "w1 w3 w2"), (200, "w1"), (200, "w2")]):
        frame = spark.createDataFrame(rows, "id bigint, content string").repartition(3)
        want = sorted(map(tuple, lexical.top(lexical.cover_density(lexical.postings(frame.where("id is not null")), terms), 6).collect()))
        got = sorted(map(tuple, lexical.best_covers(frame, asked, 6).collect()))
        assert got == want and len(got) > 20
        monkeypatch.setattr(lexical, "TABLE_CELLS", 32)
        assert sorted(map(tuple, lexical.best_covers(frame, asked, 6).collect())) == want
        monkeypatch.undo()
    assert lexical.best_covers(frame, asked.limit(0), 6).count() == lexical.best_covers(frame.limit(0), asked, 6).count() == 0
    monkeypatch.setattr(lexical, "postings", None)
    assert catalog.QUERIES["english_cover_density"](spark, "/root/testdata/sf0.001").count() > 0


def test_stored_postings_are_scored_where_they_lie(spark, monkeypatch):
    """Postings moved twice while they were made, and each of them for each of its queries in a search. Regions that several tasks read still add up."""
    monkeypatch.setattr(inverted, "REGION", 16)
    monkeypatch.setattr(inverted, "ASKED", 7)
    rng = np.random.default_rng(15)
    docs = spark.createDataFrame([(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.5, rng.integers(0, 40)) % 90)) for i in range(300)], "id bigint, content string").repartition(3)
    asked = spark.createDataFrame([(i, " ".join(f"w{int(x)}" for x in rng.integers(0, 90, 6))) for i in range(30)], "query_id bigint, query_text string")
    whole = inverted._region_postings
    assert "Exchange" not in whole(spark.createDataFrame([(1, 1, ["a"])], "docno bigint, dl int, terms array<string>"))._jdf.queryExecution().executedPlan().toString()
    for dealt in (whole, lambda rows: whole(rows).repartition(5)):
        monkeypatch.setattr(inverted, "_region_postings", dealt)
        path = inverted.build(docs, scratch_path(spark, "index"))
        inverted.update(path, docs.where("id % 3 = 0").withColumn("content", F.concat("content", F.lit(" w1"))))
        now = docs.withColumn("content", F.when(F.col("id") % 3 == 0, F.concat("content", F.lit(" w1"))).otherwise(F.col("content")))
        assert sorted(map(tuple, inverted.bm25(spark, path, asked, 4).collect())) == sorted(map(tuple, lexical.top(lexical.bm25(now, asked), 4).collect()))


def test_files_are_listed_in_tasks(spark, tmp_path, monkeypatch):
    """The driver held the state of every file. Paths, times and what is left out are those of Spark's scan."""
    for name in ("a.txt", "b/c d.md", "b/é/x.json", "b/.hidden.txt", "_skip/y.txt", "_k=1/z.csv", "b/other.bin", "b/_z.txt", "e.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"\xff text of " + name.encode())
    (tmp_path / "e.txt").write_bytes(b"")
    scan = files._scan
    want = scan(spark, str(tmp_path), True, files.EXTENSIONS).select("path", F.col("content").cast("string"), "modificationTime")
    want, sizes = sorted(map(tuple, want.collect())), sorted(map(tuple, scan(spark, str(tmp_path), True, None).select("path", "length").collect()))
    monkeypatch.setattr(files, "_scan", None)
    for path in (str(tmp_path), f"file://{tmp_path}/", [f"{tmp_path}/"]):
        assert sorted(map(tuple, files.files(spark, path).collect())) == want and len(want) == 4
        assert sorted((r["path"], r["size"]) for r in files.rejected(spark, path, max_bytes=-1).collect()) == sizes
    (tmp_path / "none").mkdir()
    assert files.files(spark, str(tmp_path / "none")).count() == 0
    monkeypatch.undo()
    assert files.files(spark, f"{tmp_path}/*.txt").count() == 1 and files.files(spark, str(tmp_path / "a.txt")).count() == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.files(spark, str(tmp_path / "nowhere")).collect()
