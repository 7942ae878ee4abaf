"""What the findings of round 3 said, in small."""

import math
import re
import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from brindle.functions import scalars as S
from brindle.operators import blocks, graph, lexical, quantized, store, substrings, vectors
from brindle.plans import catalog, ingestion, queries_ingest
from brindle.sources import files


def test_durations_round_the_exact_value(spark):
    """1.225 is a little more than that in binary, 6.345 a little less."""
    values = [1.225, 6.365, 6.345, 1.125, 1.375, 59.995, 74.7, 3599.0, 3600 * 2.675, 7e9, 1e17]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double").orderBy("i").select(S.format_duration("x")).collect()]
    assert got == [f"{v:.2f}s" if v < 60 else f"{v / 60:.2f}m" if v < 3600 else f"{v / 3600:.2f}h" for v in values]


def test_rounding_keeps_the_sign_of_zero(spark):
    rows = spark.createDataFrame([(0, -0.000001), (1, 0.000001), (2, -0.5), (3, 0.0)], "i int, x double").orderBy("i")
    got = [r[0] for r in rows.select(vectors.rounded(F.col("x"), 5)).collect()]
    assert [(abs(v), math.copysign(1, v)) for v in got] == [(0, -1), (0, 1), (0.5, -1), (0, 1)]


def test_codes_lose_no_near_vector(spark):
    rng = np.random.default_rng(7)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(3000, 64)))]
    frame = spark.createDataFrame(rows, "id bigint, embedding array<double>").repartition(3)
    asked = frame.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    want = sorted(map(tuple, vectors.search(frame, asked, 5, -1.0).collect()))
    index = quantized.build(frame)
    assert sorted(map(tuple, quantized.search(index, frame, asked, 5, 20).collect())) != want
    assert sorted(map(tuple, quantized.search_exact(index, frame, asked, 5, 20).collect())) == want


def test_codes_leave_out_far_vectors(spark, monkeypatch):
    rng = np.random.default_rng(8)
    middle = rng.normal(size=(20, 16))
    rows = [(i, (middle[i % 20] + rng.normal(size=16) * 0.02).tolist()) for i in range(1000)]
    frame = spark.createDataFrame(rows, "id bigint, embedding array<double>")
    asked = frame.where("id in (0, 20)").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    index, seen, whole = quantized.build(frame, 4), [], vectors.search
    want = sorted(map(tuple, whole(frame, asked, 5, -1.0).collect()))
    monkeypatch.setattr(vectors, "search", lambda chunks, *rest: seen.append(chunks.count()) or whole(chunks, *rest))
    assert sorted(map(tuple, quantized.search_exact(index, frame, asked, 5).collect())) == want and seen[0] <= 200


def test_documents_share_folders(spark, tmp_path):
    """A folder a document took 30 s to list for 51,282 documents, and Spark's writer 188 s to write."""
    path = queries_ingest.written_documents(spark, "/root/testdata/sf0.001")
    found = [r[0] for r in files._scan(spark, path, True, ("txt",)).select("path").collect()]
    assert len(found) == 200 and len({p.rpartition("/")[0] for p in found}) == 1


def test_each_row_is_a_file(spark, tmp_path):
    rows = spark.createDataFrame([("a/x.txt", "é\n"), ("a/y.txt", None), ("b/x.gz", "plain")], "name string, content string")
    assert files.write_each(rows, f"file://{tmp_path}/out") == 3 and files.write_each(rows.limit(0), f"file://{tmp_path}/none") == 0
    assert {str(p.relative_to(tmp_path / "out")): p.read_text() for p in (tmp_path / "out").rglob("*.*")} == {"a/x.txt": "é\n", "a/y.txt": "", "b/x.gz": "plain"}


def test_first_paths_of_a_hub(spark, monkeypatch):
    """Against all paths; the paths to a hub's thousand neighbours are no rows."""
    rng = np.random.default_rng(5)
    rows = [(f"r{i}", f"n{a}", f"n{b}", "x") for i, (a, b) in enumerate(rng.integers(0, 7, (16, 2)))] + [(f"s{i}", "n0", "n1", "x") for i in range(4)]
    plain = spark.createDataFrame(rows, "id string, source_id string, target_id string, type string")
    start = spark.createDataFrame([(f"n{i}",) for i in range(7)], "start string")
    for limit in (1, 3, 9, 100):
        for direction in ("both", "out"):
            got = sorted(map(tuple, graph.paths(plain, start, 3, None, direction, limit).collect()))
            every = sorted(map(tuple, graph.paths(plain, start, 3, None, direction, None).select("start", "hops", "target").collect()))
            want = [(s, t, h) for i, (s, h, t) in enumerate(every) if sum(x[0] == s for x in every[:i]) < limit]
            assert got == sorted(want)
    star = spark.createDataFrame([(f"r{i}", f"n{i:04}", "hub", "x") for i in range(1000)], "id string, source_id string, target_id string, type string")
    seen, whole = [], graph._longer
    monkeypatch.setattr(graph, "_longer", lambda now, steps: seen.append(whole(now, steps)) or seen[-1])
    ends = graph.paths(star, star.select(F.col("source_id").alias("start")), 3, limit=20)
    assert ends.count() == 20_000 and max(p.count() for p in seen) < 40_000


def test_only_documents_with_all_terms_go_on(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b"), (3, "c a x"), (4, None), (5, "a"), (5, "c"), (6, "c c A")], "id bigint, content string")
    asked = spark.createDataFrame([(1, "a c"), (2, "x y")], "query_id bigint, query_text string")
    held = lexical.holding_all(docs, asked)
    assert sorted(r["id"] for r in held.collect()) == [1, 3, 5, 5, 6]
    terms = lexical.query_terms(asked)
    found = lambda rows: sorted(map(tuple, lexical.match(lexical.asked_counts(rows, terms), terms).collect()))
    assert found(held.where("id <> 5")) == found(docs.where("id <> 5")) and [r[1] for r in found(docs)] == [1, 3, 5, 6]


def test_postings_of_a_long_document(spark):
    """Each distinct term went through all tokens: 60,000 of them took 3.6 thousand million comparisons of strings."""
    words = [f"w{i % 59_999}" for i in range(60_000)]
    frame = spark.createDataFrame([(1, " ".join(words)), (2, None), (3, ""), (4, "B a b")], "id int, content string")
    began = time.monotonic()
    got = {(r["id"], r["term"], r["tf"], r["dl"]) for r in lexical.term_rows(frame).collect()}
    assert got == {(1, w, n, 60_000) for w, n in Counter(words).items()} | {(4, "a", 1, 3), (4, "b", 2, 3)}
    assert time.monotonic() - began < 30


def test_matches_do_not_repeat_their_text(spark, monkeypatch):
    """Each match carried its row's whole text, and a batch's matches were put together at once."""
    monkeypatch.setattr(substrings, "MATCHES", 3)
    frame = spark.createDataFrame([(1, "abab"), (2, "b"), (3, None)], "id int, t string")
    given = spark.createDataFrame([("a",), ("b",), ("ab",), ("",), (None,)], "pattern string")
    found = substrings.occurrences(frame, "t", given)
    assert found.columns == ["id", "pattern", "n"]
    assert sorted(map(tuple, found.collect())) == [(1, "a", 2), (1, "ab", 2), (1, "b", 2), (2, "b", 1)]


def test_few_rows_of_a_task_go_on():
    """Each batch sent its own best k of each query on: of 100 batches, 500 rows of each query instead of about k ln(n / k)."""
    rng = np.random.default_rng(9)
    scores = np.round(rng.random((10_000, 7)), 3)
    scores[:, 6] = -np.inf
    best, sent = blocks.Best(5, 7, 1e-9), []
    for a in range(0, 10_000, 100):
        row, query = best.rows(scores[a : a + 100, ::-1], np.arange(7)[::-1])
        sent += zip((row + a).tolist(), (6 - query).tolist())
    for q in range(6):
        least = np.sort(scores[:, q])[-5]
        assert {r for r in np.flatnonzero(scores[:, q] >= least)} <= {r for r, of in sent if of == q}
    assert not [q for _, q in sent if q == 6] and len(sent) < 6 * 200
    capped = blocks.Best(1, 1, 1e-9, 1.0)
    assert [len(capped.rows(np.array([[x]]))[0]) for x in (3.0, 2.0, 5.0, 0.5)] == [1, 1, 1, 0]


def test_lists_are_searched_in_products(spark, monkeypatch):
    """Pairs of queries and vectors were rows of a join. Also in several blocks, with vectors of two lengths."""
    rng = np.random.default_rng(10)
    rows = [(i, rng.normal(size=8 if i % 9 else 5).tolist(), i % 4) for i in range(400)]
    frame = spark.createDataFrame(rows, "id bigint, embedding array<double>, list_id int").repartition(3)
    asked = frame.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    centroids = spark.createDataFrame([(i, [1.0] * 8) for i in range(4)], "list_id int, centroid array<double>")
    want = sorted(map(tuple, vectors.search(frame, asked, 5, -1.0).collect()))
    assert sorted(map(tuple, vectors.ivf_search(frame, centroids, asked, 5, 4).select("query_id", "id", "score", "rank").collect())) == want
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 6)
    assert sorted(map(tuple, vectors.ivf_search(frame, centroids, asked, 5, 4).select("query_id", "id", "score", "rank").collect())) == want
    some = vectors.ivf_search(frame, centroids, asked, 5, 2).select("id").distinct().join(frame, "id").select("list_id").distinct()
    assert {r[0] for r in some.collect()} <= {0, 1, 2, 3}
    plan = vectors.ivf_search(frame, centroids, asked, 5, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_extraction_deals_documents(spark, monkeypatch):
    """All documents of a file were one task's, with all that it found."""
    monkeypatch.setattr(graph, "DOCUMENTS", 10)
    docs = spark.range(100).select(F.col("id").alias("document_id"), F.lit("Drug ASPIRIN, ALT and AST, dataset ADSL. CU0001 received aspirin").alias("content")).coalesce(1)
    found = graph.advanced_entities(docs)
    assert found.count() == docs.count() * found.where("document_id = 7").count() > 0
    assert found.select("document_id", F.spark_partition_id().alias("p")).groupBy("p").agg(F.count_distinct("document_id").alias("n")).agg(F.max("n")).first()[0] < 40
    assert graph.basic_entities(docs).rdd.getNumPartitions() == 10


def test_ranking_sums_pairs_by_id(spark):
    """All pairs of queries and entities were summed in the tasks of the entities' files, before they moved by query."""
    related = spark.range(1000).select(F.col("id"), F.lit("t").alias("type"), F.lit("n").alias("name")).coalesce(1).crossJoin(spark.range(3).withColumnRenamed("id", "query_id"))
    asked = spark.createDataFrame([(0, "t", "x"), (1, "x", "n"), (2, "x", "x")], "query_id bigint, q_type string, q_name string")
    scores = spark.range(1000).select("id", (F.col("id") % 10).cast("double").alias("pagerank"), F.lit(0.0).alias("betweenness"))
    found = graph.rank_entities(related, asked, scores, 2)
    assert sorted(map(tuple, found.collect())) == [(q, i, s + 2.7, n) for q, s in ((0, 0.5), (1, 1.0), (2, 0.0)) for i, n in ((9, 1), (19, 2))]
    assert not re.search(r"hashpartitioning\(query_id#\d+L?, id#", found._jdf.queryExecution().executedPlan().toString())


def _by_hand(pairs, n):
    """Betweenness by all shortest paths of each pair."""
    near = {i: [b for a, b in pairs if a == i] + [a for a, b in pairs if b == i] for i in range(n)}
    score = dict.fromkeys(range(n), 0.0)
    for s in range(n):
        far, count, order = {s: 0}, Counter({s: 1}), [s]
        for u in order:
            for v in near[u]:
                if v not in far:
                    far[v] = far[u] + 1
                    order.append(v)
                count[v] += count[u] if far[v] == far[u] + 1 else 0
        owed = Counter()
        for v in reversed(order[1:]):
            for u in near[v]:
                owed[u] += count[u] / count[v] * (1 + owed[v]) if far[u] == far[v] - 1 else 0
            score[v] += owed[v]
    return score


def test_trees_need_no_accumulation(spark, monkeypatch):
    """Every node was a source, though trees that hang on a graph add to it by their sizes alone; here two graphs with trees, and a tree."""
    rng = np.random.default_rng(11)
    pairs = {(0, 1), (1, 2), (2, 3), (0, 3), (1, 3), (30, 31), (31, 32), (30, 32), (50, 51), (51, 52), (51, 53), (53, 54), (60, 61)}
    pairs |= {(int(rng.integers(0, i)), i) for i in range(4, 30)} | {(int(rng.integers(30, i)), i) for i in range(33, 50)}
    nodes = sorted({x for p in pairs for x in p})
    at = {x: i for i, x in enumerate(nodes)}
    want = _by_hand([(at[a], at[b]) for a, b in pairs], len(nodes))
    scale = (len(nodes) - 1) * (len(nodes) - 2)
    frame = spark.createDataFrame(sorted(pairs), "a bigint, b bigint")
    monkeypatch.setattr(graph, "SMALL_GRAPH_EDGES", 8)
    got = {r["id"]: r["betweenness"] for r in graph.betweenness(frame).collect()}
    assert got.keys() == set(nodes) and max(abs(got[x] - want[at[x]] / scale) for x in nodes) < 1e-6


def test_visible_pairs_do_not_move(spark, monkeypatch):
    """All pairs were made in a task a study, and then moved to be made distinct."""
    monkeypatch.setattr(store, "VISIBLE_PAIRS", 100)
    seen = [(i % 50, f"s{i % 2}" if i < 60 else None) for i in range(80)]
    users = [(i % 40, [f"s{i % 3}", "s0"], ["admin"] if i == 7 else ["read"]) for i in range(60)] + [(None, ["s1"], ["read"]), (None, None, ["admin"]), (99, None, ["read"])]
    rows = spark.createDataFrame(seen, "id bigint, study_id string")
    got = store.visible(rows, spark.createDataFrame(users, "user_id bigint, studies array<string>, permissions array<string>"))
    want = {(u, *r) for u, studies, may in users for r in seen if "admin" in may or r[1] in (studies or []) and r[1] is not None}
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not re.match(r"Aggregate|Repartition", plan) and got.rdd.getNumPartitions() > len(want) // 100
    assert got.where("user_id between 0 and 39").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 600


def test_texts_are_searched_once(spark):
    """Each reading of the entities and relations searched all texts again: six times for a query of the graph."""
    docs = spark.createDataFrame([(1, "Subject CU0001 received aspirin. Drug ASPIRIN"), (2, "Subject CU0002 received placebo. Drug placebo")], "document_id bigint, content string")
    made = ingestion.build_graph(docs)
    asked = spark.createDataFrame([(5, "what about subject CU0002 now")], "query_id bigint, query_text string")
    scores = made["entities"].select("id", F.lit(0.0).alias("pagerank"), F.lit(0.0).alias("betweenness"))
    ranked = ingestion.query_graph(asked, made["entities"], made["relations"], scores)
    names = {(r["type"], r["name"]): r["id"] for r in made["entities"].collect()}
    assert (5, names["subject", "CU0002"]) in {(r["query_id"], r["id"]) for r in ranked.collect()}
    for df in (*made.values(), ranked):
        assert "regexp" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_positions_do_not_repeat_their_text(spark, tmp_path):
    """Each match carried its text and walked through it from its start."""
    texts = [(1, "é Aa, Bb 1999-12-31 xé AB1234" * 2_000), (2, None), (3, ""), (4, "nothing"), (5, "Doe, Jane"), (5, "123-45-6789"), (None, "01/02/2003")]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    found = catalog.QUERIES["phi_positions"](spark, f"file://{tmp_path}")
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(1, 4_000 + 1, True), (5, 2, True), (None, 1, True)], key=str)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_louvain_broadcasts_no_table_of_nodes(spark, monkeypatch):
    """Each round broadcast tables of all nodes, through the driver; here of 400 nodes in 20 cliques."""
    monkeypatch.setattr(graph, "LOUVAIN_FEW", 50)
    edges = spark.createDataFrame([(f"n{r:02}{i:02}", f"n{r:02}{j:02}") for r in range(20) for i in range(20) for j in range(i + 1, 20)], "a string, b string")
    seen, whole = [], graph._moves
    monkeypatch.setattr(graph, "_moves", lambda *given: seen.append(whole(*given)) or seen[-1])
    found = graph.louvain(edges)
    assert {(r["id"], r["community"]) for r in found.collect()} == {(f"n{r:02}{i:02}", f"n{r:02}00") for r in range(20) for i in range(20)}
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert seen and not any("BroadcastHashJoin" in x._jdf.queryExecution().executedPlan().toString() for x in seen)


def test_closeness_walks_the_graph_in_tasks(spark, monkeypatch):
    """Each step of each block was a job of its own; here over a hundred steps of three blocks, hubs, an odd part, and a node of no name."""
    monkeypatch.setattr(graph, "CLOSENESS_BLOCK", 150)
    monkeypatch.setattr(graph, "PACKED_WAYS", 50)
    monkeypatch.setattr(graph, "CLOSENESS_BYTES", 1)  # 64 nodes at once
    pairs = [(i, i + 1) for i in range(120)] + [(120, 1000 + i) for i in range(100)] + [(5, 1000 + 7 * i) for i in range(10)] + [(2000, 2001)]
    near, far = {}, {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    for s in near:
        hops, queue = {s: 0}, [s]
        for u in queue:
            for v in near[u]:
                if v not in hops:
                    hops[v] = hops[u] + 1
                    queue.append(v)
        far[s] = round((len(hops) - 1) / sum(hops.values()) * (len(hops) - 1) / (len(near) + 1), 6)
    nodes = spark.createDataFrame([(i,) for i in [*near, 3000, None]], "id bigint")
    edges = spark.createDataFrame(pairs, "a bigint, b bigint")
    spark.sparkContext.setJobGroup("closeness", "")
    got = {r["id"]: r["closeness"] for r in graph.closeness(nodes, edges, nodes).collect()}
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("closeness")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {**far, 3000: 0.0, None: 0.0}
    assert len(jobs) < 60
    monkeypatch.setattr(graph, "CLOSENESS_EDGES", 0)  # the way of larger graphs
    some = spark.createDataFrame([(a, b) for a, b in pairs if min(a, b) > 110], "a bigint, b bigint")
    ends = graph.both_ways(some).select(F.col("u").alias("id")).distinct()
    joined = sorted(map(tuple, graph.closeness(ends, some, ends).collect()))
    monkeypatch.setattr(graph, "CLOSENESS_EDGES", 1_000)
    assert joined == sorted(map(tuple, graph.closeness(ends, some, ends).collect()))
