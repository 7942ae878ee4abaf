"""Hand-checked results of single operators."""

import pytest
from pyspark.sql import functions as F

from brindle.functions import scalars as S
from brindle.functions import text as T
from brindle.operators import chunking, export, fusion, graph, lexical, store, vectors
from brindle.plans import retrieval
from brindle.sources import clinical, files


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def ranked(spark, ids):
    return spark.createDataFrame([(1, x, i + 1) for i, x in enumerate(ids)], "query_id int, id string, rank int")


def scores(df):
    return {r["id"]: round(r["score"], 6) for r in df.collect()}


def test_cosine(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("c", [0.0, 1.0]), ("z", [0.0, 0.0])], "id string, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, query_embedding array<double>")
    assert scores(vectors.search(rows, q, 10, 0.0)) == {"a": 1.0, "b": 0.707107, "c": 0.0, "z": 0.0}
    assert scores(vectors.search(rows, q, 10, 0.707107, strict=True)) == {"a": 1.0}
    assert scores(vectors.search_blocks(rows, q, 1, block=1, threshold=0.0)) == {"a": 1.0}


def test_rank_fusion(spark):
    dense, text = ranked(spark, ["x", "y"]), ranked(spark, ["y", "z"])
    assert scores(fusion.weighted_rrf(dense, text, 0.7)) == {"x": 0.011475, "y": 0.016208, "z": 0.004839}
    assert scores(fusion.rrf([dense, text])) == {"x": 0.016393, "y": 0.032522, "z": 0.016129}
    assert scores(fusion.rrf([text, dense])) == scores(fusion.rrf([dense, text]))
    d = spark.createDataFrame([(1, "x", 0.9), (1, "y", 0.8)], "query_id int, id string, score double")
    s = spark.createDataFrame([(1, "y", 0.5), (1, "z", 1.0)], "query_id int, id string, score double")
    assert scores(fusion.linear(d, s)) == {"x": 0.63, "y": 0.71, "z": 0.3}


def test_windows(spark):
    docs = spark.createDataFrame([("d", "a b c d e f g h i j"), ("e", "  "), ("n", None)], "document_id string, content string")
    starts = lambda to_end: [r["start_token"] for r in chunking.token_windows(docs, 4, 2, to_end).orderBy("start_token").collect()]
    assert starts(False) == [0, 2, 4, 6, 8] and starts(True) == [0, 2, 4, 6]
    with pytest.raises(ValueError):
        chunking.token_windows(docs, 4, 4)


def test_packing_and_markdown(spark):
    text = "a b c\n\nd e f\n\ng h i j k\n\nl"
    docs = spark.createDataFrame([("d", text)], "document_id string, content string")
    assert [r["token_count"] for r in chunking.paragraph_chunks(docs, 6).orderBy("chunk_index").collect()] == [6, 6]
    md = spark.createDataFrame([("m", "lead\n# One\nfirst words\n## Two\nsecond"), ("o", "lead\n# Only\ntail")], "document_id string, content string")
    got = {(r["document_id"], r["section_title"], r["content"]) for r in chunking.markdown_chunks(md).collect()}
    assert got == {("m", "One", "first words"), ("m", "Two", "second"), ("o", None, "lead"), ("o", "Only", "tail")}


def test_json_chunks(spark):
    docs = spark.createDataFrame([("o", '{"a": {"b": 1}, "c": "x"}'), ("a", '[{"x": 1}, 2]'), ("p", "7"), ("bad", '{"a": 1,}')], "document_id string, content string")
    got = {(r["document_id"], r["path"], r["content"], r["parsed"]) for r in chunking.json_chunks(docs).collect()}
    assert got == {("o", "a.b", "1", True), ("o", "c", "x", True), ("a", "0", '{"x":1}', True), ("a", "1", "2", True), ("p", "text", "7", True), ("bad", "text", '{"a": 1,}', False)}
    assert one(spark, S.is_json(chunking.lenient_json("x")), x='[{"a": 1,},]')


def test_query_analysis(spark):
    rows = spark.createDataFrame([("AB1234 adverse",), ("what is safety",), ("lab results",), ("safety of drug",)], "q string")
    assert [r[0] for r in rows.select(T.analyze_query("q")["strategy"]).collect()] == ["keyword", "hybrid", "adaptive", "adaptive"]
    assert one(spark, T.key_terms("q"), q="the lab test for safety") == ["test", "safety"]
    assert one(spark, T.adaptive_weight("q"), q="safety of drug") == 0.8


def test_diversify(spark):
    def kept(texts):
        rows = spark.createDataFrame([(1, i, 1.0 - i / 10, t) for i, t in enumerate(texts)], "query_id int, id int, score double, content string")
        return sorted(r["id"] for r in fusion.diversify(rows).collect())

    assert kept(["a b c d", "a b c d", "x y", "p q"]) == [0, 2, 3]
    assert kept(["a b c d", "a b c d", "x y"]) == [0, 1, 2]


def test_redaction_and_detection(spark):
    text = "Call 555-123-4567 on 2024-01-02, id AB1234"
    red = one(spark, T.redact_phi("x"), x=text)
    assert red == "Call [REDACTED] on [REDACTED], id [REDACTED]" and one(spark, T.redact_phi("x"), x=red) == red
    found = one(spark, T.phi_matches("x"), x=text)
    assert all(text[m["start"] : m["end"]] == m["text"] for m in found) and {m["type"] for m in found} >= {"Phone", "Date", "Medical Record"}


def test_dates_ages_sizes(spark):
    d = lambda x: str(one(spark, S.parse_date("x").cast("date"), x=x))
    assert d("02/03/2024") == "2024-02-03" and d("13/03/2024") == "2024-03-13" and d("soon") == "None"
    a = lambda r: one(spark, S.age(F.col("x").cast("date"), F.lit(r).cast("date")), x="2000-06-15")
    assert a("2024-06-14") == 23 and a("2024-06-15") == 24
    assert one(spark, S.format_bytes("x"), x=1536) == "1.50 KB" and one(spark, S.format_duration("x"), x=0.0025) == "2ms" and one(spark, S.format_duration("x"), x=90.0) == "1.50m"


def test_study_ids(spark):
    rows = spark.createDataFrame([("STUDY001_SAP.md", "x"), ("STUDY001_DM.csv", "STUDYID,USUBJID\nSTUDY001,STUDY001001"), ("TEST001_SAP.md", "x"), ("TEST001_DM.csv", "STUDYID,USUBJID\n")], "n string, c string")
    assert [r[0] for r in rows.select(T.study_id("n", "c")).collect()] == ["001_SAP", "001001", None, "ID"]
    assert one(spark, T.study_id_strict("n"), n="STUDY001_DM.csv") == "STUDY001"


def test_entities(spark):
    docs = spark.createDataFrame([(1, "usubjid=AB1234 given"), (2, "patient AB1234 was fine"), (3, "Subject AB1234 received aspirin. drug ASPIRIN")], "document_id int, content string")
    got = {(r["document_id"], r["type"], r["name"]): r["confidence"] for r in graph.advanced_entities(docs).collect()}
    assert got[1, "subject", "AB1234"] == 1.0
    rel = graph.basic_relations(docs, graph.basic_entities(docs)).collect()
    assert [(r["source"], r["type"], r["target"]) for r in rel] == [("AB1234", "received", "ASPIRIN")]
    assert not graph.basic_relations(docs, graph.basic_entities(docs).where("type <> 'treatment'")).count()


def test_graph_small(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6)], "a int, b int")
    nodes = spark.createDataFrame([(i,) for i in range(1, 8)], "id int")
    parts = {r["id"]: r["component"] for r in graph.components(nodes, edges).collect()}
    assert parts == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 7}
    assert {r["label"] for r in graph.label_propagation(edges, 4).collect()} == {1, 4}
    assert {r["community"] for r in graph.louvain(edges).collect()} == {1, 4}
    assert all(r["coefficient"] == 1.0 for r in graph.clustering(edges).collect())
    assert graph.density(nodes.where("id <= 3"), edges.where("b <= 3")).first()["density"] == 1.0
    path = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a int, b int")
    assert {r["id"]: r["betweenness"] for r in graph.betweenness(path).collect()} == {1: 0.0, 2: 0.666667, 3: 0.666667, 4: 0.0}
    total = graph.pagerank(nodes, edges, 10).agg(F.sum("pagerank")).first()[0]
    assert abs(total - 1) < 1e-6


def test_paths(spark):
    rel = spark.createDataFrame([("1", "a", "b", "t"), ("2", "b", "c", "t"), ("3", "c", "d", "t")], "id string, source_id string, target_id string, type string")
    got = graph.paths(rel, spark.createDataFrame([("a",)], "start string"), 2).collect()
    assert sorted((r["target"], r["hops"]) for r in got) == [("b", 1), ("c", 2)]


def test_community_summary(spark):
    e = spark.createDataFrame([(str(i), "subject" if i < 3 else "lab_test", n) for i, n in enumerate("ABCWXYZ")], "id string, type string, name string")
    m = e.select(F.lit(1).alias("community_id"), F.col("id").alias("entity_id"))
    assert graph.community_summaries(m, e).first()["summary"] == "lab_test: 4 items | subject: A, B, C"


def test_upsert_by_hash_counts(spark):
    kind = "id string, content string, content_hash string, access_count bigint, last_accessed timestamp"
    now = F.lit("2024-01-01").cast("timestamp")
    first = store.upsert_by_hash(spark.createDataFrame([], kind), spark.createDataFrame([("b", "x"), ("a", "x"), ("c", "y")], "id string, content string"), now)
    assert sorted((r["id"], r["access_count"]) for r in first.collect()) == [("a", 1), ("c", 0)]
    second = store.upsert_by_hash(first, spark.createDataFrame([("d", "x")], "id string, content string"), now)
    assert sorted((r["id"], r["access_count"]) for r in second.collect()) == [("a", 2), ("c", 0)]


def test_baseline(spark):
    rows = spark.createDataFrame([("s", 1, 50.0), ("s", 2, 55.0)], "u string, v int, x double")
    assert [(r["CHG"], r["PCHG"], r["ABLFL"]) for r in clinical.baseline_changes(rows, ["u"], "v", "x").orderBy("v").collect()] == [(0.0, 0.0, "Y"), (5.0, 10.0, "")]


def test_model_seams(spark):
    rows = spark.createDataFrame([(1, i, f"text {i}", "q", i) for i in range(1, 7)], "query_id int, id int, content string, query_text string, rank int").withColumn("score", F.lit(0.0))
    best = fusion.cross_encoder(rows, 2, lambda q, c: c.str[-1].astype(float)).orderBy("rank").collect()
    assert [r["id"] for r in best] == [6, 5]
    assert fusion.rerank_if_many(rows.where("id < 4"), 5).count() == 3
    made = retrieval.answer(retrieval.prompts(rows), lambda p: ["yes"] * len(p)).first()
    assert made["answer"] == "yes" and made["tokens_used"] > 1 and "[5]" in made["prompt"] and "[6]" not in made["prompt"]
    assert vectors.embed(rows, "content", lambda b: [[1.0, 2.0]] * len(b)).first()["embedding"] == [1.0, 2.0]


def test_files_and_backups(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/STUDY001_sdtm.csv").write_text("SUBJID\n001\n")
    (tmp_path / "in/sub/a.md").write_text("# A")
    (tmp_path / "in/x.bin").write_text("no")
    got = files.documents(files.files(spark, str(tmp_path / "in"))).collect()
    assert sorted((r["title"], r["document_type"]) for r in got) == [("STUDY001_sdtm", "sdtm"), ("a", "other")]
    assert files.csv(spark, str(tmp_path / "in/STUDY001_sdtm.csv"), "SUBJID string").first()[0] == "001"
    for name in ("2024-01-01", "2024-02-01"):
        store.backup({"t": spark.range(3)}, str(tmp_path / "b"), name)
    assert store.list_backups(spark, str(tmp_path / "b")) == ["2024-02-01", "2024-01-01"]
    assert store.cleanup_backups(spark, str(tmp_path / "b"), "2024-01-15") == ["2024-01-01"]
    assert store.restore(spark, str(tmp_path / "b"), "2024-02-01", ["t"])["t"].count() == 3
    store.save(spark.range(2), str(tmp_path / "t"))
    store.save(store.load(spark, str(tmp_path / "t")).where("id = 1"), str(tmp_path / "t"))
    store.save(spark.range(5), str(tmp_path / "t"))
    assert store.load(spark, str(tmp_path / "t")).count() == 5 and store.saved_versions(spark, str(tmp_path / "t")) == [2, 3]
    assert export.writer("csv") is export.csv_sources
    with pytest.raises(ValueError):
        export.writer("pdf")


def test_deep_set_keeps_siblings(spark):
    import json

    from brindle.functions import scalars as S

    rows = spark.createDataFrame([('{"a":{"x":1,"b":0},"c":2}',), ('{"a":"text"}',), ("no json",), (None,), ('{"a":{"b":{"deep":true}}}',)], "j string")
    got = [json.loads(r[0]) for r in rows.select(S.deep_set("j", "a.b", F.lit('q"v'))).collect()]
    v = 'q"v'
    assert got == [{"a": {"x": 1, "b": v}, "c": 2}, {"a": {"b": v}}, {"a": {"b": v}}, {"a": {"b": v}}, {"a": {"b": v}}]


def test_entity_context_is_where_the_match_is(spark):
    docs = spark.createDataFrame([(1, "salty water, malted. " + "x" * 200 + " alt was high")], "document_id int, content string")
    got = [r for r in graph.advanced_entities(docs).collect() if r["name"] == "ALT"]
    assert len(got) == 1 and got[0]["context"] == "x" * 99 + " alt was high"


def test_ingest_refuses_lost_history(spark, tmp_path):
    from brindle.streaming import ingest

    (tmp_path / "in").mkdir()
    spark.createDataFrame([("1", "a")], "id string, content string").write.parquet(str(tmp_path / "table/v=-7"))
    spark.createDataFrame([("2", "b")], "id string, content string").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, content string").parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="missing"):
        ingest.start_ingest(stream, str(tmp_path / "table"), str(tmp_path / "check")).awaitTermination()


def test_sample_graph_and_graph_queries(spark):
    entities, relations = graph.sample_graph(spark)
    assert graph.valid_relations(relations, entities).count() == 2 and graph.constraint_violations(entity=(entities, "id")).isEmpty()
    asked = spark.createDataFrame([(1, "what had STUDY001001", "study001001")], "query_id int, query_text string, pattern string")
    communities = spark.createDataFrame([(7, 0, "subject: STUDY001001")], "community_id int, level int, summary string")
    got = graph.query_graph("local", asked, entities, relations, communities).collect()
    assert [r["triple"] for r in got] == ["STUDY001001 had ALT", "STUDY001001 received DRUG_A"]
    assert [r["community_id"] for r in graph.query_graph("global", asked, entities, relations, communities).collect()] == [7]
    assert graph.query_graph("drift", asked, entities, relations, communities).first()["context"][-1] == "subject: STUDY001001"
    with pytest.raises(ValueError):
        graph.query_graph("other", asked, entities, relations, communities)


def test_result_cache(spark):
    queries = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "query_id int, query_text string")
    keys = {"mode": F.lit("hybrid"), "k": F.lit(2), "filters": F.lit(""), "study_id": F.lit(None).cast("string")}
    asked = []

    def search(q):
        asked.append(sorted(r["query_id"] for r in q.collect()))
        return q.select("query_id", F.col("query_id").cast("string").alias("id"), F.lit(0.5).alias("score"), F.lit(1).alias("rank"))

    empty = spark.createDataFrame([], "key bigint, id string, score double, rank int")
    got, new = retrieval.with_result_cache(empty, queries, search, keys)
    assert sorted((r["query_id"], r["id"]) for r in got.collect()) == [(1, "1"), (2, "2"), (3, "2")] and new.count() == 2
    more = queries.unionByName(spark.createDataFrame([(4, "c")], "query_id int, query_text string"))
    got, new = retrieval.with_result_cache(spark.createDataFrame(new.collect(), new.schema), more, search, keys)
    assert sorted((r["query_id"], r["id"]) for r in got.collect()) == [(1, "1"), (2, "2"), (3, "2"), (4, "4")]
    assert asked == [[1, 2], [4]] and new.count() == 1


def test_code_ids_and_objects(spark):
    rows = spark.createDataFrame([(1, "make a table", 1, "text")], "query_id int, query_text string, rank int, content string")
    fence = "`" * 3
    got = retrieval.generated_code(rows, lambda prompts: [f"first {fence}x = 1{fence} last" for _ in prompts]).first()
    assert got["code"] == ["x = 1"] and got["explanation"] == "first  last"
    ids = [r[0] for r in spark.range(50).select(S.generate_id()).collect()]
    assert len(set(ids)) == 50 and all(len(i) == 16 and int(i, 16) >= 0 for i in ids)
    sent = store.insert_objects(spark.range(250).repartition(2), len, 100).collect()
    assert sum(r["n"] for r in sent) == 250 and max(r["n"] for r in sent) <= 100


def test_analysis_tables(spark):
    dm = clinical.subjects(spark, "STUDY001", 20)
    adsl = clinical.subject_level(dm)
    assert adsl.count() == 20 and adsl.where("TRT01A <> TRT01P OR datediff(TRTEDT, TRTSDT) <> TRTDURD OR BMIBL NOT BETWEEN 10 AND 50").count() == 0
    adlb = clinical.laboratory_analysis(clinical.findings(dm, clinical.LABS, "LB", 3), adsl)
    rows = adlb.collect()
    assert len(rows) == 20 * len(clinical.LABS) * 3
    base = {(r["USUBJID"], r["PARAMCD"]): r["AVAL"] for r in rows if r["AVISITNUM"] == 1}
    for r in rows:
        first = base[r["USUBJID"], r["PARAMCD"]]
        assert r["BASE"] == first and r["ABLFL"] == ("Y" if r["AVISITNUM"] == 1 else "")
        assert abs(r["CHG"] - (r["AVAL"] - first)) < 1e-6


def test_rank_counts_all_occurrences(spark):
    counts = spark.createDataFrame([(str(n), n, "word", n) for n in (1, 2, 50, 51, 60, 1000, 200_000)], "id string, dl int, term string, tf long")
    terms = spark.createDataFrame([(1, "word", 1)], "query_id int, term string, n_terms int")
    want = {str(n): round(0.1 * sum(1 / i**2 for i in range(1, n + 1)) / 1.64493406685, 6) for n in (1, 2, 50, 51, 60, 1000, 200_000)}
    assert scores(lexical.ts_rank(counts, terms)) == want
    assert want["50"] < want["51"] < want["60"] < want["1000"] < want["200000"]
