"""Files to chunks and graph, and questions to the graph."""

from pyspark.sql import functions as F

from brindle.operators import graph
from brindle.plans import ingestion, retrieval


def test_from_files_to_graph(spark, tmp_path):
    (tmp_path / "ab_protocol.md").write_text("Subject AB1234 received treatment aspirin today. usubjid=AB1234. Lab hemoglobin was fine.")
    (tmp_path / "c.txt").write_text("Patient AB1234 had headache. subject AB1234 again")
    made = ingestion.ingest(spark, str(tmp_path), size=5, overlap=1)
    assert made["documents"].count() == 2
    chunks = made["chunks"]
    assert chunks.count() > 2 and chunks.where(F.size("embedding") != 64).count() == 0
    entities = made["entities"].cache()
    assert entities.where("name = 'AB1234' and type = 'subject'").first()["document_ids"].__len__() == 2
    relations = made["relations"].cache()
    assert graph.valid_relations(relations, entities).count() == relations.count() > 0
    out = ingestion.communities(entities, relations)
    assert out["communities"].count() >= 1
    scores = entities.select("id", F.lit(0.1).alias("pagerank"), F.lit(0.0).alias("betweenness"))
    queries = spark.createDataFrame([(1, "what about subject AB1234")], "query_id int, query_text string")
    ranked = ingestion.query_graph(queries, entities, relations, scores)
    best = ranked.where("rank = 1").join(entities, "id").first()
    assert "AB1234" in best["name"]
    context = ingestion.graph_context(ranked, entities, relations)
    assert "AB1234" in context.first()["graph"]
    results = spark.createDataFrame([(1, "c", "what", "text", 1)], "query_id int, id string, query_text string, content string, rank int")
    assert "Graph: " in retrieval.prompts(results, graph_context=context).first()["prompt"]
    again = ingestion.reembed(chunks, chunks.limit(1).select("id"), lambda b: [[9.0]] * len(b))
    assert again.where(F.size("embedding") == 1).count() == 1 and again.count() == chunks.count()


def test_files_over_the_cap(spark, tmp_path):
    import pytest

    from brindle.sources import files

    (tmp_path / "small.txt").write_text("short")
    (tmp_path / "large.md").write_text("x" * 200)
    (tmp_path / "other.bin").write_text("?")
    folder = str(tmp_path)
    assert {r["path"].rsplit("/", 1)[1]: (r["size"], r["reason"]) for r in files.rejected(spark, folder, max_bytes=100).collect()} == {"large.md": (200, "size"), "other.bin": (1, "extension")}
    assert [r["content"] for r in files.files(spark, folder, max_bytes=100, oversize="skip").collect()] == ["short"]
    with pytest.raises(Exception, match="file too large"):
        files.files(spark, folder, max_bytes=100).collect()
    assert files.files(spark, folder).count() == 2
    with pytest.raises(ValueError):
        files.files(spark, folder, oversize="maybe")
