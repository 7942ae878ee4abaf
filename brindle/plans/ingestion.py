"""Ingestion and graph building: files to documents, chunks with vectors, entities, relations, communities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from brindle.functions import text as T
from brindle.operators import chunking, graph, store, vectors
from brindle.session import materialize
from brindle.sources import files


def ingest(spark: SparkSession, path: str | list[str], size: int = 512, overlap: int = 50, embed: Callable | None = None) -> dict[str, DataFrame]:
    """``documents``, ``chunks`` (with vectors, one for each distinct content), ``entities``, ``relations`` of a folder of files."""
    documents = materialize(files.documents(files.files(spark, path)), "documents")  # the files are read once
    rows = documents.select(F.col("id").alias("document_id"), "content", "document_type", "study_id")
    cut = chunking.token_windows(rows, size, overlap)
    cut = cut.join(rows.select("document_id", "document_type", "study_id"), "document_id").withColumn("content_hash", T.sha256("content"))
    chunks = vectors.embed(cut, "content", embed)
    return {"documents": documents, "chunks": chunks, **build_graph(rows)}


def build_graph(docs: DataFrame) -> dict[str, DataFrame]:
    """Entities and relations of all documents, named by type and name, ready for keyed upserts.

    What the patterns find is written, so texts are searched once, however often the tables are read.
    """
    found = materialize(graph.advanced_entities(docs), "found")
    entities = graph.merge_entities(found)
    names = entities.groupBy("name").agg(F.min("id").alias("id"))
    related = graph.merge_relations(graph.advanced_relations(docs, found))
    ends = lambda c, out: names.select(F.col("name").alias(c), F.col("id").alias(out))
    relations = related.join(ends("subject", "source_id"), "subject").join(ends("object", "target_id"), "object")
    relations = relations.select(T.sha256(F.concat_ws("\x1f", "source_id", "type", "target_id")).alias("id"), "source_id", "target_id", "type", "confidence", "document_ids")
    return {"entities": entities, "relations": relations}


def communities(entities: DataFrame, relations: DataFrame, rounds: int = 5) -> dict[str, DataFrame]:
    """``membership`` and ``communities`` (summary, level 0) by label propagation; running it again gives the same tables."""
    edges = graph.undirected(relations)
    membership = graph.label_propagation(edges, rounds).select(F.col("label").alias("community_id"), F.col("id").alias("entity_id"))
    return {"membership": membership, "communities": graph.community_summaries(membership, entities).withColumn("level", F.lit(0))}


def reembed(chunks: DataFrame, ids: DataFrame, embed: Callable | None = None) -> DataFrame:
    """The chunk table with new vectors for a list of ids."""
    chosen = chunks.join(ids.select("id").distinct(), "id", "left_semi")
    fresh = vectors.embed(chosen.drop("embedding"), "content", embed).select(*[F.col(c).cast(chunks.schema[c].dataType) for c in chunks.columns])
    return store.upsert_chunks(chunks, fresh)


def query_graph(queries: DataFrame, entities: DataFrame, relations: DataFrame, scores: DataFrame, k: int = 10, hops: int = 2) -> DataFrame:
    """(query_id, id, score, rank): entities related to those of each query.

    Up to three entities of the query's text, up to five graph entities for each of them by type and
    name, and what lies within ``hops`` relations of these.
    """
    entities = materialize(entities.select("id", "type", "name"), "entities")  # each is read several times
    relations = materialize(relations.select("id", "source_id", "target_id", "type"), "relations")
    asked = graph.advanced_entities(queries.select(F.col("query_id").alias("document_id"), F.col("query_text").alias("content")))
    asked = asked.withColumn("n", F.row_number().over(W.partitionBy("document_id").orderBy("pos"))).where("n <= 3").select(F.col("document_id").alias("query_id"), F.col("type").alias("q_type"), F.col("name").alias("q_name"))
    asked = materialize(asked, "asked")
    hit = entities.join(asked, (F.col("type") == F.col("q_type")) & F.contains("name", F.col("q_name")))
    hit = hit.withColumn("n", F.row_number().over(W.partitionBy("query_id", "q_type", "q_name").orderBy("name", "id"))).where("n <= 5").select("query_id", F.col("id").alias("start"))
    near = graph.paths(relations, hit.select("start").distinct(), hops).select("start", F.col("target").alias("id")).distinct()
    related = hit.join(near, "start").select("query_id", "id").unionByName(hit.select("query_id", F.col("start").alias("id"))).distinct()
    return graph.rank_entities(related.join(entities.select("id", "type", "name"), "id"), asked, scores, k)


def graph_context(ranked: DataFrame, entities: DataFrame, relations: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, graph): names of the ranked entities and up to ``k`` triples of theirs, as text for a prompt."""
    t = graph.triples(relations, entities).withColumnRenamed("source_id", "id")
    facts = ranked.join(t, "id").select("query_id", "triple").distinct()
    names = ranked.join(entities.select("id", "name"), "id").groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("names"))
    lines = facts.groupBy("query_id").agg(F.array_join(F.slice(F.array_sort(F.collect_set("triple")), 1, k), "; ").alias("facts"))
    return names.join(lines, "query_id", "left").select("query_id", F.concat_ws(" - ", "names", "facts").alias("graph"))
