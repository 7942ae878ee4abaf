"""Registered queries of files, ingestion and stores: tables are written to the shared folder as files, then read back.

Each compares what comes back with the tables themselves.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from brindle.functions import text as T
from brindle.operators import chunking, export, graph, store
from brindle.plans import ingestion, retrieval
from brindle.plans.queries_graph import _E, _LOCAL, _R, _asked, entities, relations, reports
from brindle.plans.queries_search import _windows_sql, chunk_docs, item_queries, text_chunks
from brindle.plans.queries_store import chunks, letter_counts
from brindle.plans.registry import ORACLES, query
from brindle.session import scratch_path, table
from brindle.sources import files


#: Documents (about) below one folder: a folder each would be listed one by one.
_FOLDER = 1_000


def written_documents(spark, d, extension: str = "txt") -> str:
    """The documents as text files, one each, named by the document, below folders of about ``_FOLDER``."""
    path = scratch_path(spark, "files")
    docs = table(spark, d, "documents").select("doc_id", "text")
    folders = max(1, -(-docs.count() // _FOLDER))
    # texts move only where ids repeat, so that files of one id differ
    alike = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    n = F.lit(1) if alike else F.row_number().over(W.partitionBy("doc_id").orderBy("text"))
    rows = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(folders)).alias("folder"), "doc_id", n.alias("n"), "text")
    names = rows.select(F.concat_ws("/", F.lpad(F.col("folder").cast("string"), 8, "0"), F.concat(F.lit("doc_id="), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("-"), F.col("n").cast("string"), F.lit(f".{extension}"))).alias("name"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).alias("content"))
    files.write_each(names.repartition(spark.sparkContext.defaultParallelism, "name"), path)
    return path


def _doc_id(path):
    return F.regexp_extract(path, r"/doc_id=(\d+)-", 1).cast("bigint")


_BLANK = r"regexp_replace(text, '^\s+|\s+$', '', 'g') <> ''"


@query("ingested_files", f"SELECT doc_id, octet_length(encode(text)) + 1 AS file_size, sha256(text || chr(10)) AS content_hash, 'doc' AS prefix, 37 AS id_length FROM documents WHERE {_BLANK}")
def _(spark, d):
    """Files of a folder as documents: id by path and content, size, content."""
    got = files.documents(files.files(spark, written_documents(spark, d)))
    return got.select(_doc_id("file_path").alias("doc_id"), "file_size", T.sha256("content").alias("content_hash"), F.substring("id", 1, 3).alias("prefix"), F.length("id").cast("int").alias("id_length"))


@query("rejected_files", "SELECT doc_id, octet_length(encode(text)) + 1 AS size, 'size' AS reason FROM documents WHERE octet_length(encode(text)) + 1 > 2000")
def _(spark, d):
    """Files over a cap, with the reason; they aren't read."""
    got = files.rejected(spark, written_documents(spark, d), max_bytes=2000)
    return got.select(_doc_id("path").alias("doc_id"), "size", "reason")


@query("ingested_chunks", f"SELECT document_id, chunk_index, content, token_count FROM ({_windows_sql('CASE WHEN len(w) = 0 THEN [] ELSE range(0, greatest(CAST(ceil((len(w) - 100) / 80.0) AS BIGINT), 0) * 80 + 1, 80) END', 'chunk')})")
def _(spark, d):
    """Files to chunks by the ingestion: cut into windows, with a vector each."""
    made = ingestion.ingest(spark, written_documents(spark, d), 100, 20, letter_counts)
    named = made["documents"].select(F.col("id").alias("document_id"), F.concat(F.lit("doc"), _doc_id("file_path").cast("string")).alias("name"))
    return made["chunks"].where(F.size("embedding") == 8).join(named, "document_id").select(F.col("name").alias("document_id"), "chunk_index", "content", "token_count")


@query("csv_scan", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(spark, d):
    path = scratch_path(spark, "csv")
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    rows.write.option("header", True).csv(path)
    return files.csv(spark, path, rows.schema)


@query("json_scan", "SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def _(spark, d):
    path = scratch_path(spark, "json")
    rows = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    rows.write.json(path)
    return spark.read.schema(rows.schema).json(path).select(*rows.columns)


@query("chunks_in_order", "SELECT doc_id AS id, doc_id % 100 AS chunk_index FROM documents WHERE doc_id IN (7, 3, 100, 55)")
def _(spark, d):
    rows = chunks(spark, d).withColumn("chunk_index", F.col("id") % 100)
    return store.by_chunk_index(rows, [7, 3, 100, 55, -1]).select("id", "chunk_index")


@query("inserted_objects", "SELECT CAST(count(*) AS BIGINT) AS n, max(n) <= 100 AS bounded FROM (SELECT 1 AS n FROM documents)")
def _(spark, d):
    sent = store.insert_objects(chunks(spark, d).select("id", "content"), len)
    return sent.agg(F.sum("n").alias("n"), (F.max("n") <= 100).alias("bounded"))


@query("restored_backup", "SELECT doc_id AS id, lang AS document_type, '20240201' AS name, CAST(1 AS BIGINT) AS left_over FROM documents")
def _(spark, d):
    """Two snapshots, the older one cleaned up, the newer one restored."""
    folder = scratch_path(spark, "backups")
    rows = chunks(spark, d).select("id", "document_type")
    for name in ("20240101", "20240201"):
        store.backup({"chunks": rows}, folder, name)
    store.cleanup_backups(spark, folder, "20240115")
    names = store.list_backups(spark, folder)
    return store.restore(spark, folder, names[0], ["chunks"])["chunks"].withColumn("name", F.lit(names[0])).withColumn("left_over", F.lit(len(names)).cast("bigint"))


@query("chunker_by_name", _windows_sql("CASE WHEN len(w) = 0 THEN [] ELSE range(0, greatest(CAST(ceil((len(w) - 100) / 80.0) AS BIGINT), 0) * 80 + 1, 80) END", "chunk"))
def _(spark, d):
    return chunking.chunker("fixed")(chunk_docs(spark, d), 100, 20)


@query("export_by_format", ORACLES["export_csv_sources"])
def _(spark, d):
    rows = chunks(spark, d).select((F.col("id") % 40).alias("query_id"), F.col("id").alias("rank"), "id", "content", F.lit(0.5).alias("score"))
    return export.writer("csv")(rows)


@query("graph_query_by_kind", f"WITH {_E}, {_R}, {_LOCAL} SELECT query_id, triple, CAST(rank AS INTEGER) AS rank FROM l WHERE rank <= 10")
def _(spark, d):
    return graph.query_graph("local", _asked(spark, d), entities(spark, d), relations(spark, d), None)


@query("cached_results", ORACLES["bm25_topk"])
def _(spark, d):
    """Half of the queries from a cache of results, the others searched: together what a search gives."""
    from brindle.operators import lexical

    docs, queries = text_chunks(spark, d), item_queries(spark, d)
    keys = {"mode": F.lit("bm25"), "k": F.lit(10), "filters": F.lit(""), "study_id": F.lit(None).cast("string")}
    search = lambda some: lexical.best(docs, some, 10)
    none = spark.createDataFrame([], "key bigint, id bigint, score double, rank int")
    _, cache = retrieval.with_result_cache(none, queries.where("query_id % 2 = 0"), search, keys)
    return retrieval.with_result_cache(cache, queries, search, keys)[0]


@query("lasting_cache", ORACLES["bm25_topk"])
def _(spark, d):
    """Some queries are searched and stored, then all are asked: an hour later the first are still held, a day later none is."""
    from brindle.operators import lexical

    docs, queries, path = text_chunks(spark, d), item_queries(spark, d), scratch_path(spark, "cache")
    keys = {"mode": F.lit("bm25"), "k": F.lit(10), "filters": F.lit(""), "study_id": F.lit(None).cast("string")}
    search = lambda some: lexical.best(docs, some, 10)
    at = lambda x: F.lit(x).cast("timestamp")
    retrieval.cached_search(path, queries.where("query_id % 3 = 0"), search, keys, at("2024-01-01 10:00:00"), 7200)
    return retrieval.cached_search(path, queries, search, keys, at("2024-01-01 11:00:00"), 7200)


_SUBJECT = "'CU' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0')"


@query("graph_answers", f"""SELECT n_nationkey AS query_id, {_SUBJECT} AS name FROM nation JOIN customer ON c_custkey = n_nationkey + 1""")
def _(spark, d):
    """For a question about a subject, the graph entity of its type and name, found among all entities of the reports."""
    asked = table(spark, d, "nation").select(F.col("n_nationkey").alias("query_id"), F.concat(F.lit("what about subject CU"), F.lpad(((F.col("n_nationkey") + 1) % 10000).cast("string"), 4, "0"), F.lit(" now")).alias("query_text"))
    made = ingestion.build_graph(reports(spark, d))
    scores = made["entities"].select("id", F.lit(0.0).alias("pagerank"), F.lit(0.0).alias("betweenness"))
    ranked = ingestion.query_graph(asked, made["entities"], made["relations"], scores)
    return ranked.where("rank = 1").join(made["entities"].where("type = 'subject'"), "id").select("query_id", F.right("name", F.lit(6)).alias("name"))
