"""Registered queries of storage, statistics, joins, clinical derivations and exports.

Conventions: ``documents`` stand for chunks (study = source, type = lang); ``events`` for accesses and the query log.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.operators import export, metrics, store
from brindle.plans.queries_text import sql_words
from brindle.plans.registry import query
from brindle.session import table
from brindle.sources import clinical
from brindle.streaming import ingest


def chunks(spark, d):
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("source").alias("study_id"), F.col("lang").alias("document_type"),
        F.concat(F.lit("d"), (F.col("doc_id") % 100).cast("string")).alias("document_id"), (F.col("doc_id") % 13).alias("access_count"), T.word_count("text").alias("token_count"),
    )


@query("chunk_filters", "SELECT doc_id AS id, source AS study_id, lang AS document_type FROM documents WHERE source = 'src3' AND lang IN ('en', 'fr')")
def _(spark, d):
    from brindle.operators.vectors import with_filters

    return with_filters(chunks(spark, d), "src3", ["en", "fr"]).select("id", "study_id", "document_type")


@query("non_blank", r"SELECT doc_id AS id FROM documents WHERE regexp_replace(text, '^\s+|\s+$', '', 'g') <> '' AND source <> ''")
def _(spark, d):
    return store.not_blank(chunks(spark, d), "content", "study_id").select("id")


@query("chunks_by_ids", "SELECT e.vec_id AS pos, d.doc_id AS id, d.lang AS document_type FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id * 2")
def _(spark, d):
    ids = table(spark, d, "embeddings").select(F.col("vec_id").alias("pos"), (F.col("vec_id") * 2).alias("id"))
    return store.by_ids(chunks(spark, d), ids).select("pos", "id", "document_type")


@query("type_counts", "SELECT lang AS document_type, count(*) AS n FROM documents GROUP BY lang")
def _(spark, d):
    return store.type_counts(chunks(spark, d))


@query("top_studies", "SELECT source AS study_id, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, study_id LIMIT 10")
def _(spark, d):
    return store.top_studies(chunks(spark, d))


@query("store_statistics", f"SELECT count(*) AS total_chunks, count(DISTINCT doc_id % 100) AS documents, count(DISTINCT source) AS studies, round(avg(doc_id % 13), 6) AS avg_access, max(doc_id % 13) AS max_access, round(avg(len({sql_words('text')})), 6) AS avg_tokens FROM documents")
def _(spark, d):
    return store.statistics(chunks(spark, d))


@query("upsert_chunks", "SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'new ' || lang ELSE lang END AS content FROM documents UNION ALL SELECT doc_id + 1000000000, 'new ' || lang FROM documents WHERE doc_id % 2 = 1")
def _(spark, d):
    old = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("content"))
    new = old.select(F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(F.col("id") + 1_000_000_000).alias("id"), F.concat(F.lit("new "), "content").alias("content"))
    return store.upsert_chunks(old, new, "content")


@query("upsert_by_hash", "SELECT min(doc_id) AS id, sha256(text) AS content_hash, count(*) - 1 AS access_count, count(*) > 1 AS touched FROM documents GROUP BY sha256(text), text")
def _(spark, d):
    old = spark.createDataFrame([], "id bigint, content string, content_hash string, access_count bigint, last_accessed timestamp")
    new = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    got = store.upsert_by_hash(old, new, F.lit("2024-01-31").cast("timestamp"))
    return got.select("id", "content_hash", "access_count", F.col("last_accessed").isNotNull().alias("touched"))


@query("delete_document", "SELECT doc_id AS id FROM documents WHERE doc_id % 100 <> 7")
def _(spark, d):
    return store.delete_document(chunks(spark, d), "d7")[0].select("id")


@query("deleted_count", "SELECT count(*) AS deleted FROM documents WHERE doc_id % 100 = 7")
def _(spark, d):
    return store.delete_document(chunks(spark, d), "d7")[1]


@query("vector_records", "SELECT doc_id AS id, substr(text, 1, 1000) AS content, 'd' || (doc_id % 100) AS document_id FROM documents JOIN embeddings ON doc_id = vec_id")
def _(spark, d):
    rows = chunks(spark, d).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id")
    return store.vector_records(rows).select("id", F.col("metadata")["content"].alias("content"), F.col("metadata")["document_id"].alias("document_id"))


@query("recent_access", "SELECT user_id, last_accessed FROM (SELECT user_id, max(ts) AS last_accessed, count(*) AS n FROM events GROUP BY user_id) WHERE last_accessed > TIMESTAMP '2024-02-27 12:00:00' - INTERVAL 30 DAY")
def _(spark, d):
    last = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last_accessed"))
    return store.recently_accessed(last, F.lit("2024-02-27 12:00:00").cast("timestamp_ntz"))


@query("visible_rows", "SELECT c.c_custkey AS user_id, s.s_suppkey AS id FROM customer c JOIN supplier s ON s.s_nationkey IN (c.c_nationkey, (c.c_nationkey + 1) % 25) WHERE c.c_mktsegment = 'BUILDING'")
def _(spark, d):
    users = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"), F.array("c_nationkey", (F.col("c_nationkey") + 1) % 25).alias("studies"), F.array(F.lit("read")).alias("permissions"))
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("study_id"))
    return store.visible(rows, users).select("user_id", "id")


def letter_counts(texts) -> list[list[float]]:
    """A provider whose vectors SQL can make too: how often a text has each of eight letters."""
    return [[float((t or "").lower().count(c)) for c in "etaonirs"] for t in texts]


_LETTER_COUNTS = ", ".join(f"CAST(length(lower(text)) - length(replace(lower(text), '{c}', '')) AS DOUBLE)" for c in "etaonirs")


@query("cached_embeddings", f"SELECT doc_id, sha256(text) AS content_hash, CASE WHEN cached THEN [0 - 1.0::DOUBLE] ELSE [{_LETTER_COUNTS}] END AS embedding FROM (SELECT *, bool_or(doc_id % 2 = 0) OVER (PARTITION BY sha256(text)) AS cached FROM documents)")
def _(spark, d):
    """Every document's vector: that of the cache (made to be told apart) if an even document has its text, else the provider's."""
    from brindle.operators import vectors

    texts = table(spark, d, "documents").select("doc_id", "text")
    cache = texts.where("doc_id % 2 = 0").select(T.sha256("text").alias("content_hash"), F.array(F.lit(-1.0)).alias("embedding")).dropDuplicates(["content_hash"])
    return vectors.embed_missing(texts, cache, "text", letter_counts).select("doc_id", "content_hash", "embedding")


@query("query_log_metrics", "SELECT event_type AS mode, year(ts) AS y, count(*) AS n, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY ALL")
def _(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("mode"), F.year("ts").cast("bigint").alias("y")).agg(F.count("*").alias("n"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"))


_BOUNDS = (5.0, 10.0, 25.0, 50.0, 75.0, 100.0, 250.0)


@query(
    "query_log_histogram",
    f"""WITH b AS (SELECT unnest([{', '.join(map(str, _BOUNDS))}, 'inf'::DOUBLE]) AS le), l AS (SELECT event_type AS mode, CASE WHEN event_id % 5 = 0 THEN 'error' ELSE 'success' END AS status, value FROM events),
    g AS (SELECT DISTINCT mode, status FROM l)
    SELECT mode, status, le, (SELECT count(*) FROM l WHERE l.mode = g.mode AND l.status = g.status AND l.value <= b.le) AS n FROM g, b""",
)
def _(spark, d):
    """Durations by mode and status: histograms of each month, merged."""
    log = table(spark, d, "events").select(F.col("event_type").alias("mode"), F.when(F.col("event_id") % 5 == 0, "error").otherwise("success").alias("status"), "value", F.month("ts").alias("month"))
    monthly = metrics.histogram(log, "value", ["mode", "status", "month"], _BOUNDS)
    return metrics.cumulative(metrics.merged(monthly, by=["mode", "status"]), ["mode", "status"], _BOUNDS)


@query("rate_limit", "SELECT user_id, time_bucket(INTERVAL 1 MINUTE, ts) AS start, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def _(spark, d):
    return ingest.requests_per_minute(table(spark, d, "events"), 1).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("event_rollups", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(spark, d):
    return ingest.rollups(table(spark, d, "events"), "1 hour").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("event_sessions", "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE, true) AS fresh FROM events)) GROUP BY user_id, s")
def _(spark, d):
    return ingest.sessions(table(spark, d, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("baseline_changes", """WITH v AS (SELECT o_custkey, o_orderkey, o_totalprice, first_value(o_totalprice) OVER w AS base, row_number() OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
    SELECT o_custkey, o_orderkey, base AS "BASE", CASE WHEN n = 1 THEN 0.0 ELSE round(o_totalprice - base, 6) END AS "CHG", CASE WHEN n = 1 OR base = 0 THEN 0.0 ELSE round(100 * (o_totalprice - base) / base, 6) END AS "PCHG", CASE WHEN n = 1 THEN 'Y' ELSE '' END AS "ABLFL" FROM v""")
def _(spark, d):
    return clinical.baseline_changes(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_orderkey", "o_totalprice").drop("o_totalprice")


@query("carried_forward", """SELECT o_custkey, o_orderkey, last_value(CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS value FROM orders""")
def _(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "F", None).otherwise(F.col("o_totalprice")).alias("value"))
    return clinical.carried_forward(rows, ["o_custkey"], "o_orderkey", "value")


@query("clinical_generator")
def _(spark, d):
    dm = clinical.subjects(spark, "STUDY001", 50)
    vs = clinical.findings(dm, clinical.VITALS, "VS", 4).groupBy(F.col("VSTESTCD").alias("code")).agg(F.count("*").alias("n"))
    return vs.unionByName(clinical.findings(dm, clinical.LABS, "LB", 3).groupBy(F.col("LBTESTCD").alias("code")).agg(F.count("*").alias("n"))).unionByName(clinical.adverse_events(dm).groupBy(F.col("AETERM").alias("code")).agg(F.count("*").alias("n")))


@query("export_csv_sources", "SELECT doc_id % 40 AS query_id, doc_id AS rank, doc_id AS id, substr(text, 1, 200) || '...' AS content, 0.5 AS score FROM documents")
def _(spark, d):
    rows = chunks(spark, d).select((F.col("id") % 40).alias("query_id"), F.col("id").alias("rank"), "id", "content", F.lit(0.5).alias("score"))
    return export.csv_sources(rows)


@query("export_json", "SELECT item_id AS query_id, CAST(json_object('query_id', item_id, 'answer', text, 'sources', [{'rank': 1, 'id': item_id * 2}, {'rank': 2, 'id': NULL}]) AS VARCHAR) AS document FROM benchmark")
def _(spark, d):
    """Whole documents; what is null stays in them."""
    source = lambda rank, i: F.struct(F.lit(rank).alias("rank"), i.cast("bigint").alias("id"))
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("answer"), F.array(source(1, F.col("item_id") * 2), source(2, F.lit(None))).alias("sources"))
    return export.json_rows(rows)


_MARKDOWN = """WITH s AS (SELECT doc_id % 40 AS query_id, string_agg('### Source ' || doc_id || ' (' || doc_id || ')' || E'\\n\\n' || substr(text, 1, 500), E'\\n\\n' ORDER BY doc_id) AS s FROM documents GROUP BY 1)
    SELECT item_id AS query_id, '# ' || text || E'\\n\\n## Answer\\n\\nanswer\\n\\n## Sources\\n\\n' || coalesce(s, '') AS document FROM benchmark LEFT JOIN s ON query_id = item_id"""


@query("export_markdown", _MARKDOWN)
def _(spark, d):
    answers = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), F.lit("answer").alias("answer"))
    sources = chunks(spark, d).select((F.col("id") % 40).alias("query_id"), F.col("id").alias("rank"), "id", F.substring("content", 1, 500).alias("content"))
    return export.markdown(answers, sources)


@query("audit_log", "SELECT event_id, user_id, event_type FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'")
def _(spark, d):
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    return export.audit_log(table(spark, d, "events"), at("2024-01-05"), at("2024-01-20")).select("event_id", "user_id", "event_type")


@query("study_export", "SELECT doc_id AS id, lang AS document_type FROM documents WHERE source = 'src1'")
def _(spark, d):
    return export.study_rows(chunks(spark, d), "src1").select("id", "document_type")


def tasks(spark, d):
    """Events as ingestion tasks."""
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("status"), F.col("ts").alias("created_at"))


@query("newest_tasks", "SELECT event_id AS id, event_type AS status, ts AS created_at FROM events ORDER BY ts DESC, event_id LIMIT 50")
def _(spark, d):
    return store.newest_tasks(tasks(spark, d))


@query("task_census", "SELECT event_type AS status, count(*) AS n, min(ts) AS first_created, max(ts) AS last_created FROM events GROUP BY 1")
def _(spark, d):
    return store.task_census(tasks(spark, d))
