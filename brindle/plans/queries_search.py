"""Registered queries of chunking, vector, lexical and hybrid search.

Test-only convention: ``embeddings.vec_id`` is taken as ``documents.doc_id``. Searches ask with every
row whose id is divisible by 20, against all rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.operators import chunking, fusion, lexical, vectors
from brindle.plans import retrieval
from brindle.plans.queries_text import sql_list, sql_words, turns
from brindle.plans.registry import query
from brindle.session import table


def vector_chunks(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.concat(F.lit("study"), (F.col("label") % 3).cast("string")).alias("study_id"), F.col("label").cast("string").alias("document_type"), (F.col("vec_id") % 7).alias("access_count"))


def vector_queries(spark, d):
    return table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))


_COS = "round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6)"


def _dense_sql(k: int, where: str = "true", condition: str = "score >= 0.2", ties: str = "id", extra: str = "") -> str:
    return f"""SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {ties}) AS rank FROM
        (SELECT q.vec_id AS query_id, a.vec_id AS id, {_COS} AS score{extra} FROM embeddings a, embeddings q WHERE q.vec_id % 20 = 0 AND {where}) WHERE {condition}) WHERE rank <= {k}"""


@query("vector_topk", _dense_sql(10))
def _(spark, d):
    return vectors.search(vector_chunks(spark, d), vector_queries(spark, d), 10, 0.2)


@query("vector_strict_ties", _dense_sql(10, condition="score > 0.2", ties="access_count DESC, id", extra=", a.vec_id % 7 AS access_count"))
def _(spark, d):
    return vectors.search(vector_chunks(spark, d), vector_queries(spark, d), 10, 0.2, strict=True, tie_breaks=("access_count",))


@query("vector_filtered", _dense_sql(5, "a.label % 3 = 1 AND a.label IN (1, 4, 7)", "score >= 0.0"))
def _(spark, d):
    return vectors.search(vectors.with_filters(vector_chunks(spark, d), "study1", ["1", "4", "7"]), vector_queries(spark, d), 5, 0.0)


@query("similar_chunks", _dense_sql(5, "a.vec_id <> q.vec_id", "score >= 0.0"))
def _(spark, d):
    return vectors.search_blocks(vector_chunks(spark, d), vector_queries(spark, d), 5, threshold=0.0, exclude_self=True)


@query("vector_normalization", "SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: round(x / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y))), 5)) AS unit FROM embeddings")
def _(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.transform(vectors.normalized("embedding"), lambda x: vectors.rounded(x, 5)).alias("unit"))


@query("vector_store_stats", "SELECT label, count(*) AS n, max(len(embedding)) AS dimension, round(avg(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y))), 5) AS mean_square FROM embeddings GROUP BY label")
def _(spark, d):
    v = F.col("embedding")
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.max(F.size(v)).alias("dimension"), F.round(F.avg(vectors.norm(v) ** 2), 5).alias("mean_square"))


@query("vector_ivf")
def _(spark, d):
    """Approximate search, with the recall of each query against the exact one."""
    chunks, queries = vector_chunks(spark, d), vector_queries(spark, d)
    indexed, centroids = vectors.ivf_index(chunks.select("id", "embedding"), 16)
    near = vectors.ivf_search(indexed, centroids, queries, 10, 12).withColumn("hit", F.lit(1))
    exact = vectors.search(chunks, queries, 10, -1.0).select("query_id", "id")
    return exact.join(near.select("query_id", "id", "hit"), ["query_id", "id"], "left").groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))


# --- lexical -----------------------------------------------------------------------------------


def text_chunks(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))


def item_queries(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


_TOKENS = r"regexp_extract_all(lower({}), '[\p{L}\p{N}]+')"


def _tokens(x: str) -> str:
    return _TOKENS.replace("{}", x)


_POSTINGS = f"""w AS (SELECT doc_id AS id, t AS term, len(toks) AS dl FROM (SELECT doc_id, {_tokens('text')} AS toks FROM documents), unnest(toks) AS u(t)),
    p AS (SELECT id, term, any_value(dl) AS dl, count(*) AS tf FROM w GROUP BY id, term),
    qt AS (SELECT item_id AS query_id, len(ts) AS n_terms, t AS term FROM (SELECT item_id, list_distinct({_tokens('text')}) AS ts FROM benchmark), unnest(ts) AS u(t))"""


def _topk(inner: str, k: int) -> str:
    return f"SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ({inner})) WHERE rank <= {k}"


_BM25 = """SELECT query_id, p.id, round(least(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - CAST(0.75 AS DOUBLE) + CAST(0.75 AS DOUBLE) * dl / avg_dl))) / 10, 1.0), 6) AS score
    FROM p JOIN (SELECT term, count(*) AS df FROM p GROUP BY term) USING (term) JOIN qt USING (term), (SELECT count(*) AS n_docs, avg(len({})) AS avg_dl FROM documents) GROUP BY query_id, p.id""".replace("{}", _tokens("text"))


@query("bm25_topk", f"WITH {_POSTINGS} {_topk(_BM25, 10)}")
def _(spark, d):
    return lexical.best(text_chunks(spark, d), item_queries(spark, d), 10)


_RANK = "SELECT query_id, id, round(sum(CAST(0.1 AS DOUBLE) * list_sum(list_transform(range(1, CAST(tf AS BIGINT) + 1), lambda i: 1.0 / (i * i))) / CAST(1.64493406685 AS DOUBLE)) / any_value(n_terms), 6) AS score FROM p JOIN qt USING (term) GROUP BY query_id, id"


@query("fulltext_any", f"WITH {_POSTINGS} {_topk(_RANK, 10)}")
def _(spark, d):
    return lexical.best(text_chunks(spark, d), item_queries(spark, d), 10, "rank")


#: English words and their published stems ("" for function words, which are left out). The documents are invented prose, so English
#: search reads them with every token replaced by the word (or number) of its class, and SQL gets the stems from this table.
ENGLISH = {
    "the": "", "of": "", "and": "", "were": "", "consign": "consign", "consigned": "consign", "consigning": "consign", "consignment": "consign", "consist": "consist", "consisted": "consist", "consistency": "consist",
    "consistently": "consist", "consolation": "consol", "consolatory": "consolatori", "console": "consol", "consolidate": "consolid", "consolidated": "consolid", "consolidating": "consolid", "consolingly": "consol",
    "consonant": "conson", "conspicuously": "conspicu", "conspiracy": "conspiraci", "conspirator": "conspir", "conspire": "conspir", "constable": "constabl", "constance": "constanc", "constancy": "constanc",
    "knackeries": "knackeri", "knaves": "knave", "knavish": "knavish", "kneaded": "knead", "knees": "knee", "knelt": "knelt", "knightly": "knight", "knitted": "knit", "knitting": "knit", "knives": "knive",
    "knocker": "knocker", "knopp": "knopp", "knots": "knot", "study": "studi", "studies": "studi", "cause": "caus", "caused": "caus", "causes": "caus", "box": "box", "boxes": "box", "agree": "agre", "agreed": "agre",
    "hopping": "hop", "hoping": "hope", "generous": "generous", "generally": "general", "communication": "communic", "skies": "sky", "dying": "die", "gas": "gas", "gaps": "gap", "ties": "tie", "cries": "cri",
    "kiwis": "kiwi", "luxuriated": "luxuri", "proceed": "proceed", "exceedingly": "exceed", "early": "earli", "saying": "say", "enjoy": "enjoy", "youth": "youth", "relational": "relat", "hopefulness": "hope",
    "rationalize": "ration", "digitizer": "digit", "decisively": "decis", "sensibility": "sensibl", "analogies": "analog", "happily": "happili", "national": "nation", "triplicate": "triplic", "active": "activ",
    "adoption": "adopt", "irritant": "irrit", "controlling": "control", "rolled": "roll", "rate": "rate", "singing": "sing", "falling": "fall", "failing": "fail", "filing": "file", "troubled": "troubl", "sized": "size",
}
_CLASSES = 400


def english_text(rows, text: str):
    """``rows`` with every token of ``text`` replaced by the English word, or the number, of its class."""
    number = lambda t: ((F.ascii(t) * 7 + F.ascii(F.right(t, F.lit(1))) * 13 + F.length(t) * 31) % _CLASSES).cast("int")
    words = F.array(*map(F.lit, ENGLISH))
    replaced = F.transform(F.transform(lexical.tokens(text), number), lambda n: F.when(n < len(ENGLISH), F.get(words, n)).otherwise(F.concat(F.lit("n"), n.cast("string"))))
    return rows.withColumn(text, F.array_join(replaced, " "))


def _english_sql(x: str) -> str:
    number = f"(unicode(t) * 7 + unicode(right(t, 1)) * 13 + length(t) * 31) % {_CLASSES}"
    return f"list_filter(list_transform({_tokens(x)}, lambda t: CASE WHEN {number} < {len(ENGLISH)} THEN ({sql_list(list(ENGLISH.values()))})[{number} + 1] ELSE 'n' || ({number}) END), lambda t: t <> '')"


def english_chunks(spark, d):
    return english_text(text_chunks(spark, d), "content")


def english_queries(spark, d):
    return english_text(item_queries(spark, d), "query_text")


@query("stemmed_terms", f"SELECT id, term, count(*) AS tf FROM (SELECT doc_id AS id, unnest({_english_sql('text')}) AS term FROM documents) GROUP BY id, term")
def _(spark, d):
    """The search table of all documents by stems."""
    return lexical.postings(english_chunks(spark, d), analyze=lexical.english).select("id", "term", "tf")


@query("fulltext_english", f"""WITH w AS (SELECT doc_id AS id, t AS term FROM (SELECT doc_id, {_english_sql('text')} AS toks FROM documents), unnest(toks) AS u(t)),
    p AS (SELECT id, term, count(*) AS tf FROM w GROUP BY id, term),
    qt AS (SELECT item_id AS query_id, len(ts) AS n_terms, t AS term FROM (SELECT item_id, list_distinct({_english_sql('text')}) AS ts FROM benchmark), unnest(ts) AS u(t)) {_topk(_RANK, 10)}""")
def _(spark, d):
    return lexical.best(english_chunks(spark, d), english_queries(spark, d), 10, "rank", analyze=lexical.english)


@query("fulltext_all", f"WITH {_POSTINGS} SELECT query_id, id, count(*) AS n_matched, sum(tf) AS tf FROM p JOIN qt USING (term) GROUP BY query_id, id HAVING count(*) = any_value(n_terms)")
def _(spark, d):
    asked = item_queries(spark, d)
    terms = lexical.query_terms(asked)
    return lexical.match(lexical.asked_counts(lexical.holding_all(text_chunks(spark, d), asked), terms), terms, "all")


_COVER = f"""WITH w AS (SELECT doc_id AS id, toks[i] AS term, i - 1 AS pos FROM (SELECT doc_id, toks, unnest(range(1, len(toks) + 1)) AS i FROM (SELECT doc_id, {_tokens('text')} AS toks FROM documents))),
    qt AS (SELECT item_id AS query_id, len(ts) AS n, t AS term FROM (SELECT item_id, list_distinct({_tokens('text')}) AS ts FROM benchmark), unnest(ts) AS u(t)),
    hit AS (SELECT query_id, id FROM w JOIN qt USING (term) GROUP BY query_id, id HAVING count(DISTINCT term) = any_value(n)),
    p AS (SELECT query_id, id, term, pos, n FROM hit JOIN w USING (id) JOIN qt USING (query_id, term)),
    c AS (SELECT query_id, id, e, any_value(n) AS n, min(latest) AS s FROM (SELECT x.query_id, x.id, x.pos AS e, x.n, y.term, max(y.pos) AS latest FROM p x JOIN p y ON x.query_id = y.query_id AND x.id = y.id AND y.pos <= x.pos GROUP BY ALL) GROUP BY query_id, id, e HAVING count(*) = any_value(n)),
    k AS (SELECT *, lag(s) OVER (PARTITION BY query_id, id ORDER BY e) AS before FROM c)"""


@query("fulltext_cover_density", _COVER + _topk("SELECT query_id, id, round(r / (r + 1), 6) AS score FROM (SELECT query_id, id, sum(CAST(n AS DOUBLE) / (e - s + 1)) AS r FROM k WHERE before IS NULL OR s > before GROUP BY query_id, id)", 10))
def _(spark, d):
    asked = item_queries(spark, d)
    return lexical.top(lexical.cover_density(lexical.postings(lexical.holding_all(text_chunks(spark, d), asked)), lexical.query_terms(asked)), 10)


_FEW = "array_to_string((" + _tokens("text") + ")[1:3], ' ')"


@query("english_cover_density", _COVER.replace(_tokens("text") + " AS toks FROM documents", _english_sql("text") + " AS toks FROM documents").replace(_tokens("text") + ") AS ts", _english_sql(_FEW) + ") AS ts") + _topk("SELECT query_id, id, round(r / (r + 1), 6) AS score FROM (SELECT query_id, id, sum(CAST(n AS DOUBLE) / (e - s + 1)) AS r FROM k WHERE before IS NULL OR s > before GROUP BY query_id, id)", 10))
def _(spark, d):
    """Cover density by stems of the first three tokens of each item."""
    asked = english_text(item_queries(spark, d).withColumn("query_text", F.array_join(F.slice(lexical.tokens("query_text"), 1, 3), " ")), "query_text")
    return lexical.best_covers(english_chunks(spark, d), asked, 10, lexical.english)


@query("postings_table", f"WITH {_POSTINGS} SELECT id, term, tf, dl FROM p")
def _(spark, d):
    return lexical.term_rows(text_chunks(spark, d))


_CONTAINS = f"""SELECT item_id AS query_id, doc_id AS id, round(least(1.0, CAST(list_sum(list_transform({sql_words('lower(b.text)')}, lambda t: (length(lower(d.text)) - length(replace(lower(d.text), t, ''))) // length(t))) AS DOUBLE) / len({sql_words('d.text')})), 6) AS score FROM documents d, (SELECT * FROM benchmark WHERE item_id % 20 = 0) b"""


@query("contains_relevance", _topk(f"SELECT * FROM ({_CONTAINS}) WHERE score > 0", 10))
def _(spark, d):
    return lexical.top(lexical.contains_search(text_chunks(spark, d), item_queries(spark, d).where("query_id % 20 = 0")), 10)


# --- hybrid ------------------------------------------------------------------------------------


def both_chunks(spark, d):
    """All documents, with the vector of the same number where there is one; vector search finds only those."""
    rows = text_chunks(spark, d).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id", "left")
    return rows.withColumn("last_accessed", F.when(F.col("id") % 3 == 0, F.lit("2024-01-01")))


def both_queries(spark, d):
    """All benchmark items, with the vector of the same number where there is one."""
    return item_queries(spark, d).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding")), "query_id", "left")


_BOTH = f"""docs AS (SELECT doc_id AS id, text, embedding FROM documents LEFT JOIN embeddings ON doc_id = vec_id),
    asked AS (SELECT item_id AS query_id, text, embedding FROM benchmark LEFT JOIN embeddings ON item_id = vec_id),
    w AS (SELECT id, t AS term, len(toks) AS dl FROM (SELECT id, {_tokens('text')} AS toks FROM docs), unnest(toks) AS u(t)),
    p AS (SELECT id, term, any_value(dl) AS dl, count(*) AS tf FROM w GROUP BY id, term),
    qt AS (SELECT query_id, len(ts) AS n_terms, t AS term FROM (SELECT query_id, list_distinct({_tokens('text')}) AS ts FROM asked), unnest(ts) AS u(t)),
    dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT q.query_id, a.id, {_COS} AS score FROM docs a, asked q) WHERE score >= 0.05)),
    sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ({_RANK})),
    bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ({_BM25.replace('FROM documents)', 'FROM docs)')}))"""


def _rrf_sql(lists: list[tuple[str, str]], k: int, depth: int) -> str:
    parts = " UNION ALL ".join(f"SELECT query_id, id, {w} / (60 + rank) AS part FROM {name} WHERE rank <= {depth}" for name, w in lists)
    return _topk(f"SELECT query_id, id, round(sum(part), 9) AS score FROM ({parts}) GROUP BY query_id, id", k)


@query("hybrid_weighted_rrf", f"WITH {_BOTH} {_rrf_sql([('dense', 'CAST(0.7 AS DOUBLE)'), ('sparse', '(1 - CAST(0.7 AS DOUBLE))')], 10, 20)}")
def _(spark, d):
    return retrieval.hybrid(both_chunks(spark, d), both_queries(spark, d), 10, threshold=0.05)


@query("hybrid_three_lists", f"WITH {_BOTH} {_rrf_sql([('dense', 'CAST(1 AS DOUBLE)'), ('sparse', 'CAST(1 AS DOUBLE)'), ('bm', 'CAST(1 AS DOUBLE)')], 10, 20)}")
def _(spark, d):
    chunks, queries = both_chunks(spark, d), both_queries(spark, d)
    lists = [vectors.search(chunks, queries, 20, 0.05), lexical.best(chunks, queries, 20, "rank"), lexical.best(chunks, queries, 20)]
    return fusion.ranked(fusion.rrf(lists), 10)


def _linear_sql(right: str, depth: int, k: int) -> str:
    return _topk(f"SELECT query_id, id, round(CAST(0.7 AS DOUBLE) * coalesce(a.score, 0) + (1 - CAST(0.7 AS DOUBLE)) * coalesce(b.score, 0), 9) AS score FROM (SELECT * FROM dense WHERE rank <= {depth}) a FULL JOIN (SELECT * FROM {right} WHERE rank <= {depth}) b USING (query_id, id)", k)


@query("hybrid_linear", f"WITH {_BOTH} {_linear_sql('sparse', 10, 10)}")
def _(spark, d):
    return retrieval.linear_hybrid(both_chunks(spark, d), both_queries(spark, d), 10, threshold=0.05)


@query("hybrid_bm25", f"WITH {_BOTH} {_linear_sql('bm', 20, 10)}")
def _(spark, d):
    return retrieval.bm25_hybrid(both_chunks(spark, d), both_queries(spark, d), 10, threshold=0.05)


@query("merged_results", f"WITH {_BOTH} {_topk('SELECT query_id, id, max(score) AS score FROM (SELECT query_id, id, score FROM dense WHERE rank <= 10 UNION ALL SELECT query_id, id, score FROM bm WHERE rank <= 10) GROUP BY query_id, id', 10)}")
def _(spark, d):
    chunks, queries = both_chunks(spark, d), both_queries(spark, d)
    return fusion.ranked(fusion.best_of(vectors.search(chunks, queries, 10, 0.05), lexical.best(chunks, queries, 10)), 10)


@query("identifier_boost", "SELECT conv_id, turn, round(0.5 + CASE WHEN (conv_id + turn) % 6 = 2 AND turn % 2 = 0 THEN CAST(0.2 AS DOUBLE) ELSE 0 END, 6) AS score FROM conversations")
def _(spark, d):
    rows = turns(spark, d).withColumn("query_text", F.col("q")).withColumn("content", F.when(F.col("turn") % 2 == 0, F.lit("about ab1234")).otherwise(F.lit("nothing"))).withColumn("score", F.lit(0.5))
    return fusion.boost_identifiers(rows).select("conv_id", "turn", "score")


@query("freshness_boost", "SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN round(0.5 * CAST(1.1 AS DOUBLE), 6) ELSE 0.5 END AS score FROM embeddings")
def _(spark, d):
    rows = vector_chunks(spark, d).select("id", F.lit(0.5).alias("score"), F.when(F.col("id") % 3 == 0, F.lit("2024-01-01")).alias("last_accessed"))
    return fusion.freshness(rows).select("id", "score")


def hashed(rows):
    return vectors.embed(rows, "query_text", name="query_embedding")


def hashed_chunks(spark, d):
    rows = text_chunks(spark, d).withColumn("last_accessed", F.when(F.col("id") % 3 == 0, F.lit("2024-01-01")))
    return vectors.embed(rows, "content")


def hashed_queries(spark, d):
    rows = turns(spark, d).where("role = 'user'").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"), F.col("q").alias("query_text"))
    return hashed(rows)


@query("strategy_router")
def _(spark, d):
    return retrieval.route(hashed_chunks(spark, d), hashed_queries(spark, d), 10, hashed, 0.3)


@query("semantic_expansion")
def _(spark, d):
    return retrieval.semantic(hashed_chunks(spark, d), hashed_queries(spark, d), 10, hashed, 0.3)


_VARIED = f"""WITH RECURSIVE {_BOTH.replace('score >= 0.05', 'score >= 0.0')}, f AS ({_rrf_sql([('dense', 'CAST(0.7 AS DOUBLE)'), ('sparse', '(1 - CAST(0.7 AS DOUBLE))')], 20, 40)}),
    r AS (SELECT query_id, id, score, rank, count(*) OVER (PARTITION BY query_id) AS n, list_distinct({sql_words('lower(substr(text, 1, 200))')}) AS words FROM f JOIN docs USING (id)),
    g AS (SELECT query_id, 0 AS step, CAST([] AS STRUCT(id BIGINT, score DOUBLE, words VARCHAR[])[]) AS kept FROM (SELECT DISTINCT query_id FROM r WHERE n > 3)
        UNION ALL SELECT g.query_id, step + 1, CASE WHEN len(kept) >= 10 OR len(list_filter(kept, lambda k: CASE WHEN len(list_distinct(k.words || r.words)) > 0 THEN CAST(len(list_intersect(k.words, r.words)) AS DOUBLE) / len(list_distinct(k.words || r.words)) ELSE 0 END > 0.7)) > 0
            THEN kept ELSE list_append(kept, CAST({{'id': r.id, 'score': r.score, 'words': r.words}} AS STRUCT(id BIGINT, score DOUBLE, words VARCHAR[]))) END FROM g JOIN r ON r.query_id = g.query_id AND r.rank = step + 1),
    v AS (SELECT query_id, k.id AS id, k.score AS score FROM (SELECT query_id, unnest(arg_max(kept, step)) AS k FROM g GROUP BY query_id) UNION ALL SELECT query_id, id, score FROM r WHERE n <= 3),
    b AS (SELECT query_id, id, CASE WHEN id % 3 = 0 THEN round(score * CAST(1.1 AS DOUBLE), 6) ELSE score END AS score FROM v)"""


@query("diversified_rerank", _VARIED + " SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM b")
def _(spark, d):
    chunks = both_chunks(spark, d)
    return retrieval.rerank(retrieval.hybrid(chunks, both_queries(spark, d), 20, threshold=0.0), chunks).drop("last_accessed")


@query("cross_encoder_rerank", f"WITH {_BOTH.replace('score >= 0.05', 'score >= 0.0')} SELECT query_id, id, CAST(1 AS DOUBLE) AS score, rank FROM ({_rrf_sql([('dense', 'CAST(1 AS DOUBLE)'), ('bm', 'CAST(1 AS DOUBLE)')], 5, 10)})")
def _(spark, d):
    return retrieval.rrf_then_rerank(both_chunks(spark, d), both_queries(spark, d), 5)


@query("answer_sources", f"WITH {_BOTH} SELECT query_id, id, substr(text, 1, 500) || '...' AS content, score, CAST(rank AS INTEGER) AS rank FROM dense JOIN docs USING (id) WHERE rank <= 5")
def _(spark, d):
    chunks = both_chunks(spark, d)
    return retrieval.sources(fusion.with_chunks(vectors.search(chunks, both_queries(spark, d), 5, 0.05), chunks.select("id", "content")))


_PROMPTS = f"""WITH {_BOTH}, f AS ({_rrf_sql([('dense', 'CAST(0.7 AS DOUBLE)'), ('sparse', '(1 - CAST(0.7 AS DOUBLE))')], 5, 10)}),
    c AS (SELECT query_id, string_agg('[' || rank || '] ' || substr(text, 1, 500), E'\\n\\n' ORDER BY rank) AS context FROM f JOIN docs USING (id) GROUP BY query_id),
    pr AS (SELECT query_id, '{retrieval.TEMPLATES['qa']}' || E'\\n\\nContext:\\n' || context || E'\\n\\nQuestion: ' || text AS prompt, 'No language model is configured.' AS answer FROM c JOIN asked USING (query_id))"""


@query("answer_prompts", f"{_PROMPTS} SELECT *, len({sql_words('prompt')}) + len({sql_words('answer')}) AS tokens_used FROM pr")
def _(spark, d):
    chunks, queries = both_chunks(spark, d), both_queries(spark, d)
    full = fusion.with_chunks(retrieval.hybrid(chunks, queries, 5, threshold=0.05), chunks.select("id", "content")).join(queries.select("query_id", "query_text"), "query_id")
    return retrieval.answer(retrieval.prompts(full))


@query("first_words_jaccard", f"""SELECT doc_id, round(CASE WHEN len(u) = 0 THEN 0 ELSE CAST(len(list_intersect(a, b)) AS DOUBLE) / len(u) END, 6) AS similarity FROM (SELECT doc_id, a, b, list_distinct(a || b) AS u FROM
    (SELECT d.doc_id, list_distinct({sql_words('lower(substr(d.text, 1, 200))')}) AS a, list_distinct({sql_words('lower(substr(n.text, 1, 200))')}) AS b FROM documents d JOIN documents n ON n.doc_id = d.doc_id + 1))""")
def _(spark, d):
    rows = text_chunks(spark, d)
    after = rows.select((F.col("id") - 1).alias("id"), F.col("content").alias("next"))
    return rows.join(after, "id").select(F.col("id").alias("doc_id"), F.round(T.jaccard(T.head_words("content"), T.head_words("next")), 6).alias("similarity"))


# --- chunking ----------------------------------------------------------------------------------


def chunk_docs(spark, d):
    return table(spark, d, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("document_id"), F.col("text").alias("content"), F.when(F.col("doc_id") % 2 == 0, "clinical_trial").otherwise("sap").alias("document_type"))


_W = f"(SELECT doc_id, {sql_words('text')} AS w FROM documents)"


def _windows_sql(starts: str, tag: str) -> str:
    return f"""SELECT 'doc' || doc_id AS document_id, CAST(s // 80 AS INTEGER) AS chunk_index, 'doc' || doc_id || '_{tag}_' || (s // 80) AS id, array_to_string(w[s + 1 : s + 100], ' ') AS content, CAST(s AS INTEGER) AS start_token, len(w[s + 1 : s + 100]) AS token_count
        FROM (SELECT doc_id, w, unnest({starts}) AS s FROM {_W})"""


@query("fixed_windows", _windows_sql("range(0, len(w), 80)", "fixed"))
def _(spark, d):
    return chunking.token_windows(chunk_docs(spark, d), 100, 20, to_end=False, tag="fixed")


@query("overlap_windows", _windows_sql("CASE WHEN len(w) = 0 THEN [] ELSE range(0, greatest(CAST(ceil((len(w) - 100) / 80.0) AS BIGINT), 0) * 80 + 1, 80) END", "chunk"))
def _(spark, d):
    return chunking.token_windows(chunk_docs(spark, d), 100, 20, to_end=True)


_SENTENCES = r"""(SELECT doc_id, list_filter(list_transform(CASE WHEN len(a) > 1 THEN a WHEN len(b) > 1 THEN b ELSE c END, lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS s FROM
    (SELECT doc_id, string_split(regexp_replace(t, '([.!?])\s+([A-Z])', '\1§§\2', 'g'), '§§') AS a, string_split(regexp_replace(t, '([.!?])\s+', '\1§§', 'g'), '§§') AS b, regexp_split_to_array(t, '\n+') AS c
     FROM (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents)))"""


@query("sentences", f"SELECT 'doc' || doc_id AS document_id, CAST(i - 1 AS INTEGER) AS pos, s[i] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM {_SENTENCES})")
def _(spark, d):
    return chunking.sentence_rows(chunk_docs(spark, d))


def letter_vectors(rows):
    """Counts of eight letters: a transparent stand-in for sentence vectors."""
    low = F.lower("sentence")
    return rows.withColumn("embedding", F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))).cast("double") for c in "etaonirs"]))


_LETTERS = ", ".join(f"CAST(length(l) - length(replace(l, '{c}', '')) AS DOUBLE)" for c in "etaonirs")


@query("semantic_boundaries", f"""WITH r AS (SELECT doc_id, i AS pos, lower(s[i]) AS l FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM {_SENTENCES})),
    v AS (SELECT doc_id, pos, [{_LETTERS}] AS e FROM r), n AS (SELECT *, lead(e) OVER (PARTITION BY doc_id ORDER BY pos) AS e2 FROM v),
    c AS (SELECT doc_id, pos, CASE WHEN e2 IS NULL THEN NULL WHEN list_sum(e) * list_sum(e2) = 0 THEN 0.0 ELSE round(list_cosine_similarity(e, e2), 9) END AS sim FROM n),
    q AS (SELECT doc_id, quantile_cont(sim, 0.25) AS cut FROM c GROUP BY doc_id)
    SELECT 'doc' || doc_id AS document_id, 1 + count(*) FILTER (WHERE sim < cut - 1e-9) AS n_chunks, count(*) AS n_sentences FROM c JOIN q USING (doc_id) GROUP BY doc_id""")
def _(spark, d):
    found = chunking.semantic_groups(letter_vectors(chunking.sentence_rows(chunk_docs(spark, d))))
    return found.groupBy("document_id").agg((F.max("grp") + 1).alias("n_chunks"), F.count("*").alias("n_sentences"))


_ADAPTIVE = f"""WITH r AS (SELECT doc_id, i AS pos, s[i] AS sentence, lower(s[i]) AS l FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM {_SENTENCES})),
    v AS (SELECT doc_id, pos, sentence, [{_LETTERS}] AS e FROM r), n AS (SELECT *, lead(e) OVER (PARTITION BY doc_id ORDER BY pos) AS e2 FROM v),
    c AS (SELECT doc_id, pos, sentence, CASE WHEN e2 IS NULL THEN NULL WHEN list_sum(e) * list_sum(e2) = 0 THEN 0.0 ELSE round(list_cosine_similarity(e, e2), 9) END AS sim FROM n),
    q AS (SELECT doc_id, quantile_cont(sim, 0.25) AS cut FROM c GROUP BY doc_id),
    g AS (SELECT doc_id, pos, sentence, coalesce(sum(CASE WHEN sim < cut - 1e-9 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM c JOIN q USING (doc_id)),
    j AS (SELECT doc_id, CAST(grp AS INTEGER) AS grp, string_agg(sentence, ' ' ORDER BY pos) AS content FROM g GROUP BY doc_id, grp), jw AS (SELECT *, {sql_words('content')} AS w FROM j),
    m AS (SELECT doc_id, 'doc' || doc_id || '_semantic_' || grp AS id, content, len(w) AS token_count FROM jw WHERE len(w) <= 100
        UNION ALL SELECT doc_id, 'doc' || doc_id || '_semantic_split_' || grp || '_' || (s // 100), array_to_string(w[s + 1 : s + 100], ' '), len(w[s + 1 : s + 100]) FROM (SELECT *, unnest(range(0, len(w), 100)) AS s FROM jw WHERE len(w) > 100)),
    good AS (SELECT doc_id FROM m GROUP BY doc_id HAVING doc_id % 2 = 0 OR count(*) BETWEEN 2 AND 20),
    fixed AS ({_windows_sql("range(0, len(w), 80)", "fixed")})
    SELECT 'doc' || doc_id AS document_id, id, content, token_count, 'semantic' AS method FROM m WHERE doc_id IN (SELECT doc_id FROM good)
    UNION ALL SELECT document_id, id, content, token_count, 'fixed' FROM fixed WHERE document_id IN (SELECT 'doc' || doc_id FROM documents WHERE doc_id % 2 = 1 AND doc_id NOT IN (SELECT doc_id FROM good))"""


@query("adaptive_chunks", _ADAPTIVE)
def _(spark, d):
    docs = chunk_docs(spark, d)
    return chunking.adaptive_chunks(docs, letter_vectors(chunking.sentence_rows(docs)), 100, 20)


_PACKED = f"""WITH RECURSIVE para AS (SELECT doc_id, i, regexp_replace(ps[i], '^\\s+|\\s+$', '', 'g') AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS ps, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
    pw AS (SELECT doc_id, i, p, {sql_words('p')} AS w FROM para WHERE p <> ''),
    cut AS (SELECT doc_id, i, 0 AS s, p AS piece, len(w) AS n FROM pw WHERE len(w) <= 100 UNION ALL SELECT doc_id, i, s, array_to_string(w[s + 1 : s + 100], ' '), len(w[s + 1 : s + 100]) FROM (SELECT *, unnest(range(0, len(w), 100)) AS s FROM pw WHERE len(w) > 100)),
    pieces AS MATERIALIZED (SELECT doc_id, piece, n, row_number() OVER (PARTITION BY doc_id ORDER BY i, s) AS i FROM cut),
    k AS (SELECT doc_id, i, 0 AS chunk_index, piece AS content, n FROM pieces WHERE i = 1
        UNION ALL SELECT k.doc_id, p.i, CASE WHEN k.n + p.n <= 100 THEN k.chunk_index ELSE k.chunk_index + 1 END, CASE WHEN k.n + p.n <= 100 THEN k.content || chr(10) || chr(10) || p.piece ELSE p.piece END, CASE WHEN k.n + p.n <= 100 THEN k.n + p.n ELSE p.n END
        FROM k JOIN pieces p ON p.doc_id = k.doc_id AND p.i = k.i + 1)
    SELECT 'doc' || doc_id AS document_id, chunk_index, 'doc' || doc_id || '_chunk_' || chunk_index AS id, arg_max(content, i) AS content, arg_max(n, i) AS token_count FROM k GROUP BY doc_id, chunk_index"""


@query("paragraph_chunks", _PACKED)
def _(spark, d):
    return chunking.paragraph_chunks(chunk_docs(spark, d), 100, r"\n")


_MARKDOWN = f"""WITH c AS (SELECT doc_id, 'lead' || chr(10) || '# First part' || chr(10) || text || chr(10) || '## Second part' || chr(10) || 'tail words' AS content FROM documents),
    b AS (SELECT doc_id, string_split_regex(content, '(?m)^#{{1,6}}[ \\t]+[^\\n]*$') AS bodies, regexp_extract_all(content, '(?m)^#{{1,6}}[ \\t]+([^\\n]*)$', 1) AS titles FROM c),
    s AS (SELECT doc_id, i - 1 AS section, regexp_replace(titles[i], '^\\s+|\\s+$', '', 'g') AS section_title, {sql_words('bodies[i + 1]')} AS w FROM (SELECT *, unnest(range(1, len(titles) + 1)) AS i FROM b))
    SELECT 'doc' || doc_id AS document_id, CAST(section AS INTEGER) AS section, section_title, CAST(t AS INTEGER) AS start_token, array_to_string(w[t + 1 : t + 100], ' ') AS content, len(w[t + 1 : t + 100]) AS token_count
    FROM (SELECT *, unnest(CASE WHEN len(w) = 0 THEN [] ELSE range(0, greatest(CAST(ceil((len(w) - 100) / 80.0) AS BIGINT), 0) * 80 + 1, 80) END) AS t FROM s)"""


@query("markdown_chunks", _MARKDOWN)
def _(spark, d):
    docs = chunk_docs(spark, d).withColumn("content", F.concat(F.lit("lead\n# First part\n"), "content", F.lit("\n## Second part\ntail words")))
    return chunking.markdown_chunks(docs, 100, 20)


@query("json_chunks", "SELECT event_id AS document_id, CAST(0 AS INTEGER) AS chunk_index, 'k' AS path, CAST(props->>'$.k' AS VARCHAR) AS content, true AS parsed FROM events")
def _(spark, d):
    return chunking.json_chunks(table(spark, d, "events").select(F.col("event_id").alias("document_id"), F.col("props").alias("content")))


@query("row_chunks", """SELECT user_id AS document_id, rn // 5 AS chunk_index, count(*) AS n_rows, CAST(min(rn) AS INTEGER) AS first_row, CAST(max(rn) AS INTEGER) AS last_row FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS rn FROM events) GROUP BY ALL""")
def _(spark, d):
    found = chunking.row_chunks(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", ["event_id"])
    return found.select("document_id", "chunk_index", F.size(F.split("content", "\n")).cast("bigint").alias("n_rows"), "first_row", "last_row")


@query("chunk_offsets", f"SELECT 'doc' || doc_id AS document_id, instr(text, w[len(w)]) - 1 AS start_char FROM {_W} JOIN (SELECT doc_id AS i, text FROM documents) ON doc_id = i WHERE len(w) > 0")
def _(spark, d):
    return chunk_docs(spark, d).where(F.size(T.words("content")) > 0).select("document_id", chunking.locate_chunk(F.col("content"), F.element_at(T.words("content"), -1)).cast("bigint").alias("start_char"))
