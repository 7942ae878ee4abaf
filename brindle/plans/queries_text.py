"""Registered queries over texts and scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import scalars as S
from brindle.functions import text as T
from brindle.functions import vocabulary as V
from brindle.plans.registry import query
from brindle.session import table

#: White space and word characters of Unicode, for the oracle's engine.
WS = r"[\s\x0b\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')"


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def docs(spark, d):
    return table(spark, d, "documents")


CLEAN_SQL = rf"regexp_replace(regexp_replace(regexp_replace(text, '{WS}+', ' ', 'g'), '[\x00-\x1f\x7f\x{{80}}-\x{{9f}}]', '', 'g'), '^{WS}+|{WS}+$', '', 'g')"


@query("clean_text", f"SELECT doc_id, {CLEAN_SQL} AS cleaned FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", T.clean("text").alias("cleaned"))


@query("truncate_text", "SELECT doc_id, CASE WHEN length(text) <= 500 THEN text ELSE substr(text, 1, 497) || '...' END AS short FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", T.truncate("text", 500).alias("short"))


@query("keywords", rf"""SELECT doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(' ' || regexp_replace(lower(text), '[^\p{{L}}\p{{N}}\p{{M}}_]', '  ', 'g') || ' ', ' ([a-z]{{3,}}) ', 1), lambda w: NOT list_contains({sql_list(V.STOP_WORDS)}, w)))) AS keywords FROM documents""")
def _(spark, d):
    return docs(spark, d).select("doc_id", T.keywords("text").alias("keywords"))


@query("text_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", T.sha256("text").alias("content_hash"))


@query("token_counts", f"SELECT lang, source, count(*) AS n_docs, sum(len({sql_words('text')})) AS n_tokens FROM documents GROUP BY lang, source")
def _(spark, d):
    return docs(spark, d).groupBy("lang", "source").agg(F.count("*").alias("n_docs"), F.sum(T.word_count("text")).alias("n_tokens"))


@query("bpe_token_counts")
def _(spark, d):
    """Tokens of each document by a byte-pair vocabulary."""
    import public_tokenizers

    from brindle.functions import bpe

    return docs(spark, d).select("doc_id", bpe.token_count("text", public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).alias("n_tokens"))


@query("sanitize_filenames", r"""WITH n AS (SELECT page_id, regexp_replace(regexp_replace(url, '[<>:"/\\|?*]', '_', 'g'), '[\x00-\x1f\x7f]', '', 'g') AS name FROM pages)
    SELECT page_id, CASE WHEN length(name) > 255 THEN substr(name, 1, 255) ELSE name END AS file_name, CASE WHEN contains(name, '.') THEN lower(regexp_extract(name, '([^.]*)$', 1)) ELSE '' END AS extension FROM n""")
def _(spark, d):
    name = T.sanitize_filename("url")
    return table(spark, d, "pages").select("page_id", name.alias("file_name"), T.file_extension(name).alias("extension"))


@query("email_check", rf"""SELECT doc_id, word, regexp_full_match(word, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}') AS valid
    FROM (SELECT doc_id, unnest({sql_words('text')}) AS word FROM documents) WHERE contains(word, '@')""")
def _(spark, d):
    found = docs(spark, d).select("doc_id", F.explode(T.words("text")).alias("word")).where(F.contains("word", F.lit("@")))
    return found.select("doc_id", "word", T.is_email("word").alias("valid"))


_ASCII = "regexp_replace(text, '[^\\x00-\\x7f]', 'x', 'g')"
_PHI_SQL = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS type, unnest(regexp_extract_all(t, '{p}')) AS match FROM a" for k, p in V.PHI_PATTERNS)


@query("phi_detection", f"WITH a AS (SELECT doc_id, {_ASCII} AS t FROM documents), m AS ({_PHI_SQL}) SELECT doc_id, type, match, count(*) AS n FROM m GROUP BY ALL")
def _(spark, d):
    ascii_text = F.regexp_replace("text", r"[^\x00-\x7f]", "x")
    found = docs(spark, d).select("doc_id", F.explode(T.phi_matches(ascii_text)).alias("m"))
    return found.groupBy("doc_id", F.col("m.type").alias("type"), F.col("m.text").alias("match")).agg(F.count("*").alias("n"))


@query("phi_positions", f"""WITH a AS (SELECT doc_id, {_ASCII} AS t FROM documents), m AS ({_PHI_SQL}) SELECT doc_id, count(*) AS n_matches, true AS positions_hold FROM m GROUP BY doc_id""")
def _(spark, d):
    ascii_text = F.regexp_replace("text", r"[^\x00-\x7f]", "x")
    found = docs(spark, d).select("doc_id", ascii_text.alias("t")).select("doc_id", F.col("t").cast("binary").alias("b"), T.phi_matches("t").alias("ms"))
    # a byte is a character of ``t``, and bytes are cut out without a walk through the text before them
    held = F.forall("ms", lambda m: F.substring("b", m["start"] + 1, m["end"] - m["start"]) == m["text"].cast("binary"))
    each = found.select("doc_id", F.size("ms").alias("n"), held.alias("held"))
    return each.groupBy("doc_id").agg(F.sum("n").alias("n_matches"), F.bool_and("held").alias("positions_hold")).where("n_matches > 0")


def _redact_sql(x: str) -> str:
    for _, p in V.PHI_PATTERNS:
        x = f"regexp_replace({x}, '{p}', '[REDACTED]', 'g')"
    return x


@query("phi_redaction", f"SELECT doc_id, {_redact_sql(_ASCII)} AS redacted FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", T.redact_phi(F.regexp_replace("text", r"[^\x00-\x7f]", "x")).alias("redacted"))


@query("context_windows", "SELECT doc_id, substr(text, greatest(p - 1 - 100, 0) + 1, (p + 2 + 100) - greatest(p - 1 - 100, 0)) AS context FROM (SELECT doc_id, text, instr(text, 'the') AS p FROM documents) WHERE p > 0")
def _(spark, d):
    start = F.locate("the", F.col("text")) - 1
    return docs(spark, d).where(start >= 0).select("doc_id", T.context_window("text", start, start + 3, 100).alias("context"))


@query("code_blocks", r"""WITH p AS (SELECT conv_id, turn, string_split('Intro ' || role || ' ```' || text || '``` done', '```') AS parts FROM conversations)
    SELECT conv_id, turn, list_filter(parts, lambda x, i: i % 2 = 0) AS code, trim(parts[1] || parts[-1]) AS explanation FROM p""")
def _(spark, d):
    answer = F.concat(F.lit("Intro "), "role", F.lit(" ```"), "text", F.lit("``` done"))
    return table(spark, d, "conversations").select("conv_id", "turn", T.code_blocks(answer).alias("b")).select("conv_id", "turn", "b.code", "b.explanation")


@query("document_types", """SELECT doc_id, CASE WHEN contains(n, 'sdtm') THEN 'sdtm' WHEN contains(n, 'adam') THEN 'adam' WHEN contains(n, 'sap') THEN 'sap' WHEN contains(n, 'protocol') THEN 'protocol' ELSE 'other' END AS document_type
    FROM (SELECT doc_id, lower(['SDTM_', 'Adam-', 'SAP_', 'Protocol_', 'notes_'][1 + doc_id % 5] || source || '.csv') AS n FROM documents)""")
def _(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ["SDTM_", "Adam-", "SAP_", "Protocol_", "notes_"])), (F.col("doc_id") % 5 + 1).cast("int"))
    return docs(spark, d).select("doc_id", T.document_type(F.concat(kind, "source", F.lit(".csv"))).alias("document_type"))


_STUDY = [r"STUDY(\d{4,6})", r"STUDYID[_-]?([\p{L}\p{N}_]+)", r"STUDY[_-]?([\p{L}\p{N}_]+)", r"PROTOCOL[_-]?([\p{L}\p{N}_]+)"]
_STUDY_SQL = "coalesce(" + ", ".join(f"nullif(regexp_extract({x}, '(?i){p}', 1), '')" for p in _STUDY for x in ("file_name", "substr(content, 1, 1000)")) + ")"


@query("document_metadata", rf"""WITH f AS (SELECT doc_id, 'STUDY' || lpad(CAST(doc_id AS VARCHAR), CAST(3 + doc_id % 3 AS INTEGER), '0') || '_' || source || '.TXT' AS file_name, 'PROTOCOL-' || lang || ' ' || text AS content FROM documents)
    SELECT doc_id, file_name, '.TXT' AS file_extension, octet_length(encode(content)) AS file_size, {_STUDY_SQL} AS study_id FROM f""")
def _(spark, d):
    name = F.concat(F.lit("/data/in/STUDY"), F.expr("lpad(cast(doc_id as string), cast(3 + doc_id % 3 as int), '0')"), F.lit("_"), "source", F.lit(".TXT"))
    files = docs(spark, d).select("doc_id", name.alias("path"), F.concat(F.lit("PROTOCOL-"), "lang", F.lit(" "), "text").alias("content"))
    return files.select("doc_id", T.metadata("path", "content").alias("m")).select("doc_id", "m.*")


@query("document_domains", f"SELECT doc_id, list_sort(list_filter({sql_list(V.SDTM_DOMAINS + V.ADAM_DATASETS)}, lambda c: contains(text, c))) AS domains FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", T.domains("text").alias("domains"))


@query("json_domains", "SELECT event_id, list_sort(json_keys(props)) AS domains FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", T.domains("props").alias("domains"))


@query("document_ids", "SELECT doc_id, 'doc_' || substr(sha256(source || '/' || CAST(doc_id AS VARCHAR)), 1, 16) || '_' || substr(sha256(text), 1, 16) AS document_id FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", T.document_id(F.concat_ws("/", "source", F.col("doc_id").cast("string")), "text").alias("document_id"))


# --- queries as data ---------------------------------------------------------------------------

#: Conversation turns, made clinical by their number, so that every branch occurs.
_TURN_TAILS = ["", " adverse event safety of the trial", " AB1234", " hemoglobin laboratory efficacy", " what is treatment", " lb12 dosage"]
_TURNS_SQL = f"(SELECT conv_id, turn, role, text || ({sql_list(_TURN_TAILS)})[1 + (conv_id + turn) % 6] AS q FROM conversations)"


def turns(spark, d):
    tail = F.element_at(F.array(*map(F.lit, _TURN_TAILS)), ((F.col("conv_id") + F.col("turn")) % 6 + 1).cast("int"))
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.concat("text", tail).alias("q"))


_MED = f"len(list_filter({sql_list(V.MEDICAL_TERMS)}, lambda t: contains(lower(q), t)))"
_UNICODE_EDGE = r"[^\p{L}\p{N}\p{M}_]"


@query("query_analysis", rf"""WITH a AS (SELECT conv_id, turn, q, len(list_filter({sql_list(V.QUESTION_WORDS)}, lambda t: contains(lower(q), t))) > 0 AS is_question, {_MED} AS medical_term_count,
        regexp_matches(q, '(^|{_UNICODE_EDGE})[A-Z]{{2}}\d{{4}}($|{_UNICODE_EDGE})') OR regexp_matches(lower(q), '(^|{_UNICODE_EDGE})(trt|ae|lb)\d*($|{_UNICODE_EDGE})') AS has_identifiers, len({sql_words('lower(q)')}) AS word_count FROM {_TURNS_SQL}),
    b AS (SELECT *, word_count > 10 OR medical_term_count > 2 AS is_complex FROM a)
    SELECT conv_id, turn, CASE WHEN has_identifiers THEN 'keyword' WHEN is_complex AND medical_term_count > 1 THEN 'semantic' WHEN is_question THEN 'hybrid' ELSE 'adaptive' END AS strategy,
        is_question, medical_term_count, has_identifiers, is_complex, word_count FROM b""")
def _(spark, d):
    return turns(spark, d).select("conv_id", "turn", T.analyze_query("q").alias("a")).select("conv_id", "turn", "a.*")


_KEY = f"list_filter({sql_words('lower(q)')}, lambda w: (length(w) > 3 AND NOT list_contains({sql_list(V.KEY_TERM_STOP_WORDS)}, w)) OR list_contains({sql_list(V.MEDICAL_TERMS)}, w))"


@query("query_key_terms", f"SELECT conv_id, turn, {_KEY} AS key_terms, array_to_string({_KEY}, ' | ') AS boolean_query FROM {_TURNS_SQL}")
def _(spark, d):
    return turns(spark, d).select("conv_id", "turn", T.key_terms("q").alias("key_terms"), T.boolean_query(T.key_terms("q")).alias("boolean_query"))


_EXPAND = " UNION ALL ".join(f"SELECT conv_id, turn, replace(lower(q), '{t}', '{s}') AS expansion FROM t WHERE contains(lower(q), '{t}')" for t, ss in V.SYNONYMS.items() for s in ss[:2])


@query("query_expansion", f"WITH t AS {_TURNS_SQL} {_EXPAND}")
def _(spark, d):
    return turns(spark, d).select("conv_id", "turn", F.explode(T.expansions("q")).alias("expansion"))


@query("adaptive_weights", f"""SELECT conv_id, turn, least(1.0, round(CAST(0.7 AS DOUBLE) + CASE WHEN {_MED} > 0 THEN CAST(0.1 AS DOUBLE) ELSE 0 END + CASE WHEN len({sql_words('q')}) > 8 THEN CAST(0.1 AS DOUBLE) ELSE 0 END + CASE WHEN role = 'system' THEN CAST(0.2 AS DOUBLE) ELSE 0 END, 6)) AS dense_weight FROM {_TURNS_SQL}""")
def _(spark, d):
    mode = F.when(F.col("role") == "system", "semantic").otherwise("qa")
    return turns(spark, d).select("conv_id", "turn", T.adaptive_weight("q", mode).alias("dense_weight"))


# --- scalars -----------------------------------------------------------------------------------


@query("score_normalization", """SELECT o_orderkey, CASE WHEN hi = lo THEN 0.0 ELSE round((o_totalprice - lo) / (hi - lo), 6) END AS score
    FROM orders JOIN (SELECT o_orderpriority, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1) USING (o_orderpriority)""")
def _(spark, d):
    orders = table(spark, d, "orders")
    ends = orders.groupBy("o_orderpriority").agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    return orders.join(ends, "o_orderpriority").select("o_orderkey", F.round(S.normalize_score("o_totalprice", F.col("lo"), F.col("hi")), 6).alias("score"))


@query("safe_division", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN -1.0 ELSE round(l_extendedprice / l_discount, 4) END AS ratio FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.safe_divide("l_extendedprice", "l_discount", -1.0), 4).alias("ratio"))


@query("format_bytes", """SELECT doc_id, CASE WHEN b < 1024 THEN printf('%.2f B', b) WHEN b < 1048576 THEN printf('%.2f KB', b / 1024) WHEN b < 1073741824 THEN printf('%.2f MB', b / 1048576) WHEN b < 1099511627776 THEN printf('%.2f GB', b / 1073741824) ELSE printf('%.2f TB', b / 1099511627776) END AS size
    FROM (SELECT doc_id, CAST(n_chars AS DOUBLE) * [1, 64, 4096, 1048576, 1073741824][1 + doc_id % 5] AS b FROM documents)""")
def _(spark, d):
    factor = F.element_at(F.array(*[F.lit(x).cast("double") for x in (1, 64, 4096, 1048576, 1073741824)]), (F.col("doc_id") % 5 + 1).cast("int"))
    return docs(spark, d).select("doc_id", S.format_bytes(F.col("n_chars") * factor).alias("size"))


@query("format_duration", """SELECT event_id, CASE WHEN s < 1 THEN printf('%dms', CAST(round_even(s * 1000, 0) AS BIGINT)) WHEN s < 60 THEN printf('%.2fs', s) WHEN s < 3600 THEN printf('%.2fm', s / 60) ELSE printf('%.2fh', s / 3600) END AS duration
    FROM (SELECT event_id, CAST(event_id AS DOUBLE) * [0.0005, 0.25, 1, 64][1 + event_id % 4] / 8 AS s FROM events)""")
def _(spark, d):
    factor = F.element_at(F.array(*[F.lit(x) for x in (0.0005, 0.25, 1.0, 64.0)]), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", S.format_duration(F.col("event_id") * factor / 8).alias("duration"))


@query("parse_dates", """WITH s AS (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') WHEN 4 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 5 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE strftime(o_orderdate, 'on %d %m') END AS s FROM orders)
    SELECT o_orderkey, strftime(coalesce(try_strptime(s, '%Y-%m-%d'), try_strptime(s, '%Y-%m-%d %H:%M:%S'), try_strptime(s, '%Y-%m-%dT%H:%M:%S'), try_strptime(s, '%Y-%m-%dT%H:%M:%SZ'), try_strptime(s, '%m/%d/%Y'), try_strptime(s, '%d/%m/%Y')), '%Y-%m-%d %H:%M:%S') AS parsed FROM s""")
def _(spark, d):
    formats = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'", "MM/dd/yyyy", "dd/MM/yyyy", "'on' dd MM"]
    written = F.element_at(F.array(*[F.date_format("o_orderdate", f) for f in formats]), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", F.date_format(S.parse_date(written), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("ages", "SELECT o_orderkey, CAST(year(r) - year(o_orderdate) - CASE WHEN (month(r), day(r)) < (month(o_orderdate), day(o_orderdate)) THEN 1 ELSE 0 END AS INTEGER) AS age FROM (SELECT *, DATE '2024-06-14' AS r FROM orders)")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.age("o_orderdate", F.lit("2024-06-14").cast("date")).cast("int").alias("age"))


@query("merge_maps", "SELECT o_orderkey, o_orderpriority AS a, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'left' END AS b FROM orders")
def _(spark, d):
    left = F.create_map(F.lit("a"), "o_orderpriority", F.lit("b"), F.lit("left"))
    right = F.when(F.col("o_orderkey") % 2 == 0, F.create_map(F.lit("b"), "o_orderstatus")).otherwise(F.create_map(F.lit("c"), F.lit("x")))
    return table(spark, d, "orders").select("o_orderkey", S.merge_maps(left, right).alias("m")).select("o_orderkey", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"))


@query("flatten_json", "SELECT event_id, 'outer.props.k' AS key, CAST(props->>'$.k' AS VARCHAR) AS value FROM events UNION ALL SELECT event_id, 'type' AS key, event_type AS value FROM events")
def _(spark, d):
    nested = F.concat(F.lit('{"outer": {"props": '), "props", F.lit('}, "type": "'), "event_type", F.lit('"}'))
    return table(spark, d, "events").select("event_id", F.explode(S.flatten_json(nested)))


@query("json_paths", "SELECT event_id, props->>'$.k' AS k, coalesce(props->>'$.missing.key', 'none') AS missing, 'v' AS written FROM events")
def _(spark, d):
    set_ = S.deep_set("props", "a.b", F.lit("v"))
    return table(spark, d, "events").select("event_id", S.deep_get("props", "k").alias("k"), S.deep_get("props", "missing.key", "none").alias("missing"), S.deep_get(set_, "a.b").alias("written"))


_NESTED = """'{"a": {"b": {"c": {"d": {"e": {"f": ' || props || ', "n": ' || event_id || '}, "s": "{x"}}}, "z": []}, "b": {}, "t": "' || event_type || '"}'"""


@query(
    "flatten_deep_json",
    f"""SELECT event_id, unnest(['a.b.c.d.e.f.k', 'a.b.c.d.e.n', 'a.b.c.d.s', 'a.z', 't']) AS key,
    unnest([props->>'$.k', CAST(event_id AS VARCHAR), '{{x', '[]', event_type]) AS value FROM events""",
)
def _(spark, d):
    """Seven levels, a string that looks like an object, an array, an empty object."""
    rows = table(spark, d, "events").withColumn("j", F.expr(_NESTED))
    return rows.select("event_id", F.explode(S.flatten_json("j", S.deepest(rows, "j"))))


@query("merge_deep_json", """SELECT event_id, CAST(event_id AS VARCHAR) AS kept, props->>'$.k' AS put, CASE WHEN event_id % 2 = 0 THEN 'flat' ELSE event_type END AS won, 'sibling' AS beside FROM events""")
def _(spark, d):
    left = """'{"a": {"b": {"c": {"kept": ' || event_id || ', "put": 0}, "beside": "sibling"}}, "won": {"was": "' || event_type || '"}}'"""
    right = """'{"a": {"b": {"c": {"put": ' || get_json_object(props, '$.k') || '}}}' || if(event_id % 2 = 0, ', "won": "flat"', ', "won": {"other": 1}') || '}'"""
    rows = table(spark, d, "events").select("event_id", F.expr(left).alias("l"), F.expr(right).alias("r"))
    rows = rows.withColumn("m", S.merge_json("l", "r", S.deepest(rows, "l", "r")))
    at = lambda p: S.deep_get("m", p)
    return rows.select("event_id", at("a.b.c.kept").alias("kept"), at("a.b.c.put").alias("put"), F.when(F.col("event_id") % 2 == 0, at("won")).otherwise(at("won.was")).alias("won"), at("a.b.beside").alias("beside"))


@query("json_validity", "SELECT event_id, json_valid(CASE WHEN event_id % 3 = 0 THEN props || '}' ELSE props END) AS valid FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", S.is_json(F.when(F.col("event_id") % 3 == 0, F.concat("props", F.lit("}"))).otherwise(F.col("props"))).alias("valid"))


@query("array_batches", f"""SELECT doc_id, CAST(i AS INTEGER) AS batch, w[1 + 50 * i : 50 * (i + 1)] AS items FROM (SELECT doc_id, w, unnest(range(CAST(ceil(len(w) / 50.0) AS BIGINT))) AS i FROM (SELECT doc_id, {sql_words('text')} AS w FROM documents))""")
def _(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(S.batches(T.words("text"), 50)).alias("batch", "items"))


@query("embedding_cache_keys", "SELECT doc_id, 'embedding:base:' || sha256(text) AS cache_key FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", S.cache_key("base", "text").alias("cache_key"))


@query("study_access", """SELECT c_custkey, n_regionkey, list_contains(studies, n_regionkey) OR list_contains(permissions, 'admin') AS allowed
    FROM (SELECT c_custkey, n_regionkey, [c_custkey % 5, (c_custkey + 1) % 5] AS studies, CASE WHEN c_mktsegment = 'BUILDING' THEN ['read', 'admin'] ELSE ['read'] END AS permissions FROM customer JOIN nation ON c_nationkey = n_nationkey)""")
def _(spark, d):
    users = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("c_custkey")
    studies = F.array((key % 5).cast("int"), ((key + 1) % 5).cast("int"))
    permissions = F.when(F.col("c_mktsegment") == "BUILDING", F.array(F.lit("read"), F.lit("admin"))).otherwise(F.array(F.lit("read")))
    return users.select("c_custkey", "n_regionkey", S.has_access("n_regionkey", studies, permissions).alias("allowed"))
