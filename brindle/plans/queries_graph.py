"""Registered queries of the knowledge graph.

Two graphs from the tables. Property graph: regions, nations, customers and suppliers with ``part_of`` and
``located_in``. Users: an undirected edge between the users of consecutive events.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import vocabulary as V
from brindle.operators import graph
from brindle.plans import ingestion
from brindle.plans.queries_text import sql_list
from brindle.plans.registry import query
from brindle.session import table


def entities(spark, d):
    one = lambda t, key, kind, name: table(spark, d, t).select(F.concat(F.lit(kind[0]), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("type"), F.col(name).alias("name"))
    out = one("region", "r_regionkey", "region", "r_name")
    for t, key, kind, name in (("nation", "n_nationkey", "nation", "n_name"), ("customer", "c_custkey", "customer", "c_name"), ("supplier", "s_suppkey", "supplier", "s_name")):
        out = out.unionByName(one(t, key, kind, name))
    return out


_E = """e AS (SELECT 'r' || r_regionkey AS id, 'region' AS type, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'nation', n_name FROM nation
    UNION ALL SELECT 'c' || c_custkey, 'customer', c_name FROM customer UNION ALL SELECT 's' || s_suppkey, 'supplier', s_name FROM supplier)"""


def relations(spark, d):
    one = lambda t, a, ka, b, kb, kind: table(spark, d, t).select(F.concat(F.lit(kind + ka), F.col(a).cast("string")).alias("id"), F.concat(F.lit(ka), F.col(a).cast("string")).alias("source_id"), F.concat(F.lit(kb), F.col(b).cast("string")).alias("target_id"), F.lit(kind).alias("type"))
    return one("nation", "n_nationkey", "n", "n_regionkey", "r", "part_of").unionByName(one("customer", "c_custkey", "c", "c_nationkey", "n", "located_in")).unionByName(one("supplier", "s_suppkey", "s", "s_nationkey", "n", "located_in"))


_R = """r AS (SELECT 'part_ofn' || n_nationkey AS id, 'n' || n_nationkey AS source_id, 'r' || n_regionkey AS target_id, 'part_of' AS type FROM nation
    UNION ALL SELECT 'located_inc' || c_custkey, 'c' || c_custkey, 'n' || c_nationkey, 'located_in' FROM customer UNION ALL SELECT 'located_ins' || s_suppkey, 's' || s_suppkey, 'n' || s_nationkey, 'located_in' FROM supplier)"""


def user_edges(spark, d):
    ev = table(spark, d, "events").select("event_id", "user_id")
    after = ev.select((F.col("event_id") - 1).alias("event_id"), F.col("user_id").alias("then"))
    return graph.undirected(ev.join(after, "event_id"), "user_id", "then")


def user_nodes(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("id")).distinct()


_U = """ed AS (SELECT DISTINCT least(x.user_id, y.user_id) AS a, greatest(x.user_id, y.user_id) AS b FROM events x JOIN events y ON y.event_id = x.event_id + 1 WHERE x.user_id <> y.user_id),
    ways AS (SELECT a AS u, b AS v FROM ed UNION ALL SELECT b, a FROM ed), deg AS (SELECT u AS id, count(*) AS degree FROM ways GROUP BY u), nodes AS (SELECT DISTINCT user_id AS id FROM events)"""


@query("find_entities", f"WITH {_E} SELECT * FROM e WHERE type = 'nation' AND regexp_matches(name, '(?i)an') ORDER BY name LIMIT 100")
def _(spark, d):
    return graph.find_entities(entities(spark, d), "nation", "an")


@query("graph_stats", f"WITH {_E}, {_R} SELECT 'entity' AS kind, type, count(*) AS n FROM e GROUP BY type UNION ALL SELECT 'relation', type, count(*) FROM r GROUP BY type")
def _(spark, d):
    count = lambda df, kind: df.groupBy("type").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "type", "n")
    return count(entities(spark, d), "entity").unionByName(count(relations(spark, d), "relation"))


@query("constraint_violations", f"WITH {_E}, {_R} SELECT 'entity_id_unique' AS constraint, id AS key, count(*) AS n FROM e GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'relation_id_unique', source_id, count(*) FROM r GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'user_id_unique', CAST(user_id AS VARCHAR), count(*) FROM events GROUP BY 2 HAVING count(*) > 1")
def _(spark, d):
    return graph.constraint_violations(entity=(entities(spark, d), "id"), relation=(relations(spark, d), "source_id"), user=(table(spark, d, "events"), "user_id"))


@query("valid_relations", f"WITH {_E}, {_R} SELECT r.id FROM r WHERE source_id IN (SELECT id FROM e WHERE type <> 'supplier') AND target_id IN (SELECT id FROM e WHERE type <> 'supplier')")
def _(spark, d):
    return graph.valid_relations(relations(spark, d), entities(spark, d).where("type <> 'supplier'")).select("id")


@query("entity_upsert", f"WITH {_E} SELECT id, type, CASE WHEN type = 'nation' THEN lower(name) ELSE name END AS name FROM e")
def _(spark, d):
    new = entities(spark, d).where("type = 'nation'").withColumn("name", F.lower("name"))
    return graph.upsert(entities(spark, d), new, ["id"])


@query("paths_in", f"""WITH RECURSIVE {_R}, p AS (SELECT 'r' || r_regionkey AS start, 'r' || r_regionkey AS cur, 0 AS hops, [] :: VARCHAR[] AS path FROM region
    UNION ALL SELECT p.start, r.source_id, p.hops + 1, list_append(p.path, r.id) FROM p JOIN r ON r.target_id = p.cur WHERE p.hops < 2 AND NOT list_contains(p.path, r.id))
    SELECT start, cur AS target, CAST(hops AS INTEGER) AS hops FROM p WHERE hops > 0 AND cur <> start""")
def _(spark, d):
    start = entities(spark, d).where("type = 'region'").select(F.col("id").alias("start"))
    return graph.paths(relations(spark, d), start, 2, ["part_of", "located_in"], "in", None)


@query("paths_limited", f"""WITH RECURSIVE {_R}, both_ways AS (SELECT id, source_id AS x, target_id AS y FROM r UNION ALL SELECT id, target_id, source_id FROM r),
    p AS (SELECT 's' || s_suppkey AS start, 's' || s_suppkey AS cur, 0 AS hops, [] :: VARCHAR[] AS path FROM supplier
    UNION ALL SELECT p.start, w.y, p.hops + 1, list_append(p.path, w.id) FROM p JOIN both_ways w ON w.x = p.cur WHERE p.hops < 3 AND NOT list_contains(p.path, w.id))
    SELECT start, target, hops FROM (SELECT start, cur AS target, CAST(hops AS INTEGER) AS hops, row_number() OVER (PARTITION BY start ORDER BY hops, cur, path) AS n FROM p WHERE hops > 0 AND cur <> start) WHERE n <= 20""")
def _(spark, d):
    start = entities(spark, d).where("type = 'supplier'").select(F.col("id").alias("start"))
    return graph.paths(relations(spark, d), start, 3, None, "both", 20)


def nation_communities(spark, d):
    """Communities by region (level 1) with all nations, customers and suppliers below as members, and one without any."""
    member = table(spark, d, "nation").select(F.col("n_regionkey").cast("bigint").alias("community_id"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("entity_id"))
    for t, k, nk, p in (("customer", "c_custkey", "c_nationkey", "c"), ("supplier", "s_suppkey", "s_nationkey", "s")):
        rows = table(spark, d, t).join(table(spark, d, "nation"), F.col(nk) == F.col("n_nationkey"))
        member = member.unionByName(rows.select(F.col("n_regionkey").cast("bigint").alias("community_id"), F.concat(F.lit(p), F.col(k).cast("string")).alias("entity_id")))
    communities = table(spark, d, "region").select(F.col("r_regionkey").cast("bigint").alias("community_id"), F.lit(1).alias("level")).unionByName(spark.createDataFrame([(99, 1)], "community_id bigint, level int"))
    return communities, member


_M = """m AS (SELECT CAST(n_regionkey AS BIGINT) AS community_id, 'n' || n_nationkey AS entity_id FROM nation UNION ALL SELECT n_regionkey, 'c' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT n_regionkey, 's' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


@query("communities_with_members", f"WITH {_M} SELECT c.community_id, CAST(1 AS INTEGER) AS level, coalesce(list_sort(list(entity_id) FILTER (WHERE entity_id IS NOT NULL)), []) AS members FROM (SELECT CAST(r_regionkey AS BIGINT) AS community_id FROM region UNION ALL SELECT 99) c LEFT JOIN m USING (community_id) GROUP BY 1")
def _(spark, d):
    communities, member = nation_communities(spark, d)
    return graph.find_communities(communities, member, 1)


_SUMMARY = """s AS (SELECT community_id, array_to_string(list_sort(list(type || ': ' || CASE WHEN n <= 3 THEN array_to_string(names, ', ') ELSE n || ' items' END)), ' | ') AS summary
    FROM (SELECT community_id, type, count(*) AS n, list_sort(list(name)) AS names FROM m JOIN e ON e.id = m.entity_id GROUP BY 1, 2) GROUP BY 1)"""


@query("community_summaries", f"WITH {_E}, {_M}, {_SUMMARY} SELECT * FROM s")
def _(spark, d):
    return graph.community_summaries(nation_communities(spark, d)[1], entities(spark, d))


def type_communities(spark, d):
    """A community for the nations of one remainder by nine, with all their customers and suppliers, summed up by names or numbers."""
    own = table(spark, d, "nation").select(F.col("n_nationkey"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("entity_id"))
    for t, k, nk, p in (("customer", "c_custkey", "c_nationkey", "c"), ("supplier", "s_suppkey", "s_nationkey", "s")):
        own = own.unionByName(table(spark, d, t).select(F.col(nk).alias("n_nationkey"), F.concat(F.lit(p), F.col(k).cast("string")).alias("entity_id")))
    member = own.select((F.col("n_nationkey") % 9).cast("bigint").alias("community_id"), "entity_id")
    return graph.community_summaries(member, entities(spark, d)).withColumn("level", F.lit(0))


_GLOBAL = """m AS (SELECT CAST(n_nationkey % 9 AS BIGINT) AS community_id, 'n' || n_nationkey AS entity_id FROM nation
    UNION ALL SELECT c_nationkey % 9, 'c' || c_custkey FROM customer UNION ALL SELECT s_nationkey % 9, 's' || s_suppkey FROM supplier)"""


@query("global_search", f"""WITH {_E}, {_GLOBAL}, {_SUMMARY}, q AS (SELECT n_nationkey AS query_id, 'where is nation: ' || n_name AS t FROM nation)
    SELECT query_id, community_id, overlap, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, community_id) AS rank FROM
    (SELECT query_id, community_id, len(list_intersect(string_split(lower(t), ' '), string_split(lower(summary), ' '))) AS overlap FROM q, s) WHERE overlap > 0) WHERE rank <= 10""")
def _(spark, d):
    asked = table(spark, d, "nation").select(F.col("n_nationkey").alias("query_id"), F.concat(F.lit("where is nation: "), "n_name").alias("query_text"))
    return graph.global_search(asked, type_communities(spark, d)).withColumn("overlap", F.col("overlap").cast("bigint"))


def _asked(spark, d):
    return table(spark, d, "region").select(F.col("r_regionkey").alias("query_id"), F.col("r_name").alias("pattern"))


_LOCAL = """t AS (SELECT source_id, target_id, x.name || ' ' || r.type || ' ' || y.name AS triple FROM r JOIN e x ON x.id = r.source_id JOIN e y ON y.id = r.target_id),
    q AS (SELECT r_regionkey AS query_id, r_name AS pattern FROM region),
    f AS (SELECT query_id, arg_min(id, (name, id)) AS id FROM q JOIN e ON contains(lower(name), lower(pattern)) GROUP BY 1),
    l AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY triple) AS rank FROM (SELECT DISTINCT query_id, triple FROM f JOIN t ON f.id IN (t.source_id, t.target_id)))"""


@query("local_search", f"WITH {_E}, {_R}, {_LOCAL} SELECT query_id, triple, CAST(rank AS INTEGER) AS rank FROM l WHERE rank <= 10")
def _(spark, d):
    return graph.local_search(_asked(spark, d), entities(spark, d), relations(spark, d))


@query("drift_search", f"""WITH {_E}, {_R}, {_LOCAL}, {_GLOBAL}, {_SUMMARY},
    g AS (SELECT query_id, summary, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, community_id) AS rank FROM
        (SELECT query_id, community_id, summary, len(list_intersect(string_split('nation: ' || lower(pattern), ' '), string_split(lower(summary), ' '))) AS overlap FROM q, s) WHERE overlap > 0),
    x AS (SELECT query_id, triple AS line, 0 AS side, rank FROM l WHERE rank <= 10 UNION ALL SELECT query_id, summary, 1, rank FROM g WHERE rank <= 10)
    SELECT query_id, list(line ORDER BY side, rank)[1 : 20] AS context FROM x GROUP BY query_id""")
def _(spark, d):
    asked = _asked(spark, d)
    found = graph.global_search(asked.select("query_id", F.concat(F.lit("nation: "), "pattern").alias("query_text")), type_communities(spark, d))
    return graph.drift_search(graph.local_search(asked, entities(spark, d), relations(spark, d)), found, type_communities(spark, d))


@query("entity_ranking", f"""WITH {_E}, p AS (SELECT n_nationkey AS query_id, e.id, e.type, e.name, n_name, n_regionkey FROM nation CROSS JOIN e)
    SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM
    (SELECT query_id, id, round(CASE WHEN name = n_name THEN 1.0 WHEN type = 'nation' THEN 0.5 ELSE 0.0 END + CAST(0.3 AS DOUBLE) * length(name) / 100 + CAST(0.2 AS DOUBLE) * 0.25, 6) AS score FROM p)) WHERE rank <= 10""")
def _(spark, d):
    some = entities(spark, d)
    queries = table(spark, d, "nation").select(F.col("n_nationkey").alias("query_id"), F.lit("nation").alias("q_type"), F.col("n_name").alias("q_name"))
    related = some.crossJoin(F.broadcast(queries.select("query_id")))  # all entities, 25 stated queries
    scores = some.select("id", (F.length("name") / 100).alias("pagerank"), F.lit(0.25).alias("betweenness"))
    return graph.rank_entities(related, queries, scores)


# --- users -------------------------------------------------------------------------------------


@query("degrees", f"WITH {_U} SELECT * FROM deg")
def _(spark, d):
    return graph.degrees(user_edges(spark, d))


@query("clustering_coefficients", f"""WITH {_U}, tri AS (SELECT x.u AS id, count(*) // 2 AS t FROM ways x JOIN ways y ON x.v = y.u JOIN ways z ON z.u = y.v AND z.v = x.u GROUP BY x.u)
    SELECT id, degree, coalesce(t, 0) AS triangles, CASE WHEN degree > 1 THEN round(2.0 * coalesce(t, 0) / (degree * (degree - 1)), 6) ELSE 0.0 END AS coefficient FROM deg LEFT JOIN tri USING (id)""")
def _(spark, d):
    return graph.clustering(user_edges(spark, d))


@query("graph_density", f"WITH {_U} SELECT n AS n_nodes, m AS n_edges, round(2.0 * m / (n * (n - 1)), 9) AS density FROM (SELECT count(*) AS n FROM nodes), (SELECT count(*) AS m FROM ed)")
def _(spark, d):
    return graph.density(user_nodes(spark, d), user_edges(spark, d))


def _pagerank_sql(n: int) -> str:
    steps = ["r0 AS (SELECT id, CAST(1 AS DOUBLE) / (SELECT count(*) FROM nodes) AS r FROM nodes)"]
    for i in range(n):
        steps.append(f"""r{i + 1} AS MATERIALIZED (SELECT nodes.id, (1 - CAST(0.85 AS DOUBLE)) / (SELECT count(*) FROM nodes) + CAST(0.85 AS DOUBLE) * (coalesce(s, 0) + (SELECT coalesce(sum(r), 0) FROM r{i} WHERE id NOT IN (SELECT id FROM deg)) / (SELECT count(*) FROM nodes)) AS r
            FROM nodes LEFT JOIN (SELECT v AS id, sum(r / degree) AS s FROM ways JOIN r{i} ON r{i}.id = u JOIN deg ON deg.id = u GROUP BY v) USING (id))""")
    return f"WITH {_U}, {', '.join(steps)} SELECT id, round(r, 6) AS pagerank FROM r{n}"


@query("pagerank", _pagerank_sql(40))
def _(spark, d):
    return graph.pagerank(user_nodes(spark, d), user_edges(spark, d)).withColumn("pagerank", F.round("pagerank", 6))


def _labels_sql(n: int) -> str:
    steps = ["l0 AS (SELECT DISTINCT u AS id, u AS label FROM ways)"]
    for i in range(n):
        steps.append(f"l{i + 1} AS MATERIALIZED (SELECT u AS id, arg_min(label, (-n, label)) AS label FROM (SELECT u, label, count(*) AS n FROM ways JOIN l{i} ON l{i}.id = v GROUP BY u, label) GROUP BY u)")
    return f"WITH {_U}, {', '.join(steps)} SELECT * FROM l{n}"


@query("label_propagation", _labels_sql(12))
def _(spark, d):
    return graph.label_propagation(user_edges(spark, d))


@query("connected_components", f"WITH RECURSIVE {_U}, c AS (SELECT id, id AS x FROM nodes UNION SELECT c.id, w.v FROM c JOIN ways w ON w.u = c.x) SELECT id, min(x) AS component FROM c GROUP BY id")
def _(spark, d):
    return graph.components(user_nodes(spark, d), user_edges(spark, d))


@query("closeness", f"""WITH RECURSIVE {_U}, b(source, id, h) USING KEY (source, id) AS (SELECT id, id, 0 FROM nodes
        UNION SELECT b.source, w.v, min(b.h) + 1 FROM b JOIN ways w ON w.u = b.id WHERE NOT EXISTS (SELECT 1 FROM recurring.b k WHERE k.source = b.source AND k.id = w.v) GROUP BY 1, 2),
    t AS (SELECT source, sum(h) AS total, count(*) - 1 AS reached FROM b GROUP BY 1)
    SELECT source AS id, CASE WHEN total > 0 THEN round(CAST(reached AS DOUBLE) / total * reached / ((SELECT count(*) FROM nodes) - 1), 6) ELSE 0.0 END AS closeness FROM t""")
def _(spark, d):
    nodes = user_nodes(spark, d)
    return graph.closeness(nodes, user_edges(spark, d), nodes)


# the relations are trees of region, nations, customers and suppliers: a node lies between all that are on different branches of it
@query("betweenness", """WITH leaf AS (SELECT 'c' || c_custkey AS id, c_nationkey AS k FROM customer UNION ALL SELECT 's' || s_suppkey, s_nationkey FROM supplier),
    n AS (SELECT n_nationkey, n_regionkey, CAST(count(leaf.id) AS DOUBLE) AS own FROM nation LEFT JOIN leaf ON k = n_nationkey GROUP BY 1, 2),
    r AS (SELECT n_regionkey, sum(1 + own) AS below, sum((1 + own) ** 2) AS squares FROM n GROUP BY 1),
    through AS (SELECT id, 0.0 AS w FROM leaf UNION ALL SELECT 'n' || n_nationkey, below ** 2 - own - (below - own) ** 2 FROM n JOIN r USING (n_regionkey) UNION ALL SELECT 'r' || n_regionkey, below ** 2 - squares FROM r),
    size AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM through)
    SELECT id, round(w / ((n - 1) * (n - 2)), 6) AS betweenness FROM through, size""")
def _(spark, d):
    """On the property graph, with all customers and suppliers."""
    return graph.betweenness(graph.undirected(relations(spark, d)))


@query("louvain")
def _(spark, d):
    return graph.louvain(graph.undirected(relations(spark, d)))


@query("density_communities", f"""WITH RECURSIVE {_R}, ed AS (SELECT DISTINCT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b FROM r WHERE source_id <> target_id),
    ways AS (SELECT a AS u, b AS v FROM ed UNION ALL SELECT b, a FROM ed), deg AS (SELECT u AS id, count(*) AS d FROM ways GROUP BY u),
    close AS (SELECT x.u AS a, y.u AS b FROM ways x JOIN ways y ON x.v = y.v JOIN deg p ON p.id = x.u JOIN deg q ON q.id = y.u GROUP BY 1, 2, p.d, q.d HAVING count(*) / sqrt(p.d * q.d) >= 0.5 - 1e-9),
    c AS (SELECT id, id AS x FROM deg UNION SELECT c.id, close.b FROM c JOIN close ON close.a = c.x)
    SELECT id, min(x) AS community FROM c GROUP BY id HAVING count(*) >= 2""")
def _(spark, d):
    return graph.near_components(graph.undirected(relations(spark, d)))


@query("kmeans_communities")
def _(spark, d):
    return graph.kmeans_communities(user_edges(spark, d)).groupBy("community").agg(F.count("*").alias("n"))


# --- extraction --------------------------------------------------------------------------------


def reports(spark, d):
    """A short clinical report for each customer."""
    k = F.col("c_custkey")
    subject = F.concat(F.lit("CU"), F.lpad((k % 10000).cast("string"), 4, "0"))
    drug = F.element_at(F.array(*map(F.lit, ["ASPIRIN", "placebo", "ibuprofen"])), (k % 3 + 1).cast("int"))
    text = F.concat(F.lit("Malted salty basted food was kept. Subject "), subject, F.lit(" received treatment. Drug "), drug, F.lit(" in study "), F.lit("ST"), F.lpad((k % 7).cast("string"), 4, "0"), F.lit("; aeterm='headache'. "), subject, F.lit(" received "), drug, F.lit(". Lab "), F.lit("hemoglobin"), F.lit(" test done, ALT and AST high, dataset ADSL"))
    return table(spark, d, "customer").select(k.alias("document_id"), text.alias("content"))


_REPORTS = """rep AS (SELECT c_custkey AS document_id, 'Malted salty basted food was kept. Subject ' || s || ' received treatment. Drug ' || g || ' in study ST' || lpad(CAST(c_custkey % 7 AS VARCHAR), 4, '0') || '; aeterm=''headache''. ' || s || ' received ' || g || '. Lab hemoglobin test done, ALT and AST high, dataset ADSL' AS content
    FROM (SELECT c_custkey, 'CU' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS s, ['ASPIRIN', 'placebo', 'ibuprofen'][1 + c_custkey % 3] AS g FROM customer))"""


def _sql_pattern(p: str) -> str:
    return "(?i)" + p.replace("'", "''")


_BASIC = " UNION ALL ".join([f"SELECT document_id, '{k}' AS type, upper(unnest(regexp_extract_all(content, '{_sql_pattern(p)}', 1))) AS name FROM rep" for k, ps in V.ENTITY_PATTERNS.items() for p in ps]
    + [f"SELECT document_id, '{k}' AS type, unnest(list_filter({sql_list(codes)}, lambda x: contains(content, x))) AS name FROM rep" for k, codes in (("sdtm_domain", V.SDTM_DOMAINS), ("adam_dataset", V.ADAM_DATASETS))])


@query("basic_entities", f"WITH {_REPORTS} {_BASIC}")
def _(spark, d):
    return graph.basic_entities(reports(spark, d))


_RELS = " UNION ALL ".join(f"SELECT document_id, '{k}' AS type, unnest(regexp_extract_all(content, '{_sql_pattern(p)}', 1)) AS s, unnest(regexp_extract_all(content, '{_sql_pattern(p)}', 2)) AS t FROM rep" for k, p in V.RELATION_PATTERNS)


@query("basic_relations", f"""WITH {_REPORTS}, en AS (SELECT DISTINCT document_id, lower(name) AS n FROM ({_BASIC})), rl AS ({_RELS})
    SELECT document_id, type, upper(s) AS source, upper(t) AS target FROM rl WHERE (document_id, lower(s)) IN (SELECT (document_id, n) FROM en) AND (document_id, lower(t)) IN (SELECT (document_id, n) FROM en)""")
def _(spark, d):
    docs = reports(spark, d)
    return graph.basic_relations(docs, graph.basic_entities(docs))


def _advanced_sql() -> str:
    parts = []
    for order, (kind, p, g) in enumerate((k, p, g) for k, ps in V.ADVANCED_ENTITY_PATTERNS.items() for p, g in ps):
        q = "(?im)" + p.replace("'", "''")
        parts.append(f"SELECT document_id, content, '{kind}' AS type, regexp_extract_all(content, '{q}', 0) AS ms, regexp_extract_all(content, '{q}', {g}) AS ns, string_split_regex(content, '{q}') AS gaps, {order} AS o FROM rep")
    size = lambda x: f"coalesce(list_sum(list_transform({x}, lambda y: length(y))), 0)"
    conf = f"least(1.0, round(CAST(0.6 AS DOUBLE) + CASE WHEN contains(m, '=') THEN CAST(0.2 AS DOUBLE) ELSE 0 END + CASE WHEN type IN ('subject', 'study') AND regexp_matches(name, '^[A-Z]{{2}}\\d{{4}}$') THEN CAST(0.2 AS DOUBLE) ELSE 0 END + CASE WHEN name IN ({', '.join(repr(t) for t in V.COMMON_TERMS)}) THEN CAST(0.1 AS DOUBLE) ELSE 0 END, 6))"
    return f"""WITH {_REPORTS}, y AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM ({' UNION ALL '.join(parts)})),
        z AS (SELECT document_id, content, type, o, i, ms[i] AS m, upper(regexp_replace(trim(ns[i]), '\\s+', ' ', 'g')) AS name, CAST({size('gaps[1 : i]')} + {size('ms[1 : i - 1]')} AS BIGINT) AS place FROM y),
        x AS (SELECT *, {conf} AS sure, substr(content, greatest(place - 100, 0) + 1, place + length(m) + 100 - greatest(place - 100, 0)) AS context FROM z)"""


@query("advanced_entities", _advanced_sql() + " SELECT document_id, type, name, max(sure) AS confidence, arg_max(context, (sure, -o, -i)) AS context FROM x GROUP BY 1, 2, 3")
def _(spark, d):
    return graph.advanced_entities(reports(spark, d)).select("document_id", "type", "name", "confidence", "context")


@query("merged_entities", _advanced_sql() + ", b AS (SELECT document_id, type, name, max(sure) AS sure, arg_max(context, (sure, -o, -i)) AS context FROM x GROUP BY 1, 2, 3) SELECT type, name, max(sure) AS confidence, count(*) AS n_documents, arg_min(context, document_id) AS context FROM b GROUP BY 1, 2")
def _(spark, d):
    return graph.merge_entities(graph.advanced_entities(reports(spark, d))).select("type", "name", "confidence", F.size("document_ids").cast("bigint").alias("n_documents"), "context")


_SIDE = r"(\w+(?:\s+\w+)*)"
_ADVANCED_RELS = " UNION ALL ".join(f"SELECT document_id, '{k}' AS type, {c} AS sure, unnest(regexp_extract_all(content, '(?im){_SIDE}\\s+(?:{v})\\s+{_SIDE}', 1)) AS s, unnest(regexp_extract_all(content, '(?im){_SIDE}\\s+(?:{v})\\s+{_SIDE}', 2)) AS t FROM rep" for k, v, c in V.ADVANCED_RELATIONS)


def _side_sql(side: str, out: str) -> str:
    """The entity of a side: that of its name, else the first whose name holds it or is held by it."""
    return f"{out}s AS (SELECT d.document_id, d.type, s, t, arg_min(name, (CAST(name <> {side} AS INTEGER), pos, name)) AS {out} FROM d JOIN b ON b.document_id = d.document_id AND (contains({side}, name) OR contains(name, {side})) GROUP BY 1, 2, 3, 4)"


_RELATED = f"""{_advanced_sql()}, b AS (SELECT document_id, type, name, arg_max(o * 1000000 + i, (sure, -o, -i)) AS pos FROM x GROUP BY 1, 2, 3), rl AS ({_ADVANCED_RELS}),
    d AS (SELECT DISTINCT document_id, type, CAST(sure AS DOUBLE) AS sure, upper(trim(s)) AS s, upper(trim(t)) AS t FROM rl), {_side_sql('s', 'subject')}, {_side_sql('t', 'object')},
    merged AS (SELECT subject, object, type, max(sure) AS confidence, count(DISTINCT document_id) AS n_documents FROM d JOIN subjects USING (document_id, type, s, t) JOIN objects USING (document_id, type, s, t) GROUP BY 1, 2, 3)"""


@query("advanced_relations", f"{_RELATED} SELECT * FROM merged")
def _(spark, d):
    docs = reports(spark, d)
    found = graph.merge_relations(graph.advanced_relations(docs, graph.advanced_entities(docs)))
    return found.withColumn("n_documents", F.size("document_ids").cast("bigint")).drop("document_ids")


@query("built_graph", f"""{_RELATED}, names AS (SELECT name, min(sha256(type || chr(31) || name)) AS id FROM b GROUP BY name)
    SELECT sha256(concat_ws(chr(31), x.id, m.type, y.id)) AS id, x.id AS source_id, y.id AS target_id, m.type, confidence, n_documents FROM merged m JOIN names x ON x.name = subject JOIN names y ON y.name = object""")
def _(spark, d):
    """Relations between merged entities, as ingestion builds them."""
    return ingestion.build_graph(reports(spark, d))["relations"].withColumn("n_documents", F.size("document_ids").cast("bigint")).drop("document_ids")
