"""Knowledge graph: extraction, deduplication, search, communities, centrality.

Entities: document_id, type, name, confidence, context, pos. Relations: source_id, target_id, type.
Edges of the undirected analytics: (a, b) with a < b. Iterative operators write each step to
the shared folder, so lineage stays short.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from brindle.functions import text as T
from brindle.functions import vocabulary as V
from brindle.operators import substrings
from brindle.operators.blocks import spans
from brindle.session import few, materialize, release, spread

# --- extraction --------------------------------------------------------------------------------


def entity_id(kind: Column, name: Column) -> Column:
    return T.sha256(F.concat_ws("\x1f", kind, name))


def basic_entities(docs: DataFrame, word_boundary: bool = False) -> DataFrame:
    """(document_id, type, name) of every pattern match and of the domain and dataset codes that occur."""
    c = F.col("content")

    def typed(kind: str, names: Column) -> Column:
        return F.transform(names, lambda n: F.struct(F.lit(kind).alias("type"), F.upper(n).alias("name")))

    docs = spread(docs.select("document_id", "content"), "document_id", rows=DOCUMENTS)
    found = [typed(kind, F.regexp_extract_all(c, F.lit(f"(?iU){p}"), F.lit(1))) for kind, patterns in V.ENTITY_PATTERNS.items() for p in patterns]
    for kind, codes in (("sdtm_domain", V.SDTM_DOMAINS), ("adam_dataset", V.ADAM_DATASETS)):
        hit = (lambda d: F.rlike(c, F.concat(F.lit(r"\b"), d, F.lit(r"\b")))) if word_boundary else (lambda d: F.contains(c, d))
        found.append(typed(kind, F.filter(F.array(*map(F.lit, codes)), hit)))
    return docs.select("document_id", F.explode(F.concat(*found)).alias("e")).select("document_id", "e.type", "e.name")


def confidence(kind: Column, name: Column, matched: Column) -> Column:
    """0.6, +0.2 for an assignment, +0.2 for a canonical subject or study id, +0.1 for a common term; 1 at most."""
    canonical = kind.isin("subject", "study") & F.rlike(name, F.lit(r"^[A-Z]{2}\d{4}$"))
    score = 0.6 + F.when(F.contains(matched, F.lit("=")), 0.2).otherwise(0.0) + F.when(canonical, 0.2).otherwise(0.0) + F.when(name.isin(V.COMMON_TERMS), 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), F.round(score, 6))


def _typed_matches(c: Column, found: Column, order: int, kind: str, pattern: str, group: int, accept: float, window: int) -> Column:
    """array<struct<type, name, confidence, context, pos>> of one pattern's matches ``found`` in a text, in text order.

    A match starts where the last one ended, after the piece between them; its name is sought in the match alone.
    """
    gaps = F.transform(F.split(c, pattern, -1), F.length)
    name = (lambda m: m) if group == 0 else (lambda m: F.regexp_extract(m, pattern, group))
    both = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.struct(m.alias("m"), name(m).alias("n"), g.alias("g")))
    none = F.array().cast("array<struct<m:string,n:string,start:int>>")

    def place(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["g"]
        return F.struct((start + F.length(x["m"])).alias("at"), F.array_append(acc["out"], F.struct(x["m"].alias("m"), x["n"].alias("n"), start.alias("start"))).alias("out"))

    placed = F.aggregate(both, F.struct(F.lit(0).alias("at"), none.alias("out")), place, lambda acc: acc["out"])

    def entity(x: Column, i: Column) -> Column:
        name = F.upper(F.regexp_replace(T.strip(x["n"]), T.SPACE, " "))
        return F.struct(
            F.lit(kind).alias("type"), name.alias("name"), confidence(F.lit(kind), name, x["m"]).alias("confidence"),
            T.context_window(c, x["start"], x["start"] + F.length(x["m"]), window).alias("context"), (F.lit(order << 40) + i).alias("pos"),
        )

    return F.filter(F.transform(placed, entity), lambda e: e["confidence"] > accept)


#: Documents of a part whose entities a task finds, about.
DOCUMENTS = 20_000
_ENTITY = "array<struct<type:string,name:string,confidence:double,context:string,pos:bigint>>"


def advanced_entities(docs: DataFrame, accept: float = 0.5, window: int = 100) -> DataFrame:
    """(document_id, type, name, confidence, context, pos): matches of the typed patterns, the best per type and name.

    Each pattern scans a text once, and once more where it matches; only matches leave the row. Ties go to the first match: by pattern, then by place.
    Documents are dealt by their ids first, so that neither the scan nor the choice of the best moves or holds more than a part's matches.
    """
    c = F.col("content")
    docs = spread(docs.select("document_id", "content"), "document_id", rows=DOCUMENTS)
    patterns = [(kind, p, group) for kind, ps in V.ADVANCED_ENTITY_PATTERNS.items() for p, group in ps]
    rows = docs.select("document_id", "content", *[F.regexp_extract_all(c, F.lit(f"(?imU){p}"), F.lit(0)).alias(f"m{order}") for order, (_, p, _) in enumerate(patterns)])
    each = [(F.col(f"m{order}"), _typed_matches(c, F.col(f"m{order}"), order, kind, f"(?imU){p}", group, accept, window)) for order, (kind, p, group) in enumerate(patterns)]
    found = F.concat(*[F.when(F.size(m) > 0, x).otherwise(F.array().cast(_ENTITY)) for m, x in each])
    return best_entities(rows.select("document_id", F.explode(found).alias("e")).select("document_id", "e.*"), ["document_id"])


def best_entities(entities: DataFrame, by: list[str]) -> DataFrame:
    """One row per type and name (within ``by``): the greatest confidence, of equals the first."""
    best = F.max_by(F.struct(*[c for c in entities.columns if c not in (*by, "type", "name")]), F.struct("confidence", -F.col("pos")))
    return entities.groupBy(*by, "type", "name").agg(best.alias("b")).select(*by, "type", "name", "b.*")


def merge_entities(entities: DataFrame) -> DataFrame:
    """Entities of all documents: id, type, name, greatest confidence, sorted distinct documents, the first context."""
    out = entities.groupBy("type", "name").agg(
        F.max("confidence").alias("confidence"), F.array_sort(F.collect_set("document_id")).alias("document_ids"), F.min_by("context", F.struct("document_id", "pos")).alias("context"),
    )
    return out.select(entity_id(F.col("type"), F.col("name")).alias("id"), "*")


def _relation_matches(docs: DataFrame, patterns: list[tuple[str, str, float]]) -> DataFrame:
    c = F.col("content")

    def of(kind: str, p: str, sure: float) -> Column:
        sides = (F.regexp_extract_all(c, F.lit(p), F.lit(g)) for g in (1, 2))
        return F.zip_with(*sides, lambda s, t: F.struct(F.lit(kind).alias("type"), F.lit(sure).alias("confidence"), s.alias("s"), t.alias("t")))

    found = [of(*p) for p in patterns]
    return docs.select("document_id", F.explode(F.concat(*found)).alias("r")).select("document_id", "r.*")


def basic_relations(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """(document_id, type, source, target): matches whose both sides name entities of the document, in any case."""
    known = entities.select("document_id", F.lower("name").alias("n")).distinct()
    docs = spread(docs.select("document_id", "content"), "document_id", rows=DOCUMENTS)
    rows = _relation_matches(docs, [(k, f"(?iU){p}", 1.0) for k, p in V.RELATION_PATTERNS]).select("document_id", "type", F.lower("s").alias("s"), F.lower("t").alias("t"))
    rows = rows.join(known.withColumnRenamed("n", "s"), ["document_id", "s"], "left_semi").join(known.withColumnRenamed("n", "t"), ["document_id", "t"], "left_semi")
    return rows.select("document_id", "type", F.upper("s").alias("source"), F.upper("t").alias("target"))


def verb_relations(docs: DataFrame, verbs: list[tuple[str, str, float]]) -> DataFrame:
    """(document_id, type, confidence, s, t): what stands before and after the last verb of each kind in each run of words.

    A run is all words with nothing but white space between them, so sides may be of any length; a run is
    cut by one step back from its end, in time that grows with its length.
    """
    runs = docs.select("document_id", F.explode(F.regexp_extract_all("content", F.lit(r"(?U)\w++(?:\s++\w++)*+"), F.lit(0))).alias("run"))
    cut = lambda v: rf"(?isU)\A(.*\w)\s+(?:{v})\s+(\w.*)\z"
    each = [F.when(F.rlike("run", F.lit(cut(v))), F.struct(F.lit(k).alias("type"), F.lit(sure).alias("confidence"), F.regexp_extract("run", cut(v), 1).alias("s"), F.regexp_extract("run", cut(v), 2).alias("t"))) for k, v, sure in verbs]
    any_verb = rf"(?iU)\s(?:{'|'.join(v for _, v, _ in verbs)})\s"
    return runs.where(F.rlike("run", F.lit(any_verb))).select("document_id", F.explode(F.array_compact(F.array(*each))).alias("r")).select("document_id", "r.*")


def advanced_relations(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """(document_id, type, confidence, subject, object): both sides found among the document's entities.

    A side's entity is that of its exact name, else the first (by position) whose name holds it or is held by it.
    """
    rows = verb_relations(spread(docs.select("document_id", "content"), "document_id", rows=DOCUMENTS), V.ADVANCED_RELATIONS)
    rows = rows.select("document_id", F.monotonically_increasing_id().alias("r"), "type", "confidence", F.upper(T.strip("s")).alias("s"), F.upper(T.strip("t")).alias("t"))
    rows = rows.drop("r").withColumn("r", F.xxhash64("document_id", "type", "s", "t")).distinct()
    rows = materialize(rows, "verbs")  # read three times

    def side(name: str, out: str) -> DataFrame:
        near = rows.select("document_id", "r", F.col(name).alias("x")).join(entities.select("document_id", F.col("name").alias("e"), "pos"), "document_id")
        near = near.where(F.contains("x", F.col("e")) | F.contains("e", F.col("x")))
        return near.groupBy("document_id", "r").agg(F.min_by("e", F.struct(F.col("e") != F.col("x"), "pos", "e")).alias(out))

    return rows.join(side("s", "subject"), ["document_id", "r"]).join(side("t", "object"), ["document_id", "r"]).select("document_id", "type", "confidence", "subject", "object")


def merge_relations(relations: DataFrame) -> DataFrame:
    return relations.groupBy("subject", "object", "type").agg(F.max("confidence").alias("confidence"), F.array_sort(F.collect_set("document_id")).alias("document_ids"))


# --- storage and search ------------------------------------------------------------------------


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` (one for each key: the greatest row), and those of ``old`` with other keys."""
    rest = F.struct(*[c for c in new.columns if c not in keys])
    latest = new.groupBy(*keys).agg(F.max(rest).alias("_r")).select(*keys, "_r.*")
    return old.join(latest, keys, "left_anti").select(old.columns).unionByName(latest.select(old.columns))


def valid_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations both of whose ends are entities."""
    ids = entities.select("id")
    return relations.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


def constraint_violations(**tables: tuple[DataFrame, str]) -> DataFrame:
    """(constraint, key, n): ids that a table lacks or has more than once. ``tables``: name = (rows, id column).

    What a graph store enforces as unique ids is here a check of the data, one aggregation a table.
    """
    found = None
    for name, (df, key) in tables.items():
        n = df.groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("n")).where(F.col("key").isNull() | (F.col("n") > 1))
        one = n.select(F.lit(f"{name}_id_unique").alias("constraint"), "key", "n")
        found = one if found is None else found.unionByName(one)
    return found


def sample_graph(spark) -> tuple[DataFrame, DataFrame]:
    """Entities and relations of a small sample study (fixed values)."""
    entities = [("entity_001", "subject", "STUDY001001"), ("entity_002", "treatment", "DRUG_A"), ("entity_003", "lab_test", "ALT")]
    relations = [("rel_001", "entity_001", "entity_002", "received"), ("rel_002", "entity_001", "entity_003", "had")]
    return spark.createDataFrame(entities, "id string, type string, name string"), spark.createDataFrame(relations, "id string, source_id string, target_id string, type string")


def query_graph(kind: str, queries: DataFrame, entities: DataFrame, relations: DataFrame, communities: DataFrame, k: int = 10) -> DataFrame:
    """A graph query by its kind: ``local``, ``global`` or ``drift``. ``queries``: query_id, query_text, pattern."""
    if kind == "local":
        return local_search(queries, entities, relations, k)
    if kind == "global":
        return global_search(queries, communities, k)
    if kind == "drift":
        return drift_search(local_search(queries, entities, relations, k), global_search(queries, communities, k), communities, k)
    raise ValueError(f"unknown kind of graph query {kind!r}; there are local, global and drift")


def find_entities(entities: DataFrame, kind: str | None = None, pattern: str | None = None, limit: int = 100) -> DataFrame:
    """By type and by a pattern anywhere in the name, in any case; by name, ``limit`` at most."""
    if kind is not None:
        entities = entities.where(F.col("type") == kind)
    if pattern is not None:
        entities = entities.where(F.rlike("name", F.lit(f"(?iu){pattern}")))
    return entities.orderBy("name", "id").limit(limit)


def find_communities(communities: DataFrame, membership: DataFrame, level: int | None = None, limit: int = 50) -> DataFrame:
    """Communities with their sorted members; those without members have an empty list."""
    chosen = communities if level is None else communities.where(F.col("level") == level)
    first = chosen.orderBy("level", "community_id").limit(limit)
    members = membership.groupBy("community_id").agg(F.array_sort(F.collect_list("entity_id")).alias("members"))
    return first.join(members, "community_id", "left").withColumn("members", F.coalesce("members", F.array().cast(membership.select(F.array("entity_id")).schema[0].dataType)))


def paths(relations: DataFrame, start: DataFrame, hops: int, types: list[str] | None = None, direction: str = "both", limit: int | None = 100) -> DataFrame:
    """(start, target, hops): ends of paths of 1 to ``hops`` relations without a repeated relation.

    Every relation of a path is of one of ``types``. A row for each path; ends other than the
    start; shortest first, ``limit`` for each start. ``start``: (start).
    """
    edges = relations if types is None else relations.where(F.col("type").isin(types))
    out_ = edges.select(F.col("id").alias("rel"), F.col("source_id").alias("at"), F.col("target_id").alias("to"))
    in_ = edges.select(F.col("id").alias("rel"), F.col("target_id").alias("at"), F.col("source_id").alias("to"))
    steps = {"out": out_, "in": in_}.get(direction) or out_.unionByName(in_)
    now = start.select("start", F.col("start").alias("at"), F.array().cast(edges.select(F.array("id")).schema[0].dataType).alias("path"))
    if limit is not None:
        return _first_paths(now, steps, hops, limit)
    found = None
    for h in range(1, hops + 1):
        now = _longer(now, steps)
        one = now.where(F.col("at") != F.col("start")).select("start", F.col("at").alias("target"), F.lit(h).alias("hops"))
        found = one if found is None else found.unionByName(one)
    return found


def _longer(now: DataFrame, steps: DataFrame) -> DataFrame:
    """Paths (start, at, path) with one relation more."""
    return now.join(steps, "at").where(~F.array_contains("path", F.col("rel"))).select("start", F.col("to").alias("at"), F.array_append("path", F.col("rel")).alias("path"))


def _first_paths(now: DataFrame, steps: DataFrame, hops: int, limit: int) -> DataFrame:
    """(start, target, hops) of the first ``limit`` paths of each start, by hops, target and path.

    A path can be among them only as one of the first ``limit`` that go on from its last node but one. Of a node's steps by end
    and relation that takes as many, and those that may be ruled out: relations of the path, and relations to the start,
    which are at most as many as the most that lead to one end. A start that has ``limit`` paths goes no further, so the
    paths that do are about ``limit`` a start.
    """
    in_order = W.partitionBy("at").orderBy("to", "rel")
    few_steps = steps.withColumn("_same", F.count("*").over(W.partitionBy("at", "to"))).withColumn("_n", F.row_number().over(in_order)).withColumn("_most", F.max("_same").over(in_order))
    few_steps = materialize(few_steps.where(F.col("_n") <= limit + hops + F.col("_most")).select("at", "rel", "to"), "first-steps")
    found = None
    for h in range(1, hops + 1):
        ends = _longer(now, few_steps).where(F.col("at") != F.col("start"))
        ends = ends.withColumn("_n", F.row_number().over(W.partitionBy("start").orderBy("at", "path"))).select("start", F.col("at").alias("target"), F.lit(h).alias("hops"), "_n")
        if found is not None:
            had = found.groupBy("start").agg(F.count("*").alias("_had"))
            ends = ends.join(had, "start", "left").where(F.col("_n") <= limit - F.coalesce("_had", F.lit(0))).drop("_had")
        ends = materialize(ends.where(F.col("_n") <= limit).drop("_n"), "ends")
        found = ends if found is None else found.unionByName(ends)
        if h < hops:
            done = found.groupBy("start").agg(F.count("*").alias("_had")).where(F.col("_had") >= limit).select("start")
            now = materialize(_longer(now.join(done, "start", "left_anti"), steps), "paths")
    return found


def triples(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """(source_id, target_id, triple): "A relation B" with the entities' names."""
    name = entities.select("id", "name")
    got = relations.join(name.select(F.col("id").alias("source_id"), F.col("name").alias("s")), "source_id").join(name.select(F.col("id").alias("target_id"), F.col("name").alias("t")), "target_id")
    return got.select("source_id", "target_id", F.concat_ws(" ", "s", "type", "t").alias("triple"))


def local_search(queries: DataFrame, entities: DataFrame, relations: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, triple, rank): for each query (query_id, pattern) the first entity whose name holds the pattern, and its triples."""
    wanted = queries.select("query_id", F.lower("pattern").alias("pattern"))
    hit = substrings.occurrences(entities.select("id", "name", F.lower("name").alias("_low")), "_low", wanted).join(few(wanted), "pattern")
    everywhere = entities.select("id", "name").join(F.broadcast(wanted.where("pattern = ''")))  # an empty pattern is in every name
    hit = hit.select("id", "name", "query_id").unionByName(everywhere.select("id", "name", "query_id"))
    first = hit.groupBy("query_id").agg(F.min(F.struct("name", "id")).alias("e")).select("query_id", F.col("e.id").alias("id"))
    t = triples(relations, entities)
    own = first.join(t.withColumnRenamed("source_id", "id"), "id").select("query_id", "triple").unionByName(first.join(t.withColumnRenamed("target_id", "id"), "id").select("query_id", "triple")).distinct()
    return own.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("triple"))).where(F.col("rank") <= k)


def global_search(queries: DataFrame, communities: DataFrame, k: int = 10, first: int = 50) -> DataFrame:
    """(query_id, community_id, overlap, rank): the communities whose summary shares most words with the query."""
    some = communities.orderBy("level", "community_id").limit(first)
    pairs = queries.crossJoin(F.broadcast(some))  # ``first`` rows
    both = F.size(F.array_intersect(T.words(F.lower("query_text")), T.words(F.lower("summary"))))
    scored = pairs.select("query_id", "community_id", both.alias("overlap")).where("overlap > 0")
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("overlap"), "community_id"))).where(F.col("rank") <= k)


def drift_search(local: DataFrame, global_: DataFrame, communities: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, context): local triples, then summaries of global hits, 2k at most."""
    a = local.select("query_id", F.lit(0).alias("p"), "rank", F.col("triple").alias("x"))
    b = global_.join(communities.select("community_id", "summary"), "community_id").select("query_id", F.lit(1).alias("p"), "rank", F.col("summary").alias("x"))
    got = a.unionByName(b).groupBy("query_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("p", "rank", "x"))), lambda r: r["x"]), 1, 2 * k).alias("context"))
    return got


def rank_entities(related: DataFrame, asked: DataFrame, scores: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, id, score, rank): +1 for a name, else +0.5 for a type, of each query entity, + 0.3 PageRank + 0.2 betweenness.

    ``related``: query_id, id, type, name. ``asked``: query_id, q_type, q_name. ``scores``: id, pagerank, betweenness.
    """
    n = max(related.sparkSession.sparkContext.defaultParallelism, -(-related.count() // 500_000))
    related, scores = related.repartition(n, "id"), scores.repartition(n, "id")  # an id's pairs are summed and scored where they are
    pairs = related.join(few(asked), "query_id", "left")
    point = F.when(F.col("name") == F.col("q_name"), 1.0).when(F.col("type") == F.col("q_type"), 0.5).otherwise(0.0)
    got = pairs.groupBy("query_id", "id").agg(F.sum(point).alias("s")).join(scores, "id", "left")
    got = got.select("query_id", "id", F.round(F.col("s") + 0.3 * F.coalesce("pagerank", F.lit(0.0)) + 0.2 * F.coalesce("betweenness", F.lit(0.0)), 6).alias("score"))
    return got.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def community_summaries(membership: DataFrame, entities: DataFrame) -> DataFrame:
    """(community_id, summary): for each type the names if there are three at most, else their number; types joined by bars."""
    named = membership.join(entities.select(F.col("id").alias("entity_id"), "type", "name"), "entity_id")
    kinds = named.groupBy("community_id", "type").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list("name")), 1, 3).alias("names"))
    part = F.when(F.col("n") <= 3, F.concat("type", F.lit(": "), F.array_join("names", ", "))).otherwise(F.concat("type", F.lit(": "), F.col("n").cast("string"), F.lit(" items")))
    return kinds.select("community_id", F.struct("type", part.alias("p")).alias("x")).groupBy("community_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["p"]), " | ").alias("summary"))


# --- analytics ---------------------------------------------------------------------------------


def undirected(relations: DataFrame, source: str = "source_id", target: str = "target_id") -> DataFrame:
    """Distinct edges (a, b), a < b; loops go."""
    return relations.select(F.least(source, target).alias("a"), F.greatest(source, target).alias("b")).where("a < b").distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("u").agg(F.count("*").alias("degree")).withColumnRenamed("u", "id")


def clustering(edges: DataFrame) -> DataFrame:
    """(id, degree, triangles, coefficient). Wedges start at the end of lesser degree, so hubs don't square."""
    edges = materialize(edges, "edges")  # read six times
    deg = materialize(degrees(edges), "degrees")
    d = lambda c, n: deg.select(F.col("id").alias(c), F.col("degree").alias(n))
    ranked = edges.join(d("a", "da"), "a").join(d("b", "db"), "b")
    low = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    up = materialize(ranked.select(F.when(low, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("y")), "oriented")
    wedge = up.join(up.withColumnRenamed("y", "z"), "x").where("y < z")
    closed = wedge.join(edges.select(F.col("a").alias("y"), F.col("b").alias("z")), ["y", "z"])
    per = closed.select(F.explode(F.array("x", "y", "z")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))
    got = deg.join(per, "id", "left").withColumn("triangles", F.coalesce("triangles", F.lit(0)).cast("bigint"))
    return got.withColumn("coefficient", F.when(F.col("degree") > 1, F.round(2 * F.col("triangles") / (F.col("degree") * (F.col("degree") - 1)), 6)).otherwise(0.0))


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n, e = nodes.agg(F.count("*").alias("n_nodes")), edges.agg(F.count("*").alias("n_edges"))
    ratio = F.when(F.col("n_nodes") > 1, F.round(2 * F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1)), 9)).otherwise(0.0)
    return n.crossJoin(e).withColumn("density", ratio)  # one row each


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int | None = None, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """(id, pagerank) on the undirected graph; what isolated nodes hold is dealt out evenly.

    Without a number of ``iterations`` it goes on until ranks change by less than ``tolerance`` in all, which
    the damping brings about within ln(tolerance / 2) / ln(damping) steps on any graph.
    """
    spark, kept, old = nodes.sparkSession, [], []
    n = nodes.count()
    ways = materialize(both_ways(edges).join(degrees(edges).select(F.col("id").alias("u"), "degree"), "u"), "ways")
    loose = nodes.join(degrees(edges), "id", "left_anti").select("id", F.lit(True).alias("loose"))
    base = materialize(nodes.join(loose, "id", "left").select("id", F.coalesce("loose", F.lit(False)).alias("loose")), "nodes")
    now = base.select("id", "loose", F.lit(1.0 / max(n, 1)).alias("r"))
    done = 0
    while iterations is None or done < iterations:
        spare = now.where("loose").agg(F.coalesce(F.sum("r"), F.lit(0.0)).alias("s")).first()[0]
        into = ways.join(now.select(F.col("id").alias("u"), "r"), "u").groupBy(F.col("v").alias("id")).agg(F.sum(F.col("r") / F.col("degree")).alias("in"))
        after = base.join(into, "id", "left").select("id", "loose", ((1 - damping) / max(n, 1) + damping * (F.coalesce("in", F.lit(0.0)) + spare / max(n, 1))).alias("r"))
        after = materialize(after.join(now.select("id", F.col("r").alias("was")), "id"), "ranks", kept)
        moved = after.agg(F.sum(F.abs(F.col("r") - F.col("was")))).first()[0] or 0.0
        now, done = after.select("id", "loose", "r"), done + 1
        release(spark, old)
        old, kept = kept, []
        if iterations is None and moved < tolerance:
            break
    return now.select("id", F.round("r", 9).alias("pagerank"))


def label_propagation(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(id, label): synchronous; each node takes its neighbours' commonest label, of equals the least. Counts combine before they move.

    Without a number of ``rounds`` it goes on until labels are stable. Where they repeat with a period instead
    (as the two sides of a bipartite graph may), each node gets the least label that it has in the period.
    """
    spark, kept, old = edges.sparkSession, [], []
    ways = materialize(both_ways(edges), "ways")
    now = ways.select(F.col("u").alias("id")).distinct().withColumn("label", F.col("id"))

    def step(now: DataFrame) -> DataFrame:
        votes = ways.join(now.select(F.col("id").alias("v"), "label"), "v").groupBy("u", "label").agg(F.count("*").alias("n"))
        return votes.groupBy("u").agg(F.min(F.struct(-F.col("n"), "label")).alias("m")).select(F.col("u").alias("id"), F.col("m.label").alias("label"))

    seen: dict = {}
    done = 0
    while rounds is None or done < rounds:
        now = materialize(step(now), "labels", kept)
        done += 1
        release(spark, old)
        old, kept = kept, []
        if rounds is None:
            mark = now.agg(F.sum(F.xxhash64("id", "label").cast("decimal(38,0)")), F.sum(F.hash("label", "id").cast("bigint"))).first()
            if mark in seen:
                break
            seen[mark] = done
    period = done - seen[mark] if rounds is None else 1
    least = now
    for _ in range(period - 1):
        now = materialize(step(now), "labels")
        least = materialize(least.unionByName(now).groupBy("id").agg(F.min("label").alias("label")), "least")
    return least


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least id that a node reaches, by repeated minima and shortcuts through labels."""
    spark, kept, old = nodes.sparkSession, [], []
    ways = materialize(both_ways(edges), "ways")
    now = materialize(nodes.select("id", F.col("id").alias("component")), "parts", kept)
    while True:
        old, kept = kept, []
        low = ways.join(now.select(F.col("id").alias("v"), "component"), "v").groupBy(F.col("u").alias("id")).agg(F.min("component").alias("m"))
        better = now.join(low, "id", "left").select("id", F.least("component", "m").alias("component"), F.col("component").alias("was"))
        better = materialize(better, "parts", old)
        jump = better.select(F.col("id").alias("component"), F.col("component").alias("far"))
        now = materialize(better.join(jump, "component").select("id", F.col("far").alias("component"), "was"), "parts", kept)
        changed = not now.where("component <> was").isEmpty()
        now = now.select("id", "component")
        release(spark, old)
        if not changed:
            return now


def near_components(edges: DataFrame, eps: float = 0.5, least: int = 2) -> DataFrame:
    """(id, community): density clusters by cosine distance of adjacency rows.

    With two points to a core, clusters are the components of the pairs that share
    t x sqrt(degree x degree) neighbours, t = 1 - eps. Nodes of equal rows are one class. Where one
    shared neighbour is enough (degree x degree up to 1 / t**2), a neighbour's classes are linked to
    that of least degree. Other pairs share two neighbours and t**2 x degree of each, so they meet in
    the first neighbours of both, of least degree first, and are counted on their full rows; thus a
    hub's neighbours are not paired with each other for the hub alone.
    """
    t2 = (1 - eps) ** 2
    deg = degrees(edges)
    near = both_ways(edges).join(deg.select(F.col("id").alias("v"), F.col("degree").alias("dv")), "v")
    rows = near.groupBy("u").agg(F.transform(F.array_sort(F.collect_list(F.struct("dv", "v"))), lambda x: x["v"]).alias("near"))
    rows = materialize(rows.withColumn("class_id", F.min("u").over(W.partitionBy("near"))), "rows")
    classes = rows.where("u = class_id").select(F.col("u").alias("id"), "near", F.size("near").alias("d"))
    at = classes.select("id", "d", F.explode("near").alias("v"))
    first = at.groupBy("v").agg(F.min_by(F.struct("id", "d"), F.struct("d", "id")).alias("m"))
    sure = at.join(first, "v").where((F.col("m.id") != F.col("id")) & (F.col("m.d") * F.col("d") <= 1 / t2 + 1e-9)).select(F.least("m.id", "id").alias("a"), F.greatest("m.id", "id").alias("b"))
    head = F.slice("near", F.lit(1), F.col("d") - F.greatest(F.lit(2), F.ceil(t2 * F.col("d") - 1e-9).cast("int")) + 1)
    heads = classes.where("d > 1").select("id", "d", F.explode(head).alias("v"))
    pairs = heads.select("v", F.col("id").alias("a"), F.col("d").alias("da")).join(heads.select("v", F.col("id").alias("b"), F.col("d").alias("db")), "v").where("a < b")
    pairs = pairs.where((F.col("da") * t2 <= F.col("db") + 1e-9) & (F.col("db") * t2 <= F.col("da") + 1e-9)).select("a", "b").distinct()
    side = lambda c: few(classes.select(F.col("id").alias(c), F.col("near").alias(f"near_{c}")))
    full = pairs.join(side("a"), "a").join(side("b"), "b")
    close = full.where(F.size(F.array_intersect("near_a", "near_b")) / F.sqrt(F.size("near_a") * F.size("near_b").cast("double")) >= 1 - eps - 1e-9).select("a", "b")
    parts = components(classes.select("id"), materialize(sure.unionByName(close).distinct(), "close")).withColumnRenamed("id", "class_id")
    parts = rows.select(F.col("u").alias("id"), "class_id").join(parts, "class_id").select("id", F.col("component").alias("community"))
    big = parts.groupBy("community").count().where(F.col("count") >= least).select("community")
    return parts.join(big, "community").select("id", "community")


def kmeans_communities(edges: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """(id, community) by k-means on degree and clustering coefficient: the fallback of small graphs."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    found = materialize(clustering(edges).select("id", "degree", "coefficient"), "features")  # each step of the fit reads it
    rows = found.select("id", array_to_vector(F.array(F.col("degree").cast("double"), "coefficient")).alias("features"))
    return KMeans(k=k, seed=seed, predictionCol="community").fit(rows).transform(rows).select("id", "community")


def distances(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, id, hops) by breadth-first steps from every source at once, until no new pair is found; each step keeps only new pairs."""
    ways = materialize(both_ways(edges), "ways")
    seen = materialize(sources.select(F.col("id").alias("source"), "id", F.lit(0).alias("hops")), "reached")
    edge, h = seen, 0
    while True:
        h += 1
        edge = edge.select("source", F.col("id").alias("u")).join(ways, "u").select("source", F.col("v").alias("id")).distinct().join(seen, ["source", "id"], "left_anti").withColumn("hops", F.lit(h))
        edge = materialize(edge, "reached")
        if edge.isEmpty():
            return seen
        seen = seen.unionByName(edge)


#: Edges of a graph that closeness sends to each of its tasks at most (four bytes each way); larger graphs are walked by joins.
CLOSENESS_EDGES = 40_000_000
#: Bytes of the bits that a task of closeness holds of all nodes at once, three times over.
CLOSENESS_BYTES = 48 << 20
#: Ways of a packed row of a graph.
PACKED_WAYS = 250_000
#: Nodes (about) whose distances to all others closeness finds at once by joins, as bits of each row.
CLOSENESS_BLOCK = 1024


def closeness(nodes: DataFrame, edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, closeness) of the sources, scaled by the share of nodes that they reach. ``nodes`` has both ends of every edge.

    All pairs of nodes are looked at, so the work is quadratic. Nodes are dealt out in their order to a fixed number of tasks;
    each gets the graph once, as packed rows that Spark shuffles, and walks it from its own nodes (see ``_steps``). Graphs of more than
    CLOSENESS_EDGES edges go through joins instead.
    """
    n = nodes.count()
    if not n:
        return sources.select("id", F.lit(0.0).alias("closeness"))
    edges = materialize(edges.select("a", "b"), "edges")
    sums = _sums_in_tasks(nodes, edges, n) if edges.count() <= CLOSENESS_EDGES else _sums_by_joins(nodes, edges, n)
    wanted = sources.select(F.col("id").alias("_id"))
    d = sums.join(wanted, F.col("id").eqNullSafe(F.col("_id")), "left_semi").groupBy("id").agg(F.sum("total").alias("total"), F.sum("reached").alias("reached"))
    return d.select("id", F.when((F.col("total") > 0) & F.lit(n > 1), F.round(F.col("reached") / F.col("total") * F.col("reached") / max(n - 1, 1), 6)).otherwise(0.0).alias("closeness"))


def _numbered(nodes: DataFrame) -> DataFrame:
    """(id, place): places from 0 in the order of ids, as a written table; only numbers of rows by partition reach the driver."""
    spark = nodes.sparkSession
    rows = nodes.select("id").repartitionByRange("id").sortWithinPartitions("id").select("id", F.monotonically_increasing_id().alias("m"))
    rows = materialize(rows.select("id", F.shiftright("m", 33).cast("int").alias("part"), F.col("m").bitwiseAND((1 << 33) - 1).alias("at")), "numbered")
    starts, before = [], 0
    for part, size in sorted(tuple(r) for r in rows.groupBy("part").count().collect()):
        starts.append((part, before))
        before += size
    starts = F.broadcast(spark.createDataFrame(starts, "part int, start bigint"))  # a row a partition
    return materialize(rows.join(starts, "part").select("id", (F.col("start") + F.col("at")).cast("int").alias("place")), "places")


def _packed(ways: DataFrame) -> DataFrame:
    """(first, last, nodes, sizes, ways): ways (u, v) in the order of u, about PACKED_WAYS a row: the nodes u from ``first`` to ``last``, how many ways each has, and their ends v, as 4-byte numbers."""

    def pack(batches):
        held, size = [], 0

        def row():
            u, v = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            held.clear()
            at, sizes = np.unique(u, return_counts=True)
            return pd.DataFrame({"first": at[:1], "last": at[-1:], "nodes": [at.astype(np.int32).tobytes()], "sizes": [sizes.astype(np.int32).tobytes()], "ways": [v.astype(np.int32).tobytes()]})

        for pdf in batches:
            if len(pdf):
                held.append((pdf["u"].to_numpy(), pdf["v"].to_numpy()))
                size += len(pdf)
            if size >= PACKED_WAYS:
                yield row()
                size = 0
        if size:
            yield row()

    return ways.repartitionByRange("u").sortWithinPartitions("u", "v").mapInPandas(pack, "first int, last int, nodes binary, sizes binary, ways binary")


def _sums_in_tasks(nodes: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """(id, total, reached): parts of the sum of the distances to all nodes that a node reaches, and of their number."""
    places = _numbered(nodes)
    end = lambda c, to: places.select(F.col("id").alias(c), F.col("place").alias(to))
    ways = both_ways(edges.join(end("a", "u"), "a").join(end("b", "v"), "b").select(F.col("u").alias("a"), F.col("v").alias("b")))
    packed = materialize(_packed(ways), "packed")
    count = sum(r[0] for r in packed.select((F.length("ways") / 4).cast("bigint")).collect())
    tasks = min(-(-n // 64), 2 * nodes.sparkSession.sparkContext.defaultParallelism)
    share, width = -(-n // tasks), 64 * max(1, CLOSENESS_BYTES // (8 * n))

    def run(batches):
        to, degree, filled, task = np.empty(count, np.int32), np.zeros(n, np.int64), 0, None
        for pdf in batches:
            for t, at, sizes, ends in zip(pdf["task"], pdf["nodes"], pdf["sizes"], pdf["ways"]):
                ends = np.frombuffer(ends, np.int32)
                to[filled : filled + len(ends)] = ends
                degree[np.frombuffer(at, np.int32)] += np.frombuffer(sizes, np.int32)
                filled, task = filled + len(ends), t
        if task is None:
            return
        first = np.concatenate([[0], np.cumsum(degree)])
        total, reached = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for start in range(task * share, min(n, (task + 1) * share), width):
            _steps(first, to, start, min(width, n - start, (task + 1) * share - start), total, reached)
        at = np.flatnonzero(reached)
        for i in range(0, len(at), 50_000):
            part = at[i : i + 50_000]
            yield pd.DataFrame({"place": part, "total": total[part], "reached": reached[part]})

    copies = packed.crossJoin(F.broadcast(nodes.sparkSession.range(tasks).select(F.col("id").cast("int").alias("task"))))  # the graph once for each of a fixed number of tasks
    dealt = copies.repartitionById(tasks, F.col("task")).sortWithinPartitions("first", "last")
    found = dealt.select("task", "nodes", "sizes", "ways").mapInPandas(run, "place int, total bigint, reached bigint")
    found = materialize(found, "sums").groupBy("place").agg(F.sum("total").alias("total"), F.sum("reached").alias("reached"))
    return places.join(found, "place", "left").select("id", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("reached", F.lit(0)).alias("reached"))


#: Ways from which on a node's are united one by one.
MANY_WAYS = 32


def _steps(first: np.ndarray, to: np.ndarray, start: int, width: int, total: np.ndarray, reached: np.ndarray) -> None:
    """Walk from the ``width`` nodes from ``start`` on at once, breadth-first, and add what each node meets to ``total`` and ``reached``.

    A node has a bit for each of them: those met so far, and those met by the last step. A step unites the new bits of
    the neighbours of nodes that have any, until there are none.
    """
    n, words = len(first) - 1, -(-width // 64)
    degree = np.diff(first)
    seen, new = np.zeros((n, words), np.uint64), np.zeros((n, words), np.uint64)
    own = np.arange(width)
    seen[start + own, own // 64] = np.uint64(1) << (own % 64).astype(np.uint64)
    whole = np.bitwise_or.reduce(seen[start : start + width], axis=0)
    open_, active = ~(seen == whole).all(1), start + own
    new[active] = seen[active]
    lively = np.zeros(n, bool)
    hops = 0
    while len(active):
        hops += 1
        lively[:] = False
        lively[active] = True
        met = np.zeros(n, bool)
        for a, b in spans(degree[active], 1 << 20):
            k, at = degree[active[a:b]], first[active[a:b]]
            met[to[np.repeat(at - np.cumsum(k) + k, k) + np.arange(k.sum())]] = True
        rows = np.flatnonzero(met & open_)
        got = _united(first, to, degree, rows, new, lively)
        got &= ~seen[rows]
        fresh = np.bitwise_count(got).sum(1, dtype=np.int64)
        new[active] = 0
        rows, got, fresh = rows[fresh > 0], got[fresh > 0], fresh[fresh > 0]
        total[rows] += hops * fresh
        reached[rows] += fresh
        seen[rows] |= got
        new[rows] = got
        open_[rows] = ~(seen[rows] == whole).all(1)
        active = rows


def _united(first: np.ndarray, to: np.ndarray, degree: np.ndarray, rows: np.ndarray, new: np.ndarray, lively: np.ndarray) -> np.ndarray:
    """For each of ``rows`` the bits of ``new`` of its neighbours, of which only ``lively`` ones have any."""
    out = np.zeros((len(rows), new.shape[1]), np.uint64)
    for i in np.flatnonzero(degree[rows] >= MANY_WAYS):
        near = to[first[rows[i]] : first[rows[i] + 1]]
        near = near[lively[near]]
        for a in range(0, len(near), 4096):
            out[i] |= np.bitwise_or.reduce(new[near[a : a + 4096]], axis=0)
    rest = np.flatnonzero(degree[rows] < MANY_WAYS)
    rest = rest[np.argsort(-degree[rows[rest]], kind="stable")]
    step = max(1, (1 << 18) // (8 * new.shape[1]))
    for a in range(0, len(rest), step):
        at = rest[a : a + step]
        size, begin = degree[rows[at]], first[rows[at]]
        for k in range(size[0]):
            m = np.searchsorted(-size, -k)  # those of more than k ways
            out[at[:m]] |= new[to[begin[:m] + k]]
    return out


def _sums_by_joins(nodes: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """What ``_sums_in_tasks`` gives, for graphs of any size.

    Nodes are dealt into blocks. For each block every row holds a bit for each of its nodes: those reached
    so far, and those reached by the last step. A step unites the neighbours' new bits, until there are none.
    """
    spark = nodes.sparkSession
    ways = materialize(both_ways(edges), "ways")
    blocks = max(1, -(-n // CLOSENESS_BLOCK))
    placed = nodes.select("id", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    placed = materialize(placed.withColumn("slot", F.row_number().over(W.partitionBy("block").orderBy("id")) - 1), "slots")
    sums, passing = None, []
    for block, top in placed.groupBy("block").agg(F.max("slot")).orderBy("block").collect():
        words = range(top // 64 + 1)
        bit = lambda i: F.when((F.col("block") == block) & (F.floor(F.col("slot") / 64) == i), F.expr("shiftleft(1L, slot % 64)")).otherwise(F.lit(0).cast("bigint"))  # noqa: B023, E731
        now = placed.select("id", F.lit(0).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("reached"), *[bit(i).alias(f"s{i}") for i in words], *[bit(i).alias(f"n{i}") for i in words])
        now, hops, old = materialize(now, "bits", passing), 0, []
        some = " OR ".join(f"n{i} <> 0" for i in words)
        while not now.where(some).isEmpty():
            hops, old, passing = hops + 1, passing, []
            got = ways.join(now.where(some).select(F.col("id").alias("v"), *[f"n{i}" for i in words]), "v").groupBy(F.col("u").alias("id")).agg(*[F.bit_or(f"n{i}").alias(f"g{i}") for i in words])
            new = now.select("id", "total", "reached", *[f"s{i}" for i in words]).join(got, "id", "left").select("id", "total", "reached", *[f"s{i}" for i in words], *[F.expr(f"coalesce(g{i} & ~s{i}, 0L)").alias(f"n{i}") for i in words])
            found = F.expr(" + ".join(f"bit_count(n{i})" for i in words))
            new = new.select("id", (F.col("total") + hops * found).alias("total"), (F.col("reached") + found).alias("reached"), *[F.expr(f"s{i} | n{i}").alias(f"s{i}") for i in words], *[f"n{i}" for i in words])
            now = materialize(new, "bits", passing)
            release(spark, old)
        part = materialize(now.select("id", "total", "reached"), "sums")
        release(spark, passing)
        sums = part if sums is None else sums.unionByName(part)
    return sums


#: Edges of a graph's core that is sent whole to every task, for betweenness.
SMALL_GRAPH_EDGES = 1_000_000


def _small(edges: DataFrame) -> list:
    got = edges.select("a", "b").limit(SMALL_GRAPH_EDGES + 1).collect()
    if len(got) > SMALL_GRAPH_EDGES:
        raise ValueError(f"only graphs of up to {SMALL_GRAPH_EDGES} edges besides their trees; use label_propagation and pagerank beyond")
    return sorted((r[0], r[1]) for r in got)


def _without_leaves(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(core, nodes, hung): the edges of the graph without the trees that hang on it, and what hung where.

    Nodes of one edge go, round by round, until there are none. ``nodes`` (id, weight): all nodes, and how many nodes each stood for when it went
    or, in the core, at the end, itself included. ``hung`` (id, below): a row for each node that went with ``below`` nodes into ``id``.
    Of a tree without a core its last edge's lesser end stays, alone.
    """
    left = materialize(edges.select("a", "b"), "left")
    weights = materialize(degrees(left).select("id", F.lit(1).cast("bigint").alias("weight")), "weights")
    gone, hung = weights.limit(0), weights.select("id", F.col("weight").alias("below")).limit(0)
    while True:
        single = degrees(left).where("degree = 1").select("id")
        ends = left.join(single.select(F.col("id").alias("a"), F.lit(True).alias("la")), "a", "left").join(single.select(F.col("id").alias("b"), F.lit(True).alias("lb")), "b", "left")
        ends = materialize(ends.select("a", "b", F.when(F.col("lb"), F.col("b")).when(F.col("la"), F.col("a")).alias("leaf")), "ends")
        cut = ends.where("leaf is not null").select(F.col("leaf").alias("id"), F.when(F.col("leaf") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("to"))
        went = materialize(cut.join(weights, "id"), "went")
        if went.isEmpty():
            return left, gone.unionByName(weights), hung
        onto = went.select(F.col("to").alias("id"), F.col("weight").alias("below"))
        gone, hung = gone.unionByName(went.select("id", "weight")), hung.unionByName(onto)
        added = onto.groupBy("id").agg(F.sum("below").alias("more"))
        weights = weights.join(went.select("id"), "id", "left_anti").join(added, "id", "left").select("id", (F.col("weight") + F.coalesce("more", F.lit(0))).alias("weight"))
        weights, left = materialize(weights, "weights"), materialize(ends.where("leaf is null").select("a", "b"), "left")


def betweenness(edges: DataFrame) -> DataFrame:
    """(id, betweenness), normalised.

    Trees that hang on the graph are taken off first, in Spark: on a path out of a tree every node of it up to the core
    lies for sure, so sizes say how many pairs do; only the core needs an accumulation for each of its nodes, in which a node counts for all
    that hung on it. Sources are spread over tasks, the bounded core is sent to each.
    """
    core, nodes, hung = _without_leaves(edges)
    nodes = materialize(nodes, "nodes")
    every = materialize(components(nodes.select("id"), edges).withColumnRenamed("component", "part"), "component")
    size = every.groupBy("part").agg(F.count("*").alias("size"))
    n = nodes.count()
    # ordered pairs of different branches at a node: those that hung on it, and the rest of its component
    branches = hung.groupBy("id").agg(F.sum("below").alias("below"), F.sum(F.col("below") * F.col("below")).alias("squares"))
    at = nodes.join(every, "id").join(size, "part").join(branches, "id", "left").select("id", "weight", F.coalesce("below", F.lit(0)).cast("double").alias("below"), F.coalesce("squares", F.lit(0)).cast("double").alias("squares"), "size")
    rest = F.col("size") - 1.0 - F.col("below")
    trees = at.select("id", (F.col("below") * F.col("below") - F.col("squares") + 2 * F.col("below") * rest).alias("part"))
    parts = trees.unionByName(_core_betweenness(core, nodes))
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    return parts.groupBy("id").agg(F.round(F.sum("part") * scale, 6).alias("betweenness"))


def _core_betweenness(edges: DataFrame, weights: DataFrame) -> DataFrame:
    """(id, part): for each node the ordered pairs of other nodes, times their weights, that shortest paths through it join, by tasks."""
    pairs = _small(edges)
    names = sorted({x for p in pairs for x in p})
    n, place = len(names), {x: i for i, x in enumerate(names)}
    ends = np.array([(place[a], place[b]) for a, b in pairs], np.int64).reshape(-1, 2)
    ways = np.concatenate([ends, ends[:, ::-1]])
    ways = ways[np.lexsort((ways[:, 1], ways[:, 0]))]
    spark = edges.sparkSession
    held = weights.join(degrees(edges).select("id"), "id", "left_semi")
    many = np.ones(n)
    for r in held.where("weight > 1").toLocalIterator():  # nodes of the bounded core
        many[place[r["id"]]] = r["weight"]
    shared = spark.sparkContext.broadcast((names, np.searchsorted(ways[:, 0], np.arange(n + 1)), np.ascontiguousarray(ways[:, 1]), many))

    def run(batches):
        names, first, to, many = shared.value
        place = {x: i for i, x in enumerate(names)}
        score = np.zeros(len(names))
        for pdf in batches:
            for s in pdf["id"]:
                s = place[s]
                far, count, owed = np.full(len(names), -1), np.zeros(len(names)), np.zeros(len(names))
                far[s], count[s] = 0, 1.0
                edge, steps = np.array([s]), []
                while len(edge):
                    k = first[edge + 1] - first[edge]
                    u, v = np.repeat(edge, k), to[np.repeat(first[edge] - np.cumsum(k) + k, k) + np.arange(k.sum())]
                    far[v[far[v] < 0]] = len(steps) + 1
                    on = far[v] == len(steps) + 1
                    u, v = u[on], v[on]
                    np.add.at(count, v, count[u])
                    steps.append((u, v))
                    edge = np.unique(v)
                for u, v in reversed(steps):
                    np.add.at(owed, u, count[u] / count[v] * (many[v] + owed[v]))
                owed[s] = 0.0
                score += many[s] * owed
        yield pd.DataFrame({"id": names, "part": score})

    kind = edges.schema["a"].dataType.simpleString()
    tasks = spark.sparkContext.defaultParallelism  # a number of its own, so that few ids aren't put into one task
    return degrees(edges).select("id").repartition(tasks, "id").mapInPandas(run, f"id {kind}, part double")


#: Rounds of moves at a level at most, and rounds without a better modularity after which a level ends.
LOUVAIN_ROUNDS, LOUVAIN_PATIENCE = 80, 4
#: Communities that are broadcast to a round's joins at most.
LOUVAIN_FEW = 20_000


def _sorted(df: DataFrame) -> DataFrame:
    """``df``, which grows with the graph, to be joined by sorting: for a broadcast all of it would go through the driver, in each round."""
    return df.hint("merge")


def _moves(ways: DataFrame, now: DataFrame, total: float, kept: list[str]) -> DataFrame:
    """(u, k, old, inside, new): each node's community, its weight into it, and where it goes in this round.

    ``ways``: (u, v, w) both ways, a loop once with all of its weight; ``now``: (u, k, community), k the sum of a node's weights.
    A node would join the neighbouring community of greatest gain, if that is more than its own; of equal gains the least community.
    It does so if no neighbour would gain more by a move of its own (of equal gains the greater node goes), so
    that neighbours don't move at once and the node that gains most always does.
    """
    held = now.groupBy("community").agg(F.sum("k").alias("held"))
    held = F.broadcast(held) if held.limit(LOUVAIN_FEW + 1).count() <= LOUVAIN_FEW else _sorted(held)
    links = ways.join(_sorted(now.select(F.col("u").alias("v"), "community")), "v").groupBy("u", "community").agg(F.sum(F.when(F.col("u") != F.col("v"), F.col("w")).otherwise(0.0)).alias("w"), F.sum("w").alias("all"))
    own = now.withColumnRenamed("community", "old")
    met = links.join(_sorted(own), "u").join(held, "community")
    rest = F.col("held") - F.when(F.col("community") == F.col("old"), F.col("k")).otherwise(0.0)
    met = met.select("u", "community", "all", "old", "w", (F.col("w") - F.col("k") * rest / F.lit(total)).alias("gain"))
    here = F.col("community") == F.col("old")
    best = met.groupBy("u").agg(
        F.max(F.when(here, F.col("all"))).alias("inside"),
        F.max(F.when(here, F.col("gain"))).alias("stay"),
        F.min(F.when(~here, F.struct((-F.round("gain", 12)).alias("loss"), "community"))).alias("first"),
    )
    away = own.join(held.withColumnRenamed("community", "old"), "old").join(_sorted(best), "u", "left")
    stay = F.coalesce("stay", -F.col("k") * (F.col("held") - F.col("k")) / F.lit(total))  # no link into its own community
    more = F.round(-F.col("first.loss") - stay, 12)
    want = away.select("u", "k", "old", F.coalesce("inside", F.lit(0.0)).alias("inside"), F.when(more > 1e-11, more).alias("gain"), F.col("first.community").alias("to"))
    want = materialize(want, "wants", kept)
    movers = want.where("gain is not null").select("u", F.struct("gain", "u").alias("claim"))
    rivals = ways.where("u <> v").join(_sorted(movers.select(F.col("u").alias("v"), "claim")), "v").groupBy("u").agg(F.max("claim").alias("rival"))
    goes = F.col("gain").isNotNull() & (F.col("rival").isNull() | (F.struct("gain", "u") > F.col("rival")))
    return want.join(_sorted(rivals), "u", "left").select("u", "k", "old", "inside", F.when(goes, F.col("to")).otherwise(F.col("old")).alias("new"))


def _level(ways: DataFrame, start: DataFrame, total: float) -> tuple[DataFrame, float]:
    """(u, community) of the round of greatest modularity, as a written table, and that modularity, from the communities ``start`` (u, community) on."""
    spark, kept = ways.sparkSession, []
    now = materialize(ways.groupBy("u").agg(F.sum("w").alias("k")).join(_sorted(start), "u"), "round", kept)
    best, found, since = None, -2.0, 0
    for _ in range(LOUVAIN_ROUNDS):
        round_ = materialize(_moves(ways, now, total, kept), "round", kept)
        inside, moved = round_.agg(F.sum("inside"), F.count(F.when(F.col("new") != F.col("old"), 1))).first()
        spread = round_.groupBy("old").agg(F.sum("k").alias("k")).agg(F.sum(F.col("k") * F.col("k"))).first()[0]
        modularity, since = inside / total - spread / total**2, since + 1
        if modularity > found + 1e-9:
            best, found, since = round_.select("u", F.col("old").alias("community")), modularity, 0
        if since >= LOUVAIN_PATIENCE or not moved:
            break
        now = round_.select("u", "k", F.col("new").alias("community"))
    best = materialize(best, "level")
    release(spark, kept)
    return best, found


def louvain(edges: DataFrame, passes: int = 10) -> DataFrame:
    """(id, community) by greedy moves that raise modularity, and folding of communities into nodes, level by level; at last nodes move once more one by one.

    All of it is joins and sums over tables in the shared folder: neither nodes nor edges reach the driver, only the
    modularity of a round does. A level keeps its round of greatest modularity; folding ends when a level
    brings no more. A community is named by its least node. Without edges there are no rows.
    """
    first = ways = materialize(both_ways(edges).withColumn("w", F.lit(1.0)), "ways")
    total = float(ways.agg(F.sum("w")).first()[0] or 0.0)
    groups = materialize(degrees(edges).select("id", F.col("id").alias("node")), "groups")
    reached = -1.0
    for _ in range(passes if total else 0):
        at, found = _level(ways, ways.select("u", F.col("u").alias("community")).distinct(), total)
        if found <= reached + 1e-9:
            break
        reached = found
        groups = materialize(groups.join(_sorted(at.select(F.col("u").alias("node"), "community")), "node").select("id", F.col("community").alias("node")), "groups")
        end = lambda c: _sorted(at.select(F.col("u").alias(c), F.col("community").alias(f"c{c}")))  # noqa: B023, E731
        ways = materialize(ways.join(end("u"), "u").join(end("v"), "v").groupBy(F.col("cu").alias("u"), F.col("cv").alias("v")).agg(F.sum("w").alias("w")), "ways")
    if total:
        at, _ = _level(first, groups.select(F.col("id").alias("u"), F.col("node").alias("community")), total)
        groups = at.select(F.col("u").alias("id"), F.col("community").alias("node"))
    names = groups.groupBy("node").agg(F.min("id").alias("community"))
    return groups.join(_sorted(names), "node").select("id", "community")
