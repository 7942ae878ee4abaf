"""The registered queries of this subpackage: one ``opN_<name>`` for each operator."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import containment, html_layout, near_dups, periodic_runs, pieces, prefix_trie, quality_gam, quality_rules, ring_shards, token_store, toxicity_fm, url_rules, vp_trees
from brindle.llm.texts import fold
from brindle.session import scratch_path, table

#: Production parameters of the queries; every operator takes them as arguments.
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
SHARDS = 8
NEIGHBOURS = 5
#: Share of the triangle inequality's bound that op12 keeps; 1 is exact.
VP_FACTOR = 0.2
#: host, path, verdict
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_store.write_store(table(spark, sf_dir, "documents"), path, WORD_VOCABULARY)
    return token_store.store_digest(spark, path)


def _judged(scored: DataFrame, remainder: int, divisor: int) -> DataFrame:
    return scored.select("doc_id", fold(remainder, divisor).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_gam.train(docs, labels.where(~fold(1, 3)))
    return _judged(quality_gam.score(docs, model, ["doc_id"]), 1, 3)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.apply_rules(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


def op4_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity_fm.train(docs, labels.where(~fold(0, 5)))
    return _judged(toxicity_fm.score(docs, model, ["doc_id"]), 0, 5)


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge(table(spark, sf_dir, "pages"), rules)


def op6_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment.find_contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.components(table(spark, sf_dir, "documents"), width=2).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op8_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_layout.extract(table(spark, sf_dir, "pages"))


def op9_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``rows``: the counts of shards differ by one at most."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = ring_shards.assign(docs, F.col("doc_id"), [F.col("doc_id"), F.col("text_crc32"), F.col("size")], SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def piece_digest(docs: DataFrame) -> DataFrame:
    """Per document its ids, their number, and the size and crc32 of the text that they decode to."""
    coded = pieces.round_trip(docs, PIECE_MODEL)
    return coded.select("doc_id", "ids", F.size("ids").cast("bigint").alias("n_tokens"), F.crc32(F.col("text").cast("binary")).alias("decoded_crc32"), F.octet_length("text").cast("bigint").alias("decoded_bytes"))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digest(table(spark, sf_dir, "documents"))


def pieces_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator over the same pieces taken as a unigram model: per document the ids of greatest summed score."""
    coded = pieces.encode(table(spark, sf_dir, "documents"), PIECE_MODEL, pieces.UNIGRAM)
    return coded.select("doc_id", "ids", F.size("ids").cast("bigint").alias("n_tokens"))


def repeating_words(ids: list, sizes: list[int]) -> list:
    """Which original words the texts of op11 get: with h the crc32 of the doc_id, every tenth text repeats p of its words from word a on. A null id repeats none."""
    out = []
    for doc_id, n in zip(ids, sizes):
        h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
        if h is None or h % 10 or not n:
            out.append(None)
            continue
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        i = np.arange(n)
        out.append(np.where(i < a, i, a + (i - a) % p))
    return out


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(table(spark, sf_dir, "documents"), order=repeating_words)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    top = F.col("greatest")
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        *(top[c].alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * greatest.length div greatest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_vp_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    found = vp_trees.search(vp_trees.build(vectors, NEIGHBOURS + 1), vectors.where("vec_id % 50 = 0"), NEIGHBOURS, VP_FACTOR)
    return found.select(F.col("query_id").cast("bigint"), "rank", F.col("vec_id").cast("bigint"), "score")


def rebuilt(sequences: DataFrame) -> DataFrame:
    """Conversation c as the first h turns of conversation c - c % 100, then its own turns after its first h; h = crc32(c) % 6."""
    heads = sequences.where("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.substring("turns", 1, 5 * prefix_trie.CODE).alias("head"))
    h = F.expr(f"int({prefix_trie.CODE} * (crc32(cast(cast(conv_id as string) as binary)) % 6))")
    own = sequences.withColumns({"base": F.expr("conv_id - conv_id % 100"), "h": h})
    return own.join(heads, "base", "left").select("conv_id", F.expr("concat(substring(coalesce(head, X''), 1, h), substring(turns, h + 1))").alias("turns"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = prefix_trie.prefix_trie(rebuilt(prefix_trie.sequences(table(spark, sf_dir, "conversations"))))
    return nodes.drop("turn")


QUERIES = {f.__name__: f for f in (op1_token_store, op2_quality_gam, op3_quality_rules, op4_toxicity_fm, op5_url_rules, op6_containment, op7_near_dups, op8_html_layout, op9_ring_shards, op10_pieces, op11_periodic_runs, op12_vp_trees, op13_prefix_trie, pieces_viterbi)}

_URL_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

ORACLES = {
    "op5_url_rules": f"""
        WITH parts AS (
            SELECT page_id,
                   translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path
            FROM pages),
        rules(rule_host, rule_path, rule_verdict) AS (VALUES {_URL_RULES_SQL}),
        hits AS (
            SELECT page_id, rule_host || rule_path AS rule, rule_verdict,
                   row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS n
            FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
        SELECT p.page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict
        FROM parts p LEFT JOIN (SELECT * FROM hits WHERE n = 1) h ON p.page_id = h.page_id
    """,
}
