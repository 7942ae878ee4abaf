"""Token counts against the library, histograms against counting, relations of long runs."""

import base64
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.functions import bpe
from brindle.operators import graph, metrics
from brindle.plans import catalog

tiktoken = pytest.importorskip("tiktoken")
public_tokenizers = pytest.importorskip("public_tokenizers")
SMALL = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts_of_documents(spark):
    _, coder = library()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r["doc_id"]: r["n_tokens"] for r in catalog.QUERIES["bpe_token_counts"](spark, SMALL).collect()}
    assert got == {i: len(coder.encode_ordinary(t or "")) for i, t in texts.items()}
    odd = spark.sql("select 1 i, cast(null as string) t union all select 2, '' union all select 3, cast(X'FF41' as string)")
    assert {r["i"]: r["n"] for r in odd.select("i", bpe.token_count("t", PATH, public_tokenizers.PATTERN).alias("n")).collect()} == {1: 0, 2: 0, 3: len(coder.encode_ordinary("�A"))}


def test_ids_of_random_pieces():
    ranks, coder = library()
    rng = np.random.default_rng(1)
    for _ in range(300):
        piece = "".join(rng.choice(list("abcdeingst é漢😀"), rng.integers(1, 40))).encode()
        assert bpe.merge(piece, ranks) == coder._encode_single_piece(piece)
    began = time.process_time()
    assert bpe.merge(b"ab" * 100_000, ranks)
    assert time.process_time() - began < 20


def test_histograms_add_up(spark):
    rng = np.random.default_rng(2)
    rows = [(str(i % 3), i % 4, None if i % 17 == 0 else float(rng.exponential(2))) for i in range(2000)] + [("0", 0, 10.0), ("0", 0, 0.005), ("1", 1, 1e9)]
    log = spark.createDataFrame(rows, "mode string, day int, s double")
    daily = metrics.histogram(log, "s", ["mode", "day"])
    parts = [daily.where(f"day = {i}") for i in range(4)]
    whole = metrics.histogram(log, "s", ["mode"])
    plain = lambda h: sorted((r["mode"], r["le"], r["n"], round(r["total"], 6)) for r in h.collect())
    assert plain(metrics.merged(*parts, by=["mode"])) == plain(whole)
    for r in metrics.cumulative(whole, ["mode"]).collect():
        assert r["n"] == sum(m == r["mode"] and s is not None and s <= r["le"] for m, _, s in rows)
    for r in metrics.quantiles(whole, ["mode"], 0.9).collect():
        exact = float(np.quantile([s for m, _, s in rows if m == r["mode"] and s is not None], 0.9))
        bounds = [0.0, *metrics.BOUNDS, float("inf")]
        at = next(i for i, b in enumerate(bounds) if b >= exact)
        assert bounds[at - 1] <= r["value"] <= bounds[at]


def test_relations_of_long_runs(spark):
    import re

    verbs = [("received", r"received|was\s+given", 0.8)]
    texts = ["a b c d e f g h i j received k l m n o p q r s", "x received y received z", "received a", "a received", "A WAS  given\nb. c received d", "no verb", "p received, q", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "document_id int, content string")
    side = r"(\w+(?:\s+\w+)*)"
    want = sorted((i, *m) for i, t in enumerate(texts) if t for m in re.findall(rf"(?im){side}\s+(?:received|was\s+given)\s+{side}", t))
    assert sorted((r["document_id"], r["s"], r["t"]) for r in graph.verb_relations(docs, verbs).collect()) == want
    long = spark.range(1).select(F.lit(1).alias("document_id"), F.repeat(F.lit("word "), 100_000).alias("a")).select("document_id", F.concat("a", F.lit("received "), "a", F.lit("end")).alias("content"))
    began = time.time()
    assert graph.verb_relations(long, verbs).select(F.length("s"), F.length("t")).collect() == [(499_999, 500_003)]
    assert time.time() - began < 30
