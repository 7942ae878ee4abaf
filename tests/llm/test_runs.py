"""Periodic runs against a walk over all periods."""

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pytest

from brindle.llm import periodic_runs, queries

SMALL = "/root/testdata/sf0.001"


def plain_runs(words, least=6, exponent=4):
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    """What the contract of op11 says, word by word."""
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    digest = lambda b: hashlib.sha256(b).hexdigest()
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (doc_id, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, digest(lines.encode()), digest(b" ".join(w for i, w in enumerate(words) if i not in gone)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def key(row):
    return tuple((x is not None, x) for x in row)


@pytest.mark.parametrize("which", ["small", "odd"])
def test_query_against_plain_walk(spark, which, odd, monkeypatch):
    if which == "odd":
        extra = [(i, " ".join(f"w{k % (1 + i % 7)}" for k in range(i))) for i in range(20, 60)]
        docs = odd.where("doc_id is null or doc_id not in (7, 8)").select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id bigint, text string")).selectExpr("doc_id", "text", "1 runs", "2 greatest")
        monkeypatch.setattr(queries, "table", lambda *_: docs)
    else:
        docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = queries.op11_periodic_runs(spark, SMALL)
    assert got.columns == COLUMNS
    want = [plain_row(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_empty_table_bad_bytes_and_long_text(spark, empty):
    assert periodic_runs.find_runs(empty).count() == 0
    docs = spark.sql("select 1L doc_id, cast(X'FF20FF20FF20FF20FF20FF20FE' as string) text union all select 2L, repeat('a b c ', 60000)")
    got = {r["doc_id"]: r for r in periodic_runs.find_runs(docs).collect()}
    assert [tuple(r) for r in got[1]["runs"]] == [(0, 6, 1)] and bytes(got[1]["collapsed"]) == b"\xff \xfe"
    assert [tuple(r) for r in got[2]["runs"]] == [(0, 180_000, 3)] and bytes(got[2]["collapsed"]) == b"a b c"


def test_random_words_in_small_blocks(monkeypatch):
    rng = np.random.default_rng(1)
    for t in range(150):
        monkeypatch.setattr(periodic_runs, "PAIRS", int(rng.integers(1, 50)) if t % 2 else 1 << 18)
        texts = [rng.integers(0, rng.integers(1, 4), rng.integers(0, 60)).tolist() for _ in range(rng.integers(1, 6))]
        starts = np.concatenate([[0], np.cumsum([len(d) for d in texts])]).astype(np.int64)
        exponent = 4 if t % 3 else 2
        got = periodic_runs.runs_of(np.array([x for d in texts for x in d], np.int64), starts, 6, exponent)
        want = [(int(at) + s, n, q) for d, at in zip(texts, starts) for s, n, q in plain_runs(d, 6, exponent)]
        assert [tuple(map(int, r)) for r in zip(*got)] == want


def test_colliding_hashes_change_nothing(monkeypatch):
    same = periodic_runs._Prefixes.same
    monkeypatch.setattr(periodic_runs._Prefixes, "same", lambda self, a, b, n: same(self, a, b, n) | (n % 5 == 0))
    rng = np.random.default_rng(2)
    for _ in range(60):
        words = rng.integers(0, 2, 60)
        words[20:50] = np.tile(words[20:23], 10)
        assert [tuple(map(int, r)) for r in zip(*periodic_runs.runs_of(words, np.array([0, 60])))] == plain_runs(words.tolist())


def test_collapsed_column(spark, odd):
    got = periodic_runs.collapsed(odd.withColumnRenamed("_text", "Collapsed"))
    assert got.count() == odd.count() and "collapsed0" in got.columns
    assert {r["collapsed0"] for r in got.where("text is null or text = 'one'").collect()} == {"", "one"}
