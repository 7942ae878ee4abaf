"""The prefix trie against dictionaries of prefixes, the merge against sorting, and odd rows."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from brindle.llm import prefix_trie, queries

SMALL = "/root/testdata/sf0.001"


def originals(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(t[2], t[3]) for t in sorted(own[c])] for c in own}


def plain_rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def plain_trie(conversations):
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(conversations):
        turns = tuple(conversations[c])
        ends[turns].append(c)
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(members[p]) - 1) * len(p[-1][1]) if p else 0
    return Counter(
        (members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p in members
    )


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
DDL = "conv_id bigint, turn bigint, role string, text string"


def made(seed):
    """Few texts and many conversations, so that prefixes meet; a group of like ones, a very long one, nulls, repeated rows."""
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(260):
        for t in range(int(rng.integers(1, 9))):
            if rng.random() < 0.9:
                rows.append((c, t if rng.random() < 0.97 else None, ["user", "assistant", None][rng.integers(0, 3)] if t > 3 else "user", [None, "", "été 漢", "b", "ab"][rng.integers(0, 5)] if t > 1 else "x"))
    rows += [(c, t, "user", "same") for c in range(400, 500) for t in range(7)]
    rows += [(600, t, "user", f"n{t % 50}") for t in range(150)] + [(601, t, "user", f"n{t % 50}") for t in range(149)]
    return rows + [(None, 1, "user", "nobody's"), (5, 1, "user", "x"), (5, 1, "user", "x")]


@pytest.mark.parametrize("which", ["small", "made", "ranges"])
def test_query_against_dictionaries(spark, which, monkeypatch):
    if which == "small":
        frame = spark.read.parquet(f"{SMALL}/conversations.parquet")
    else:
        frame = spark.createDataFrame([(*r, "k", 7) for r in made(3)], DDL + ", key string, runs int").repartition(5)
        monkeypatch.setattr(queries, "table", lambda *_: frame)
        if which == "ranges":
            monkeypatch.setattr(prefix_trie, "RANGE_BYTES", 6_000)
    got = queries.op13_prefix_trie(spark, SMALL)
    assert got.columns == COLUMNS
    want = plain_trie(plain_rebuilt(originals(map(tuple, frame.select("conv_id", "turn", "role", "text").collect()))))
    found = Counter(map(tuple, got.collect()))
    assert found == want, ([*(found - want)][:3], [*(want - found)][:3])


def test_empty_and_turnless(spark):
    none = spark.createDataFrame([], DDL)
    assert prefix_trie.prefix_trie(prefix_trie.sequences(none)).count() == 0
    bare = spark.createDataFrame([(3, None), (2, b"")], "conv_id bigint, turns binary")
    assert [tuple(r)[:7] for r in prefix_trie.prefix_trie(bare).collect()] == [(2, 0, None, 2, 0, 1, 0)]


def test_bad_bytes(spark):
    rows = spark.sql("select 1L conv_id, 0L turn, cast(X'FF' as string) role, cast(X'FFFE' as string) text union all select 2L, 0L, 'user', 'a'")
    assert prefix_trie.prefix_trie(prefix_trie.sequences(rows)).count() == 3


def test_merge_of_runs():
    rng = np.random.default_rng(5)
    for _ in range(200):
        items = list({b"".join(bytes([rng.integers(0, 3)]) * prefix_trie.CODE for _ in range(rng.integers(0, 6))) for _ in range(rng.integers(0, 40))})
        runs = [sorted(items[i::k]) for k in [int(rng.integers(1, 7))] for i in range(k)]
        runs = [[(prefix_trie.shared_turns(r[i - 1], x) if i else 0, x) for i, x in enumerate(r)] for r in runs]
        got = list(prefix_trie.merge(runs))
        assert [x for _, (_, x) in got] == sorted(items)
        assert [s for s, _ in got] == [prefix_trie.shared_turns(a, b) for a, b in zip([b"", *sorted(items)], sorted(items))]


def test_merge_compares_shared_turns_once(monkeypatch):
    """Runs that share a long beginning: turns compared grow with the items, not with the items times its length."""
    compared = [0]
    plain = prefix_trie.shared_turns

    def counted(a, b, known=0):
        found = plain(a, b, known)
        compared[0] += found - known + 1
        return found

    start = b"s" * prefix_trie.CODE * 200
    items = sorted(start + bytes([i // 16, i % 16]) * 10 for i in range(256))
    runs = [[(200 if i else 0, x) for i, x in enumerate(items[k::8])] for k in range(8)]
    monkeypatch.setattr(prefix_trie, "shared_turns", counted)
    assert [x for _, (_, x) in prefix_trie.merge(runs)] == items
    assert compared[0] < 8 * 200 + 256 * 8


def test_texts_of_nodes(spark):
    rows = spark.createDataFrame([(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, None, "x")], DDL)
    nodes = prefix_trie.node_texts(prefix_trie.prefix_trie(prefix_trie.sequences(rows)), rows)
    assert sorted((r["depth"], r["role"], r["text"], r["n_convs"]) for r in nodes.collect()) == [(0, None, None, 2), (1, "user", "hi", 2), (2, "", "x", 1)]
