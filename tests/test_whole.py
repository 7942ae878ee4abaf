"""Queries reach every row of their tables, against plain versions of them."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from brindle.operators import graph
from brindle.plans import catalog

SMALL = "/root/testdata/sf0.001"
PLACES = 6


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def plain_bm25(docs, query):
    """{id: score} over all of ``docs``."""
    counts = {i: Counter(tokens(t)) for i, t in docs.items()}
    lengths = {i: sum(c.values()) for i, c in counts.items()}
    mean = sum(lengths.values()) / len(docs)
    out = {}
    for term in set(tokens(query)):
        df = sum(term in c for c in counts.values())
        for i, c in counts.items():
            if term in c:
                idf = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
                out[i] = out.get(i, 0.0) + idf * c[term] * 2.2 / (c[term] + 1.2 * (0.25 + 0.75 * lengths[i] / mean))
    return {i: round(min(s / 10, 1.0), PLACES) for i, s in out.items()}


@pytest.fixture
def folder(spark, tmp_path):
    """A data folder of six documents, of which three have a vector, and two items, of which one has."""
    docs = [(0, "red apple pie"), (1, "green apple"), (2, "blue sky over red hills"), (3, "rare zebra"), (4, "zebra zebra apple"), (5, "nothing here")]
    tables = {
        "documents": (docs, "doc_id bigint, text string"),
        "benchmark": ([(0, "zebra apple"), (5, "red zebra")], "item_id bigint, text string"),
        "embeddings": ([(i, v, 0) for i, v in ((0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0]))], "vec_id bigint, embedding array<float>, label int"),
    }
    for name, (rows, kind) in tables.items():
        spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["hybrid_weighted_rrf", "hybrid_three_lists", "hybrid_linear", "hybrid_bm25", "merged_results", "diversified_rerank", "cross_encoder_rerank"])
def test_words_find_documents_without_vectors(spark, folder, name):
    found = {(r["query_id"], r["id"]) for r in catalog.QUERIES[name](spark, folder).collect()}
    assert {(0, 3), (0, 4), (5, 0), (5, 2), (5, 3), (5, 4)} <= found


def test_prompts_hold_documents_without_vectors(spark, folder):
    prompts = {r["query_id"]: r["prompt"] for r in catalog.QUERIES["answer_prompts"](spark, folder).collect()}
    assert all("rare zebra" in prompts[q] for q in (0, 5))


def test_statistics_cover_all_documents(spark, folder):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {r["id"]: r["score"] for r in catalog.QUERIES["hybrid_bm25"](spark, folder).where("query_id = 5").collect()}
    assert got == pytest.approx({i: 0.3 * s for i, s in plain_bm25(docs, "red zebra").items()}, abs=2e-9)


# --- graph -------------------------------------------------------------------------------------


def neighbours(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return near


def some_edges(seed, n, m):
    rng = random.Random(seed)
    return sorted({(min(p), max(p)) for p in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if p[0] != p[1]})


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "a bigint, b bigint")


def hops(near, s):
    far, queue = {s: 0}, [s]
    for u in queue:
        for v in near[u]:
            if v not in far:
                far[v] = far[u] + 1
                queue.append(v)
    return far


def plain_betweenness(near):
    far = {s: hops(near, s) for s in near}
    count = {}
    for s in near:
        count[s] = {s: 1}
        for v in sorted(far[s], key=far[s].get):
            if v != s:
                count[s][v] = sum(count[s][u] for u in near[v] if far[s][u] == far[s][v] - 1)
    n, out = len(near), {}
    for v in near:
        part = sum(count[s][v] * count[v][t] / count[s][t] for s in near if s != v and v in far[s] for t in far[s] if t not in (s, v) and far[s][v] + far[v][t] == far[s][t])
        out[v] = part / ((n - 1) * (n - 2))
    return out


def plain_near_components(near, t=0.5):
    root = {u: u for u in near}

    def find(u):
        while root[u] != u:
            u = root[u]
        return u

    for a in near:
        for b in near:
            if a < b and len(near[a] & near[b]) >= t * math.sqrt(len(near[a]) * len(near[b])) - 1e-9:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    sizes = Counter(map(find, near))
    return {u: find(u) for u in near if sizes[find(u)] > 1}


@pytest.mark.parametrize("name", ["betweenness", "louvain", "density_communities"])
def test_graph_queries_reach_customers_and_suppliers(spark, name):
    got = {r["id"][0] for r in catalog.QUERIES[name](spark, SMALL).select("id").collect()}
    assert {"c", "s"} <= got


def test_betweenness_brute_force(spark):
    pairs = some_edges(1, 30, 45)
    got = {r["id"]: r["betweenness"] for r in graph.betweenness(frame(spark, pairs)).collect()}
    assert got == pytest.approx(plain_betweenness(neighbours(pairs)), abs=1e-6)


@pytest.mark.parametrize("pairs", [some_edges(2, 40, 60), some_edges(3, 25, 120), [(0, i) for i in range(1, 30)] + [(i, i + 100) for i in range(1, 15)], [(i, 50 + j) for i in range(6) for j in range(7)]])
def test_near_components_brute_force(spark, pairs):
    got = {r["id"]: r["community"] for r in graph.near_components(frame(spark, pairs)).collect()}
    assert got == plain_near_components(neighbours(pairs))


def plain_closeness(near, n):
    out = {}
    for s in near:
        far = hops(near, s)
        total, reached = sum(far.values()), len(far) - 1
        out[s] = reached / total * reached / (n - 1) if total else 0.0
    return out


def test_closeness_of_every_user(spark):
    events = {r["event_id"]: r["user_id"] for r in spark.read.parquet(f"{SMALL}/events.parquet").collect()}
    near = neighbours((u, events[e + 1]) for e, u in events.items() if e + 1 in events and events[e + 1] != u)
    got = {r["id"]: r["closeness"] for r in catalog.QUERIES["closeness"](spark, SMALL).collect()}
    assert got == pytest.approx(plain_closeness(near, len(near)), abs=1e-6)


def test_closeness_of_a_long_path(spark, monkeypatch):
    """Longer than any fixed number of steps, in blocks, with parts that don't reach each other."""
    monkeypatch.setattr(graph, "CLOSENESS_BLOCK", 30)
    pairs = [(i, i + 1) for i in range(36)] + [(100, 101)]
    near = neighbours(pairs)
    nodes = spark.createDataFrame([(i,) for i in [*near, 500]], "id bigint")
    got = {r["id"]: r["closeness"] for r in graph.closeness(nodes, frame(spark, pairs), nodes).collect()}
    assert got == pytest.approx({**plain_closeness(near, len(near) + 1), 500: 0.0}, abs=1e-6)


def plain_labels(near):
    now, states = {u: u for u in near}, []
    while now not in states:
        states.append(now)
        votes = {u: Counter(now[v] for v in near[u]) for u in near}
        now = {u: min(votes[u], key=lambda x: (-votes[u][x], x)) for u in near}  # noqa: B023
    return {u: min(s[u] for s in states[states.index(now) :]) for u in near}


def test_labels_until_stable(spark):
    """A path, whose least label takes many rounds, beside a square and a star, whose labels swap sides."""
    pairs = [(i, i + 1) for i in range(0, 9)] + [(0, 2), (20, 21), (21, 22), (22, 23), (20, 23), (30, 31), (30, 32)]
    got = {r["id"]: r["label"] for r in graph.label_propagation(frame(spark, pairs)).collect()}
    assert got == plain_labels(neighbours(pairs)) and len({got[i] for i in (30, 31, 32)}) == 1


def test_pagerank_until_stable(spark):
    pairs = [(0, i) for i in range(1, 6)] + [(5, 6)]
    near = neighbours(pairs)
    n, want = len(near), dict.fromkeys(near, 1 / len(near))
    for _ in range(300):
        want = {u: 0.5 / n + 0.5 * sum(want[v] / len(near[v]) for v in near[u]) for u in near}
    nodes = spark.createDataFrame([(i,) for i in near], "id bigint")
    got = {r["id"]: r["pagerank"] for r in graph.pagerank(nodes, frame(spark, pairs), damping=0.5, tolerance=1e-4).collect()}
    assert got == pytest.approx(want, abs=1e-4)


@pytest.mark.parametrize(("name", "operator"), [("label_propagation", "label_propagation"), ("pagerank", "pagerank")])
def test_queries_set_no_number_of_rounds(spark, monkeypatch, name, operator):
    given, run = [], getattr(graph, operator)
    monkeypatch.setattr(graph, operator, lambda *a, **k: given.append((a, k)) or run(*a, 1))
    catalog.QUERIES[name](spark, SMALL)
    assert [k for a, k in given if not any(isinstance(x, int) for x in a)] == [{}]


def test_index_finds_nine_of_ten(spark):
    found = [r["recall"] for r in catalog.QUERIES["vector_ivf"](spark, "/root/testdata/sf0.01").collect()]
    assert found and sum(found) / len(found) >= 0.9, sorted(found)


def modularity(pairs, part):
    total, degree, held, inside = 2 * len(pairs), {}, {}, 0
    for a, b in pairs:
        degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
        inside += 2 * (part[a] == part[b])
    for u, k in degree.items():
        held[part[u]] = held.get(part[u], 0) + k
    return inside / total - sum(k * k for k in held.values()) / total**2


def one_by_one(pairs, seed=42):
    """Greedy modularity as it is usually done: nodes move one after the other, then communities become nodes."""
    level = {u: dict.fromkeys(vs, 1.0) for u, vs in neighbours(pairs).items()}
    group, rng = {u: u for u in level}, np.random.default_rng(seed)
    while True:
        strength, own, moved = {u: sum(v.values()) for u, v in level.items()}, {u: u for u in level}, False
        total, held, nodes = sum(strength.values()), dict(strength), sorted(level)
        while True:
            again = False
            for u in (nodes[i] for i in rng.permutation(len(nodes))):
                links = {}
                for v, w in level[u].items():
                    if v != u:
                        links[own[v]] = links.get(own[v], 0.0) + w
                held[own[u]] -= strength[u]
                gain = lambda c: links.get(c, 0.0) - strength[u] * held[c] / total  # noqa: B023, E731
                best = max(links, key=lambda c: (gain(c), -c), default=own[u])
                if gain(best) > gain(own[u]) + 1e-12:
                    own[u], again, moved = best, True, True
                held[own[u]] += strength[u]
            if not again:
                break
        if not moved:
            return group
        group, folded = {x: own[g] for x, g in group.items()}, {}
        for u, row in level.items():
            for v, w in row.items():
                into = folded.setdefault(own[u], {})
                into[own[v]] = into.get(own[v], 0.0) + w
        level = folded


def planted(seed, n, groups, within, between):
    rng = np.random.default_rng(seed)
    return [(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < (within if i % groups == j % groups else between)]


@pytest.mark.parametrize("pairs", [planted(3, 60, 4, 0.5, 0.04), planted(7, 60, 3, 0.15, 0.08), [(0, i) for i in range(1, 12)] + [(0, 100), (100, 101), (100, 102), (101, 102)]])
def test_louvain_near_sequential_modularity(spark, pairs):
    got = {r["id"]: r["community"] for r in graph.louvain(frame(spark, pairs)).collect()}
    assert got.keys() == neighbours(pairs).keys() and all(min(x for x in got if got[x] == c) == c for c in set(got.values()))
    assert modularity(pairs, got) >= 0.98 * modularity(pairs, one_by_one(pairs)) - 1e-9


def test_louvain_keeps_edges_in_spark(spark, monkeypatch):
    from pyspark.sql import DataFrame

    collect = DataFrame.collect

    def one_row(self):
        found = collect(self)
        assert len(found) <= 1
        return found

    monkeypatch.setattr(DataFrame, "collect", one_row)
    monkeypatch.setattr(DataFrame, "toPandas", lambda self: pytest.fail("collected"))
    monkeypatch.setattr(graph, "LOUVAIN_ROUNDS", 2)
    assert graph.louvain(frame(spark, [(1, 2), (3, 4)]), 1).columns == ["id", "community"]
    assert graph.louvain(frame(spark, [(1, 2)]).limit(0)).isEmpty()
