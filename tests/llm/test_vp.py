"""Vantage-point trees: exact with factor 1, recall below, ties, repeated rows, vectors that take no part."""

import numpy as np
import pytest

from brindle.llm import queries, vp_trees

SMALL = "/root/testdata/sf0.001"


def usable(rows):
    return [(i, np.asarray(v, float)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]


def brute(rows, asked, k):
    """All (query, rank, id, cosine), ties to smaller ids, one own row left out."""
    rows = usable(rows)
    dim = max((len(v) for _, v in rows), default=0)
    m = np.zeros((len(rows), dim))
    for i, (_, v) in enumerate(rows):
        m[i, : len(v)] = v
    ids = np.array([i for i, _ in rows])
    norms = np.sqrt((m * m).sum(1))
    out = []
    for q in np.flatnonzero([asked(i) for i in ids]):
        score = (m * m[q]).sum(1) / (norms * norms[q])
        order = [i for i in np.lexsort((ids, -score)) if i != q][:k]
        out += [(int(ids[q]), r + 1, int(ids[i]), float(score[i])) for r, i in enumerate(order)]
    return sorted(out)


def scaled(v):
    """A vector times a power of two, so that squares of its components are neither 0 nor infinite."""
    return np.ldexp(v, -np.frexp(np.abs(v).max())[1])


def rows_of(frame):
    return [(r["vec_id"], r["embedding"]) for r in frame.collect()]


def found(frame):
    assert frame.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, frame.collect()))


def same(got, want):
    assert [g[:3] for g in got] == [w[:3] for w in want]
    np.testing.assert_allclose([g[3] for g in got], [w[3] for w in want], rtol=0, atol=1e-15)


@pytest.fixture
def small_trees(monkeypatch):
    for name, value in (("SAMPLE", 256), ("TREE_POINTS", 60), ("LEAF_POINTS", 8), ("BLOCK", 10)):
        monkeypatch.setattr(vp_trees, name, value)


def test_factor_one_is_exact(spark, small_trees):
    frame = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    same(found(vp_trees.search(vp_trees.build(frame), frame.where("vec_id % 50 = 0"), 5, 1.0)), brute(rows_of(frame), lambda i: i % 50 == 0, 5))


def test_recall_of_the_query(spark):
    big = "/root/testdata/sf0.1"
    got = found(queries.op12_vp_trees(spark, big))
    want = brute(rows_of(spark.read.parquet(f"{big}/embeddings.parquet")), lambda i: i % 50 == 0, 5)
    assert len(got) == len(want)
    assert len({g[:1] + g[2:3] for g in got} & {w[:1] + w[2:3] for w in want}) >= 0.93 * len(want)


def test_odd_vectors(spark, small_trees):
    """A third of the rows is one vector, some are its multiples by powers of two; nulls, zeros, short and repeated rows, clashing names."""
    rng = np.random.default_rng(1)
    base = [float(x) for x in np.round(rng.standard_normal(6), 2)]
    rows = [(i, base) for i in range(0, 300)] + [(i, [x * 2.0 ** (i % 5 - 2) for x in base]) for i in range(300, 340)]
    rows += [(i, [float(x) for x in rng.standard_normal(6)]) for i in range(340, 900)] + [(i, [float(x) for x in rng.standard_normal(4)]) for i in range(900, 905)]
    rows += [(350, rows[345][1]), (350, rows[345][1]), (400, base), (400, base)]
    rows += [(None, base), (1000, None), (1050, []), (1100, [0.0] * 6), (1150, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1200, [float("nan")] * 6), (1250, [float("inf")] + [0.0] * 5), (1300, [1e300] * 6), (1350, [1e-300] * 6)]
    frame = spark.createDataFrame([(*r, 0.5, 1) for r in rows], "vec_id bigint, embedding array<double>, score double, region int").repartition(4)
    asked = frame.where("vec_id % 50 = 0")
    want = brute([(i, scaled(v)) for i, v in usable(rows)], lambda i: i % 50 == 0, 5)
    same(found(vp_trees.search(vp_trees.build(frame), asked, 5, 1.0)), want)
    assert vp_trees.search(vp_trees.build(frame), asked, 5, queries.VP_FACTOR).count() == len(want)


def test_few_and_no_rows(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0])], "vec_id bigint, embedding array<float>")
    assert found(vp_trees.search(vp_trees.build(frame), frame, 5)) == [(0, 1, 1, 0.0), (1, 1, 0, 0.0)]
    assert vp_trees.search(vp_trees.build(frame.limit(0)), frame.limit(0), 5).count() == 0
    with pytest.raises(ValueError):
        vp_trees.search(vp_trees.build(frame, ids=3), frame, 5)
