"""JSON of any depth against recursion."""

import json

import numpy as np
from pyspark.sql import functions as F

from brindle.functions import scalars as S
from brindle.operators import chunking


def made(rng, depth):
    kinds = ["s", "i", "b", "n", "l"] + ["o"] * (3 if depth else 0)
    out = {}
    for k in rng.choice(list("abcdef"), rng.integers(0, 4), replace=False):
        kind = rng.choice(kinds)
        out[str(k)] = {"s": "{t}\" \\ x", "i": int(rng.integers(100)), "b": True, "n": None, "l": [1, {"x": 2}], "o": None}[kind] if kind != "o" else made(rng, depth - 1)
    return out


def flat(d, before=""):
    out = {}
    for k, v in d.items():
        if isinstance(v, dict):
            out |= flat(v, f"{before}{k}.")
        else:
            out[before + k] = v if v is None or isinstance(v, str) else json.dumps(v, separators=(",", ":"))
    return out


def both(a, b):
    return a | {k: both(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}


def deep(n):
    return {"k": deep(n - 1), "s": n} if n else {"end": "{"}


def test_against_recursion(spark):
    rng = np.random.default_rng(1)
    cases = [(made(rng, 5), made(rng, 5)) for _ in range(60)] + [(deep(12), deep(9)), ({}, {}), ({"a": {}}, {"a": 1}), ({"a": 1}, {"a": {}})]
    rows = spark.createDataFrame([(i, json.dumps(a), json.dumps(b)) for i, (a, b) in enumerate(cases)], "id int, a string, b string")
    assert S.deepest(rows, "a", "b") == 13
    n = S.deepest(rows, "a", "b")
    got = rows.select("id", S.flatten_json("a", n).alias("f"), S.merge_json("a", "b", n).alias("m")).collect()
    for r in got:
        a, b = cases[r["id"]]
        assert r["f"] == flat(a), (a, r["f"])
        assert json.loads(r["m"]) == both(a, b), (a, b, r["m"])


def test_odd_texts(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "[1]"), (4, "{"), (5, '{"a": {"b": 1}, "a.b": 2}')], "id int, j string")
    got = {r["id"]: (r["f"], r["m"], r["n"]) for r in rows.select("id", S.flatten_json("j", 3).alias("f"), S.merge_json("j", F.lit('{"z": 1}'), 3).alias("m"), S.nesting("j").alias("n")).collect()}
    assert got[1] == (None, '{"z":1}', 0) and got[3][0] is None and got[4][1] == '{"z":1}' and got[5][0] == {"a.b": "2"} and got[5][2] == 2


def test_chunks_of_deep_objects(spark):
    docs = spark.createDataFrame([(1, json.dumps(deep(8))), (2, "[1, {\"a\": 2}]"), (3, "no json")], "document_id int, content string")
    got = chunking.json_chunks(docs).collect()
    assert {r["path"]: r["content"] for r in got if r["document_id"] == 1} == flat(deep(8))
    assert [r["content"] for r in got if r["document_id"] == 2] == ["1", '{"a":2}'] and [r["parsed"] for r in got if r["document_id"] == 3] == [False]
