"""Compare registered queries with their SQL in DuckDB: names, row counts and values, order apart."""

from __future__ import annotations

import math
import sys
from collections import Counter
from datetime import date, datetime
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None or isinstance(x, (str, bool)):
        return x
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if hasattr(x, "asDict"):
        return plain(x.asDict())
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if isinstance(x, (date, datetime)):
        return str(x)
    if hasattr(x, "__float__"):
        f = float(x)
        return "nan" if math.isnan(f) else float(f"{f:.6g}") if abs(f) < 1e15 else f
    return x


def difference(spark, name: str, sf_dir: str, queries=None, oracles=None) -> str:
    import duckdb

    import __spark_entry__ as entry

    df = (queries or entry.queries())[name](spark, sf_dir)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rel = con.sql((oracles or entry.oracle_sql())[name])
    names = sorted(df.columns)
    if names != sorted(rel.columns):
        return f"columns {names} and {sorted(rel.columns)}"
    order = [rel.columns.index(c) for c in names]
    got = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    want = Counter(tuple(plain(r[i]) for i in order) for r in rel.fetchall())
    if got != want:
        return f"{sum(got.values())} and {sum(want.values())} rows; only here {list((got - want).items())[:3]}, only there {list((want - got).items())[:3]}"
    return ""


if __name__ == "__main__":
    import time

    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    s = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("OFF")
    from brindle.plans import catalog as registry

    wanted = [n for n in registry.QUERIES if len(sys.argv) < 2 or any(a in n for a in sys.argv[1:])]
    for n in wanted:
        t = time.time()
        try:
            if n in registry.ORACLES:
                said = difference(s, n, "/root/testdata/sf0.01")
            else:
                said = f"(no SQL) {registry.QUERIES[n](s, '/root/testdata/sf0.01').count()} rows"
        except Exception as e:
            said = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{'ok ' if not said else '-- '} {n} {time.time() - t:.1f}s {said[:900]}", flush=True)
