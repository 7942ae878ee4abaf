"""URL filters by a sort-merge range join.

A host is written with its labels reversed and a closing dot (``com.example.www.``), so that a
host with all its subdomains is one interval of sorted keys; a path with all that it begins is one
of sorted paths. A rule is an interval of hosts and, below each of them, one of paths; intervals of
either kind are nested or disjoint. The rules are sorted once a task and swept with a stack of open
intervals: each is left with the one that encloses it, for hosts and, within a host's rules, for
paths. Rows are sorted by key and merged with them: from the last interval that begins at or before
a row's key, the stack of open ones is followed outwards. Among the rules that fit the longest wins
(host and path together; of equals the one with the longer host).

Up to ``BROADCAST_RULES`` rules go to every task and each Arrow batch is one sorted run, which
needs no shuffle. Beyond, urls are cut into key ranges at sampled bounds, each rule goes to the
ranges that it touches, and each range is swept on its own; popular hosts are cut by path.

Edge cases: a null url, or one without ``://``, has empty host and path and fits no rule; rules
with a null host, path or verdict, or an empty host, are ignored; of rules that repeat a host (in
any case) and a path the least verdict counts (``allow`` before ``block``); without a fitting rule
the verdict is ``DEFAULT_VERDICT``; other columns of either table are not read.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.texts import arrow_map

DEFAULT_VERDICT = "allow"
BROADCAST_RULES = 100_000
SAMPLED_KEYS = 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(_UPPER, _LOWER)
_PARTS = "://([^/?#]*)([^?#]*)"


def url_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """``df`` with ``host`` (A-Z lower-cased) and ``path``."""
    part = lambda i: F.coalesce(F.regexp_extract(url, _PARTS, i), F.lit(""))
    return df.withColumns({"host": F.translate(part(1), _UPPER, _LOWER), "path": part(2)})


def host_key(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "." if host else ""


def nested(keys: list[str]) -> list[int]:
    """For sorted keys, each the interval of all that it begins: the place of the one that encloses it, or -1."""
    around, stack = [], []
    for i, key in enumerate(keys):
        while stack and not key.startswith(keys[stack[-1]]):
            stack.pop()
        around.append(stack[-1] if stack else -1)
        stack.append(i)
    return around


class Rules:
    """Rules (host, path, verdict) sorted and nested, for any number of sweeps."""

    def __init__(self, rules):
        by_host: dict[str, dict[str, str]] = {}
        for host, path, verdict in rules:
            if host and path is not None and verdict is not None:
                of = by_host.setdefault(host.translate(_FOLD), {})
                of[path] = min(verdict, of.get(path, verdict))
        self.hosts = sorted(by_host, key=host_key)
        self.keys = [host_key(h) for h in self.hosts]
        self.around = nested(self.keys)
        self.verdicts = [by_host[h] for h in self.hosts]
        self.paths = [sorted(v) for v in self.verdicts]
        self.paths_around = [nested(x) for x in self.paths]

    def _path(self, at: int, path: str) -> str | None:
        """The longest path of a host's rules that begins ``path``."""
        paths, around = self.paths[at], self.paths_around[at]
        i = bisect.bisect_right(paths, path) - 1
        while i >= 0 and not path.startswith(paths[i]):
            i = around[i]
        return paths[i] if i >= 0 else None

    def _winner(self, open_hosts: list[int], path: str) -> tuple[str, str] | None:
        best, found = (-1, -1), None
        for at in open_hosts:
            rule = self._path(at, path)
            if rule is not None and (size := (len(self.hosts[at]) + len(rule), len(self.hosts[at]))) > best:
                best, found = size, (self.hosts[at] + rule, self.verdicts[at][rule])
        return found

    def sweep(self, hosts: list[str], paths: list[str]) -> list[tuple[str, str] | None]:
        """Per url the winning (rule, verdict)."""
        keys = [host_key(h) for h in hosts]
        out: list[tuple[str, str] | None] = [None] * len(keys)
        at, before, open_hosts = 0, None, []
        for i in sorted(range(len(keys)), key=keys.__getitem__):
            key = keys[i]
            if key != before:
                at = bisect.bisect_right(self.keys, key, at)
                open_hosts, one = [], at - 1
                while one >= 0:
                    if key.startswith(self.keys[one]):
                        open_hosts.append(one)
                    one = self.around[one]
                before = key
            if open_hosts:
                out[i] = self._winner(open_hosts, paths[i])
        return out


def judge(urls: DataFrame, rules: DataFrame, id_column: str = "page_id", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """(id, host, path, rule, verdict) for each row of ``urls``; ``rules``: host, path, verdict."""
    rows = url_parts(urls.select(id_column, "url")).select(id_column, "host", "path")
    kind = rows.schema[id_column].dataType.simpleString()
    schema = f"{id_column} {kind}, host string, path string, rule string, verdict string"
    few = rules.select("host", "path", "verdict").limit(broadcast_rules + 1).collect()
    if len(few) > broadcast_rules:
        return _judge_ranges(rows, rules, id_column, schema)
    known = [tuple(r) for r in few]

    def make():
        prepared = Rules(known)

        def step(batch: pa.RecordBatch) -> list:
            found = prepared.sweep(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            return [*batch.columns, [x and x[0] for x in found], [x[1] if x else DEFAULT_VERDICT for x in found]]

        return step

    return arrow_map(rows, schema, make)


def _judge_ranges(rows: DataFrame, rules: DataFrame, id_column: str, schema: str) -> DataFrame:
    """The join for rule tables of any size: one sweep for each range of keys.

    Bounds are quantiles of at most SAMPLED_KEYS sampled keys (host key, path, then a hash of the
    id), so a host or a url with many rows spans several ranges. A rule is sent to the ranges between its first and last
    possible key; only rules as broad as a whole range go to several.
    """
    spark = rows.sparkSession
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = max(1, rows.count())
    rows = rows.withColumn("_id", F.hex(F.xxhash64(id_column)))
    taken = rows.sample(fraction=min(1.0, SAMPLED_KEYS / total), seed=7).select("host", "path", "_id").limit(SAMPLED_KEYS).collect()
    keys = sorted("\0".join((host_key(r[0]), *r[1:])) for r in taken)
    bounds = sorted({keys[len(keys) * i // n] for i in range(1, n)}) if keys else []

    @F.pandas_udf("int")
    def range_of(host: pd.Series, path: pd.Series, row: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(bounds, "\0".join((host_key(h), p, i))) for h, p, i in zip(host, path, row)], dtype=np.int32)

    @F.pandas_udf("array<int>")
    def ranges_of(host: pd.Series) -> pd.Series:
        spans = [(host_key(h), host_key(h)[:-1] + "/") for h in host]
        return pd.Series([list(range(bisect.bisect_right(bounds, a), bisect.bisect_right(bounds, b) + 1)) for a, b in spans])

    sent = rules.where("host <> '' and path is not null and verdict is not null").groupBy(F.translate("host", _UPPER, _LOWER).alias("host"), "path").agg(F.min("verdict").alias("verdict"))
    sent = sent.withColumn("_range", F.explode(ranges_of("host")))
    dealt = rows.withColumn("_range", range_of("host", "path", "_id"))

    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = Rules(right[["host", "path", "verdict"]].itertuples(index=False)).sweep(left["host"].tolist(), left["path"].tolist())
        return left[[id_column, "host", "path"]].assign(rule=[x and x[0] for x in found], verdict=[x[1] if x else DEFAULT_VERDICT for x in found])

    return dealt.groupBy("_range").cogroup(sent.groupBy("_range")).applyInPandas(one, schema)
