"""Which of a stated set of patterns a text holds, by one automaton a block of patterns: a substring join without pairs of texts and patterns.

The automaton (Aho-Corasick) goes through each text once, however many patterns there are; only matches leave the row.
"""

from __future__ import annotations

from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Characters of the patterns of one automaton at most, about; more patterns are taken in blocks, each of which reads the texts again.
BLOCK_CHARS = 4_000_000


def _automaton(patterns: list[str]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for i, p in enumerate(patterns):
        automaton.add_word(p, (i, len(p)))
    automaton.make_automaton()
    return automaton


def _counts(automaton: ahocorasick.Automaton, text: str) -> dict[int, int]:
    """pattern -> how often it stands in the text, from the left and without overlaps."""
    counts: dict[int, int] = {}
    free: dict[int, int] = {}
    for end, (i, size) in automaton.iter(text):
        if end - size + 1 >= free.get(i, 0):
            counts[i], free[i] = counts.get(i, 0) + 1, end + 1
    return counts


def _blocks(patterns: list[str]) -> list[list[str]]:
    edges = np.cumsum([len(p) for p in patterns]) // BLOCK_CHARS
    return [[p for p, e in zip(patterns, edges) if e == b] for b in np.unique(edges)]


#: Matches that a task holds at once, about.
MATCHES = 1 << 18


def occurrences(rows: DataFrame, text: str, patterns: DataFrame) -> DataFrame:
    """The other columns of ``rows`` x (pattern, n): a row for each of ``patterns`` (pattern) that stands in the row's text, and how often. Empty and null patterns stand nowhere.

    The patterns are a stated set, which goes to every task block by block; texts don't move, nor are they repeated for each match.
    """
    wanted = sorted({r[0] for r in patterns.select("pattern").where("pattern <> ''").distinct().toLocalIterator()})
    kept = rows.drop(text)
    names = kept.columns
    plain = rows.select(*names, F.make_valid_utf8(F.col(text)).alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "pattern string", "n int"])
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def search(block: list[str]) -> DataFrame:
        def run(batches):
            automaton, known = _automaton(block), pa.array(block, pa.string())

            def table(batch, at: array, found: array, n: array) -> pa.RecordBatch:
                index = pa.array(np.array(at, np.int64))
                return pa.RecordBatch.from_arrays([*(batch.column(c).take(index) for c in range(len(names))), known.take(pa.array(np.array(found, np.int64))), pa.array(np.array(n, np.int32))], schema=arrow)

            for batch in batches:
                at, found, n = array("q"), array("q"), array("q")
                for i, t in enumerate(batch.column(len(names))):
                    for p, c in _counts(automaton, t.as_py() or "").items():
                        at.append(i)
                        found.append(p)
                        n.append(c)
                    if len(at) >= MATCHES:
                        yield table(batch, at, found, n)
                        at, found, n = array("q"), array("q"), array("q")
                yield table(batch, at, found, n)

        return plain.mapInArrow(run, schema)

    out = rows.sparkSession.createDataFrame([], schema)
    for block in _blocks(wanted):
        out = out.unionByName(search(block))
    return out
