"""Prefix trie of conversations: which beginnings are shared, by how many, and what sharing them saves.

A turn is a code of 20 bytes: 16 of the SHA-256 of its role and text, 4 for the code points of its text. A
conversation is the string of its codes, so texts don't move. The trie comes from an external
mergesort that knows common prefixes:

1. equal conversations become one item with their number and least id; the ids of each are hashed as
   a sorted stream, which never holds a group;
2. each batch of items becomes a sorted run; every item carries the number of turns that it shares
   with its predecessor (LCP); the runs are written;
3. the runs are dealt by ranges of items; each task merges its parts of the runs by a loser tree whose
   contests compare LCPs first and turns only from there on;
4. the merged stream pushes turns on a stack of open nodes; what it pops is finished.

Nodes on the first and the last path of a range may go on in its neighbours. Their parts (two paths a
range, however many items it has) are summed over all ranges and finished together.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from brindle.llm.texts import arrow_map, broadcast_if_small
from brindle.session import materialize

CODE = 20
#: Bytes of items that a merging task gets, about.
RANGE_BYTES = 16 << 20
#: Bytes of an item by which ranges are cut; items that agree so far share a range.
RANGE_KEY = 20 * 50_000
NO_ENDS = hashlib.sha256(b"").hexdigest()


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the codes of each conversation's turns by turn (null first; equal numbers by role, then by code), as one binary.

    Null role or text counts as empty; rows that repeat are turns that repeat; rows without conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("binary"), F.lit(b"")) for c in ("role", "text"))
    size = F.char_length(F.coalesce("text", F.lit("")))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string").cast("binary"), F.lit(b":"), role, text), 256))
    coded = conversations.where("conv_id is not null").select(
        "conv_id", "turn", role.alias("role"), F.concat(F.substring(digest, 1, CODE - 4), F.unhex(F.lpad(F.hex(size), 8, "0"))).alias("code")
    )
    return coded.groupBy("conv_id").agg(F.expr("listagg(code) within group (order by turn nulls first, role, code)").alias("turns"))


def _ends(keyed: DataFrame) -> DataFrame:
    """(key, ends): SHA-256 of the sorted, comma-joined conv_ids of each key; the ids stream through the hash."""
    schema = "key binary, ends string"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, state = None, None
        for batch in batches:
            keys, ends = [], []
            for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key == open_key:
                    state.update(b",%d" % conv)
                else:
                    if state is not None:
                        keys.append(open_key)
                        ends.append(state.hexdigest())
                    open_key, state = key, hashlib.sha256(b"%d" % conv)
            yield pa.record_batch([pa.array(keys, arrow[0].type), pa.array(ends, arrow[1].type)], schema=arrow)
        if state is not None:
            yield pa.record_batch([pa.array([open_key], arrow[0].type), pa.array([state.hexdigest()], arrow[1].type)], schema=arrow)

    return keyed.select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(run, schema)


def shared_turns(a: bytes, b: bytes, known: int = 0) -> int:
    """How many turns two items have in common, of which ``known`` are known."""
    at, most = known * CODE, min(len(a), len(b))
    while at < most and a[at : at + CODE] == b[at : at + CODE]:
        at += CODE
    return at // CODE


def _as_runs(items: DataFrame) -> DataFrame:
    """(run, place, lcp, turns, n, least, ends): each batch sorted; lcp: turns shared with the item before in the run."""

    def make():
        task, batches = TaskContext.get().partitionId(), [0]

        def step(batch: pa.RecordBatch) -> list:
            turns = batch.column(0).to_pylist()
            order = sorted(range(len(turns)), key=turns.__getitem__)
            turns = [turns[i] for i in order]
            run, batches[0] = (task << 32) + batches[0], batches[0] + 1
            lcp = [0, *(shared_turns(a, b) for a, b in zip(turns, turns[1:]))][: len(turns)]
            index = pa.array(order, pa.int64())
            return [[run] * len(turns), list(range(len(turns))), lcp, turns, *(batch.column(c).take(index) for c in (1, 2, 3))]

        return step

    return arrow_map(items.select("turns", "n", "least", "ends"), "run bigint, place bigint, lcp bigint, turns binary, n bigint, least bigint, ends string", make, rows=1 << 30)


def merge(runs: list[list[tuple]]) -> Iterator[tuple[int, tuple]]:
    """(turns shared with the item before, item) in order, from sorted runs of items (lcp, turns, ...).

    A loser tree: a node holds the run that lost there and the turns its item shares with the winner. Of two
    items the one that shares more with the last item put out comes first; only if they share the
    same number are turns compared, from there on.
    """
    k = len(runs)
    if not k:
        return
    at = [0] * k
    loser, shares = [-1] * k, [-1] * k  # node 0: the winner of all

    def head(run: int) -> bytes | None:
        return runs[run][at[run]][1] if at[run] < len(runs[run]) else None

    def contest(a: int, a_shares: int, b: int, b_shares: int) -> tuple[int, int, int, int]:
        """Winner and what it shares with the last item, loser and what it shares with the winner."""
        if a_shares != b_shares:
            return (a, a_shares, b, b_shares) if a_shares > b_shares else (b, b_shares, a, a_shares)
        x, y = head(a), head(b)
        if x is None or y is None:
            return (a, a_shares, b, -1) if y is None else (b, b_shares, a, -1)
        common = shared_turns(x, y, a_shares)
        edge = common * CODE
        first = (x[edge : edge + CODE], a) < (y[edge : edge + CODE], b)
        return (a, a_shares, b, common) if first else (b, b_shares, a, common)

    def play(node: int) -> tuple[int, int]:
        if node >= k:
            run = node - k
            return run, 0 if head(run) is not None else -1
        w, ws, loser[node], shares[node] = contest(*play(2 * node), *play(2 * node + 1))
        return w, ws

    winner, share = play(1) if k > 1 else (0, 0 if runs[0] else -1)
    while share >= 0:
        yield share, runs[winner][at[winner]]
        at[winner] += 1
        share = runs[winner][at[winner]][0] if at[winner] < len(runs[winner]) else -1
        node = (winner + k) >> 1
        while node:
            winner, share, loser[node], shares[node] = contest(winner, share, loser[node], shares[node])
            node >>= 1


class _Node:
    """An open node: sums over the finished nodes below it and the items that end at it."""

    __slots__ = ("code", "convs", "least", "children", "leaves", "saved", "ends", "waiting", "first")

    def __init__(self, code: bytes, first: bool):
        self.code, self.first, self.ends = code, first, None
        self.convs = self.children = self.leaves = self.saved = 0
        self.least, self.waiting = None, []

    def size(self) -> int:
        return int.from_bytes(self.code[CODE - 4 :], "big")

    def add(self, convs: int, least: int) -> None:
        self.convs += convs
        self.least = least if self.least is None else min(self.least, least)


_CLOSED, _BELOW_OPEN, _OPEN = 0, 1, 2
_NODES = (
    "kind int, key binary, parent_key binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, size bigint, ends_sha256 string, turn binary"
)


def _nodes(merged: Iterator[tuple[int, tuple]]) -> Iterator[tuple]:
    """Rows of _NODES from items in order: nodes that are finished, and the parts of those on the first and last path."""
    stack = [_Node(b"", True)]
    keys: list = [hashlib.sha256()]  # of the paths of open nodes that may lie in neighbours too
    began = False

    def key(depth: int) -> bytes:
        while len(keys) <= depth:
            state = keys[-1].copy()
            state.update(stack[len(keys)].code)
            keys.append(state)
        return keys[depth].digest()[:16]

    def pop(last: bool) -> Iterator[tuple]:
        node, depth = stack[-1], len(stack) - 1
        if node.first or last:
            own = key(depth)
            for row in node.waiting:
                yield (_BELOW_OPEN, None, own, *row[:2], None, *row[2:])
            yield (_OPEN, own, key(depth - 1) if depth else None, node.least, depth, None, node.convs, node.children, node.leaves, node.saved, node.size(), node.ends, node.code[: CODE - 4])
            stack.pop()
            del keys[len(stack) :]
            return
        for row in node.waiting:
            yield (_CLOSED, None, None, *row[:2], node.least, *row[2:])
        stack.pop()
        del keys[len(stack) :]
        above = stack[-1]
        leaves, saved = node.leaves or 1, node.saved + (node.convs - 1) * node.size()
        above.add(node.convs, node.least)
        above.children += 1
        above.leaves += leaves
        above.saved += saved
        above.waiting.append((node.least, depth, node.convs, node.children, leaves, saved, node.size(), node.ends, node.code[: CODE - 4]))

    for lcp, (_, turns, n, least, ends) in merged:
        while len(stack) - 1 > lcp:
            yield from pop(False)
        for at in range(lcp * CODE, len(turns), CODE):
            stack.append(_Node(turns[at : at + CODE], not began))
        stack[-1].add(n, least)
        stack[-1].ends = ends
        began = True
    while began and stack:
        yield from pop(True)


def _batches(rows: Iterator[tuple], arrow: pa.Schema, most: int = 8192) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)

    for row in rows:
        held.append(row)
        if len(held) == most:
            yield batch()
            held = []
    if held:
        yield batch()


def _merge_ranges(batches: Iterator[pa.RecordBatch], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One range: its items by run and place."""
    runs: list[list[tuple]] = []
    open_run = None
    for batch in batches:
        for run, lcp, *item in zip(*(batch.column(c).to_pylist() for c in ("run", "lcp", "turns", "n", "least", "ends"))):
            if run != open_run:
                runs.append([])
                open_run, lcp = run, 0
            runs[-1].append((lcp, *item))
    yield from _batches(_nodes(merge(runs)), arrow)


def _finish_open(batches: Iterator[pa.RecordBatch], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The nodes on first and last paths, summed over ranges before, deepest first: adds what lies below each."""
    nodes = {r["key"]: r for b in batches for r in b.to_pylist()}
    for r in sorted(nodes.values(), key=lambda r: -r["depth"]):
        r["n_leaves"] = r["n_leaves"] or 1
        r["saved_tokens"] += (r["n_convs"] - 1) * r["size"]
        if r["parent_key"] is not None:
            above = nodes[r["parent_key"]]
            above["conv_id"] = r["conv_id"] if above["conv_id"] is None else min(above["conv_id"], r["conv_id"])
            above["n_children"] += 1
            for c in ("n_convs", "n_leaves", "saved_tokens"):
                above[c] += r[c]
    for r in nodes.values():
        r["parent_conv_id"] = nodes[r["parent_key"]]["conv_id"] if r["parent_key"] is not None else None
    yield from _batches((tuple(r[n] for n in arrow.names) for r in nodes.values()), arrow)


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, turn) per node of the trie of
    ``sequences`` (conv_id, distinct and not null; turns, see ``sequences``; null: none).

    conv_id is the smallest member, and names with depth the node: its last turn is that conversation's turn number ``depth``, of
    digest ``turn`` (the root's is empty). Without conversations there is no node.
    """
    arrow = to_arrow_schema(StructType.fromDDL(_NODES))
    turns = F.coalesce("turns", F.lit(b""))
    keyed = materialize(sequences.select("conv_id", turns.alias("turns"), F.substring(F.unhex(F.sha2(turns, 256)), 1, 16).alias("key")), "sequences")
    items = keyed.groupBy("key").agg(F.first("turns").alias("turns"), F.count("*").alias("n"), F.min("conv_id").cast("bigint").alias("least"))
    runs = materialize(_as_runs(items.join(_ends(keyed), "key")), "runs")
    size = runs.agg(F.sum(F.octet_length("turns") + 100)).first()[0] or 0
    ranges = runs.repartitionByRange(max(1, math.ceil(size / RANGE_BYTES)), F.substring("turns", 1, RANGE_KEY)).sortWithinPartitions("run", "place")
    nodes = materialize(ranges.mapInArrow(lambda batches: _merge_ranges(batches, arrow), _NODES), "nodes")
    part = nodes.where(f"kind = {_OPEN}").groupBy("key", "parent_key", "depth", "size", "turn")
    summed = part.agg(F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.max("ends_sha256").alias("ends_sha256"))
    summed = summed.select(*(f.name if f.name in summed.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in nodes.schema))
    open_ = materialize(summed.coalesce(1).mapInArrow(lambda batches: _finish_open(batches, arrow), _NODES), "open")
    above = broadcast_if_small(open_.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id")))
    below = nodes.where(f"kind = {_BELOW_OPEN}").drop("parent_conv_id").join(above, "parent_key")
    found = nodes.where(f"kind = {_CLOSED}").unionByName(below).unionByName(open_)
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"), "turn")


def node_texts(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """``nodes`` with role and text of each one's last turn (null for the root), for a trie of ``sequences(conversations)`` itself."""
    role, text = (F.coalesce(F.col(c).cast("binary"), F.lit(b"")) for c in ("role", "text"))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string").cast("binary"), F.lit(b":"), role, text), 256)), 1, CODE - 4)
    turns = conversations.select(digest.alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["turn"])
    return nodes.join(turns, "turn", "left")
