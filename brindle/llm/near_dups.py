"""MinHash near-dedup with tensored banding, exact verification and connected components.

A document's set holds its distinct runs of ``width`` words (A-Z lower-cased). Two collections of
``SIDE`` keys of ``DEPTH`` minhashes each give ``SIDE**2`` tables: table (i, j) is keyed by key i of
the first and key j of the second collection, so 2 x SIDE x DEPTH minhashes do the work of SIDE**2 x
2 x DEPTH. Two sets of similarity s meet in a table with probability
``(1 - (1 - s**DEPTH)**SIDE)**2``: 0.99998 at s = 0.8 with the values below, next to nothing for
unrelated texts.

1. Rows of equal sets are one class, known by a number of its own; only classes are searched.
2. Rows (class, first key i, all second keys) are sorted by first key and class across partitions;
   a popular key spans several of them. Each partition splits its runs of a first key by second
   keys into buckets and links each bucket's classes with the member nearest to the bucket's
   consensus (small buckets: with each other). Buckets that partitions share are linked through
   their centres. So links are in proportion to rows, not to pairs.
3. Links are verified on the full sets; verified links make components.
4. Where a large bucket still holds several components, its members are joined across them by an
   exact prefix filter: with shingles that only one component has first and the others from rare to
   common, two sets of enough similarity share one of the first few (see ``_across_components``).
   Only such pairs are verified, on the full sets.

Components are found by alternating large-star and small-star steps; every step is written to the
shared folder. Joins on ids that have very many rows are spread by a salt. Nothing but counts
reaches the driver.

Edge cases: rows without words (null, empty, blank) have the empty set and are linked with nothing;
fewer words than ``width`` make one shingle; rows that repeat a doc_id each get a row, with the
component of their own set; rows with a null doc_id are searched like others, but a null never names
a component that has another id (one of nulls only has a null name); an empty table gives no rows;
other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from brindle.llm.texts import BROADCAST_IDS, WordHashes, arrow_map, broadcast_if_small, mixed, once, row_key, shingle_hashes, without
from brindle.session import materialize, release

SIDE = 16
DEPTH = 3
PERCENT = 80
#: Buckets up to this size link all their members directly.
SMALL_BUCKET = 4
#: Rows of shingles that several components share, broadcast at most.
SHARED_ROWS = 200_000
#: Rows of one key from which on a join spreads them, at least.
HOT_ROWS = 2_000
_PARAMETERS = np.random.default_rng(11).integers(0, 1 << 32, (2, 2 * SIDE * DEPTH, 1), dtype=np.uint32)
_MULTIPLY, _ADD = _PARAMETERS[0] | np.uint32(1), _PARAMETERS[1]


def minhash_keys(found: np.ndarray) -> np.ndarray:
    """2 x SIDE keys (uint32) of a set of 64-bit hashes."""
    short = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(_ADD), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(short), 4096):
        part = short[at : at + 4096] * _MULTIPLY
        part += _ADD
        np.minimum(least, part.min(1), out=least)
    key = np.zeros(2 * SIDE, np.uint64)
    for k in range(DEPTH):
        key = mixed(key + least[k::DEPTH])
    return (key >> np.uint64(32)).astype(np.uint32)


def _sets(text: bytes | None, width: int, hashes: WordHashes) -> np.ndarray:
    return np.unique(shingle_hashes((text or b"").lower().split(), width, hashes))


def signatures(documents: DataFrame, width: int) -> DataFrame:
    """(doc_id, row, n_shingles, set_id, keys): the row's key, a 128-bit name of its set, null if that is empty, and its minhash keys."""
    import xxhash

    def make():
        hashes = WordHashes()

        def step(batch: pa.RecordBatch) -> list:
            found = [_sets(t, width, hashes) for t in batch.column(2).to_pylist()]
            names = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in found]
            return [batch.column(0), batch.column(1), [len(s) for s in found], names, [minhash_keys(s).tobytes() if len(s) else None for s in found]]

        return step

    return arrow_map(documents.select("doc_id", row_key(documents).alias("row"), F.col("text").cast("binary")), "doc_id bigint, row bigint, n_shingles bigint, set_id binary, keys binary", make)


_LINKS = "bucket bigint, a bigint, b bigint"


_STEP = (np.arange(SIDE, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)


def _buckets(keep, first: np.ndarray, ids: np.ndarray, second: np.ndarray, opening, closing) -> None:
    """Find the buckets of rows with sorted first keys and give ``keep(kind, bucket, a, b)`` their links.

    Buckets of the partition's opening and closing keys may go on in other partitions: their members
    and centres are reported whatever their size.
    """
    if not len(first):
        return
    alone = np.r_[True, first[1:] != first[:-1]] & np.r_[first[1:] != first[:-1], True]
    border = (first == opening) | (first == closing)
    rows = np.flatnonzero(~alone | border)
    names = (mixed(mixed(first[rows, None] + _STEP) + second[rows].astype(np.uint64)) >> np.uint64(1)).ravel()
    order = np.argsort(names)
    names, row = names[order].astype(np.int64), rows[order // SIDE]
    cut = np.flatnonzero(np.r_[True, names[1:] != names[:-1], True]) if len(names) else np.zeros(1, np.int64)
    start, size = cut[:-1], np.diff(cut)
    shared = border[row[start]]
    for n in range(2, SMALL_BUCKET + 1):
        members = ids[row[start[size == n][:, None] + np.arange(n)]]
        for i in range(n):
            for j in range(i):
                keep(0, 0, members[:, i], members[:, j])
    large = (size > SMALL_BUCKET) | shared
    for at, n, is_shared in zip(start[large], size[large], shared[large]):
        here = row[at : at + n]
        members = ids[here]
        c = _centre(second[here], members)
        keep(1, members[c], np.delete(members, c), np.full(n - 1, members[c]))
        if is_shared:
            keep(2, names[at], members[c : c + 1], members[c : c + 1])


def _centre(second: np.ndarray, ids: np.ndarray) -> int:
    """The member that agrees with the commonest value of each column most often; of equals the least id,
    so that the buckets of one group of near copies have few centres."""
    agree = np.zeros(len(second), np.int64)
    for j in range(SIDE):
        values, back, n = np.unique(second[:, j], return_inverse=True, return_counts=True)
        agree += back == np.argmax(n)
    best = np.flatnonzero(agree == agree.max())
    return int(best[np.argmin(ids[best])])


def candidate_links(classes: DataFrame) -> DataFrame:
    """Links (kind, bucket, a, b) with a <= b. Kind 0: two members of a small bucket; 1: a member and the centre
    (``bucket``) of a large bucket; 2: the centre (a) of a part of a bucket that other partitions may hold too."""
    rows = classes.select("class_id", "keys", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(SIDE - 1)), lambda i: F.substring(F.col("keys"), i * 4 + 1, 4))).alias("i", "part"))
    rows = rows.select(F.xxhash64("i", "part").alias("first"), "class_id", F.expr(f"substring(keys, {4 * SIDE + 1}, {4 * SIDE})").alias("second"))
    ordered = rows.repartitionByRange("first", "class_id").sortWithinPartitions("first", "class_id")

    def link(batches):
        out: list[np.ndarray] = []

        def keep(kind: int, bucket: int, a: np.ndarray, b: np.ndarray) -> None:
            out.append(np.stack([np.full(len(a), kind), np.full(len(a), bucket), np.minimum(a, b), np.maximum(a, b)], 1))

        def found():
            once = np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 4), np.int64)
            out.clear()
            for at in range(0, len(once), 50_000):
                part = once[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part[:, 0].astype(np.int8)), *(pa.array(part[:, k]) for k in (1, 2, 3))], names=["kind", "bucket", "a", "b"])

        rest, opening = [], None  # rows of the key that is not complete yet, in parts; the partition's first key
        for batch in batches:
            if not batch.num_rows:
                continue
            first = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            rows = first, batch.column(1).to_numpy(zero_copy_only=False), np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(-1, SIDE)
            opening = rows[0][0] if opening is None else opening
            if rest and rows[0][-1] == rest[0][0][-1]:
                rest.append(rows)
                continue
            rows = tuple(map(np.concatenate, zip(*rest, rows)))
            cut = int(np.flatnonzero(rows[0] != rows[0][-1])[-1]) + 1 if rows[0][0] != rows[0][-1] else 0
            _buckets(keep, *(x[:cut] for x in rows), opening, None)
            rest = [tuple(x[cut:] for x in rows)]
            if sum(map(len, out)) > 500_000:
                yield from found()
        if rest:
            rest = tuple(map(np.concatenate, zip(*rest)))
            _buckets(keep, *rest, opening, rest[0][-1])
        yield from found()

    return ordered.mapInArrow(link, f"kind tinyint, {_LINKS}")


def _spread_join(left: DataFrame, right: DataFrame, key: str, salt_by: list[str], kept: list[str], counts: DataFrame | None = None) -> DataFrame:
    """``left`` joined with ``right``, which has one row a key. A key of very many rows of ``left`` is dealt over
    several tasks, and its row of ``right`` copied to each; these keys are few enough to broadcast.

    ``counts``: (key, n) of ``left``, if it is known already.
    """
    counts = left.groupBy(key).agg(F.count("*").alias("n")) if counts is None else counts
    counts = materialize(counts.where(F.col(key).isNotNull() & (F.col("n") > HOT_ROWS)), "counts", kept)
    most, total = counts.agg(F.max("n"), F.sum("n")).first()
    if most is None:
        return left.join(right, key)
    rows = max(HOT_ROWS, total // BROADCAST_IDS)  # so at most BROADCAST_IDS keys have more
    heavy = F.broadcast(counts.where(F.col("n") > rows).select(key, F.ceil(F.col("n") / rows).cast("int").alias("_copies")))
    copies = F.coalesce("_copies", F.lit(1))
    dealt = left.join(heavy, key, "left").withColumn("_salt", F.pmod(F.xxhash64(*salt_by), copies).cast("int")).drop("_copies")
    copied = right.join(heavy, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), copies - 1))).drop("_copies")
    return dealt.join(copied, [key, "_salt"]).drop("_salt")


def _sets_of(links: DataFrame, classes: DataFrame, documents: DataFrame, width: int, passing: list[str]) -> DataFrame:
    """(id, s): the full sets, as sorted hashes, of the classes that have any link to verify."""
    import xxhash

    ids = links.select(F.col("a").alias("class_id")).unionByName(links.select(F.col("b").alias("class_id"))).distinct()
    ids = materialize(classes.join(ids, "class_id").select("row", F.col("class_id").alias("id"), F.xxhash64("set_id").alias("name")), "ids", passing)
    wanted = documents.select(row_key(documents).alias("row"), F.col("text").cast("binary")).join(broadcast_if_small(ids), "row").select("id", "text", "name")

    def make():
        hashes = WordHashes()

        def step(batch: pa.RecordBatch) -> list:
            sets = [_sets(t, width, hashes) for t in batch.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            return [batch.column(0), batch.column(2), [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets).view(np.int64)))]

        return step

    found = arrow_map(wanted, "id bigint, name bigint, set_id binary, s array<bigint>", make)
    found = materialize(found.where(F.xxhash64("set_id") == F.col("name")).select("id", "s"), "sets", passing)
    if found.count() > ids.count():  # rows that repeat both their id and their text
        found = materialize(found.dropDuplicates(["id"]), "sets-once", passing)
    return found


def _verified(links: DataFrame, sets: DataFrame, percent: int, passing: list[str], keep: list[str] = []) -> DataFrame:  # noqa: B006
    """The links (a, b) of class ids whose full sets are similar enough."""
    pairs = _spread_join(links, sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b", ["a"], passing)
    pairs = _spread_join(pairs, sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a", ["b"], passing, links.groupBy("a").agg(F.count("*").alias("n")))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.select("a", "b", *keep, both.alias("n"), (F.size("sa") + F.size("sb")).alias("of")).where(100 * F.col("n") >= percent * (F.col("of") - F.col("n"))).select("a", "b", *keep, F.lit(True).alias("ok"))


def connected(edges: DataFrame, written: list[str] | None = None) -> DataFrame:
    """(id, component): each id of the undirected ``edges`` (a, b) with the least id that it reaches.

    Large-star links the greater neighbours of an id with its least neighbour, small-star the
    smaller ones; both keep what is connected and end in stars. Only the count of edges and a
    checksum of each step reach the driver. The result is a written table, noted in ``written``.
    """
    spark, kept, before = edges.sparkSession, [], []
    now = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges", before)
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: u's neighbours above u go to the least of u and its neighbours
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        # small star: u and its neighbours below u go to the least of these
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b")
        small = small.select(F.col("m").alias("a"), F.col("a").alias("b")).where("a < b").unionByName(low.select(F.col("m").alias("a"), "b"))
        now = materialize(small.distinct(), "small-star", kept)
        found = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        release(spark, before)
        before, kept = kept, []
        if found == mark or not found[0]:
            break
        mark = found
    done = materialize(now.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("component")), "components", written)
    release(spark, before)
    return done


def _rows(documents: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, row, n_shingles, set_id, component_id, first_row) for each row of ``documents``; ``first_row`` is the
    key of the component's row of least doc_id."""
    spark, passing, parts_at = documents.sparkSession, [], []
    signed = materialize(signatures(documents, width), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")).alias("first")
    classes = signed.where("set_id is not null").groupBy("set_id").agg(first, F.min("keys").alias("keys"), F.count("*").alias("n"))
    # numbered once, as the table is written; whoever reads it sees the same numbers
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("class_id"), "set_id", "first", F.col("first.row").alias("row"), "keys", "n"), "classes")
    found = materialize(candidate_links(classes), "links", passing)
    spans = found.where("kind = 2").groupBy("bucket").agg(F.min("a").alias("a"))
    across = found.where("kind = 2").select("bucket", F.col("a").alias("b")).join(spans, "bucket").where("b > a").select("a", "b")
    links = found.where("kind < 2").select("a", "b").unionByName(across).groupBy("a", "b").agg(F.count("*").alias("n"))
    links = materialize(links, "candidates", passing)
    sets = _sets_of(links, classes, documents, width, passing)
    # first each class's commonest link, which mostly decides; then only what joins different components
    ends = links.select(F.col("a").alias("x"), F.col("b").alias("y"), "n").unionByName(links.select(F.col("b").alias("x"), F.col("a").alias("y"), "n"))
    best = ends.groupBy("x").agg(F.max_by("y", F.struct("n", -F.col("y"))).alias("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    sure = materialize(_verified(materialize(best, "best", passing), sets, percent, passing), "verified", passing)
    parts = connected(sure, passing)
    label = lambda c, name: parts.select(F.col("id").alias(c), F.col("component").alias(name))
    rest = links.join(label("a", "x"), "a", "left").join(label("b", "y"), "b", "left").select("a", "b", F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y")).where("x <> y")
    joined = _verified(materialize(rest, "rest", passing), sets, percent, passing, ["x", "y"]).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "ok").distinct()
    stars = lambda: parts.select(F.col("component").alias("a"), F.col("id").alias("b"))
    parts = connected(stars().unionByName(materialize(joined.select("a", "b"), "joined", passing)), passing)
    more = _across_components(found, across, parts, sets, percent, passing)
    if not more.isEmpty():
        parts = connected(stars().unionByName(more.select("a", "b")), parts_at)
    else:
        parts = materialize(parts, "components", parts_at)
    release(spark, passing)
    # equal sets, then links: each component is named by its row of least doc_id
    linked = classes.select("class_id", "set_id", "first").join(parts.withColumnRenamed("id", "class_id"), "class_id").select("component", "set_id", "first")
    heads = classes.join(parts.select(F.col("component").alias("class_id")).distinct(), "class_id").select(F.col("class_id").alias("component"), "set_id", "first")
    linked = materialize(linked.unionByName(heads), "linked")
    firsts = materialize(linked.groupBy("component").agg(F.min("first").alias("lead")), "firsts")
    named = materialize(_spread_join(linked.select("component", "set_id"), firsts, "component", ["set_id"], []).select("set_id", "lead"), "named")
    named = classes.select("set_id", "first").join(named, "set_id", "left").select("set_id", F.coalesce("lead", "first").alias("lead"))
    rows = signed.select("doc_id", "row", "n_shingles", "set_id")
    some = _spread_join(rows.where("set_id is not null"), named, "set_id", ["row"], [], classes.select("set_id", "n"))
    none = rows.where("set_id is null").withColumn("lead", F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row"))
    return some.unionByName(none).select("doc_id", "row", "n_shingles", "set_id", F.coalesce("lead.doc_id", "doc_id").alias("component_id"), F.col("lead.row").alias("first_row"))


def components(documents: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``documents``."""
    return _rows(documents, width, percent).select("doc_id", "n_shingles", "component_id")


def one_of_each(documents: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """The rows of ``documents``, with all their columns, that are the first of their component: that of least doc_id,
    of equal ones one. Rows without words all stay; so do rows that share a doc_id but not enough of their texts."""
    rows = materialize(_rows(documents, width, percent).where("set_id is not null").select("doc_id", "row", "first_row"), "judged")
    again = materialize(rows.where("row = first_row").groupBy("doc_id", "row").count().where("count > 1"), "repeated")
    gone = rows.where("row <> first_row").select("doc_id", "row")
    if again.isEmpty():
        return without(documents, materialize(gone.distinct(), "gone"))
    gone = materialize(gone.unionByName(again.select("doc_id", "row")).distinct(), "gone")
    return without(documents, gone).unionByName(once(documents, again))


def _across_components(found: DataFrame, across: DataFrame, parts: DataFrame, sets: DataFrame, percent: int, passing: list[str]) -> DataFrame:
    """Links (a, b) between different components whose members share a large bucket.

    Components that meet in buckets form groups. All sets of a group are put in one order of shingles:
    first those that a single component has, then the others, from rare to common. If two sets x and y
    of different components, x at least as large, are similar enough, the first |x| - t|x| + 1 shingles
    of x and the first |y| - 2t / (1 + t) |y| + 1 of y have one in common; it is not one of a single
    component, and as many shingles follow it in both as they must share. Only such pairs are verified.
    Members whose own shingles fill these places send nothing.
    """
    label = parts.withColumnRenamed("id", "class_id")
    pairs = found.where("kind = 1").select("bucket", "a", "b").unionByName(across.select(F.col("a").alias("bucket"), "a", "b")).distinct()
    held = pairs.select("bucket", F.col("a").alias("class_id")).unionByName(pairs.select("bucket", F.col("b").alias("class_id")))
    members = held.distinct().join(label, "class_id", "left").select("bucket", "class_id", F.coalesce("component", "class_id").alias("component"))
    members = materialize(members, "members", passing)
    met = members.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket", "lo")
    met = broadcast_if_small(materialize(met, "met-buckets", passing))
    met = materialize(members.select("bucket", "component").distinct().join(met, "bucket").where("component > lo").select(F.col("lo").alias("a"), F.col("component").alias("b")).distinct(), "met", passing)
    group = connected(met, passing).select(F.col("id").alias("component"), F.col("component").alias("grp"))
    group = materialize(group.unionByName(group.select(F.col("grp").alias("component"), "grp").distinct()), "groups", passing)
    inside = materialize(_spread_join(members.select("class_id", "component").distinct(), group, "component", ["class_id"], passing), "inside", passing)
    held = sets.withColumnRenamed("id", "class_id").join(broadcast_if_small(inside), "class_id").select("grp", "component", "class_id", F.size("s").alias("n"), F.explode("s").alias("h"))
    shared = held.groupBy("grp", "h").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("df")).where("lo < hi").select("grp", "h", "df")
    shared = broadcast_if_small(materialize(shared, "shared", passing), SHARED_ROWS)
    # all in whole numbers: t|x| and 2t / (1 + t) |y|, rounded up, with t as shares of percent
    asked = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1
    kept = F.col("n") - F.ceil(F.col("n") * (2 * percent) / (100 + percent)).cast("int") + 1
    ranked = held.join(shared, ["grp", "h"])
    own = F.col("n") - F.count("*").over(W.partitionBy("class_id")).cast("int")
    at = own + F.row_number().over(W.partitionBy("class_id").orderBy("df", "h")) - 1
    sent = ranked.select("grp", "component", "class_id", "n", "h", at.alias("at"), kept.alias("kept"), asked.alias("asked")).where("at < asked").drop("asked")
    sent = materialize(sent, "sent", passing)
    x = sent.select("grp", "h", *[F.col(c).alias(f"x_{c}") for c in ("component", "class_id", "n", "at")])
    y = sent.where("at < kept").select("grp", "h", *[F.col(c).alias(f"y_{c}") for c in ("component", "class_id", "n", "at")])
    must = F.ceil((F.col("x_n") + F.col("y_n")) * percent / (100 + percent))
    meet = x.join(y, ["grp", "h"]).where("x_component <> y_component and y_n <= x_n").where(
        (100 * F.col("y_n") >= percent * F.col("x_n")) & (F.least(F.col("x_n") - F.col("x_at"), F.col("y_n") - F.col("y_at")) >= must)
    )
    meet = meet.select(F.least("x_class_id", "y_class_id").alias("a"), F.greatest("x_class_id", "y_class_id").alias("b")).distinct()
    return materialize(_verified(materialize(meet, "meet", passing), sets, percent, passing), "across", passing)
