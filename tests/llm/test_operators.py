"""The ten operators against brute force, exact round trips or held-out accuracy, and on odd rows."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from oracle import difference
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brindle.llm import containment, html_layout, near_dups, pieces, quality_gam, quality_rules, queries, ring_shards, token_store, toxicity_fm, url_rules
from brindle.session import scratch_path

SMALL = "/root/testdata/sf0.001"


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def labels_of(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 1), (None, 1, 1), (7, None, None)], "doc_id bigint, quality int, toxic int")


def test_broken_bytes(spark, broken, monkeypatch):
    """Each query of texts on texts that aren't valid UTF-8 and on null ids: a row for each row; what op1 and op10 write is the text with U+FFFD."""
    labels = labels_of(spark)
    monkeypatch.setattr(queries, "table", lambda s, d, name: {"documents": broken, "labels": labels, "benchmark": broken.selectExpr("doc_id item_id", "text")}.get(name))
    n = broken.count()
    for name, rows in (("op1_token_store", n), ("op2_quality_gam", n), ("op3_quality_rules", n), ("op4_toxicity_fm", n), ("op7_near_dups", n), ("op9_ring_shards", n), ("op10_pieces", n), ("op11_periodic_runs", n), ("pieces_viterbi", n)):
        assert len(queries.QUERIES[name](spark, SMALL).collect()) == rows, name
    assert queries.op6_containment(spark, SMALL).count() > 0
    kept = {(r["doc_id"], r["kept"]) for r in queries.op7_near_dups(spark, SMALL).collect()}
    assert (None, False) in kept and None not in {k for _, k in kept}
    want = b"alpha\xff\xfe beta \xe2\x82 ".decode(errors="replace")
    library = Tokenizer.from_file(queries.WORD_VOCABULARY).encode(want, add_special_tokens=False).ids + [1]
    got = {r["doc_id"]: r for r in queries.op1_token_store(spark, SMALL).collect()}
    assert got[20]["ids_crc32"] == got[23]["ids_crc32"] == zlib.crc32(np.array(library, "<u4").tobytes())


def test_broken_pages(spark):
    pages = spark.sql("select 1L page_id, 'x://a' url, cast(X'3C703E61FF623C2F703E' as string) html union all select null, cast(X'FF3A2F2F61' as string), null")
    assert {r["page_id"]: r["text"] for r in html_layout.extract(pages).collect()} == {1: "a\ufffdb", None: ""}
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    assert url_rules.judge(pages, rules).count() == 2


# --- 1 -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("which", ["small", "odd", "empty"])
def test_token_store(spark, small, odd, empty, which):
    docs = {"small": small("documents"), "odd": odd, "empty": empty}[which]
    path = scratch_path(spark, "tokens")
    token_store.write_store(docs, path, queries.WORD_VOCABULARY)
    library = Tokenizer.from_file(queries.WORD_VOCABULARY)
    want = Counter()
    for doc, text in texts(docs):
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        want[doc, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    got = token_store.store_digest(spark, path).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == sorted((d for d, _ in texts(docs)), key=lambda d: (d is not None, d))


def test_token_store_prunes(spark, small):
    path = scratch_path(spark, "tokens")
    token_store.write_store(small("documents"), path, queries.WORD_VOCABULARY)
    rows = token_store.read_store(spark, path, [3])
    assert rows.count() == 1 and "doc_id" in rows._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]


def test_token_encoder_random_texts(monkeypatch):
    """Cut parts, forgotten parts, combining marks, special tokens: ids equal the library's on whole texts."""
    import pyarrow as pa

    library, encoder = Tokenizer.from_file(queries.WORD_VOCABULARY), token_store._Encoder(queries.WORD_VOCABULARY)
    assert encoder.by_part
    monkeypatch.setattr(token_store, "REMEMBERED", 300)
    rng = np.random.default_rng(4)
    alphabet = list("aAbHTtsS'’.,!?-_01\n\t \x0b\x1c\u0331\u0308éÉßΣσ漢😀<>|&\u0085\u00a0\u2028") + ["the ", "'s", "'re ", "<|endoftext|>", "ing", "I\u0307"]
    for _ in range(60):
        texts = ["".join(rng.choice(alphabet, rng.integers(0, 30))) for _ in range(50)] + [None, ""]
        ids, n = encoder(pa.array(texts).slice(1))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [library.encode(t or "", add_special_tokens=False).ids for t in texts[1:]]
        assert len(encoder.part_ids.parts) <= 300 + 52 * 30


def test_other_vocabularies_get_whole_texts(tmp_path):
    """A vocabulary that marks word ends but keeps case must not be cut."""
    import json

    import pyarrow as pa

    with open(queries.WORD_VOCABULARY) as f:
        rules = json.load(f)
    rules["normalizer"] = None
    (tmp_path / "cased.json").write_text(json.dumps(rules))
    encoder, library = token_store._Encoder(str(tmp_path / "cased.json")), Tokenizer.from_file(str(tmp_path / "cased.json"))
    texts = ["The cat SAT.", "a\nB", ""]
    assert not encoder.by_part
    assert encoder(pa.array(texts))[0].tolist() == [i for t in texts for i in library.encode(t, add_special_tokens=False).ids]


# --- 2, 4 --------------------------------------------------------------------------------------


@pytest.mark.parametrize(("name", "label", "least"), [("op2_quality_gam", "quality", 0.97), ("op4_toxicity_fm", "toxic", 0.93)])
def test_held_out_accuracy(spark, name, label, least):
    big = "/root/testdata/sf0.1"
    got = queries.QUERIES[name](spark, big).where("held_out").join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id")
    right = got.agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0]
    assert right >= least
    assert got.where("score < 0 or score > 1").count() == 0


def test_classifiers_on_odd_rows(spark, odd, empty):
    labels = labels_of(spark)
    for train, score in ((quality_gam.train, quality_gam.score), (toxicity_fm.train, toxicity_fm.score)):
        model = train(odd, labels)
        got = score(odd, model, odd.columns)
        assert got.columns == ["doc_id", "text", "shard", "_text", "score"] and got.count() == 13
        by = Counter((r["text"] or "", r["score"]) for r in got.collect())
        assert len(by) == len({t for t, _ in by})
        none = train(odd, labels.limit(0))
        assert {r["score"] for r in score(odd, none, ["doc_id"]).collect()} == {0.5}
        assert score(empty, model, ["doc_id"]).count() == 0


def brute_gam(m, x):
    """Looks bins up one by one: how many cuts a value reaches."""
    total = m.base
    for f, table in enumerate(m.single):
        total += table[sum(cut <= x[f] for cut in m.cuts[f])]
    for (f, g), table in m.pair.items():
        total += table[sum(cut <= x[f] for cut in m.coarse[f]), sum(cut <= x[g] for cut in m.coarse[g])]
    return 1 / (1 + np.exp(-max(-35, min(35, total))))


def brute_machine(m, text):
    """The sum over single terms and over all pairs of terms."""
    counts = Counter(m.known[t] for w in (text or "").lower().split() for t in toxicity_fm.terms(w) if t in m.known)
    value = {i: 1 + np.log(n) for i, n in counts.items()}
    at = sorted(value)
    total = m.base + sum(m.weights[i] * value[i] for i in at)
    total += sum(m.factors[i] @ m.factors[j] * value[i] * value[j] for k, i in enumerate(at) for j in at[:k])
    return 1 / (1 + np.exp(-max(-35, min(35, total))))


def test_classifiers_against_plain_scorers(spark, odd):
    big = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    gam, machine = quality_gam.train(docs, labels), toxicity_fm.train(docs, labels)
    assert gam.pair and machine.known and machine.factors.any()
    some = docs.where("doc_id % 7 = 0").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    for model, score, plain in ((gam, quality_gam.score, lambda t: brute_gam(gam, quality_gam.features((t or "").encode()))), (machine, toxicity_fm.score, lambda t: brute_machine(machine, t))):
        for r in score(some, model, ["doc_id", "text"]).collect():
            assert abs(r["score"] - plain(r["text"])) < 1e-9


def test_clashing_names_in_any_case(spark):
    docs = spark.createDataFrame([(1, "a b", 0.1, 2)], "doc_id bigint, text string, Score double, SHARD int")
    assert quality_gam.score(docs, quality_gam.Gam(), docs.columns).columns == ["doc_id", "text", "SHARD", "score"]
    assert ring_shards.assign(docs, F.col("doc_id"), [F.col("doc_id")], 2).columns == ["doc_id", "text", "Score", "shard", "slot"]


def test_held_out_is_never_null(spark):
    got = spark.createDataFrame([(None,), (1,)], "doc_id bigint").select(queries.fold(1, 3).alias("a"), queries.fold(0, 5).alias("b")).collect()
    assert all(isinstance(v, bool) for r in got for v in r)


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.fit(x, y)
    assert (0, 1) in model.pair and ((model.probability(x) > 0.5) == (y > 0)).mean() > 0.9


def test_pairs_of_terms_that_mean_little_alone(spark):
    """Texts with an insult are sometimes toxic, those with a group mention as often as any; with both they always are."""
    rng = np.random.default_rng(10)
    rows, labels = [], []
    for d in range(3000):
        insult, group = rng.random() < 0.3, rng.random() < 0.3
        toxic = insult and group or (not group and rng.random() < 0.09)
        words = [f"plain{rng.integers(200)}" for _ in range(20)] + ["insulting"] * insult + ["grouping"] * group
        rows.append((d, " ".join(rng.permutation(words))))
        labels.append((d, int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity_fm.train(docs, labels)
    probe = spark.createDataFrame([(1, "insulting grouping plain1"), (2, "grouping plain1"), (3, "insulting plain1"), (4, "plain1")], "doc_id bigint, text string")
    p = {r["doc_id"]: r["score"] for r in toxicity_fm.score(probe, model, ["doc_id"]).collect()}
    assert p[1] > 0.5 > max(p[2], p[3], p[4])


def test_machine_learns_a_pair():
    at, value, row, y = [], [], [], []
    for i, terms in enumerate([[0], [1], [0, 1], []] * 300):
        at, value, row = at + terms, value + [1.0] * len(terms), row + [i] * len(terms)
        y.append(float(len(terms) == 2))
    model = toxicity_fm.fit(np.array(at), np.array(value), np.array(row), np.array(y), {0: 0, 1: 1})
    p = model.margins(np.array(at), np.array(value), np.array(row), len(y)) > 0
    assert (p == (np.array(y) > 0)).all()


# --- 3 -----------------------------------------------------------------------------------------


def brute_base(text):
    import re

    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)


@pytest.mark.parametrize("which", ["small", "odd", "empty"])
def test_quality_rules(spark, small, odd, empty, which):
    docs = {"small": small("documents"), "odd": odd, "empty": empty}[which]
    labels = small("labels") if which == "small" else labels_of(spark)
    got = quality_rules.apply_rules(docs, quality_rules.train(docs, labels)).collect()
    assert Counter((r["doc_id"], *r[1:6]) for r in got) == Counter((d, *brute_base(t)) for d, t in texts(docs))
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and not (r["base_failed"] and r["kept"])


def brute_probability(model, text):
    """Term by term, with the hashes written out: the mean weight of words, pairs and character runs."""
    import xxhash

    def mixed(x):
        for _ in range(2):
            x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 % 2**64
        return x ^ x >> 32

    bits, total = quality_rules.HASH_BITS, 0.0
    words = [int.from_bytes(xxhash.xxh3_64_digest(w), "little") for w in (text or "").encode().split()]
    c = [ord(x) * 2654435761 % 2**32 for x in text or ""]
    c = [x ^ x >> 15 for x in c]
    blocks = [
        [w >> 64 - bits for w in words],
        [(mixed((a * 3 + b) % 2**64) >> 64 - bits) + 2**bits for a, b in zip(words, words[1:])],
        [((x * 0x85EBCA6B + y * 0xC2B2AE35 + z) * 2654435761 % 2**32 >> 32 - bits) + 2 * 2**bits for x, y, z in zip(c, c[1:], c[2:])],
    ]
    for block in blocks:
        total += sum(float(model.weights[i]) for i in block) / len(block) if block else 0.0
    return 1 / (1 + np.exp(-(model.slope * total + model.offset)))


def test_quality_rules_verdicts(spark, small, odd):
    docs = small("documents")
    model = quality_rules.train(docs, small("labels"))
    assert (model.weights != 0).any()
    for table in (docs, odd):
        text = Counter((d, t) for d, t in texts(table))
        got = quality_rules.apply_rules(table, model).join(table.select("doc_id", "text").distinct(), "doc_id")
        for r in got.collect():
            p = brute_probability(model, r["text"])
            assert (r["doc_id"], r["text"]) in text and abs(r["probability"] - p) < 1e-6
            assert r["kept"] == (not r["base_failed"] and r["probability"] >= 0.5)


def test_quality_rules_bound(spark, small):
    """What the fit gathers is bounded by shares, too."""
    model = quality_rules.train(small("documents"), small("labels"), training_shares=0)
    assert not model.weights.any()


def test_quality_rules_separate(spark):
    big = "/root/testdata/sf0.01"
    got = queries.op3_quality_rules(spark, big).where("not base_failed").join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id")
    assert got.agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("double"))).first()[0] > 0.95


# --- 5 -----------------------------------------------------------------------------------------


def test_url_rules_sql(spark):
    assert difference(spark, "op5_url_rules", SMALL, queries.QUERIES, queries.ORACLES) == ""


def test_url_rules_both_ways(spark, small):
    urls = small("pages").select("page_id", "url").unionByName(spark.createDataFrame([(-1, None), (-2, "no scheme"), (-3, "x://COM?q"), (-4, "a://b.example.com/en/7://z"), (-4, "a://b.example.com/en/7://z"), (-5, "://")], "page_id bigint, url string"))
    rules = spark.createDataFrame([*queries.URL_RULES, ("Example.com", "/en/", "allow"), (None, "/", "block"), ("com", None, "block"), ("com", "/en/", "allow")], "host string, path string, verdict string")
    few = {tuple(r) for r in url_rules.judge(urls, rules).collect()}
    many = {tuple(r) for r in url_rules.judge(urls, rules, broadcast_rules=2).collect()}
    known = [(h.lower(), p, v) for h, p, v in [*queries.URL_RULES, ("Example.com", "/en/", "allow")]]
    for page, host, path, rule, verdict in few:
        fits = [(len(h) + len(p), h + p, v) for h, p, v in known if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (rule, verdict) == (max(fits)[1:] if fits else (None, "allow"))
    assert few == many
    assert url_rules.judge(urls.limit(0), rules).count() == 0 and url_rules.judge(urls, rules.limit(0)).where("rule is not null").count() == 0


def test_url_rules_against_all_rules(spark):
    """Many nested and repeated rules, against trying every rule; both ways of the join."""
    rng = np.random.default_rng(12)
    labels, steps = ["com", "a", "b", "ab", "Example"], ["", "/", "/a", "/ab", "/a/", "/a/b", "/a/b/c", "/b"]
    host = lambda: ".".join(rng.choice(labels, rng.integers(1, 4)))
    rules = [(host(), str(rng.choice(steps)) + str(rng.choice(["", "x", "/"])), str(rng.choice(["allow", "block"]))) for _ in range(300)] + [("", "/", "block"), ("com", "/", None)]
    urls = [(i, f"http://{host()}{rng.choice(steps)}{rng.choice(['', 'x', '/y', '?q', '#f'])}") for i in range(800)]
    least = {}
    for h, p, v in rules:
        if h and v:
            least[h.lower(), p] = min(v, least.get((h.lower(), p), v))
    rule_rows, url_rows = spark.createDataFrame(rules, "host string, path string, verdict string"), spark.createDataFrame(urls, "page_id bigint, url string")
    got = {tuple(r) for r in url_rules.judge(url_rows, rule_rows).collect()}
    assert got == {tuple(r) for r in url_rules.judge(url_rows, rule_rows, broadcast_rules=5).collect()} and len(got) == 800
    for page, h, path, rule, verdict in got:
        fits = [(len(a) + len(b), len(a), a + b, v) for (a, b), v in least.items() if (h == a or h.endswith("." + a)) and path.startswith(b)]
        assert (rule, verdict) == (max(fits)[2:] if fits else (None, "allow"))


# --- 6 -----------------------------------------------------------------------------------------


def brute_contained(docs, items, percent=80):
    """(doc, item) pairs: the item's runs of five words, or of all its words if fewer, among the document's runs of as many."""
    words = lambda t: (t or "").encode().lower().split()
    runs = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    found = set()
    for i, t in items:
        k = min(5, len(words(t)))
        wanted = runs(words(t), k) if k else set()
        for d, text in docs:
            if wanted and 100 * len(wanted & runs(words(text), k)) >= percent * len(wanted):
                found.add((d, i))
    return found


def test_containment(spark, small, odd, empty):
    docs, items = small("documents"), small("benchmark")
    part = items.orderBy("item_id").limit(3).select((F.col("item_id") + 1000).alias("item_id"), F.expr("substring_index(text, ' ', 8)").alias("text"))
    items = items.unionByName(part).unionByName(spark.createDataFrame([(5000, None), (5001, " "), (5002, "one"), (5003, "Alpha beta")], items.schema))
    for d in (docs, odd, empty):
        got = [(r["doc_id"], r["item_id"]) for r in containment.find_contained(d, items).collect()]
        assert set(got) == brute_contained(texts(d), [(r[0], r[1]) for r in items.select("item_id", "text").collect()])
    assert containment.find_contained(docs, items.limit(0)).count() == 0


def test_containment_of_many_items(spark, small, odd, empty, monkeypatch):
    """A set beyond the bound takes the other way, with equal results: repeated rows and ids, short and null items."""
    items = small("benchmark").unionByName(spark.createDataFrame([(5000, None), (5001, " "), (5002, "one"), (5003, "Alpha beta"), (3, "gamma delta epsilon"), (5004, "same row")], small("benchmark").schema))
    tables = [small("documents"), odd, empty]
    whole = [Counter(tuple(r) for r in containment.find_contained(d, items).collect()) for d in tables]
    assert whole[0] and max(whole[1].values()) == 2
    monkeypatch.setattr(containment, "BLOCK_HASHES", 60)
    monkeypatch.setattr(containment, "TOGETHER", 2)
    for d, want in zip(tables, whole):
        assert Counter(tuple(r) for r in containment.find_contained(d, items).collect()) == want
    kept = containment.without_items(odd, items)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {2, 3, 4, 7, 8, 9, 11}


def test_sketch_is_wide_enough():
    for n in range(1, 300):
        missing = n - -(-80 * n // 100)
        assert containment.sketch_width(n) > missing or containment.sketch_width(n) == n


# --- 7 -----------------------------------------------------------------------------------------


def brute_components(docs, width, percent=80):
    def shingles(text):
        w = (text or "").encode().lower().split()
        k = min(width, len(w))
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()

    sets = [(d, shingles(t)) for d, t in docs]
    root = {}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    distinct = {s for _, s in sets if s}
    root = {s: s for s in distinct}
    listed = sorted(distinct, key=len)
    for i, x in enumerate(listed):
        for y in listed[i + 1 :]:
            if 100 * len(x) < percent * len(y):
                break
            both = len(x & y)
            if 100 * both >= percent * (len(x) + len(y) - both):
                root[find(x)] = find(y)
    least = {}
    for d, s in sets:
        if s and d is not None:
            least[find(s)] = min(d, least.get(find(s), d))
    return Counter((d, len(s), least.get(find(s)) if s else d) for d, s in sets)


def test_near_dups(spark, small, odd, empty):
    for docs, width in ((small("documents"), 2), (small("documents"), 5), (odd, 2), (empty, 2)):
        got = Counter(tuple(r) for r in near_dups.components(docs, width).collect())
        assert got == brute_components(texts(docs), width)


def test_near_dups_large_group(spark):
    """Copies of a text with a few words changed: many pairs lie near the threshold on both sides."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for d in range(400):
        w = list(base)
        for i in rng.choice(120, rng.integers(3, 9), replace=False):
            w[i] = f"x{rng.integers(1_000_000)}"
        rows.append((d, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert Counter(tuple(r) for r in near_dups.components(docs, 2).collect()) == brute_components(rows, 2)


def test_near_dups_repeated_and_null_ids(spark, monkeypatch):
    """An id may have several texts, and rows may have none: each row follows its own text; hot keys are spread."""
    x, y, z = ("a b c d e f g h i j k l", "q r s t u v w x y z", "m1 m2 m3 m4 m5")
    rows = [(3, x + " more"), (5, x), (5, y), (None, z), (None, z), (None, x), (None, None), (7, z + " m6"), (8, "n1 n2 n3"), (None, "p1 p2")] + [(9, x)] * 5
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(near_dups, "HOT_ROWS", 1)
    assert Counter(tuple(r) for r in near_dups.components(docs, 2).collect()) == brute_components(rows, 2)
    kept = Counter((r["doc_id"], r["text"]) for r in near_dups.one_of_each(docs.withColumn("_row", F.lit(1)), 2).collect())
    assert kept == Counter({(3, x + " more"): 1, (5, y): 1, (None, None): 1, (7, z + " m6"): 1, (8, "n1 n2 n3"): 1, (None, "p1 p2"): 1})


def test_unlike_members_of_a_bucket_move_little(spark, monkeypatch):
    """Texts that share 140 of 170 words lie in common buckets though no two are similar enough: what is sent to
    meet must follow their number, not its square."""
    sent = []
    write = near_dups.materialize

    def noted(df, name, kept=None):
        out = write(df, name, kept)
        sent.append((name, out.count()) if name in ("inside", "sent", "meet") else (name, None))
        return out

    monkeypatch.setattr(near_dups, "materialize", noted)
    rng = np.random.default_rng(8)
    moved = {}
    for n in (1_000, 4_000):
        common = [f"w{i}" for i in range(140)]
        rows = [(d, " ".join(common + [f"x{v}" for v in rng.integers(0, 10**12, 30)])) for d in range(n)]
        sent.clear()
        got = near_dups.components(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8), 2)
        assert got.where("component_id <> doc_id").isEmpty()
        moved[n] = dict(sent)
    assert moved[4_000]["inside"] > 3_000  # they do meet in buckets
    assert all(moved[4_000][k] <= 5 * moved[1_000][k] + 100 for k in ("inside", "sent", "meet"))


def test_connected(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    got = {r["id"]: r["component"] for r in near_dups.connected(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


# --- 8 -----------------------------------------------------------------------------------------

PAGES = [
    ("<p>a b<p>c", "a b\n\nc"),
    ("<ul><li>one<li>two<ol start=3><li>x<li>y</ol></ul>", "- one\n- two\n  3. x\n  4. y"),
    ("<table><tr><th>k<th>long head<tr><td>value<td>d</table>tail", "k     | long head\nvalue | d\n\ntail"),
    ("a<script>var x='</p>'</script><style>p{}</style><div hidden>no</div><div style='display: none'>no</div><!-- no -->b", "ab"),
    ("<pre> k\n  l</pre>x &lt; y &amp; z &copy;", " k\n  l\n\nx < y & z ©"),
    ("a < b <!-- open", "a < b"),
    ("<b>one <i>two</b> three</i> four<br>five", "one two three four\nfive"),
    ("</p></div>x<td>y", "x y"),
    ("", ""),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a | b\n  | c"),
    ("<table><tr><td colspan=2>ab<td>c<tr><td>d<td>e<td>f</table>", "ab |   | c\nd  | e | f"),
    ("<table><tr><td><ul><li>a<li>b</ul><td>z</table>", "- a | z\n- b |"),
    ("<div style='visibility:hidden'>no<b style='visibility:visible'>yes</b></div>", "yes"),
    ("<p style=\"content:'display:none'\">p<dialog open>d</dialog><dialog>n</dialog>", "p\n\nd"),
    ("<p style='display:none;display:block'>a<p style='display:none!important;display:block'>b", "a"),
    ("<ol reversed><li>a<li value=7>b<li>c</ol>", "3. a\n7. b\n6. c"),
    ("<head><title>t</title>text<p>x", "text\n\nx"),
    ("<head><meta charset=x><a href=y>link</a>", "link"),
    ("<input type=checkbox value=on><input value=v><input type=hidden value=h>", "v"),
    ("<svg><title>n</title><text>s</text></svg><math><mi>x</mi></math><span aria-hidden=true>q</span>", "sxq"),
    ("a<br><br>b", "a\n\nb"),
    ("<ul><li>a<ul><li>b</ul><li>c</ul>d", "- a\n  - b\n- c\n\nd"),
    ("x <a href='q", "x"),
    ("<p title=it's>ok <!--> 1 <2 & 3<", "ok 1 <2 & 3<"),
]


@pytest.mark.parametrize(("source", "text"), PAGES)
def test_html(source, text):
    assert html_layout.extract_text(source) == text


def test_html_pages(spark, small):
    """Every page's visible words, none lost or made up, whatever the layout."""
    import html as h
    import re

    got = {r["page_id"]: r["text"] for r in html_layout.extract(small("pages")).collect()}
    assert len(got) == small("pages").count()
    words = lambda t: [w for w in t.replace("|", " ").split() if w]
    for r in small("pages").collect():
        body = re.sub(r"(?s)<(script|style|head|title)\b.*?</\1>|<!--.*?-->", " ", r["html"])
        plain = [w for w in h.unescape(re.sub(r"<[^>]*>", " ", body)).replace("|", " ").split()]
        assert sorted(w for w in words(got[r["page_id"]]) if w != "-") == sorted(w for w in plain if w != "-")


def test_html_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "<p>a"), (3, "<p>a"), (None, "<p>b"), (4, "<!-- -->")]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id bigint, html string, text string, _0 string")
    assert Counter(tuple(r) for r in html_layout.extract(pages).collect()) == Counter([(1, ""), (2, ""), (3, "a"), (3, "a"), (None, "b"), (4, "")])
    assert html_layout.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("unit", ["<div>", "<a ", "<p><div>", "<b>x</b>", "<ul><li>x", "<blockquote>x", "<table><tr><td>x", "<tr><td rowspan=65534>x", "<td colspan=1000>x", "<a href='", "<"])
def test_html_of_a_megabyte(unit):
    import time

    began = time.process_time()
    text = html_layout.extract_text("<table>" * (unit[:2] == "<t") + unit * (1_000_000 // len(unit)) + "end")
    assert time.process_time() - began < 10 and len(text) < 20_000_000
    if unit[-1] in ">x":
        assert text.endswith("end")


def test_tables_stay_in_proportion():
    """One wide cell beside thousands of small rows, and columns that later rows span, add no more than the page's room."""
    row = "<tr><td>a<td>b</tr>"
    for n in (12, 96):
        page = "<table><tr><td>" + "w" * (n * 250) + "<td>z</tr>" + row * (n * 750 // len(row)) + "</table>"
        assert len(html_layout.extract_text(page)) < 2 * len(page) + 10_000
    page = "<table><tr><td>" + "w" * 500_000 + "<td>z</tr>" + row * 30_000 + "</table>"
    text = html_layout.extract_text(page)
    assert len(text) < 2_000_000 and text.count("a | b") == 30_000 and "w | z" in text
    page = "<table><tr>" + "".join(f"<td>{'x' * 199}" for _ in range(1000)) + "<tr><td colspan=999>a<td>b" * 20_000 + "</table>"
    text = html_layout.extract_text(page)
    assert len(text) < 6 * len(page) and text.count("\na") == 20_000


def made_page(rng, depth=0):
    """(html, blocks) of a random page: blocks are (lines, whether blank lines stand around), as a reader would lay them out."""
    source, blocks = "", []
    for _ in range(rng.integers(1, 5)):
        kind, words = rng.choice(["p", "div", "ul", "ol", "pre", "quote", "hidden"]), [f"w{rng.integers(1000)}" for _ in range(rng.integers(1, 6))]
        text = " ".join(words)
        if kind == "p":
            source += f"<p>{words[0]}  <i>\n{' '.join(words[1:])}</i>" + rng.choice(["", "</p>"])
            blocks.append(([text], True))
        elif kind == "div":
            source += f"<div>{text}<!-- no --></div>"
            blocks.append(([text], False))
        elif kind in ("ul", "ol"):
            start = int(rng.integers(1, 20))
            source += f"<{kind} start={start}>" + "".join(f"<li>{w}" + rng.choice(["", "</li>"]) for w in words) + f"</{kind}>"
            blocks.append(([(f"{start + i}. " if kind == "ol" else "- ") + w for i, w in enumerate(words)], True))
        elif kind == "pre":
            source += "<pre>" + "\n".join("  " * i + w for i, w in enumerate(words)) + "</pre>"
            blocks.append((["  " * i + w for i, w in enumerate(words)], True))
        elif kind == "quote" and depth < 3:
            inner, below = made_page(rng, depth + 1)
            source += f"<blockquote>{inner}</blockquote>"
            lines = laid_out(below)
            blocks.append((["  " + x if x else "" for x in lines], True))
        elif kind == "hidden":
            source += f"<div hidden><p>{text}<table><tr><td>no</table></div><script>{text}</script>"
    return source, blocks


def laid_out(blocks):
    lines, gap = [], False
    for own, spaced in blocks:
        if own:
            if lines and (gap or spaced):
                lines.append("")
            lines, gap = lines + own, spaced
    return lines


def test_html_against_made_pages():
    rng = np.random.default_rng(6)
    for _ in range(300):
        source, blocks = made_page(rng)
        assert html_layout.extract_text(source) == "\n".join(laid_out(blocks)), source


def test_html_tables_against_a_matrix():
    """Cells placed in a full matrix of rows and columns, one place after the other."""
    rng = np.random.default_rng(7)
    for _ in range(200):
        n_rows, source, taken, cells = rng.integers(1, 6), "<table>", set(), {}
        for r in range(n_rows):
            source += "<tr>"
            for _ in range(rng.integers(1, 5)):
                c = next(c for c in range(100) if (r, c) not in taken)
                down, span = int(rng.integers(1, 4)), int(rng.integers(1, 4))
                lines = [f"x{rng.integers(10 ** rng.integers(1, 6))}" for _ in range(rng.integers(1, 3))]
                source += f"<td rowspan={down} colspan={span}>" + "<br>".join(lines)
                taken |= {(y, x) for y in range(r, min(r + down, n_rows)) for x in range(c, c + span)}
                cells[r, c] = lines
        columns = sorted({c for _, c in cells})
        widths = [max(len(x) for (_, c), ls in cells.items() if c == column for x in ls) for column in columns]
        want = []
        for r in range(n_rows):
            own = {c: ls for (y, c), ls in cells.items() if y == r}
            for k in range(max(map(len, own.values()))):
                line = [(own.get(c, [])[k : k + 1] or [""])[0].ljust(w) for c, w in zip(columns, widths) if c <= max(own)]
                want.append(" | ".join(line).rstrip(" "))
        assert html_layout.extract_text(source + "</table>") == "\n".join(want), source


# --- 9 -----------------------------------------------------------------------------------------


def test_ring_shards(spark, small, odd, empty):
    for docs, n in ((small("documents"), 8), (odd, 3), (empty, 8), (odd, 20)):
        rows = ring_shards.assign(docs, F.col("doc_id"), [F.crc32(F.col("text").cast("binary"))], n)
        assert len(rows.columns) == len(docs.columns) + (1 if "shard" in docs.columns else 2)
        got = rows.collect()
        sizes = Counter(r["shard"] for r in got)
        total = docs.count()
        assert len(got) == total and all(0 <= s < n for s in sizes)
        if total:
            assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(n)) <= 1
        for s in sizes:
            assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))


def brute_ring(counts, n_shards):
    """One row after the other in rounds: each goes to the next point clockwise until a shard has room."""
    points, total = ring_shards.ring_points(n_shards), sum(counts.values())
    room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    waiting = [(cell, rank, next((i for i, (at, _) in enumerate(points) if at >= cell), len(points))) for cell in sorted(counts) for rank in range(counts[cell])]
    owner, filled = {}, [0] * n_shards
    while waiting:
        again = []
        for cell, rank, i in waiting:
            shard = points[i % len(points)][1]
            if room[shard]:
                room[shard] -= 1
                owner[cell, rank] = shard, filled[shard]
                filled[shard] += 1
            else:
                again.append((cell, rank, i + 1))
        waiting = again
    return owner


def test_ring_against_a_walk():
    rng = np.random.default_rng(9)
    for n in (1, 3, 8):
        for _ in range(20):
            counts = {int(c): int(rng.integers(1, 40)) for c in rng.choice(ring_shards.CELLS, 60, replace=False)}
            got = {(cell, r): (shard, first + r - lo) for cell, lo, hi, shard, first in ring_shards.place(counts, n) for r in range(lo, hi)}
            assert got == brute_ring(counts, n)


def test_ring_moves_little():
    counts = dict.fromkeys(range(ring_shards.CELLS), 10)

    def owners(n):
        out = {}
        for cell, lo, hi, shard, _ in ring_shards.place(counts, n):
            out.update({(cell, r): shard for r in range(lo, hi)})
        return out

    a, b = owners(8), owners(9)
    moved = sum(a[k] != b[k] for k in a) / len(a)
    assert len(a) == 10 * ring_shards.CELLS and moved < 0.5


def test_op9_digest(spark):
    got = {r["doc_id"]: r for r in queries.op9_ring_shards(spark, SMALL).collect()}
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        data = (r["text"] or "").encode()
        assert (got[r["doc_id"]]["size"], got[r["doc_id"]]["text_crc32"], got[r["doc_id"]]["law"]) == (len(data) + 1, zlib.crc32(data), "rows")


# --- 10 ----------------------------------------------------------------------------------------


def test_pieces_match_the_library(spark, small, odd, empty):
    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)
    for docs in (small("documents"), odd, empty):
        coded = pieces.encode(docs, queries.PIECE_MODEL)
        want = texts(docs)
        assert Counter((r["doc_id"], tuple(r["ids"])) for r in coded.collect()) == Counter((d, tuple(library.encode(t or ""))) for d, t in want)
        back = pieces.decode(coded, queries.PIECE_MODEL).collect()
        assert Counter((r["doc_id"], r["text"]) for r in back) == Counter((d, t or "") for d, t in want)
        assert Counter((r["doc_id"], r["text"]) for r in pieces.round_trip(docs, queries.PIECE_MODEL).collect()) == Counter((d, t or "") for d, t in want)


@pytest.mark.parametrize("kind", ["bpe", "unigram"])
def test_pieces_random_texts(kind, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(pieces, "REMEMBERED", 200)
    with open(queries.PIECE_MODEL, "rb") as f:
        ours = pieces.PieceModel(f.read(), {"bpe": None, "unigram": pieces.UNIGRAM}[kind])
    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)
    plain = library.encode if kind == "bpe" else lambda t: brute_viterbi(ours, t)
    rng = np.random.default_rng(2)
    alphabet = list("aAbeinorstz éÉ'.,!?-_01\n\t  ▁漢😀<>|") + ["the ", "ing", "    ", "tion"]
    for _ in range(30):
        texts = ["".join(rng.choice(alphabet, rng.integers(0, 40))) for _ in range(50)] + [None, ""]
        ids, ends = ours.encode_batch(pa.array(texts).slice(1))
        want = [plain(t or "") for t in texts[1:]]
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == want
        assert [ours.encode(t or "").tolist() for t in texts[1:]] == want
        assert ours.decode_batch(ids, ends).to_pylist() == [library.decode(w) for w in want]


def brute_viterbi(m, text):
    """Ids of greatest summed score by trying every piece at every position; of equal sums the longest last piece."""
    if not text:
        return []
    text = pieces.SPACE + text.replace(" ", pieces.SPACE)
    most, n = max(map(len, m.id)), len(text)
    best = [(0.0, 0, None)] + [(-np.inf, 0, None)] * n
    for end in range(1, n + 1):
        for start in range(max(0, end - most), end):
            i = m.id.get(text[start:end])
            score = m.score[i] if i is not None else m.least if start == end - 1 else None
            if score is not None and best[start][0] + score > best[end][0]:
                best[end] = best[start][0] + score, start, i
    ids = []
    while n:
        _, start, i = best[n]
        ids[:0] = [i] if i is not None else [m.bytes[b] for b in text[start:n].encode()]
        n = start
    return ids


def test_viterbi_over_whole_documents(spark):
    """The query whose scores are summed, as for unigram models, against plain dynamic programming over whole documents."""
    with open(queries.PIECE_MODEL, "rb") as f:
        m = pieces.PieceModel(f.read(), pieces.UNIGRAM)
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = queries.pieces_viterbi(spark, SMALL).collect()
    assert len(got) == len(text)
    for r in sorted(got, key=lambda r: r["doc_id"])[:60]:
        assert list(r["ids"]) == brute_viterbi(m, text[r["doc_id"]]) and r["n_tokens"] == len(r["ids"])


def test_decoding_ids_that_no_text_gives(spark):
    rows = spark.createDataFrame([(1, [3 + 0xC3]), (2, None), (3, [])], "doc_id bigint, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in pieces.decode(rows, queries.PIECE_MODEL).collect()} == {1: "\ufffd", 2: "", 3: ""}


def test_unigram_takes_the_best_sum():
    def field(number, kind, value):
        return bytes([number << 3 | kind]) + (bytes([len(value)]) + value if kind == 2 else value)

    def piece(text, score, kind=1):
        return field(1, 2, field(1, 2, text.encode()) + field(2, 5, np.array([score], "<f4").tobytes()) + field(3, 0, bytes([kind])))

    vocabulary = [("<unk>", 0, 2), ("a", -1), ("b", -1), ("ab", -1.5), ("c", -1), ("bc", -0.4), ("abc", -3)]
    data = b"".join(piece(*p) for p in vocabulary) + field(2, 2, field(3, 0, b"\x01")) + field(3, 2, field(3, 0, b"\x00") + field(4, 0, b"\x00"))
    m = pieces.PieceModel(data)
    assert [m.text[i] for i in m.encode("abc")] == ["a", "bc"]
    assert m.encode("axb").tolist() == m.encode("axxb").tolist() == [1, 0, 2]
