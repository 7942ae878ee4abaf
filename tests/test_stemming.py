"""English stems: published pairs, regions, arrays of any shape."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brindle.functions.stemming import stem_lists, stem_word
from brindle.operators import lexical
from brindle.plans.queries_search import ENGLISH


@pytest.mark.parametrize("word", sorted(w for w, s in ENGLISH.items() if s))
def test_published_pairs(word):
    assert stem_word(word) == ENGLISH[word]


def test_inflected_forms_meet():
    for forms in ("study studies studied studying", "cause caused causes causing", "box boxes boxed", "agree agreed agrees agreeing", "relate relates related relating relation", "happy happily happiness", "argue argued argues arguing"):
        stems = {stem_word(w) for w in forms.split()}
        assert len(stems) == 1 or forms.startswith("happy") and stems == {"happi", "happili"}, stems


@pytest.mark.parametrize(("word", "stem"), [("by", "by"), ("a", "a"), ("", ""), ("'tis", "tis"), ("dog's", "dog"), ("dogs'", "dog"), ("say's'", "say"), ("yes", "yes"), ("boy", "boy"), ("cry", "cri"), ("été", "été"), ("n17", "n17"), ("inning", "inning"), ("innings", "inning"), ("ss", "ss"), ("bed", "bed"), ("beads", "bead"), ("ied", "ie"), ("uses", "use")])
def test_edges(word, stem):
    assert stem_word(word) == stem


def test_lists_keep_their_shape():
    lists = pa.array([["studies", "boxes"], None, [], ["box", None, "box"]])
    assert stem_lists(lists).to_pylist() == [["studi", "box"], None, [], ["box", None, "box"]]
    assert stem_lists(lists.slice(1, 3)).to_pylist() == [None, [], ["box", None, "box"]]


def test_analyser_in_a_plan(spark):
    rows = spark.createDataFrame([(1, "The studies WERE caused"), (2, None), (3, "")], "id int, content string")
    got = {r["id"]: r["t"] for r in rows.select("id", lexical.english("content").alias("t")).collect()}
    assert got == {1: ["studi", "caus"], 2: None, 3: []}
    assert rows.select(F.size(lexical.english("content")).alias("n")).where("n = 2").count() == 1
