"""English stems by suffix rules with regions (Porter's second algorithm), for arrays of words in Arrow batches.

Region 1 of a word begins after the first consonant that follows a vowel, region 2 likewise within
region 1. A suffix goes, or is replaced, if it lies in the region that its rule names, so that
short words keep their form while inflected forms meet in one stem. Each distinct word of a batch is
stemmed once.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions import vocabulary as V

_AFTER_SYLLABLE = re.compile("[aeiouy][^aeiouy]")
_VOWEL = re.compile("[aeiouy]")
_BEGINNING = re.compile("|".join(V.STEM_BEGINNINGS))
_SHORT_END = re.compile("(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
_CONSONANT_Y = re.compile("^y|(?<=[aeiouy])y")


def _longest(word: str, suffixes) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


def _regions(word: str) -> tuple[int, int]:
    start = _BEGINNING.match(word) or _AFTER_SYLLABLE.search(word)
    first = start.end() if start else len(word)
    second = _AFTER_SYLLABLE.search(word, first)
    return first, second.end() if second else len(word)


def _plural(word: str) -> str:
    suffix = _longest(word, ("sses", "ied", "ies", "us", "ss", "s"))
    if suffix == "sses":
        return word[:-2]
    if suffix in ("ied", "ies"):
        return word[: -2 if len(word) > 4 else -1]
    return word[:-1] if suffix == "s" and _VOWEL.search(word[:-2]) else word


def _past(word: str, first: int) -> str:
    suffix = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    base = word[: len(word) - len(suffix)]
    if suffix.startswith("eed"):
        return base + "ee" if len(base) >= first else word
    if not suffix or not _VOWEL.search(base):
        return word
    if base.endswith(("at", "bl", "iz")):
        return base + "e"
    if base[-2:] in V.STEM_DOUBLES:
        return base[:-1]
    return base + "e" if len(base) <= first and _SHORT_END.search(base) else base


def _replaced(word: str, rules: dict[str, str], first: int, second: int) -> str:
    suffix = _longest(word, rules)
    base = word[: len(word) - len(suffix)]
    if not suffix or len(base) < (second if suffix == "ative" else first):
        return word
    if suffix == "ogi" and base[-1:] != "l" or suffix == "li" and base[-1:] not in V.STEM_LI:
        return word
    return base + rules[suffix]


def _without_ending(word: str, first: int, second: int) -> str:
    suffix = _longest(word, V.STEM_STEP_4)
    base = word[: len(word) - len(suffix)]
    if suffix and len(base) >= second and (suffix != "ion" or base[-1:] in ("s", "t")):
        word = base
    base = word[:-1]
    if word.endswith("e"):
        return base if len(base) >= second or len(base) >= first and not _SHORT_END.search(base) else word
    return base if word.endswith("ll") and len(base) >= second else word


@lru_cache(200_000)
def stem_word(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    if len(word) <= 2:
        return word
    word = word.removeprefix("'")
    if word in V.STEM_OWN:
        return V.STEM_OWN[word]
    word = _CONSONANT_Y.sub("Y", word)
    first, second = _regions(word)
    for suffix in ("'s'", "'s", "'"):
        if word.endswith(suffix):
            word = word[: -len(suffix)]
            break
    word = _plural(word)
    if word in V.STEM_STAYS:
        return word
    word = _past(word, first)
    if len(word) > 2 and word[-1] in "yY" and not _VOWEL.match(word[-2]):
        word = word[:-1] + "i"
    word = _replaced(word, V.STEM_STEP_2, first, second)
    word = _replaced(word, V.STEM_STEP_3, first, second)
    return _without_ending(word, first, second).replace("Y", "y")


def stem_lists(words: pa.ListArray) -> pa.ListArray:
    coded = words.flatten().dictionary_encode()
    stemmed = pa.array([w if w is None else stem_word(w) for w in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)
    sizes = words.value_lengths().fill_null(0).to_numpy()
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, stemmed, mask=words.is_null())


def stems(words: Column) -> Column:
    """The stems of an array of lower-case words, in order; null for a null array."""

    @F.arrow_udf("array<string>")
    def run(batch: pa.Array) -> pa.Array:
        return stem_lists(batch)

    return run(words)
