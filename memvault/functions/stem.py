"""Stems of English words by the published suffix rules (Porter, 1980), applied once per distinct term of a batch."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: the rules of each step, the longest ending first where several fit
PLURALS = (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", ""))
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
    ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
    ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
#: Words that keep their form: shorter than this.
SHORTEST = 3
_PLAIN = re.compile("[a-z]+")


def _shape(word: str) -> str:
    """v for each vowel and c for each consonant; y is a vowel after a consonant."""
    out = ""
    for i, letter in enumerate(word):
        out += "v" if letter in "aeiou" or (letter == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(word: str) -> int:
    """How often vowels are followed by consonants."""
    return len(re.findall("v+c+", _shape(word)))


def _short_end(word: str) -> bool:
    """Whether a word ends in consonant, vowel and a consonant other than w, x and y."""
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _replaced(word: str, rules: tuple[tuple[str, str], ...]) -> str:
    """The first rule whose ending fits decides; it applies only to what has a measure above 0."""
    for ending, new in sorted(rules, key=lambda r: -len(r[0])):
        if word.endswith(ending):
            rest = word[: -len(ending)]
            return rest + new if _measure(rest) > 0 else word
    return word


def _past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for ending in ("ed", "ing"):
        rest = word.removesuffix(ending)
        if rest != word:
            if "v" not in _shape(rest):
                return word
            if rest.endswith(("at", "bl", "iz")):
                return rest + "e"
            if len(rest) > 1 and rest[-1] == rest[-2] and _shape(rest)[-1] == "c" and rest[-1] not in "lsz":
                return rest[:-1]
            return rest + "e" if _measure(rest) == 1 and _short_end(rest) else rest
    return word


def _residue(word: str) -> str:
    for ending in sorted(STEP_4, key=len, reverse=True):
        if word.endswith(ending):
            rest = word[: -len(ending)]
            return rest if _measure(rest) > 1 and (ending != "ion" or rest.endswith(("s", "t"))) else word
    return word


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case term; terms with other signs than a to z stay."""
    if len(word) < SHORTEST or not _PLAIN.fullmatch(word):
        return word
    for ending, new in PLURALS:
        if word.endswith(ending):
            word = word[: len(word) - len(ending)] + new
            break
    word = _past(word)
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _residue(_replaced(_replaced(word, STEP_2), STEP_3))
    if word.endswith("e"):
        rest = word[:-1]
        if _measure(rest) > 1 or (_measure(rest) == 1 and not _short_end(rest)):
            word = rest
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def stems(terms: Column) -> Column:
    """The stems of a column of terms."""

    def run(column: pa.Array) -> pa.Array:
        coded = column.dictionary_encode()
        known = pa.array([stem(t) if t is not None else None for t in coded.dictionary.to_pylist()], pa.string())
        return known.take(coded.indices)

    return F.arrow_udf(run, T.StringType())(terms)
