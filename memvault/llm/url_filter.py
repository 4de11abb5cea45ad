"""URL rules by Bloom filter cascades over the corpus's complete key universe.

A rule is a key, host and path prefix in one string such as ``example.org/es/``. A
url's candidate keys are the host's last labels joined with beginnings of its path, for each
pair of numbers of labels and characters that some rule has. Lists of any length come in as tables. The first level of a cascade encodes the
listed keys, the second the corpus keys that pass the first though they aren't listed,
the third the listed keys that pass the second, and so on until nothing passes
wrongly. Over that universe the cascade is exact, and rows need no join. Allowed
and blocked keys have a cascade each; urls that no rule fits get ``default``.

Defined cases: a null url or one without ``://`` has an empty host and path, and no
rule fits. Hosts are lower-cased in A-Z only, paths not at all. Rows are judged one by
one, so repeated rows and null ids are kept.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memvault.llm.common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of one level (32 MB), and bits to which levels grow that let most of the other keys pass; what needs more is refused.
MAX_BITS, MOST_BITS = 1 << 28, 1 << 31
#: The share of the other keys that a level may let pass before it grows.
ENOUGH = 0.75
#: Pairs of numbers of labels and characters that rules may have.
SHAPES = 10_000


@dataclass(frozen=True)
class Rules:
    """Lists of keys: few as tuples, any number as tables with a column key."""

    allow: tuple[str, ...] | DataFrame
    block: tuple[str, ...] | DataFrame

    def tables(self, session: SparkSession) -> dict[str, DataFrame]:
        """Each list as a table, without nulls and repeats."""
        made = lambda keys: keys if isinstance(keys, DataFrame) else session.createDataFrame([(k,) for k in keys], "key string")
        return {n: made(k).select("key").where("key is not null").distinct() for n, k in (("allow", self.allow), ("block", self.block))}


def shapes(tables: dict[str, DataFrame]) -> list[tuple[int, int]]:
    """The pairs of numbers of labels and of path characters that keys have, those with most labels first."""
    keys = tables["allow"].unionByName(tables["block"])
    host_ = F.substring_index("key", "/", 1)
    shape = keys.select(F.size(F.split(host_, r"\.")).alias("k"), (F.char_length("key") - F.char_length(host_)).alias("n")).distinct().limit(SHAPES + 1)
    found = sorted(((r["k"], r["n"]) for r in shape.collect()), reverse=True)
    if len(found) > SHAPES:
        raise ValueError(f"rules have more than {SHAPES} pairs of numbers of labels and characters")
    return found


@dataclass(frozen=True)
class Level:
    words: np.ndarray  # the bits, in 64-bit words
    hashes: int
    seed: int

    def has(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        bits, out = np.uint64(len(self.words) * 64), np.ones(len(a), bool)
        for i in range(self.hashes):
            at = _place(a, b, i + self.seed) % bits
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def _place(a: np.ndarray, b: np.ndarray, i: int) -> np.ndarray:
    x = a + b * np.uint64(2 * i + 1)
    return x ^ (x >> np.uint64(29))


def host(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def candidate_keys(host_: Column, path_: Column, shapes: list[tuple[int, int]]) -> Column:
    """The keys that could be a rule for this host and path, the longest first; of equally long ones that with the longer host."""
    listed = F.from_json(F.lit(json.dumps([{"k": k, "n": n} for k, n in shapes])), "array<struct<k:int,n:int>>")
    labels = F.when(host_ != "", F.size(F.split(host_, r"\."))).otherwise(0)
    fits = F.filter(listed, lambda s: (s["k"] <= labels) & (s["n"] <= F.char_length(path_)))
    keys = F.transform(fits, lambda s: F.concat(F.call_function("substring_index", host_, F.lit("."), -s["k"]), F.substring(path_, F.lit(1), s["n"])))
    return F.array_sort(keys, lambda x, y: F.char_length(y) - F.char_length(x))  # a stable sort


def _hashes(keys: Column) -> tuple[Column, Column]:
    return F.transform(keys, lambda k: F.xxhash64(k)), F.transform(keys, lambda k: F.xxhash64(F.lit("second"), k))


def member(cascade: list[Level], h: tuple[Column, Column], session) -> Column:
    """An array of booleans: which keys (by their two hash arrays) the cascade holds as listed."""
    known = session.sparkContext.broadcast(cascade)

    def test(first: pa.Array, second: pa.Array) -> pa.Array:
        a = first.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        b = second.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        sizes = first.value_lengths().to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(_inside(known.value, a, b)))

    return F.arrow_udf(test, T.ArrayType(T.BooleanType()))(*h)


def _inside(cascade: list[Level], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A key is listed if the first level that lacks it is an even one (counted from 1), or none lacks it and levels are odd."""
    out, open_ = np.zeros(len(a), bool), np.ones(len(a), bool)
    for depth, level in enumerate(cascade):
        hit = level.has(a, b) & open_
        out[open_ & ~hit] = depth % 2 == 1
        open_ = hit
    out[open_] = len(cascade) % 2 == 1
    return out


def _level(keys: DataFrame, n: int, rate: float, depth: int, most: int) -> Level:
    """A Bloom filter of keys (a, b) at a false-positive rate, of at most so many bits."""
    bits = min(most, max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2)))
    n_words = -(-bits // 64)
    hashes = max(1, round(-math.log2(rate)))
    seed = 64 * depth
    schema = "w long, b long"

    def places(batches):
        for batch in batches:
            a, b = (batch.column(c).to_numpy().view(np.uint64) for c in "ab")
            at = np.concatenate([_place(a, b, i + seed) % np.uint64(n_words * 64) for i in range(hashes)])
            word = (at >> np.uint64(6)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["w", "b"])

    found = keys.select("a", "b").mapInArrow(places, schema).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()  # at most n_words rows
    words = np.zeros(n_words, dtype=np.uint64)
    words[found["w"].to_numpy(np.int64)] = found["b"].to_numpy(np.int64).view(np.uint64)
    return Level(words, hashes, seed)


def _passing(keys: DataFrame, level: Level) -> DataFrame:
    known = keys.sparkSession.sparkContext.broadcast(level)

    def test(batches):
        for batch in batches:
            a, b = (batch.column(c).to_numpy().view(np.uint64) for c in "ab")
            yield batch.filter(pa.array(known.value.has(a, b)))

    return keys.mapInArrow(test, keys.schema)


def cascade(listed: DataFrame, universe: DataFrame) -> list[Level]:
    """Levels for listed over universe, each a DataFrame of (key, a, b); only keys that pass a level wrongly are gathered.

    A level that lets too many of the other keys pass is made again with twice the bits, so each level
    leaves fewer; ValueError if MOST_BITS don't suffice.
    """
    listed = written(listed.distinct(), "listed")
    n, seen = listed.count(), universe.count()
    if not n:
        return []
    others = universe.join(listed.select("key"), "key", "left_anti").select("key", "a", "b").distinct()
    levels: list[Level] = []
    inside, outside, most, rate = listed, None, MAX_BITS, min(0.5, n / (2 * max(seen, 1)))
    count, left = n, None  # keys inside, and of those outside that are still open
    while count:
        level = _level(inside, count, rate, len(levels), most)
        passed = _passing(universe, level).join(listed.select("key"), "key", "left_anti").select("key", "a", "b").distinct() if outside is None else _passing(outside, level)
        passed = written(passed, "wrong")
        passing = passed.count()
        if left is None and passing > 0 and most < MOST_BITS and len(level.words) * 64 >= most:
            left = others.count()
        if left is not None and passing > ENOUGH * left and len(level.words) * 64 >= most:
            if most >= MOST_BITS:
                raise ValueError(f"{count} keys need levels of more than {MOST_BITS} bits")
            most = min(2 * most, MOST_BITS)
            continue
        levels.append(level)
        # what has passed wrongly is encoded next, and tried on what this level holds
        inside, outside, count, left, rate = passed, inside, passing, count, 0.5
    return levels


def judge(pages: DataFrame, rules: Rules, *, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict.

    Columns of pages with one of these names are replaced; names that begin with two underscores
    are kept for the operator. A null url, or one without ://, has an empty host and path and fits no rule.
    """
    session = pages.sparkSession
    link = F.col(f"`{url}`")
    parsed = pages.withColumns({"__host": host(link), "__path": path(link)}).drop("host", "path", "rule", "verdict").withColumnsRenamed({"__host": "host", "__path": "path"})
    tables = rules.tables(session)
    keyed = parsed.withColumn("__keys", candidate_keys(F.col("host"), F.col("path"), shapes(tables)))
    hashed = lambda df: df.select("key", F.xxhash64("key").alias("a"), F.xxhash64(F.lit("second"), F.col("key")).alias("b"))
    universe = written(hashed(keyed.select(F.explode("__keys").alias("key"))), "universe")
    found = keyed
    for name, keys in tables.items():
        found = found.withColumn(f"__{name}", member(cascade(hashed(keys), universe), _hashes(F.col("__keys")), session))
    hits = F.filter(
        F.arrays_zip("__keys", "__allow", "__block"), lambda x: F.coalesce(x["__allow"], F.lit(False)) | F.coalesce(x["__block"], F.lit(False))
    )
    best = F.get(hits, F.lit(0))
    verdict = F.when(best.isNull(), F.lit(default)).when(best["__allow"], F.lit("allow")).otherwise(F.lit("block"))
    return found.select(*parsed.columns, best["__keys"].alias("rule"), verdict.alias("verdict"))
