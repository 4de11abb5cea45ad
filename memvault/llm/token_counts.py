"""Token counts by a two-tier lookup on the map side.

A text is cut at spaces and line feeds, where no pre-token and no special string
can span. The first tier is a broadcast table of the lengths of frequent parts
(at most ``FREQUENT`` parts of at most ``LONGEST`` bytes, so under 4 MB); it is
found over all documents by frequent-item sketches, which are merged instead of
the parts themselves. Parts that it lacks are encoded by the tokenizer and kept
in a bounded cache per worker. No part is ever shuffled, and the tables only
save work: any content of them gives the same counts.

Defined cases: a null or empty text has 0 bytes and 0 tokens. Rows are counted
one by one, so repeated rows and rows without a doc_id are kept. Other columns
pass through.
"""

from __future__ import annotations

from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memvault.llm import tokens

#: Parts in the broadcast table, and the bytes of the longest.
FREQUENT, LONGEST = 32_768, 48
#: Items that a sketch tracks, and sketches that are built side by side before they are merged.
TRACKED, SKETCHES = 65_536, 64


#: Characters of a part that a cache holds at most; so a cache of KEPT_PARTS parts has bounded bytes.
KEPT_LENGTH = 128


def frequent_parts(documents: DataFrame, text: str = "text") -> list[str]:
    """About the most frequent parts of all texts, by sketches of bounded size."""
    part = F.explode(F.split(F.col(f"`{text}`"), "[ \n]+")).alias("part")
    found = (
        documents.select(F.pmod(F.spark_partition_id(), F.lit(SKETCHES)).alias("k"), part)
        .where((F.col("part") != "") & (F.octet_length("part") <= LONGEST))
        .groupBy("k")
        .agg(F.expr(f"approx_top_k_accumulate(part, {TRACKED})").alias("sketch"))
        .groupBy(F.pmod("k", F.lit(1)))  # one group; a global aggregate would also merge the sketch of an empty partition, which has no type
        .agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(sketch, {TRACKED}), {FREQUENT})").alias("top"))
        .first()
    )
    return [row["item"] for row in found["top"]] if found else []


@cache
def _misses(path: str) -> dict[str, int]:
    """This worker's cache for a tokenizer."""
    return {}


def lengths(path: str, texts: list[str]) -> list[int]:
    return [len(x) for x in tokens.load(path).encode_batch_fast(texts, add_special_tokens=False)]


def count_tokens(text: str, path: str, frequent: dict[str, int]) -> int:
    """Tokens of a whole text."""
    missed, total = _misses(path), 0
    for piece in tokens.segments(text):
        parts = piece.replace("\n", " ").split(" ")
        found = list(map(frequent.get, parts))
        if None in found:
            rest = [p for p, n in zip(parts, found, strict=True) if n is None]
            long = [p for p in rest if len(p) > KEPT_LENGTH]
            if long:
                total += sum(lengths(path, long))
                rest = [p for p in rest if len(p) <= KEPT_LENGTH]
            new = list(set(rest).difference(missed))
            if new:
                if len(missed) > tokens.KEPT_PARTS:
                    missed.clear()
                    new = list(set(rest))
                missed.update(zip(new, lengths(path, new), strict=True))
            total += sum(map(missed.__getitem__, rest))
            found = [n for n in found if n is not None]
        total += sum(found)
    return total


def with_token_counts(
    documents: DataFrame, tokenizer: str, *, text: str = "text", limit: int = 2048, names: tuple[str, str, str] = ("n_bytes", "n_tokens", "over_limit")
) -> DataFrame:
    """documents with bytes, tokens and whether the tokens are over limit, under names."""
    common = frequent_parts(documents, text)
    table = dict(zip(common, lengths(tokenizer, common), strict=True)) if common else {}
    table[""] = 0
    frequent = documents.sparkSession.sparkContext.broadcast(table)

    def count(texts: pa.Array) -> pa.Array:
        known = frequent.value
        return pa.array([count_tokens(x.as_py(), tokenizer, known) if x.is_valid else 0 for x in texts], pa.int64())

    n_bytes, n_tokens, over = names
    body = F.col(f"`{text}`")
    counted = documents.withColumns(
        {n_bytes: F.octet_length(F.coalesce(body, F.lit(""))).cast("long"), n_tokens: F.arrow_udf(count, T.LongType())(body)}
    )
    return counted.withColumn(over, F.col(f"`{n_tokens}`") > limit)
