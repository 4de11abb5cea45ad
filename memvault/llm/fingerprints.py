"""Document fingerprints by one-permutation MinHash, in built-in functions alone.

A text's word shingles are hashed once; the top bits of a hash choose one of
``BINS`` bins and each bin keeps its least hash. An empty bin borrows from the first
full bin in its own random order of the bins (optimal densification), the same order
for every document. The low ``LOW_BITS`` bits of each bin are packed into 64-bit
words, written as hex. The share of equal bins, less what chance makes equal at
that many bits, estimates the Jaccard similarity.

Defined cases: a null or blank text has no shingles; its fingerprint is all zeros,
its likeness to another such text 1 and to any other text 0. Fewer words than the
shingle size make one shingle. Equal texts have equal fingerprints. Documents with the
same doc_id follow each other in the order of their texts; a table of one row is its own
next document.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memvault.llm.common import let, parallelism, words

#: Bins (a power of two), their number's bits, and the bits kept of each (8 to a byte).
BINS, BIN_BITS, LOW_BITS = 128, 7, 8
SHINGLE = 5
_PER_WORD = 64 // LOW_BITS
_LOWEST = 0x0101010101010101
#: Bins that an empty bin tries first; the rest of its order is only used when they are all empty.
_FIRST = 12


def _orders() -> list[list[int]]:
    """Each bin's own random order of the other bins."""
    rng = random.Random(7)
    return [rng.sample([b for b in range(BINS) if b != k], BINS - 1) for k in range(BINS)]


def shingle_hashes(text: Column) -> Column:
    """The 63-bit hashes of a text's shingles, in the order of the text."""

    def hashed(w: Column) -> Column:
        many = F.transform(
            F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)])
        )
        one = F.array(F.xxhash64(F.array_join(w, " ")))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(F.size(w) < SHINGLE, one).otherwise(many)

    positive = F.lit((1 << 63) - 1)
    return F.transform(let(words(text), hashed), lambda h: h.bitwiseAND(positive))


def _bin(h: Column) -> Column:
    return F.shiftrightunsigned(h, 63 - BIN_BITS)


def _least(sorted_hashes: Column) -> Column:
    """The first hash of each bin."""
    return F.filter(sorted_hashes, lambda h, i: (i == 0) | (_bin(h) != _bin(F.get(sorted_hashes, i - 1))))


def _densified(least: Column) -> Column:
    """One hash per bin, from the least hashes of the full bins."""
    orders = _orders()
    first = F.array(*[F.array(*map(F.lit, o[:_FIRST])) for o in orders])
    whole = F.array(*[F.array(*map(F.lit, o[_FIRST:])) for o in orders])

    def filled(bins: Column) -> Column:
        def of(k: Column) -> Column:
            return F.array_position(bins, k.cast("long"))

        def borrowed(tries: Column) -> Column:
            return F.get(F.filter(F.transform(tries, of), lambda p: p > 0), F.lit(0))

        def value(k: Column) -> Column:
            own = of(k)
            place = F.when(own > 0, own).otherwise(
                F.coalesce(borrowed(F.get(first, k)), borrowed(F.get(whole, k)))
            )
            return F.get(least, (place - 1).cast("int"))

        return F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), value)

    return F.when(F.size(least) == BINS, least).otherwise(let(F.transform(least, _bin), filled))


def packed(text: Column) -> Column:
    """The fingerprint as an array of 64-bit words; empty for a text without words."""

    def pack(values: Column) -> Column:
        low = F.lit((1 << LOW_BITS) - 1)
        # the bits above the bin number are the same all over a bin, so the low ones are taken
        return F.transform(
            F.sequence(F.lit(0), F.lit(BINS - _PER_WORD), F.lit(_PER_WORD)),
            lambda at: F.aggregate(
                F.slice(values, at + 1, _PER_WORD),
                F.lit(0).cast("long"),
                lambda acc, v: F.shiftleft(acc, LOW_BITS).bitwiseOR(v.bitwiseAND(low)),
            ),
        )

    def sign(hashes: Column) -> Column:
        least = let(F.sort_array(hashes), _least)
        return F.when(F.size(hashes) == 0, F.array().cast("array<bigint>")).otherwise(let(let(least, _densified), pack))

    return let(shingle_hashes(text), sign)


def to_hex(fingerprint: Column) -> Column:
    zeros = "0" * (BINS * LOW_BITS // 4)
    whole = F.array_join(F.transform(fingerprint, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")
    return F.when(F.size(fingerprint) == 0, F.lit(zeros)).otherwise(whole)


def likeness(a: Column, b: Column) -> Column:
    """The estimated Jaccard similarity of two fingerprints, corrected for chance and kept within 0 and 1."""

    def differing(x: Column) -> Column:
        y = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        y = y.bitwiseOR(F.shiftrightunsigned(y, 2))
        y = y.bitwiseOR(F.shiftrightunsigned(y, 4))
        return F.bit_count(y.bitwiseAND(F.lit(_LOWEST)))

    unlike = F.aggregate(F.zip_with(a, b, lambda x, y: differing(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    chance = 2.0**-LOW_BITS
    share = ((BINS - unlike) / F.lit(float(BINS)) - chance) / (1 - chance)
    one = F.lit(1.0)
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), one)
        .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
        .otherwise(F.greatest(F.lit(0.0), F.least(one, share)))
    )


def with_next(documents: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """documents with columns of the next row in descending doc_id order (after the last: the first).

    Rows are dealt into ranges of doc_id. Each range's first row is also dealt, as a guest, to
    the range before it, so that every row's next one is in its own range.
    """
    n = max(2, parallelism(documents.sparkSession))
    seen = documents.agg(
        F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000).alias("q"), F.max("doc_id").alias("top")
    ).first()
    cuts = sorted(set(seen["q"] or []))
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    # range k holds the ids above k cuts, as range numbers ascend with doc_id
    number = F.size(F.filter(bounds, lambda c: c < F.col("doc_id")))
    ranged = documents.withColumn("_range", F.when(F.col("doc_id").isNull(), -1).otherwise(number)).withColumn("_guest", F.lit(False))
    found = documents.select(F.when(F.col("doc_id").isNull(), -1).otherwise(number).alias("k"), "doc_id").groupBy("k").agg(F.max("doc_id").alias("first"))
    firsts = {row["k"]: row["first"] for row in found.collect()}  # a row per range
    order = sorted(firsts, reverse=True)
    after = {k: order[(i + 1) % len(order)] for i, k in enumerate(order)} if order else {}
    # the guest of range k comes from after[k]; a lone range follows itself
    hosts = {firsts[source]: k for k, source in after.items()}
    known = [F.lit(x) for first, k in hosts.items() if first is not None for x in (first, k)]
    guests = F.when(F.col("doc_id").isNull(), F.lit(hosts.get(None)))
    if known:
        ids = [first for first in hosts if first is not None]
        guests = guests.when(F.col("doc_id").isin(ids), F.try_element_at(F.create_map(*known), F.col("doc_id")))
    invited = ranged.withColumn("_host", guests).where("_host is not null")
    invited = invited.withColumn("_range", F.col("_host")).withColumn("_guest", F.lit(True)).drop("_host")
    by = Window.partitionBy("_range").orderBy("_guest", F.col("doc_id").desc_nulls_last(), "_tie")
    taken = {f"_next_{name}": F.lead(value).over(by) for name, value in columns.items()}
    return ranged.unionByName(invited).withColumns(taken).where(~F.col("_guest")).drop("_guest", "_range")


def fingerprints(documents: DataFrame, *, text: str = "text") -> DataFrame:
    """Per row: the fingerprints of the text and of its edited text, and likenesses to the edited and the next text."""
    base = documents.select("doc_id", F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    base = base.withColumn("_tie", F.xxhash64("_text")).withColumn("_fp", packed(F.col("_text")))
    rows = with_next(base, {"text": F.col("_text"), "fp": F.col("_fp")})
    n = F.char_length("_text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("_text", F.lit(1), n - cut), F.substring("_next_text", F.lit(1), cut))
    done = rows.withColumn("_edited", edited)
    done = done.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("_edited", 256).alias("edited_sha256"),
        "_fp",
        packed(F.col("_edited")).alias("_fpe"),
        "_next_fp",
    )
    return done.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        to_hex(F.col("_fp")).alias("fingerprint"),
        to_hex(F.col("_fpe")).alias("edited_fingerprint"),
        likeness(F.col("_fp"), F.col("_fpe")).alias("near_edited"),
        likeness(F.col("_fp"), F.col("_next_fp")).alias("near_next"),
    )
