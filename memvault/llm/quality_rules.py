"""Quality rules as a ledger of failure bits.

Each rule is evaluated once per document. The ledger keeps one bit per failed
rule and the measurements behind it; a policy is a bit mask with a version, so
verdicts of any policy and the ablation of each rule are bitwise operations on
the ledger and never read the texts again. Everything is built-in functions.

Defined cases: a null or blank text has no words, all measurements 0, and fails
``few_words``. Repeated rows are judged row by row. Other columns pass through
untouched under ``keep``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memvault.llm.common import BLANK_RUN, let, words

#: Bit number of each rule; bits are never reused for another rule.
RULES = {
    "few_words": 0,
    "repeated_words": 1,
    "word_length": 2,
    "symbols": 3,
    "repeated_lines": 4,
    "shouting": 5,
}


@dataclass(frozen=True)
class Policy:
    """A versioned choice of rules."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << RULES[r] for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_words"))
STANDARD = Policy("standard", 1, tuple(RULES))
MEASUREMENTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals")
#: Up to so many different repeated windows are looked up one by one; more are found by sorting.
FEW_WINDOWS = 32


def _covered(starts: Column) -> Column:
    """Words in the 3-word windows that begin at starts (ascending)."""
    gains = F.transform(starts, lambda s, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - s, F.lit(3))))
    return F.aggregate(gains, F.lit(0).cast("long"), lambda a, x: a + x)


def _repeat_words(word_list: Column) -> Column:
    """Words inside 3-word windows that occur twice or more; windows are compared by 64-bit hash."""

    def windows(w: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        )

    def few(hashes: Column, twice: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(hashes) - 1)
        return let(F.filter(at, lambda i: F.array_contains(twice, F.get(hashes, i))), _covered)

    def many(hashes: Column) -> Column:
        def starts(z: Column) -> Column:
            same = F.transform(
                z,
                lambda e, j: F.when(
                    (e["h"] == F.get(z, j - 1)["h"]) | (e["h"] == F.get(z, j + 1)["h"]), e["i"]
                ),
            )
            return F.sort_array(F.array_compact(same))

        keyed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(let(keyed, starts), _covered)

    def repeated(hashes: Column) -> Column:
        def among(s: Column) -> Column:
            return F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i - 1)))

        return let(
            let(F.sort_array(hashes), among),
            lambda twice: F.when(F.size(twice) <= FEW_WINDOWS, few(hashes, twice)).otherwise(many(hashes)),
        )

    return F.when(F.size(word_list) < 4, F.lit(0).cast("long")).otherwise(
        let(
            let(word_list, windows),
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(repeated(h)),
        )
    )


def measure(text: Column) -> dict[str, Column]:
    """The measurements that need the text alone (the word list is taken from column _words)."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.split(whole, "\n")
    full = F.filter(lines, lambda line: F.btrim(line, F.lit(" \t\n\x0b\x0c\r")) != "")
    return {
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": let(full, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
        "n_repeat_words": _repeat_words(F.col("_words")),
        "n_capitals": F.char_length(F.regexp_replace(whole, "[^A-Z]+", "")).cast("long"),
    }


def failures() -> dict[str, Column]:
    """Whether each rule fails, from the measurements."""
    n = F.col("n_words")
    return {
        "few_words": n < 50,
        "repeated_words": 100 * F.col("n_repeat_words") > 50 * n,
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n),
        "symbols": 100 * F.col("n_symbols") > 20 * n,
        "repeated_lines": 100 * F.col("n_dup_lines") > 50 * F.col("n_lines"),
        "shouting": 2 * F.col("n_capitals") > F.col("word_chars"),
    }


def ledger(documents: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, the measurements and fail_bits (long), one row per row of documents."""
    base = documents.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text"))
    base = base.withColumn("_words", words(F.col("_text")))
    measured = base.select(*[F.col(f"`{c}`") for c in keep], *[c.alias(n) for n, c in measure(F.col("_text")).items()])
    bits = F.lit(0).cast("long")
    for name, failed in failures().items():
        bits = bits.bitwiseOR(F.when(failed, F.lit(1 << RULES[name])).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("fail_bits", bits)


def passes(policy: Policy, bits: Column | None = None) -> Column:
    """Whether a ledger row passes a policy."""
    return (F.col("fail_bits") if bits is None else bits).bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def ablate(rows: DataFrame, policies: tuple[Policy, ...]) -> DataFrame:
    """Per policy and rule: documents that fail the rule, and that the policy would keep without it.

    The ledger is first reduced to counts per bit pattern (at most 2 ** len(RULES) rows).
    """
    spark = rows.sparkSession
    patterns = rows.groupBy("fail_bits").agg(F.count("*").alias("n"))
    grid = spark.createDataFrame(
        [(p.name, p.version, r, p.mask, 1 << RULES[r]) for p in policies for r in p.rules],
        "policy string, version int, rule string, mask long, bit long",
    )
    failed = F.col("fail_bits").bitwiseAND(F.col("mask"))
    return (
        patterns.join(F.broadcast(grid), F.col("fail_bits").bitwiseAND(F.col("bit")) != 0)
        .groupBy("policy", "version", "rule")
        .agg(F.sum("n").alias("n_failed"), F.sum(F.when(failed == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"))
    )


def kept_documents(documents: DataFrame, policy: Policy = STANDARD, *, text: str = "text") -> DataFrame:
    """The rows of documents that pass the base rules and a policy, with all their columns."""
    whole = documents.select(F.struct("*").alias("_row"), F.col(f"`{text}`").alias("_text_"))
    rows = ledger(whole, text="_text_", keep=("_row",)).where(passes(BASE) & passes(policy))
    return rows.select(*[F.col(f"_row.`{c}`") for c in documents.columns])


def judge(documents: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """The ledger with base_failed and kept under a policy."""
    return ledger(documents).select(
        "doc_id",
        *MEASUREMENTS,
        "fail_bits",
        (~passes(BASE)).alias("base_failed"),
        (passes(BASE) & passes(policy)).alias("kept"),
    )
