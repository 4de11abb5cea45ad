"""Candidate records from conversations, by rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memvault.functions import rules
from memvault.functions.text import BLANKS, trim

_SPEAKER = r"^(?i)\[?(user|assistant|human|system|ai|bot|client|agent|person|[A-Z][a-z]+)\]?:\s*"
_FILLER = "^(?i)(?:(?:" + "|".join(re.escape(f).replace("\\ ", " ") for f in rules.FILLERS) + r")\s*|[-*:.]\s*)+"
_JOINERS = r"^(?i)(?:also |and |so |furthermore |additionally )\s*"
#: Least bytes of a turn, a sentence, and a sentence without fillers.
TURN, SENTENCE, BARE = 10, 12, 10


def turns_of_text(documents: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, turn, role, text) of a JSON array of messages, of JSON lines, or of plain lines.

    Messages of an array hold content (by role) or text (by speaker); JSON lines count only with content. Whoever is
    not named is the user. Without any such message the lines themselves are the turns.
    """
    body = F.col(text)
    lines = F.filter(F.transform(F.split(body, r"\r?\n"), trim), lambda x: x != "")
    said = lambda v, key: F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant")) == "STRING", F.try_variant_get(v, f"$.{key}", "string"))
    by = lambda v, key: F.coalesce(said(v, key), F.lit("user"))
    content = lambda v: F.when(said(v, "content").isNotNull(), F.struct(by(v, "role").alias("role"), said(v, "content").alias("text")))
    spoken = lambda v: F.when(said(v, "text").isNotNull(), F.struct(by(v, "speaker").alias("role"), said(v, "text").alias("text")))
    listed = F.when(F.ltrim(body, F.lit(BLANKS)).startswith("["), F.try_variant_get(F.try_parse_json(body), "$", "array<variant>"))
    of_array = F.array_compact(F.transform(listed, lambda v: F.coalesce(content(v), spoken(v))))
    objects = F.transform(F.filter(lines, lambda x: x.startswith("{") & x.endswith("}")), F.try_parse_json)
    of_lines = F.array_compact(F.transform(objects, content))
    plain = F.transform(
        F.filter(F.transform(lines, lambda x: F.regexp_replace(x, r"^(?:- |\* |• )", "")), lambda x: F.octet_length(x) >= TURN),
        lambda x: F.struct(F.lit(None).cast("string").alias("role"), x.alias("text")),
    )
    turns = F.when(F.size(of_array) > 0, of_array).when(F.size(of_lines) > 0, of_lines).otherwise(plain)
    rows = documents.select("doc_id", F.posexplode(turns).alias("turn", "t"))
    return rows.select("doc_id", "turn", "t.role", "t.text")


def _sentences(body: Column) -> Column:
    """Pieces between line feeds and semicolons, cut after . or ! before a blank; SENTENCE bytes or more."""
    chunks = F.split(body, "[\n;]")
    cut = F.flatten(F.transform(chunks, lambda c: F.split(trim(c), r"(?<=[.!])\s+")))
    bare = F.transform(cut, lambda s: trim(F.regexp_replace(F.regexp_replace(trim(s), r"\.+$", ""), r"!+$", "")))
    found = F.filter(bare, lambda s: F.octet_length(s) >= SENTENCE)
    return F.when(F.size(found) > 0, found).otherwise(F.array(trim(body)))


def _first(tests: list[tuple[Column, Column]], default: Column) -> Column:
    out = None
    for test, value in tests:
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(default)


def classified(sentences: DataFrame) -> DataFrame:
    """sentences (speaker, sentence) with category and confidence; those not worth keeping are dropped."""
    body = F.regexp_replace(F.regexp_replace(F.col("sentence"), _SPEAKER, ""), _FILLER, "")
    body = trim(F.regexp_replace(trim(body), _JOINERS, ""))
    rows = sentences.withColumn("body", body).withColumn("low", F.lower("body")).where(F.octet_length("body") >= BARE)
    low = F.col("low")
    question = low.endswith("?") | rules.any_of(low, rules.QUESTIONS, ())
    rows = rows.where(~question & ~low.isin(*rules.ACKNOWLEDGEMENTS))
    general = (F.size(F.split("body", r"\s+")) >= 4) & F.col("body").rlike(" (?:is|are|has|using) ")
    tests = [(rules.any_of(low, begins, parts), F.lit(category), F.lit(c)) for category, c, parts, begins in rules.SENTENCE_RULES]
    tests.append((general, rules.category_of(F.col("body")), F.lit(0.85)))
    none = F.lit(None).cast("string")
    rows = rows.withColumn("category", _first([(t, c) for t, c, _ in tests], none))
    rows = rows.withColumn("confidence", _first([(t, c) for t, _, c in tests], F.lit(0.0)))
    return rows.where("category is not null")


def _rewritten(body: Column, speaker: Column) -> Column:
    """A user's first person in the third."""
    low = F.lower(body)
    tests = [(low.startswith(b), F.concat(F.lit(new), F.substring(body, len(b) + 1, 1 << 30))) for b, new in rules.REWRITES]
    return F.when(F.lower(speaker).isin("user", "human"), _first(tests, body)).otherwise(body)


def title_of(content: Column, category: Column) -> Column:
    words = F.split(trim(content), r"\s+")
    parts = F.split(content, ":", 2)
    rest = trim(F.element_at(parts, -1))
    labelled = (F.size(parts) == 2) & (F.size(F.split(trim(parts[0]), r"\s+")) <= 3) & (rest != "")
    short = F.concat(trim(parts[0]), F.lit(": "), F.array_join(F.slice(F.split(rest, r"\s+"), 1, 5), " "))
    first = F.array_join(F.slice(words, 1, 6), " ")
    cut = F.when(F.octet_length(first) > 50, F.concat(F.substring(first, 1, 47), F.lit("..."))).otherwise(first)
    return F.when(labelled, short).otherwise(cut)


def tags_of(content: Column, category: Column) -> Column:
    low = F.lower(content)
    words = F.split(low, r"[^\p{L}\p{N}\-]+")
    tests = [F.when(F.array_contains(words, w) if len(w) <= 3 else low.contains(w), F.lit(w)) for w in rules.TAG_WORDS]
    return F.array_distinct(F.concat(F.array(category), F.array_compact(F.array(*tests))))


def candidates(turns: DataFrame, *, key: tuple[str, ...] = ("conv_id",), threshold: float = 0.85, category: str | None = None, extra_tags: tuple[str, ...] = ()) -> DataFrame:
    """key, turn, category, title, content, tags, confidence of turns (key, turn, role, text), the first of equal ones.

    A category given takes the place of the one found, before equal ones are told; extra tags are added where they lack in any case.
    """
    inline = F.regexp_extract("text", _SPEAKER, 1)
    speaker = F.when(inline != "", inline).otherwise(F.col("role"))
    body = trim(F.regexp_replace(trim(F.regexp_replace("text", _SPEAKER, "")), _FILLER, ""))
    rows = turns.select(*key, "turn", speaker.alias("speaker"), body.alias("b")).where(F.octet_length("b") >= SENTENCE)
    rows = rows.select(*key, "turn", "speaker", F.posexplode(_sentences(F.col("b"))).alias("place", "sentence"))
    found = classified(rows).withColumn("content", _rewritten(F.col("body"), F.col("speaker"))).where(F.col("confidence") >= threshold)
    found = found.withColumn("_found", F.col("category")).withColumn("category", F.col("category") if category is None else F.lit(category))
    found = found.withColumn("_k", F.concat_ws(":", "category", F.lower(trim(F.col("content")))))
    first = Window.partitionBy(*key, "_k").orderBy("turn", "place")
    found = found.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    more = list(dict.fromkeys(t.strip().lower() for t in extra_tags if t.strip()))
    own = tags_of(F.col("content"), F.col("_found"))
    low = F.transform(own, lambda t: F.lower(t))
    tags = F.concat(own, F.filter(F.array(*map(F.lit, more)), lambda t: ~F.array_contains(low, t))) if more else own
    return found.select(
        *key,
        "turn",
        "place",
        "category",
        title_of(F.col("content"), F.col("_found")).alias("title"),
        "content",
        tags.alias("tags"),
        "confidence",
    )
