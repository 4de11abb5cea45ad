"""Answer selection: evidence gate, entity shortcut, grounding, span rules."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memvault.functions.modeltext import json_slice
from memvault.functions.text import content_tokens, trim
from memvault.plans.cut import stored

#: Score that stands for evidence where no lexical rank does.
EVIDENCE = 0.35
NO_EVIDENCE = "insufficient evidence"
# fixed values: words that ask for a summary, phrases that ask for several things
SUMMARY_WORDS = ("summarize", "summarise", "summary", "overview", "recap")
LIST_PHRASES = (
    " list all ", " list my ", " list the ", " all my ", " all of my ", " all the ", " what are my ", " what are the ",
    " what are all ", " which are my ", " which are the ", " show me all ", " show my ", " tell me about my ",
    " tell me about all ", " describe my ", " explain my ",
)
# fixed values: words that frame a summary
FRAMING = (
    "also additionally furthermore moreover including include includes summary summarize overall based mentioned noted across "
    "earlier currently several multiple various primarily key details history records memories goals goal plan planned ranging "
    "between through having"
).split()
# fixed values: signs of a span that says nothing
EMPTY_SPANS = ("not been ", "not recorded", "not specified", "not provided", "x0000x", "xxxx", "***")

# fixed values: answers, and parts of answers, by which a model says that it found nothing
NO_ANSWERS = ("null", "none", "n/a", "unknown", "not recorded", "insufficient evidence")
NO_ANSWER_PARTS = (
    "not been recorded", "insufficient evidence", "no matching memory", "no relevant memory", "not mentioned in", "cannot determine",
)
#: Confidence of an answer that names none; least confidence of an entity's value; margin at which a first span decides alone.
UNSTATED, SURE, EARLY = 0.85, 0.95, 11.0


def has_evidence() -> Column:
    return F.col("bm25_rank").isNotNull() | (F.col("score") >= EVIDENCE)


def gated(hits: DataFrame, limit: int = 10) -> DataFrame:
    return hits.where(has_evidence()).orderBy(F.col("score").desc(), "id").limit(limit)


def top_answer(hits: DataFrame) -> DataFrame:
    """The best hit's title as the answer, or that there is no evidence; no row without hits."""
    best = hits.orderBy(F.col("score").desc(), "id").limit(1)
    return best.select(
        F.when(has_evidence(), F.col("title")).otherwise(NO_EVIDENCE).alias("answer"),
        F.when(has_evidence(), F.col("id")).alias("selected"),
        F.when(has_evidence(), F.col("score")).otherwise(0.0).alias("confidence"),
        F.lit("top1").alias("engine"),
    )


def is_synthesis(question: Column) -> Column:
    low = F.lower(F.trim(question))
    padded = F.concat(F.lit(" "), low, F.lit(" "))
    summary = F.exists(F.split(low, r"[^\p{L}\p{N}]+"), lambda w: w.isin(*SUMMARY_WORDS))
    several = padded.rlike("|".join(map(re.escape, LIST_PHRASES)).replace("\\ ", " "))
    asks = low.rlike("^(?:what |which )") & padded.rlike(" do i have| i have| have i ") & ~low.rlike("^(?:what is |what's )")
    return summary | several | asks


def entity_answer(hits: DataFrame, entities: DataFrame, question: str, memories: DataFrame | None = None) -> DataFrame:
    """(slot, answer, selected, confidence): at most one row, the first hit's first slot that answers the question by itself.

    The question must name the slot as whole words, but not its value; and no other hit may have a slot of that name or,
    if the hits' records are given, its words in the content. The confidence is the record's, 0.95 at least.
    """
    asked = F.lit(" " + " ".join(w for w in re.split(r"[\W_]+", question.lower()) if w) + " ")
    words = lambda c: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    seen = stored(hits.select(F.col("id").alias("memory_id"), "score"))  # the hits of one recall, found once
    name, value = words(F.col("entity_name")), words(F.col("entity_val"))
    slots = stored(entities.join(F.broadcast(seen), "memory_id").withColumns({"_name": name, "_value": value}))
    told = None
    if memories is not None:
        told = stored(memories.join(F.broadcast(seen.select(F.col("memory_id").alias("id"))), "id", "left_semi").select("id", "content", "confidence"))
    sure = F.greatest(F.lit(SURE), F.col("_sure"))
    if told is None:
        said, known = slots.select("memory_id", "_name").limit(0), seen.select("memory_id", F.lit(0.0).alias("_sure"))
    else:
        named = F.broadcast(slots.select("_name").where("trim(_name) <> ''").distinct())  # slots of the hits
        said = told.join(named, words(F.col("content")).contains(F.col("_name"))).select(F.col("id").alias("memory_id"), "_name")
        known = told.select(F.col("id").alias("memory_id"), F.col("confidence").alias("_sure"))
    held = slots.select("memory_id", "_name").unionByName(said).distinct().groupBy("_name").agg(F.count("*").alias("_n"))
    fits = (F.trim("_name") != "") & (F.trim("_value") != "") & asked.contains(F.col("_name")) & ~asked.contains(F.col("_value")) & (F.col("_name") != F.col("_value"))
    found = slots.where(fits).join(held.where("_n = 1"), "_name").join(known, "memory_id")
    first = found.orderBy(F.col("score").desc(), "memory_id", "entity_name", "entity_val").limit(1)
    return first.select(F.lower("entity_name").alias("slot"), F.col("entity_val").alias("answer"), F.col("memory_id").alias("selected"), sure.alias("confidence"))


def span_answers(spans: DataFrame, paired: bool = True) -> DataFrame:
    """(question, answer, selected, confidence) from the spans (question, place, id, score, span, margin) that a model found in gated records.

    place counts a question's gated records from 0. Spans that aren't valid don't count. The first record's span decides alone if
    its margin is EARLY or more; else the largest sum of the margin and half the record's score, the first of equals.
    A question without a valid span has no row.
    """
    valid = spans.where(is_valid_span(F.col("span"), F.col("margin"), F.col("question"), paired))
    joint = F.col("margin") + F.col("score") * 0.5
    early = (F.col("place") == 0) & (F.col("margin") >= EARLY)
    weight = F.when(early, F.col("margin")).otherwise(joint)
    best = valid.groupBy("question").agg(F.max_by(F.struct("span", "id", weight.alias("weight")), F.struct(early.alias("early"), joint.alias("joint"), (-F.col("place")).alias("place"))).alias("b"))
    return best.select("question", F.col("b.span").alias("answer"), F.col("b.id").alias("selected"), confidence_of(F.col("b.weight")).alias("confidence"))


def _quoted(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\.\[\](){}*+?^$|\-&~#])", r"\\$1")


def grounded(answer: Column, content: Column) -> Column:
    """Whether the answer stands in the content between other signs than letters, digits and underscores."""
    edge = r"[^\p{L}\p{N}_]"
    return F.regexp_like(content, F.concat(F.lit(f"(?iu)(?:^|{edge})"), _quoted(answer), F.lit(f"(?:$|{edge})")))


def is_grounded(answer: Column, title: Column, content: Column) -> Column:
    """The answer as it stands, or all of its two or more content tokens."""
    tokens = content_tokens(answer)
    have = F.array_union(content_tokens(content), content_tokens(title))
    return grounded(answer, content) | grounded(answer, title) | ((F.size(tokens) >= 2) & (F.size(F.array_except(tokens, have)) == 0))


def is_synthesis_grounded(answer: Column, corpus: Column) -> Column:
    """Every token with a digit occurs in the corpus (one text), and of the others 65 % and two at least."""
    tokens, have = content_tokens(answer), content_tokens(corpus)
    digits = F.filter(tokens, lambda t: t.rlike("[0-9]"))
    real = F.filter(tokens, lambda t: ~t.isin(*FRAMING))
    stem = lambda t, n: F.substring(t, F.lit(1), F.char_length(t) - n)
    known = F.filter(
        real,
        lambda t: F.array_contains(have, t)
        | (t.endswith("s") & (F.octet_length(t) >= 4) & F.array_contains(have, stem(t, 1)))
        | (t.endswith("es") & (F.octet_length(t) >= 5) & F.array_contains(have, stem(t, 2))),
    )
    enough = (F.size(known) >= F.least(F.size(real), F.lit(2))) & (100 * F.size(known) >= 65 * F.size(real))
    return (F.size(real) > 0) & (F.size(F.array_except(digits, have)) == 0) & enough


def confidence_of(margin: Column) -> Column:
    return F.greatest(F.lit(0.05), F.least(F.lit(0.99), 1 / (1 + F.exp(-margin / 5))))


def clean_span(raw: Column) -> Column:
    """A span without outer signs, unmatched or enclosing brackets, and a short label."""
    s = F.regexp_replace(raw, r"(?U)^[\s,;.'\"`]+|[\s,;.'\"`]+$", "")
    inside = s.startswith("(") & s.endswith(")") & (F.char_length(s) > 2)
    s = (
        F.when(inside, F.trim(F.regexp_replace(s, r"^\(|\)$", "")))
        .when(s.startswith("(") & ~s.contains(")"), F.trim(F.regexp_replace(s, r"^\(+", "")))
        .when(s.endswith(")") & ~s.contains("("), F.trim(F.regexp_replace(s, r"\)+$", "")))
        .otherwise(s)
    )
    left, right = F.trim(F.element_at(F.split(s, ":", 2), 1)), F.element_at(F.split(s, ":", 2), -1)
    timed = left.rlike("^[0-9]*$") | (left.rlike("[0-9]$") & right.rlike("^[0-9]"))
    label = s.contains(":") & ~s.contains("://") & (left != "") & (F.trim(right) != "") & (F.size(F.split(left, r"\s+")) <= 4) & ~timed
    return F.regexp_replace(F.when(label, F.trim(right)).otherwise(s), r"(?U)^[\s,;.'\"]+|[\s,;.'\"]+$", "")


def is_valid_span(span: Column, margin: Column, question: Column, paired: bool = True) -> Column:
    code = ~span.contains(" ") & (F.octet_length(span) >= 6) & span.rlike("[A-Za-z]") & span.rlike("[0-9]")
    enough = margin >= F.when(code, 1.5).otherwise(4.5 if paired else 3.0)
    tokens, asked = content_tokens(span), content_tokens(question)
    echo = F.size(F.array_intersect(tokens, asked))
    only_echo = (F.size(tokens) > 0) & (echo == F.size(tokens))
    empty = rules_any(F.lower(span))
    return enough & ~empty & ~only_echo & ~((margin < (10.0 if paired else 6.0)) & (echo > 0))


def rules_any(low: Column) -> Column:
    out = F.lit(False)
    for sign in EMPTY_SPANS:
        out = out | low.contains(sign)
    return out


def best_span(start: Column, end: Column, longest: int = 20) -> Column:
    """struct(start, end, margin) of the best start and end scores (arrays; place 0 is the no-answer place)."""
    kind = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("margin", T.DoubleType())])

    def best(starts: pa.Array, ends: pa.Array) -> pa.Array:
        rows = []
        for s, e in zip(starts.to_pylist(), ends.to_pylist(), strict=True):
            if not s or not e or len(s) < 2:
                rows.append(None)
                continue
            sums = np.add.outer(np.array(s), np.array(e))
            places = np.subtract.outer(np.arange(len(e)), np.arange(len(s))).T
            sums[(places < 0) | (places >= longest)] = -np.inf
            sums[0, :], sums[:, 0] = -np.inf, -np.inf
            i, j = np.unravel_index(int(sums.argmax()), sums.shape)
            rows.append({"start": int(i), "end": int(j), "margin": float(sums[i, j] - s[0] - e[0])})
        fields = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("margin", pa.float64())])
        return pa.array(rows, fields)

    return F.arrow_udf(best, kind)(start, end)


def _places(given: Column) -> Column:
    """The distinct places in a variant: a number, an array of numbers or texts, or a text with commas or blanks."""
    kind = F.schema_of_variant(given)
    said = F.try_variant_get(given, "$", "string")
    listed = (
        F.when(kind == "STRING", F.transform(F.split(said, r"(?U)[,\s]+"), lambda t: F.btrim(t, F.lit("[]"))))
        .when(kind.startswith("ARRAY"), F.transform(F.try_variant_get(given, "$", "array<string>"), trim))
        .when(kind == "BIGINT", F.array(said))
    )
    numbers = F.filter(listed, lambda t: t.rlike(r"^\+?[0-9]{1,9}$"))
    return F.coalesce(F.array_distinct(F.transform(numbers, lambda t: t.cast("int"))), F.array().cast("array<int>"))


def model_answers(rows: DataFrame, raw: str, gated: str, synthesis: Column | None = None) -> DataFrame:
    """rows with answer, memory_index and confidence from a model's JSON; nulls where it says nothing that the records bear out.

    ``raw`` names the column of model texts, ``gated`` an array of (title, content) in order of rank. A plain answer must be
    grounded in one record, the one it names if it can be; a summary, or an answer of three tokens or more, in all
    together. Then memory_index is a named record that shares a token, else the last of those that share most.
    """
    read = rows.withColumn("_v", F.try_parse_json(json_slice(F.col(raw), "{")))
    part = lambda name: F.try_variant_get("_v", f"$.{name}", "variant")
    text_of = F.when(F.schema_of_variant(part("answer")) == "STRING", trim(F.try_variant_get("_v", "$.answer", "string")))
    number = F.when(F.schema_of_variant(part("confidence")).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get("_v", "$.confidence", "double"))
    read = read.withColumn("_said", text_of).withColumn("_at", _places(part("memory_index"))).withColumn("_sure", number)
    several = F.size("_at") > 1
    listing = F.col("_said").contains("\n") | F.col("_said").rlike("^[-*\u2022] ")
    read = read.withColumn("_joint", (F.lit(False) if synthesis is None else synthesis) | several | listing)
    unquoted = F.regexp_replace("_said", r"(?U)^[\s\"'`]+|[\s\"'`]+$", "")
    read = read.withColumn("_text", F.when(F.col("_joint"), unquoted).otherwise(clean_span(F.col("_said"))))
    low = F.lower("_text")
    nothing = (low == "") | low.isin(*NO_ANSWERS)
    for sign in NO_ANSWER_PARTS:
        nothing = nothing | low.contains(sign)
    tokens = content_tokens(F.col("_text"))
    shares = F.transform(gated, lambda g: F.size(F.array_intersect(tokens, F.array_union(content_tokens(g["content"]), content_tokens(g["title"])))))
    alone = F.transform(gated, lambda g: is_grounded(F.col("_text"), g["title"], g["content"]))
    corpus = F.array_join(F.transform(gated, lambda g: F.concat_ws(" ", g["title"], g["content"])), " ")
    read = read.withColumn("_text", F.when(~nothing, F.col("_text")))
    read = read.withColumn("_shares", shares).withColumn("_alone", alone).withColumn("_all", is_synthesis_grounded(F.col("_text"), corpus)).withColumn("_n", F.size(tokens))
    first = F.get("_at", F.lit(0))
    most = F.when(F.size("_shares") > 0, F.size("_shares") - F.array_position(F.reverse("_shares"), F.array_max("_shares"))).otherwise(0)
    sharing = F.filter("_at", lambda i: F.get("_shares", i) > 0)
    jointly = F.when(F.col("_all"), F.coalesce(F.get(sharing, F.lit(0)), most))
    where = F.array_position("_alone", F.lit(True))
    named = F.when(F.get("_alone", first), first)
    loosely = F.when((F.col("_n") >= 3) & F.col("_all"), F.coalesce(F.when(F.get("_shares", first) > 0, first), most))
    singly = F.coalesce(named, F.when(where > 0, where - 1), loosely)
    read = read.withColumn("memory_index", F.when(F.col("_text").isNotNull(), F.when(F.col("_joint"), jointly).otherwise(singly)).cast("int"))
    sure = F.when(F.col("_sure") > 0, F.greatest(F.lit(0.05), F.least(F.lit(1.0), "_sure"))).otherwise(UNSTATED)
    found = F.col("memory_index").isNotNull()
    return read.select(*[f"`{c}`" for c in rows.columns], F.when(found, F.col("_text")).alias("answer"), "memory_index", F.when(found, sure).alias("confidence"))
