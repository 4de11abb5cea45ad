"""Tokenizers and small text expressions. The tokenizers differ on purpose."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0                　"

# fixed values: stop words of query tokens
QUERY_STOP = (
    "who what where when why how is are was were the a an in on at to for of with by from as and or "
    "my me do does did user name"
).split()
# fixed values: stop words of lexical queries
LEXICAL_STOP = (
    "what which who where when why how is are was were does do did the a an in on at to for of with by from "
    "as and or my me our your use uses used run runs running please tell"
).split()
# fixed values: stop words of meaningful tokens
MEANING_STOP = "the a an on in at to for of with by is are was were be been has have had and or as from that this".split()
# fixed values: function words that answers may add
FUNCTION_WORDS = (
    "what which who where when why how is are was were does do did has have had be been being the a an in on at to for "
    "of with by from as and or but that this these those it its they them their you my me our your user users use "
    "uses used run runs running i"
).split()


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def title_of(content: Column) -> Column:
    """The default title: the first line, cut at 80 characters."""
    return F.substring(F.element_at(F.split(content, "\n"), 1), 1, 80)


def terms(text: Column) -> Column:
    """Lexical terms: runs of letters and digits, lower-cased."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def meaningful_tokens(content: Column) -> Column:
    """The distinct tokens that conflict detection compares."""
    found = F.split(content, r"[^\p{L}\p{N}_.\-]+")
    bare = F.transform(found, lambda w: F.lower(F.btrim(w, F.lit(".-_"))))
    stop = F.array(*map(F.lit, MEANING_STOP))
    return F.array_distinct(F.filter(bare, lambda w: (F.octet_length(w) > 1) & ~F.array_contains(stop, w)))


def word_tokens(tokens: Column) -> Column:
    """Those tokens that have a letter."""
    return F.filter(tokens, lambda w: w.rlike(r"\p{L}"))


def content_tokens(text: Column) -> Column:
    """The distinct tokens that grounding compares: no function words, single characters only if digits."""
    found = F.transform(F.split(text, r"[^\p{L}\p{N}]+"), lambda w: F.lower(w))
    stop = F.array(*map(F.lit, FUNCTION_WORDS))
    return F.array_distinct(
        F.filter(found, lambda w: ((F.octet_length(w) > 1) | w.rlike("[0-9]")) & (w != "") & ~F.array_contains(stop, w))
    )


def query_tokens(query: str) -> list[str]:
    """Tokens of a recall query, in order."""
    found = (w.lower() for w in re.split(r"[^\w]|_", query))
    return [w for w in found if len(w.encode()) >= 2 and w not in QUERY_STOP]


def lexical_query(query: str) -> list[list[str]]:
    """Phrases of a lexical query, all required; the last term of each is a prefix."""
    raw = [w.strip("-_") for w in re.split(r"[^\w\-]", query)]
    raw = [w for w in raw if w]
    kept = [w for w in raw if w.lower() not in LEXICAL_STOP] or raw
    return [[p for p in re.split(r"[-_]", w.lower()) if p] for w in kept]


def dedup_key(content: Column, hashes: Column | None = None) -> Column:
    """The trimmed content, with the sorted distinct attachment hashes if there are any."""
    key = trim(content)
    if hashes is None:
        return key
    listed = F.array_join(F.array_sort(F.array_distinct(hashes)), ",")
    return F.when(F.size(hashes) > 0, F.concat(key, F.lit("\0att:"), listed)).otherwise(key)


def card_text(category: Column, title: Column, content: Column, tags: Column, attachments: Column | None = None, entities: Column | None = None) -> Column:
    """What is embedded for a record."""
    parts = [F.concat(F.lit("["), F.upper(category), F.lit("] "), title), content]
    if attachments is not None:
        parts.append(F.when(F.size(attachments) > 0, F.concat(F.lit("Attachments: "), F.array_join(attachments, "; "))))
    if entities is not None:
        parts.append(F.when(F.size(entities) > 0, F.concat(F.lit("Entities: "), F.array_join(entities, "; "))))
    parts.append(F.when(F.size(tags) > 0, F.concat(F.lit("Tags: "), F.array_join(tags, ", "))))
    return F.concat_ws("\n\n", *parts)


def tag_list(raw: Column) -> Column:
    """Tags from a JSON array or a comma list."""
    listed = F.from_json(raw, "array<string>")
    commas = F.filter(F.transform(F.split(raw, ","), trim), lambda t: t != "")
    return F.when(F.ltrim(raw).startswith("["), listed).otherwise(commas)


#: Milliseconds of the TTL units.
TTL_UNITS = {"ms": 1, "s": 1_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}


def ttl_ms(raw: Column) -> Column:
    """A TTL such as 24h in milliseconds; a bare number is seconds; null if it isn't a positive TTL."""
    text = F.lower(trim(raw))
    number = F.regexp_extract(text, r"^\+?(\d+)\s*(ms|s|m|h|d|w)?$", 1).try_cast("bigint")
    unit = F.regexp_extract(text, r"^\+?(\d+)\s*(ms|s|m|h|d|w)?$", 2)
    factor = F.lit(1_000)
    for name, ms in TTL_UNITS.items():
        factor = F.when(unit == name, F.lit(ms)).otherwise(factor)
    return F.when(number > 0, F.try_multiply(number, factor.cast("bigint")))


# fixed values: options whose values are secret
SECRET_OPTIONS = ("--api-key", "--ollama-api-key", "--openai-api-key", "--model-api-key")


def redacted(args: Column, program: str = "memvault") -> Column:
    """The arguments of a run (an array, the program first) as one line: values of SECRET_OPTIONS replaced, arguments with blanks quoted."""
    secret = lambda x: x.isin(*SECRET_OPTIONS)
    quoted = lambda x, blanks: F.when(x.rlike(blanks), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(x)

    def step(s: Column, x: Column) -> Column:
        option = F.substring_index(x, "=", 1)
        said = F.when(x.contains("="), F.when(secret(option), F.concat(option, F.lit("=[REDACTED]"))).otherwise(quoted(x, "[ \t]"))).otherwise(quoted(x, "[ \t\n]"))
        return F.struct(
            (~s["hides"] & secret(x)).alias("hides"),
            F.concat(s["said"], F.array(F.when(s["hides"], "[REDACTED]").when(secret(x), x).otherwise(said))).alias("said"),
        )

    start = F.struct(F.lit(False).alias("hides"), F.array(F.lit(program)).alias("said"))
    rest = F.slice(args, F.lit(2), F.greatest(F.size(args) - 1, F.lit(0)))
    return F.array_join(F.aggregate(rest, start, step)["said"], " ")
