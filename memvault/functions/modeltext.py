"""What language models wrote: JSON inside prose, and entities inside that JSON."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memvault.functions.text import trim

CLOSING = {"[": "]", "{": "}"}


def first_json(raw: str, opening: str) -> str | None:
    """The first balanced piece from an opening bracket on that is JSON; brackets inside strings don't count."""
    closing, start = CLOSING[opening], raw.find(opening)
    while start >= 0:
        depth, quoted, at = 0, False, start
        while at < len(raw):
            c = raw[at]
            if quoted:
                at += c == "\\"
                quoted = c != '"'
            elif c == '"':
                quoted = True
            else:
                depth += (c == opening) - (c == closing)
                if not depth:
                    break
            at += 1
        if at >= len(raw):
            return None
        try:
            json.loads(raw[start : at + 1])
            return raw[start : at + 1]
        except ValueError:
            start = raw.find(opening, at + 1)
    return None


def json_slice(raw: Column, opening: str = "[") -> Column:
    """The JSON array (or object, opening "{") in a model's answer, thoughts left out; null if there is none."""

    def find(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else first_json(t, opening) for t in texts.to_pylist()], pa.string())

    # what follows the last thought, or what stands before its end if nothing follows
    parts = F.split(raw, "</think>")
    after = F.element_at(parts, -1)
    before = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))), "</think>")
    return F.arrow_udf(find, "string")(F.when(after.rlike(r"\S"), after).otherwise(before))


def entities_of(rows: DataFrame, raw: str, key: str) -> DataFrame:
    """(key, entity_name, entity_val) for the entities in the JSON arrays of a column of answers.

    Names are snake case; blank names, blank values and values that repeat the name are left out, repeats come once.
    A null, an answer without an array and one that isn't an array of objects have none.
    """
    listed = F.from_json(json_slice(F.col(raw)), "array<struct<name string, key string, entity string, val string, value string>>")
    found = rows.select(key, F.explode(listed).alias("e"))
    name = F.replace(F.lower(trim(F.coalesce("e.name", "e.key", "e.entity"))), F.lit(" "), F.lit("_"))
    out = found.select(key, name.alias("entity_name"), trim(F.coalesce("e.val", "e.value")).alias("entity_val"))
    low = F.lower("entity_val")
    same = (low == F.col("entity_name")) | (low == F.replace("entity_name", F.lit("_"), F.lit(" ")))
    return out.where((F.col("entity_name") != "") & (F.col("entity_val") != "") & ~same).distinct()
