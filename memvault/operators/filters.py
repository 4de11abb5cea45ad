"""Scans, lookups, filters in time, and pages of records."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stamp(at: str) -> Column:
    """A point in time; a bare date means its last second."""
    whole = f"{at} 23:59:59" if len(at) == 10 else at
    return F.lit(dt.datetime.fromisoformat(whole).isoformat(sep=" ")).cast("timestamp_ntz")


def listed_as_of(at: str) -> Column:
    """What lists and counts show at a time: status is not looked at."""
    t = stamp(at)
    return (F.col("created_at") <= t) & (F.col("expired_at").isNull() | (F.col("expired_at") > t))


def found_as_of(at: str) -> Column:
    """What searches see at a time: an expired record without a time of expiry is gone."""
    t = stamp(at)
    alive = (F.col("status") == "active") & F.col("expired_at").isNull()
    return (F.col("created_at") <= t) & (alive | (F.col("expired_at") > t))


def on_day(day: str) -> Column:
    d = F.lit(day).cast("date")
    return (F.to_date("created_at") == d) | (F.to_date("updated_at") == d)


def select(memories: DataFrame, *, category: str | None = None, status: str | None = None, as_of: str | None = None, day: str | None = None, search: bool = False) -> DataFrame:
    """The filters of lists (search: of search lanes); as_of takes the place of status."""
    out = memories
    if category is not None:
        out = out.where(F.col("category") == category)
    if as_of is not None:
        out = out.where(found_as_of(as_of) if search else listed_as_of(as_of))
    elif status is not None:
        out = out.where(F.col("status") == status)
    return out if day is None else out.where(on_day(day))


def page(memories: DataFrame, number: int, size: int) -> DataFrame:
    """Page number (from 1) of the newest first; size 0 means all."""
    ordered = memories.orderBy(F.col("created_at").desc(), "id")
    return ordered if size == 0 else ordered.offset((number - 1) * size).limit(size)


def page_info(total: int, number: int, size: int) -> dict[str, int | bool]:
    pages = 1 if size == 0 else -(-total // size)
    return {"total": total, "page": number, "total_pages": pages, "has_more": number < pages}


def expire_due(memories: DataFrame, now: str) -> DataFrame:
    """Active records whose time has come become expired."""
    due = (F.col("status") == "active") & (F.col("expired_at") <= stamp(now))
    return memories.withColumn("status", F.when(due, "expired").otherwise(F.col("status")))


#: Kinds of files that lists may ask for.
MEDIA_KINDS = ("image", "audio", "video", "document")


def with_media(memories: DataFrame, attachments: DataFrame, kind: str) -> DataFrame:
    """Records with an attachment of a kind; any and all: with any. Other kinds are refused."""
    kind = kind.strip().lower()
    if kind not in ("any", "all", *MEDIA_KINDS):
        raise ValueError(f"no such kind of media: {kind}")
    wanted = attachments if kind in ("any", "all") else attachments.where(F.col("media_kind") == kind)
    return memories.join(wanted.select(F.col("memory_id").alias("id")).distinct(), "id", "left_semi")


def by_id_or_prefix(memories: DataFrame, key: str) -> DataFrame:
    """The record with this id, else those (two at most, to show ambiguity) whose id begins with it."""
    exact = memories.where(F.col("id") == key).withColumn("_rank", F.lit(0))
    near = memories.where(F.col("id").startswith(key) & (F.col("id") != key)).withColumn("_rank", F.lit(1))
    return _best(exact.unionByName(near), 2)


def by_id_or_title(memories: DataFrame, key: str) -> DataFrame:
    """By id, id prefix, whole title, or part of a title (3 bytes or more); titles of active records only."""
    active, title = F.col("status") == "active", F.lower("title")
    rank = (
        F.when(F.col("id") == key, 0)
        .when(F.col("id").startswith(key), 1)
        .when(active & (title == key.lower()), 2)
        .when(active & title.contains(key.lower()) & F.lit(len(key.encode()) >= 3), 3)
    )
    return _best(memories.withColumn("_rank", rank).where("_rank is not null"), 2)


def by_ids(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """The records whose id is among ids, once each."""
    return memories.join(ids.select("id"), "id", "left_semi")


def for_restore(memories: DataFrame, key: str) -> DataFrame:
    """The record to restore, archived ones too: by id, id prefix or whole title. A blank key finds none; several records fail."""
    clean = key.strip()
    if not clean:
        return memories.limit(0)
    rank = F.when(F.col("id") == clean, 0).when(F.col("id").startswith(clean), 1).when(F.lower("title") == clean.lower(), 2)
    found = _best(memories.withColumn("_rank", rank).where("_rank is not null"), 2)
    several = found.agg(F.count("*").alias("_several"))
    one = F.when(F.col("_several") > 1, F.raise_error(F.lit(f"several records match {clean!r}; name a whole id"))).otherwise(True)
    return found.join(F.broadcast(several)).where(one).drop("_several")  # one row


def _best(ranked: DataFrame, n: int) -> DataFrame:
    """Of the rows of the least rank, the first n by id; one pass finds them."""
    found = ranked.orderBy("_rank", "id").limit(n)
    least = found.agg(F.min("_rank").alias("_least"))
    return found.join(F.broadcast(least), F.col("_rank") == F.col("_least")).drop("_rank", "_least")


def by_entity(memories: DataFrame, entities: DataFrame, name: str, value: str) -> DataFrame:
    """Active records with a slot (name in any case, value as given), newest first."""
    hits = entities.where((F.lower("entity_name") == name.lower()) & (F.col("entity_val") == value))
    ids = hits.select(F.col("memory_id").alias("id")).distinct()
    return memories.where(F.col("status") == "active").join(ids, "id", "left_semi").orderBy(F.col("updated_at").desc(), "id")


def verified(attachments: DataFrame) -> DataFrame:
    """Attachments, failing on any whose bytes disagree with their size or hash."""
    ok = (F.sha2("data", 256) == F.col("sha256")) & (F.octet_length("data") == F.col("size_bytes"))
    return attachments.where(F.when(ok, True).otherwise(F.raise_error(F.concat(F.lit("damaged attachment "), "filename"))))


def hydrated(memories: DataFrame, attachments: DataFrame, entities: DataFrame) -> DataFrame:
    """Records with their attachments and entities as arrays."""
    files = attachments.groupBy("memory_id").agg(F.array_sort(F.collect_list("sha256")).alias("attachment_hashes"))
    slots = entities.groupBy("memory_id").agg(F.array_sort(F.collect_list(F.struct("entity_name", "entity_val"))).alias("entities"))
    out = memories.join(files.withColumnRenamed("memory_id", "id"), "id", "left")
    return out.join(slots.withColumnRenamed("memory_id", "id"), "id", "left")
