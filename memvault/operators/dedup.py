"""Exact duplicates: groups, field-wise merges, write-time merges, and merges of vaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memvault.functions.text import dedup_key, title_of, trim


def keyed(memories: DataFrame, attachments: DataFrame | None = None) -> DataFrame:
    """memories with dedup_key; a 64-bit hash of it shuffles in its place where only groups matter."""
    if attachments is None:
        return memories.withColumn("dedup_key", dedup_key(F.col("content")))
    hashes = attachments.groupBy(F.col("memory_id").alias("id")).agg(F.collect_set("sha256").alias("_hashes"))
    none = F.array().cast("array<string>")
    return memories.join(hashes, "id", "left").withColumn("dedup_key", dedup_key(F.col("content"), F.coalesce("_hashes", none))).drop("_hashes")


def is_auto_title(title: Column, content: Column) -> Column:
    return (title == title_of(trim(content))) | title.endswith("...")


def _distinct_tags(tags: Column) -> Column:
    """Tags of several records in their order; of spellings that differ in case only the first stays."""

    def first(t: Column, i: Column) -> Column:
        earlier = F.slice(tags, F.lit(1), i)
        return ~F.exists(earlier, lambda e: F.lower(e) == F.lower(t))

    return F.filter(tags, first)


def merged(memories: DataFrame) -> DataFrame:
    """One active record per category and key, with merged fields and the number merged.

    The oldest (created_at, id) gives id, content, provenance and its title, unless that is an auto title and
    another record has one of its own. Aggregates run before the shuffle; tags are first
    made distinct with the place of their first record, so that a large group stays small.
    """
    rows = keyed(memories.where(F.col("status") == "active")).withColumn("_k", F.sha2("dedup_key", 256))
    order = F.struct("created_at", "id")
    own = F.when(~is_auto_title(F.col("title"), F.col("content")), order)
    fields = rows.groupBy("category", "_k").agg(
        F.min_by("id", order).alias("id"),
        F.coalesce(F.min_by("title", own), F.min_by("title", order)).alias("title"),
        F.min_by("provenance", order).alias("provenance"),
        F.max("confidence").alias("confidence"),
        F.min("created_at").alias("created_at"),
        F.max("updated_at").alias("updated_at"),
        F.min_by("expired_at", F.when(F.col("expired_at").isNotNull(), order)).alias("expired_at"),
        F.count("*").alias("n_merged"),
    )
    tag = rows.select("category", "_k", order.alias("_o"), F.posexplode("tags").alias("_p", "tag"))
    seen = tag.groupBy("category", "_k", "tag").agg(F.min(F.struct("_o", "_p")).alias("_at"))
    # a group's distinct tags, not its records, come together here
    listed = seen.groupBy("category", "_k").agg(F.array_sort(F.collect_list(F.struct("_at", "tag"))).alias("_t"))
    tags = listed.select("category", "_k", F.col("_t.tag").alias("_all")).select("category", "_k", _distinct_tags(F.col("_all")).alias("tags"))
    survivors = fields.join(tags, ["category", "_k"], "left").drop("_k")
    return survivors.join(rows.select("id", "content"), "id")


def groups(memories: DataFrame) -> DataFrame:
    """(id, primary_id): each active record and the oldest one of its group.

    Groups are first reduced to their oldest record; a hot group meets its record by AQE's skew split.
    """
    rows = keyed(memories.where(F.col("status") == "active")).select("id", "category", F.sha2("dedup_key", 256).alias("_k"), "created_at")
    first = rows.groupBy("category", "_k").agg(F.min_by("id", F.struct("created_at", "id")).alias("primary_id"))
    return rows.join(first, ["category", "_k"]).select("id", "primary_id")


def last_by_id(rows: DataFrame, place: str) -> DataFrame:
    """One row per id, the last by place; partial aggregates run before the shuffle, so a hot id stays small."""
    others = [c for c in rows.columns if c != "id"]
    found = rows.groupBy("id").agg(F.max_by(F.struct(*others), F.col(place)).alias("_row"))
    return found.select("id", *[F.col(f"_row.{c}").alias(c) for c in others])


def keyed_upsert(held: DataFrame, incoming: DataFrame, hashes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, moved): incoming active records, in order of their column place, put into held ones, as if one by one.

    Ids stay unique, and so do category and key among active records. Of incoming rows with one id only the last counts.
    It takes the place of a held record of its id, expired or not. Active records of one category and key become one: the last
    incoming row gives the content, and the title unless that is an auto title and another of them has one of its own, and the tags, to which
    those of the others come that it lacks in any case; the oldest time of creation, the newest of change and the
    greatest confidence stay, and the first time of expiry in that order. Its id and provenance are those of the last incoming row
    whose id was held before, else of the oldest held record, else of the first incoming row. moved says which ids (id) went up in which (primary_id).
    hashes (id, sha256) are the attachments of records on either side; they are part of the key.
    """
    columns = [c for c in held.columns if c != "place"]
    both = incoming.withColumn("_new", F.lit(True)).unionByName(
        held.withColumns({"place": F.lit(None).cast("long"), "_new": F.lit(False)}), allowMissingColumns=True
    )
    if hashes is not None:
        files = hashes.groupBy("id").agg(F.collect_set("sha256").alias("_hashes"))  # a record's own files
        both = both.join(files, "id", "left")
    listed = F.coalesce("_hashes", F.array().cast("array<string>")) if hashes is not None else None
    both = both.withColumn("_k", F.sha2(dedup_key(F.col("content"), listed), 256)).drop("_hashes")
    new = last_by_id(both.where("_new").drop("_new"), "place")
    old = both.where("not _new").drop("_new", "place")
    named = new.select("id", F.col("category").alias("_c"), F.col("_k").alias("_nk"))
    old = old.join(named, "id", "left")
    stays = old.where("_nk is null or (status = 'active' and category = _c and _k = _nk)").drop("_c")
    groups_in = new.select("category", "_k").distinct()
    twins = stays.where("status = 'active'").join(groups_in, ["category", "_k"], "left_semi")
    same = stays.where("_nk is null").join(twins.select("id"), "id", "left_anti").select(*columns)
    exact = new.join(old.select("id", F.lit(True).alias("_exact")), "id", "left")
    rows = exact.unionByName(twins.drop("_nk"), allowMissingColumns=True)
    from_new = F.col("place").isNotNull()
    order = F.struct((~from_new).alias("s"), (-F.col("place")).alias("p"), F.col("created_at").alias("c"), "id")
    own = F.when(~is_auto_title(F.col("title"), F.col("content")), order)
    giver = F.struct(F.when(F.col("_exact"), 0).when(~from_new, 1).otherwise(2).alias("s"), F.when(F.col("_exact"), -F.col("place")).alias("p"), F.when(~from_new, F.col("created_at")).alias("c"), F.when(~from_new, F.col("id")).alias("i"), "place")
    fields = rows.groupBy("category", "_k").agg(
        F.min_by(F.struct("id", "provenance"), giver).alias("_giver"),
        F.min_by("content", order).alias("content"),
        F.coalesce(F.min_by("title", own), F.min_by("title", order)).alias("title"),
        F.max("confidence").alias("confidence"),
        F.min("created_at").alias("created_at"),
        F.max("updated_at").alias("updated_at"),
        F.min_by("expired_at", F.when(F.col("expired_at").isNotNull(), order)).alias("expired_at"),
        F.coalesce(F.min_by("tags", order), F.array().cast("array<string>")).alias("_own"),
    )
    tag = rows.select("category", "_k", order.alias("_o"), F.posexplode("tags").alias("_p", "tag"))
    seen = tag.groupBy("category", "_k", "tag").agg(F.min(F.struct("_o", "_p")).alias("_at"))
    tags = seen.groupBy("category", "_k").agg(F.array_sort(F.collect_list(F.struct("_at", "tag"))).alias("_t"))  # a group's distinct tags
    tags = tags.select("category", "_k", F.col("_t.tag").alias("_all")).select("category", "_k", _distinct_tags(F.col("_all")).alias("tags"))
    low = F.transform("_own", lambda t: F.lower(t))
    made = fields.join(tags, ["category", "_k"], "left").withColumns(
        {"id": F.col("_giver.id"), "provenance": F.col("_giver.provenance"), "status": F.lit("active"), "tags": F.concat("_own", F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: ~F.array_contains(low, F.lower(t))))}
    )
    moved = rows.select("id", "category", "_k").join(made.select("category", "_k", F.col("id").alias("primary_id")), ["category", "_k"])
    return same.unionByName(made.select(*columns)), moved.where("id <> primary_id").select("id", "primary_id")


def upserted(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """By id, the incoming row wins; ids that come in more than once give one row."""
    incoming = incoming.dropDuplicates(["id"])
    return existing.join(incoming.select("id"), "id", "left_anti").unionByName(incoming, allowMissingColumns=True)


def rehomed(links: DataFrame, mapping: DataFrame) -> DataFrame:
    """Links with ends moved from id to primary_id: no self-loops, one per (source, target, relation), the heaviest."""
    a = mapping.select(F.col("id").alias("source_id"), F.col("primary_id").alias("_s"))
    b = mapping.select(F.col("id").alias("target_id"), F.col("primary_id").alias("_t"))
    moved = links.join(a, "source_id", "left").join(b, "target_id", "left").select(
        F.coalesce("_s", "source_id").alias("source_id"), F.coalesce("_t", "target_id").alias("target_id"), "relation", "weight"
    )
    return moved.where("source_id <> target_id").groupBy("source_id", "target_id", "relation").agg(F.max("weight").alias("weight"))


def rehomed_children(children: DataFrame, mapping: DataFrame, key: list[str]) -> DataFrame:
    """Attachments (key: sha256) or entities (key: name and value) moved from id to primary_id, once per record and key."""
    to = mapping.select(F.col("id").alias("memory_id"), F.col("primary_id").alias("_p"))
    moved = children.join(to, "memory_id", "left").withColumn("memory_id", F.coalesce("_p", "memory_id")).drop("_p")
    return moved.dropDuplicates(["memory_id", *key])


def batch_files(files: DataFrame, held: DataFrame) -> DataFrame:
    """(memory_id, sha256, filename, media_kind, copies, known): the files of a batch, once per record and content.

    The least file name stays; copies counts the files that were one; known says that the vault has the content already.
    """
    one = files.groupBy("memory_id", "sha256").agg(F.min(F.struct("filename", "media_kind")).alias("f"), F.count("*").alias("copies"))
    have = held.select("sha256").distinct().withColumn("known", F.lit(True))
    return one.join(have, "sha256", "left").select("memory_id", "sha256", "f.filename", "f.media_kind", "copies", F.coalesce("known", F.lit(False)).alias("known"))


def file_tags(memories: DataFrame, files: DataFrame) -> DataFrame:
    """memories with the kinds and extensions of their files as tags, each once in any case, after the tags that they have."""
    extension = F.lower(F.regexp_extract("filename", r"[^.]\.([^./\\]+)$", 1))
    listed = files.select(F.col("memory_id").alias("id"), F.explode(F.array("media_kind", extension)).alias("_t")).where("_t <> ''")
    # a record's distinct kinds and extensions
    added = listed.groupBy("id").agg(F.array_sort(F.collect_set("_t")).alias("_more"))
    low = F.transform("tags", lambda t: F.lower(t))
    more = F.filter(F.coalesce("_more", F.array().cast("array<string>")), lambda t: ~F.array_contains(low, F.lower(t)))
    return memories.join(added, "id", "left").withColumn("tags", F.concat("tags", more)).drop("_more")


def merge_vaults(target: DataFrame, source: DataFrame, replace: bool) -> tuple[DataFrame, DataFrame]:
    """(records, accepted ids): source rows whose id is new, or all of them if replace."""
    accepted = source if replace else source.join(target.select("id"), "id", "left_anti")
    return upserted(target, accepted), accepted.select("id")


def accepted_links(target: DataFrame, source: DataFrame, accepted: DataFrame) -> DataFrame:
    """Target links and those source links both of whose ends were accepted; a known link keeps its weight."""
    key = ["source_id", "target_id", "relation"]
    both = source.join(accepted.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(
        accepted.select(F.col("id").alias("target_id")), "target_id", "left_semi"
    )
    return target.unionByName(both.join(target.select(*key), key, "left_anti").select(*target.columns))
