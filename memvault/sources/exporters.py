"""Writers: JSON lines, Markdown by category, bundles with a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memvault.operators import stats
from memvault.schema import BACKUP_FORMAT, CATEGORIES, JSON_FORMAT, MARKDOWN_FORMAT


def json_lines(memories: DataFrame, attachments: DataFrame | None = None) -> DataFrame:
    """(value): one JSON record per line, expired ones too, with base64 attachments; importers.json_candidates knows them by their format and loses none."""
    rows = memories
    if attachments is not None:
        files = attachments.groupBy(F.col("memory_id").alias("id")).agg(
            F.array_sort(F.collect_list(F.struct("filename", "sha256", F.base64("data").alias("base64")))).alias("attachments")
        )
        rows = rows.join(files, "id", "left")
    return rows.select(F.to_json(F.struct(F.lit(JSON_FORMAT).alias("format"), *[F.col(f"`{c}`") for c in rows.columns])).alias("value"))


def backup(memories: DataFrame, attachments: DataFrame | None = None, entities: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """(value): versioned envelopes as importers.backup_parts reads them, one per record with its files and entities and one per link, so that none gathers a vault."""
    rows, fields = memories, list(memories.columns)
    if attachments is not None:
        file = F.struct(*[c for c in attachments.columns if c not in ("memory_id", "data")], F.base64("data").alias("base64"))
        files = attachments.groupBy(F.col("memory_id").alias("id")).agg(F.array_sort(F.collect_list(file)).alias("attachments"))  # a record's own files
        rows, fields = rows.join(files, "id", "left"), [*fields, "attachments"]
    if entities is not None:
        slots = entities.groupBy(F.col("memory_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("entity_name", "entity_val"))).alias("entities"))  # a record's own entities
        rows, fields = rows.join(slots, "id", "left"), [*fields, "entities"]
    name = F.lit(BACKUP_FORMAT).alias("format")
    out = rows.select(F.to_json(F.struct(name, F.array(F.struct(*fields)).alias("memories"))).alias("value"))
    if links is None:
        return out
    none = F.array().cast("array<string>").alias("memories")
    return out.unionByName(links.select(F.to_json(F.struct(name, none, F.array(F.struct(*links.columns)).alias("links"))).alias("value")))


#: The first lines of a Markdown export.
MARKDOWN_HEAD = f'---\nformat: "{MARKDOWN_FORMAT}"\n---\n\n'
#: Where links stand in a Markdown export.
LINKS_PLACE = len(CATEGORIES) + 1


def markdown(memories: DataFrame, attachments: DataFrame | None = None, entities: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """(place, category, id, value): a head, categories in their order, their active records, and links, a block a row.

    Write it sorted by (place, id); no category is gathered in one task. Each record stands for the eye and, as a comment,
    whole with its files and entities, from which importers.candidates reads it back.
    """
    spark = memories.sparkSession
    place = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category")).cast("int")
    rows, fields = memories.where(F.col("status") == "active"), list(memories.columns)
    if attachments is not None:
        files = attachments.groupBy(F.col("memory_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("filename", "sha256", F.base64("data").alias("base64")))).alias("attachments"))  # a record's own files
        rows, fields = rows.join(files, "id", "left"), [*fields, "attachments"]
    if entities is not None:
        slots = entities.groupBy(F.col("memory_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("entity_name", "entity_val"))).alias("entities"))  # a record's own entities
        rows, fields = rows.join(slots, "id", "left"), [*fields, "entities"]
    record = F.to_json(F.struct(*fields))
    block = F.concat(F.lit("### "), F.col("title"), F.lit("\n\n"), F.col("content"), F.lit("\n\n<!-- record "), record, F.lit(" -->\n"))
    blocks = rows.select(place.alias("place"), "category", "id", block.alias("value"))
    headings = rows.select("category").distinct().select(place.alias("place"), "category", F.lit("").alias("id"), F.concat(F.lit("## "), F.upper("category"), F.lit("\n")).alias("value"))
    out = spark.createDataFrame([(0, "", "", MARKDOWN_HEAD)], "place int, category string, id string, value string").unionByName(headings).unionByName(blocks)
    if links is not None:
        said = F.to_json(F.struct("source_id", "target_id", "relation", "weight"))
        out = out.unionByName(links.select(F.lit(LINKS_PLACE).alias("place"), F.lit("").alias("category"), F.concat_ws("/", "source_id", "target_id", "relation").alias("id"), F.concat(F.lit("<!-- link "), said, F.lit(" -->\n")).alias("value")))
    return out


def write_text(rows: DataFrame, path: str, suffix: str) -> None:
    """(value) as text files, one a partition, in its order, with a suffix; Spark's writer commits them whole or not at all."""
    rows.write.option("lineSep", "\n").text(path)
    spark = rows.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for file in system.listStatus(folder):
        name = file.getPath().getName()
        if name.startswith("part-"):
            system.rename(file.getPath(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name.removesuffix('.txt')}{suffix}"))


def manifest(memories: DataFrame, attachments: DataFrame, links: DataFrame) -> DataFrame:
    """One row: counts, bytes, and files of each kind."""
    kinds = stats.media_breakdown(attachments).agg(
        F.coalesce(F.sum("files"), F.lit(0)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "media_kind", "files"))), ",").alias("kinds")
    )
    counts = memories.agg(F.count("*").alias("records"), F.count_if(F.col("status") == "active").alias("active"))
    return counts.join(kinds).join(links.agg(F.count("*").alias("links")))  # one row each


def dangling(memories: DataFrame, links: DataFrame) -> DataFrame:
    """Links with an end that no record has: a whole vault has none."""
    ids = memories.select("id")
    lost = links.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_anti")
    return lost.unionByName(links.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_anti").select(*links.columns)).distinct()
