"""The given tables as tables of a vault."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memvault.functions.text import title_of
from memvault.schema import CATEGORIES

#: What decorated contents begin with, by doc_id; the last is a plain fact.
PREFIXES = (
    "password: ", "error: ", "preference: ", "rule: ", "decision: ", "goal: ", "todo: ", "learning: ",
    "event: ", "relationship: ", "observation: ", "artifact: ", "context: ", "",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def doc_key(column: str) -> F.Column:
    return F.concat(F.lit("doc-"), F.lpad(F.col(column).cast("string"), 8, "0"))


def memories(spark: SparkSession, sf_dir: str, *, decorated: bool = False, rated: bool = True) -> DataFrame:
    """documents as records. Every seventh is expired, every other one of those without a time.

    decorated: contents begin with a category's prefix, and every fifth ends in a wikilink.
    rated: with the confidence that labels give; without it no join moves the contents.
    """
    rows = table(spark, sf_dir, "documents")
    if rated:
        labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("_l"), "quality")
        rows = rows.join(labels, F.col("doc_id") == F.col("_l"), "left")
    content = F.coalesce("text", F.lit(""))
    if decorated:
        prefix = F.element_at(F.array(*map(F.lit, PREFIXES)), (F.col("doc_id") % len(PREFIXES) + 1).cast("int"))
        link = F.concat(F.lit(" [[doc-"), F.lpad((F.col("doc_id") * 7 % 1000).cast("string"), 8, "0"), F.lit("|see]]"))
        content = F.concat(prefix, content, F.when(F.col("doc_id") % 5 == 0, link).otherwise(""))
    created = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("doc_id").cast("int"))
    expired = F.col("doc_id") % 7 == 0
    return rows.select(
        doc_key("doc_id").alias("id"),
        content.alias("content"),
        title_of(content).alias("title"),
        F.array("lang", "source").alias("tags"),
        *([F.coalesce(0.5 + 0.5 * F.col("quality"), F.lit(0.9)).cast("double").alias("confidence")] if rated else []),
        F.when(expired, "expired").otherwise("active").alias("status"),
        F.lit("explicit_statement").alias("provenance"),
        created.alias("created_at"),
        created.alias("updated_at"),
        F.when(expired & (F.col("doc_id") % 2 != 0), created + F.expr("interval 30 days")).alias("expired_at"),
        F.element_at(F.array(*map(F.lit, CATEGORIES)), (F.col("doc_id") % len(CATEGORIES) + 1).cast("int")).alias("category"),
        "doc_id",
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(doc_key("vec_id").alias("id"), "embedding")


def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    data = F.col("html").cast("binary")
    return pages.select(
        doc_key("page_id").alias("memory_id"),
        F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("filename"),
        data.alias("data"),
        F.sha2(data, 256).alias("sha256"),
        F.octet_length(data).cast("long").alias("size_bytes"),
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    slots = F.explode(
        F.array(
            F.struct(F.lit("lang").alias("entity_name"), F.col("lang").alias("entity_val")),
            F.struct(F.lit("source").alias("entity_name"), F.col("source").alias("entity_val")),
        )
    ).alias("e")
    return docs.select(doc_key("doc_id").alias("memory_id"), slots).select("memory_id", "e.*")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse graph over the vectors: each points to three others, with weights from 0.5 to 1."""
    vecs = table(spark, sf_dir, "embeddings").select("vec_id")
    n = vecs.agg((F.max("vec_id") + 1).alias("n"))
    k = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k")
    rows = vecs.select("vec_id", k).join(F.broadcast(n))  # one row
    target = (F.col("vec_id") * (F.col("k") + 2) + F.col("k") * 17) % F.col("n")
    return (
        rows.select(F.col("vec_id").alias("s"), target.alias("t"), "k")
        .where("s <> t")
        .groupBy("s", "t")
        .agg(F.min("k").alias("k"))
        .select(
            doc_key("s").alias("source_id"),
            doc_key("t").alias("target_id"),
            F.lit("relates_to").alias("relation"),
            (0.5 + 0.5 / F.col("k")).cast("double").alias("weight"),
        )
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("event_id").alias("id"),
        F.lit("remember").alias("command"),
        F.col("event_type").alias("subcommand"),
        F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"),
        F.floor(F.col("value") * 1000).cast("long").alias("duration_ms"),
        F.col("ts").alias("created_at"),
    )


def _be(n: Column, size: int) -> Column:
    """A number as big-endian hex of so many bytes."""
    return F.lpad(F.hex(n), 2 * size, "0")


def _le(n: Column, size: int) -> Column:
    return F.concat(*(_be(F.shiftright(n, 8 * k).bitwiseAND(0xFF), 1) for k in range(size)))


def media_files(spark: SparkSession, sf: str) -> DataFrame:
    """(page_id, filename, data): for each page the header of a JPEG, WebP, MP4, WAV or GIF file whose sizes follow from page_id."""
    pages = table(spark, sf, "pages").select(F.col("page_id").cast("long").alias("page_id"))
    w, h = F.col("page_id") % 3000 + 1, F.col("page_id") % 2000 + 1
    text = lambda s: s.encode().hex().upper()
    # a comment segment, then the frame header
    jpeg = F.concat(F.lit("FFD8FFFE0004AAAAFFC0000B08"), _be(h, 2), _be(w, 2), F.lit("01011100FFD9000000000000"))
    webp = F.concat(F.lit(text("RIFF") + "00000000" + text("WEBPVP8X") + "0A00000000000000"), _le(w - 1, 3), _le(h - 1, 3))
    movie = F.concat(F.lit("0000001C" + text("mvhd") + "00" * 12), _be(F.lit(1000), 4), _be(w * 500, 4))
    track = F.concat(F.lit("00000064" + text("trak") + "0000005C" + text("tkhd") + "00" * 76), _be(w * 65536, 4), _be(h * 65536, 4))
    mp4 = F.concat(F.lit("00000010" + text("ftypisom") + "00000000" + "00000088" + text("moov")), movie, track)
    wav = F.concat(F.lit(text("RIFF") + "00000000" + text("WAVELIST") + "03000000AABBCC00" + text("fmt ") + "10000000" + "00" * 8), _le(F.lit(8000), 4), F.lit("00" * 4 + text("data")), _le(w * 4000, 4))
    gif = F.concat(F.lit(text("GIF89a")), _le(w, 2), _le(h, 2), F.lit("00" * 4))
    turn = F.col("page_id") % 5
    data = F.when(turn == 0, jpeg).when(turn == 1, webp).when(turn == 2, mp4).when(turn == 3, wav).otherwise(gif)
    return pages.select("page_id", F.concat(F.col("page_id").cast("string"), F.lit(".bin")).alias("filename"), F.unhex(data).alias("data"))
