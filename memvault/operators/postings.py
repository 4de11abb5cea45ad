"""A stored inverted index: segments of postings that only a query's terms are read from.

A segment is written by each commit that changes records. It holds a row per stem and record, with the places
of the stem, the length of the record and what filters ask of it, dealt into folders by the first two letters and
sorted by stem; so a query, whose last terms are prefixes, reads a few folders, and in them a few row groups. A list of
ids says whose rows in older segments no longer count. Once ``FANOUT`` segments of a level have come together they are
merged into one of the next. The numbers of records and terms are kept beside the segments.

Block maxima would not save reads here: a term's prefix takes in several stems, and the number of records with any
of them, which the weights need, takes all their ids.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memvault.functions.stem import stem, stems
from memvault.functions.text import lexical_query, terms
from memvault.operators.lexical import FLOOR, K1, B, indexed_text

FOLDERS = 64
#: Letters of a stem that its folder goes by.
LEADING = 2
#: Segments of a level that are merged into one.
FANOUT = 4
#: What filters ask of a record.
STATE = ("category", "status", "created_at", "updated_at", "expired_at")
_KIND = "term string, id string, dl int, places array<int>, category string, status string, created_at timestamp_ntz, updated_at timestamp_ntz, expired_at timestamp_ntz, folder int"


@dataclass
class Index:
    """segments: (number, level, path), the newest last; deleted: (number, path) of ids that older segments have in vain."""

    segments: list[tuple[int, int, str]] = field(default_factory=list)
    deleted: list[tuple[int, str]] = field(default_factory=list)
    records: int = 0
    terms: int = 0

    @classmethod
    def of(cls, entry: dict | None) -> Index:
        entry = entry or {}
        return cls([tuple(s) for s in entry.get("segments", [])], [tuple(d) for d in entry.get("deleted", [])], entry.get("records", 0), entry.get("terms", 0))


def folder(term: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring(term, 1, LEADING)), F.lit(FOLDERS)).cast("int")


def rows_of(memories: DataFrame) -> DataFrame:
    """The postings of records, stems and all."""
    words = terms(indexed_text(memories))
    listed = memories.select("id", *STATE, words.alias("_w")).select("id", *STATE, F.size("_w").alias("dl"), F.posexplode("_w").alias("place", "word"))
    stemmed = listed.withColumn("term", stems(F.col("word")))
    # a record's own places of a stem
    made = stemmed.groupBy("id", "term").agg(F.array_sort(F.collect_list("place")).alias("places"), F.first("dl").alias("dl"), *(F.first(c).alias(c) for c in STATE))
    return made.withColumn("folder", folder(F.col("term"))).select("term", "id", "dl", "places", *STATE, "folder")


def _write(rows: DataFrame, path: str) -> None:
    dealt = rows.hint("rebalance", "folder").sortWithinPartitions("folder", "term")
    dealt.write.partitionBy("folder").parquet(path)


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, old, new): the records that differ between two states, as structs, null where there is none."""
    columns = ["title", "content", "tags", *STATE, *(["file_text"] if "file_text" in after.columns else [])]
    packed = lambda df, name: df.select("id", F.struct(*columns).alias(name), F.xxhash64(*columns).alias(f"_{name}"))
    both = packed(before, "old").join(packed(after, "new"), "id", "full_outer")
    return both.where(~F.col("_old").eqNullSafe(F.col("_new"))).select("id", "old", "new")


def updated(index: Index, changes: DataFrame, path: Callable[[str], str], name: Callable[[str], str]) -> Index:
    """The index after changes (delta(), written or cut); path says where a name's files lie, name gives a fresh one."""
    spark = changes.sparkSession
    new, old = changes.where("new is not null").select("id", "new.*"), changes.where("old is not null").select("id", "old.*")
    size = lambda df: df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size(terms(indexed_text(df)))), F.lit(0)).alias("t"))
    counts = size(new).select(F.lit(1).alias("s"), "n", "t").unionByName(size(old).select(F.lit(-1).alias("s"), "n", "t")).collect()  # two rows
    if not any(r["n"] for r in counts):
        return index
    number = max([0, *(s[0] for s in index.segments), *(d[0] for d in index.deleted)]) + 1
    out = Index(list(index.segments), list(index.deleted), index.records + sum(r["s"] * r["n"] for r in counts), index.terms + sum(r["s"] * r["t"] for r in counts))
    if any(r["n"] for r in counts if r["s"] < 0) and index.segments:
        where = name("deleted")
        old.select("id").write.parquet(path(where))
        out.deleted.append((number, where))
    if any(r["n"] for r in counts if r["s"] > 0):
        where = name("postings")
        _write(rows_of(new), path(where))
        out.segments.append((number, 0, where))
    return compacted(spark, out, path, name)


def compacted(spark: SparkSession, index: Index, path: Callable[[str], str], name: Callable[[str], str]) -> Index:
    """The index with each level's segments merged once there are FANOUT of them; they are always the newest but for lower levels."""
    level = 0
    while (same := [s for s in index.segments if s[1] == level]) and len(same) >= FANOUT:
        where, last = name("postings"), same[-1][0]
        _write(_live(spark, Index(same, index.deleted), path).drop("number"), path(where))
        older = [s for s in index.segments if s[1] > level]
        index = Index([*older, (last, level + 1, where), *(s for s in index.segments if s[1] < level)], index.deleted, index.records, index.terms)
        if not older:
            index.deleted = [d for d in index.deleted if d[0] > last]
        level += 1
    return index


def _live(spark: SparkSession, index: Index, path: Callable[[str], str], test: Column | None = None) -> DataFrame:
    """The postings that count, of those that pass a test, with the number of their segment."""
    reads = []
    for number, _, where in index.segments:
        rows = spark.read.schema(_KIND).parquet(path(where))
        reads.append((rows if test is None else rows.where(test)).withColumn("number", F.lit(number)))
    if not reads:
        return spark.createDataFrame([], _KIND + ", number int")
    rows = reduce(DataFrame.unionByName, reads)
    oldest = index.segments[0][0]
    gone = [spark.read.schema("id string").parquet(path(where)).withColumn("_number", F.lit(number)) for number, where in index.deleted if number > oldest]
    if not gone:
        return rows
    latest = reduce(DataFrame.unionByName, gone).groupBy("id").agg(F.max("_number").alias("_number"))
    return rows.join(latest, "id", "left").where(F.col("number") >= F.coalesce("_number", F.lit(0))).drop("_number")


def scored(spark: SparkSession, index: Index, query: str, path: Callable[[str], str], eligible: Column | None = None) -> DataFrame:
    """(id, bm25, matched) as lexical.scored has them, over stems and from the stored index.

    A phrase is its stems in a row, the last one as a prefix.
    """
    phrases = [[stem(t) for t in p] for p in lexical_query(query)]
    nothing = spark.createDataFrame([], "id string, bm25 double, matched int")
    if not phrases or not index.segments:
        return nothing
    asked = [(i, k, t, k == len(p) - 1) for i, p in enumerate(phrases) for k, t in enumerate(p)]
    fits = [F.col("term").startswith(t) if last else F.col("term") == t for _, _, t, last in asked]
    # a prefix shorter than LEADING may lie in any folder
    narrow = all(len(t) >= LEADING or not last for _, _, t, last in asked)
    folders = F.lit(True)
    if narrow:
        named = spark.createDataFrame([(t,) for _, _, t, _ in asked], "t string").select(folder(F.col("t"))).distinct().collect()  # a row a term
        folders = F.col("folder").isin(*(r[0] for r in named))
    rows = _live(spark, index, path, folders & reduce(lambda a, b: a | b, fits))
    roles = F.array_compact(F.array(*(F.when(fit, F.struct(F.lit(i).alias("phrase"), F.lit(k).alias("k"))) for fit, (i, k, _, _) in zip(fits, asked, strict=True))))
    found = rows.withColumn("r", F.explode(roles))
    ok = (F.lit(True) if eligible is None else eligible).alias("ok")
    single = [i for i, p in enumerate(phrases) if len(p) == 1]
    size = F.element_at(F.array(*(F.lit(len(p)) for p in phrases)), F.col("r.phrase") + 1)
    whole = found.where(F.col("r.phrase").isin(*single)).select("id", "dl", ok, F.col("r.phrase").alias("phrase"), F.size("places").alias("n"))
    starts = found.where(~F.col("r.phrase").isin(*single)).select(
        "id", "dl", ok, F.col("r.phrase").alias("phrase"), F.col("r.k").alias("k"), size.alias("size"), F.explode("places").alias("place")
    )
    rowed = starts.groupBy("id", "phrase", (F.col("place") - F.col("k")).alias("at")).agg(
        F.count_distinct("k").alias("n_k"), F.first("size").alias("size"), F.first("dl").alias("dl"), F.first("ok").alias("ok")
    )
    rowed = rowed.where("n_k = size").select("id", "dl", "ok", "phrase", F.lit(1).alias("n"))
    tf = whole.unionByName(rowed).groupBy("id", "phrase").agg(F.sum("n").alias("tf"), F.first("dl").alias("dl"), F.first("ok").alias("ok"))
    per = tf.groupBy("id").agg(F.first("dl").alias("dl"), F.first("ok").alias("ok"), F.count("*").cast("int").alias("matched"), F.map_from_entries(F.collect_list(F.struct("phrase", "tf"))).alias("tf"))  # a record's own phrases
    stats = per.agg(
        *(F.count_if(F.col("tf")[i].isNotNull()).alias(f"df{i}") for i in range(len(phrases))), F.count_if((F.col("matched") == len(phrases)) & F.col("ok")).alias("full")
    )
    n, mean = index.records, index.terms / max(1, index.records)
    score = F.lit(0.0)
    for i in range(len(phrases)):
        df, c = F.col(f"df{i}"), F.col("tf")[i]
        idf = F.greatest(F.lit(FLOOR), F.log((n - df + 0.5) / (df + 0.5)))
        score = score + F.when(c > 0, idf * c * (K1 + 1) / (c + K1 * (1 - B + B * F.col("dl") / mean))).otherwise(0.0)
    least = F.when(F.col("full") > 0, len(phrases)).otherwise(2 if 3 <= len(phrases) <= 6 else len(phrases))
    held = per.join(F.broadcast(stats))  # one row
    return held.where((F.col("matched") >= least) & F.col("ok")).select("id", F.round(score, 6).alias("bm25"), "matched")


def top(spark: SparkSession, index: Index, query: str, limit: int, path: Callable[[str], str], eligible: Column | None = None) -> DataFrame:
    return scored(spark, index, query, path, eligible).orderBy(F.col("bm25").desc(), "id").limit(limit)
