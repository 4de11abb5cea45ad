"""Hybrid recall: lexical and vector lanes, reciprocal rank fusion, dedup, boosts, final scores."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memvault.functions.text import dedup_key, query_tokens
from memvault.operators import filters, lexical, vectors
from memvault.plans.cut import stored

K = 60
# fixed values: words that are never read as initials
NON_INITIAL = (
    "os db vm ci cd ip io ui ux id qa pr ai ml go js ts py rs sh up no ok api url uri sql tls ssl ssh tcp udp dns cpu gpu ram "
    "ssd env cli sdk jwt ttl wal fts rrf app log key tag net web dev ops sec port host node code data file path name time date "
    "role team mode type list page test prod main core base auth sync pool lock user work task goal fact rule plan item info "
    "text body view repo rust json yaml toml http grpc rest raid cidr vlan wasm onnx"
).split()
#: Boosts: initials in capitals, initials in any case, exact token with a digit, exact token; and the most in all.
CAPITALS, INITIALS, DIGITS, EXACT, MOST = 0.26, 0.12, 0.14, 0.06, 0.35
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Request:
    query: str
    vector: list[float]
    limit: int = 10
    category: str | None = None
    as_of: str | None = None
    day: str | None = None
    min_similarity: float | None = None

    def __post_init__(self) -> None:
        if not self.query.strip():
            raise ValueError("a query can't be blank")
        if self.min_similarity is not None and not 0 <= self.min_similarity <= 1:
            raise ValueError("min_similarity lies between 0 and 1")
        if self.limit < 0:
            raise ValueError("limit can't be negative")

    @property
    def bare_acronym(self) -> bool:
        word = self.query.strip().lower()
        return bool(re.fullmatch(r"[^\W_]{2,5}", word)) and word not in NON_INITIAL and query_tokens(word) == [word]

    @property
    def fetch(self) -> int:
        return max(6 * self.limit, 1000 if self.bare_acronym else 80)


def _begins(prefix: str):
    return lambda tag: tag.startswith(prefix)


def boost(tokens: list[str], title: Column, content: Column, tags: Column, files: Column | None = None) -> Column:
    """What a record gains for tokens that it holds, or whose letters begin its words; what is known of its files counts too."""
    words = F.filter(F.split(F.concat_ws(" ", title, content, *([] if files is None else [files])), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    lowered = F.transform(words, lambda w: F.lower(w))
    first = F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")
    low_tags = F.transform(tags, lambda t: F.lower(t))
    total = F.lit(0.0)
    for t in tokens:
        exact = F.array_contains(lowered, t) | F.array_contains(low_tags, t) | F.exists(low_tags, _begins(t + "-"))
        gain = F.when(exact, DIGITS if re.search("[0-9]", t) else EXACT)
        if 2 <= len(t) <= 5 and t not in NON_INITIAL:
            if re.fullmatch("[a-z]+", t):
                gain = gain.when(first.contains(t.upper()), CAPITALS)
            gain = gain.when(F.translate(first, UPPER, LOWER).contains(t), INITIALS)
        total = total + gain.otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(MOST), total))


def lanes(memories: DataFrame, vecs: DataFrame, request: Request, words: DataFrame | None = None) -> DataFrame:
    """(id, bm25_rank, vector_rank, similarity): the best of both lanes; each lane is a top-k before it is numbered.

    words (id, bm25) are the lexical lane's, if a stored index has found them; else all texts are read.
    """
    words = lexical.top(memories, request.query, request.fetch, eligible(request)) if words is None else words
    near = vecs.join(memories.where(eligible(request)).select("id"), "id", "left_semi")
    close = vectors.nearest(near, request.vector, request.fetch, keep_all=request.bare_acronym)
    # at most request.fetch rows are numbered in one task
    one = words.select("id", F.row_number().over(Window.orderBy(F.col("bm25").desc(), "id")).alias("bm25_rank"))
    two = close.select("id", "similarity", F.row_number().over(Window.orderBy(F.col("similarity").desc(), "id")).alias("vector_rank"))
    return one.join(two, "id", "full_outer")


def eligible(request: Request) -> Column:
    """What a request asks of a record's category, status and times."""
    test = F.lit(True)
    if request.category is not None:
        test = test & (F.col("category") == request.category)
    test = test & (filters.found_as_of(request.as_of) if request.as_of else F.col("status") == "active")
    return test & filters.on_day(request.day) if request.day else test


def recall(memories: DataFrame, vecs: DataFrame, request: Request, words: DataFrame | None = None) -> DataFrame:
    """(id, category, title, score, bm25_rank, vector_rank, similarity), best first; words: see lanes()."""
    found = stored(lanes(memories, vecs, request, words))  # read twice
    rrf = F.coalesce(1 / (K + F.col("bm25_rank")), F.lit(0.0)) + F.coalesce(1 / (K + F.col("vector_rank")), F.lit(0.0))
    rows = memories.join(F.broadcast(found), "id").withColumn("rrf", F.round(rrf, 9))  # twice request.fetch rows at most
    first = Window.partitionBy("category", dedup_key(F.col("content"))).orderBy(F.col("rrf").desc(), "id")
    rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    if request.min_similarity is not None:
        rows = rows.where(F.col("similarity") >= request.min_similarity)
    tokens = query_tokens(request.query)
    files = F.col("file_text") if "file_text" in rows.columns else None
    rows = rows.withColumn("boost", boost(tokens, F.col("title"), F.col("content"), F.col("tags"), files))
    lexical_lane = found.agg((F.count("bm25_rank") > 0).alias("_lexical"))
    rows = rows.join(F.broadcast(lexical_lane))  # one row
    vrank, gain = F.col("vector_rank"), F.col("boost")
    unseen = F.col("bm25_rank").isNull()
    extra = F.when(F.col("_lexical") & unseen & (F.coalesce(vrank, F.lit(999)) <= 5) & (gain >= EXACT - 1e-5), 1 / (70 + vrank)).otherwise(0.0)
    base = (F.col("rrf") + extra) * 61 / 2
    if request.bare_acronym:
        base = base + F.when(unseen & (gain >= INITIALS - 1e-5), 0.5).otherwise(0.0)
    effective = F.when((gain >= INITIALS - 1e-5) | ~unseen | (F.coalesce(vrank, F.lit(0)) == 1), gain).otherwise(0.2 * gain)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.85 * base + 0.15 * effective / MOST))
    rows = rows.withColumn("score", F.round(score, 6))
    return rows.select("id", "category", "title", "score", "bm25_rank", "vector_rank", "similarity").orderBy(F.col("score").desc(), "id").limit(request.limit)


def expanded(hits: DataFrame, memories: DataFrame, links: DataFrame, limit: int, category: str | None = None, as_of: str | None = None, day: str | None = None) -> DataFrame:
    """(id, score) with the neighbours of the three best hits, at 0.8 of their score.

    Neighbours are active now, under as_of too, and pass the request's category, as_of and day; min_similarity isn't asked again.
    """
    best = hits.orderBy(F.col("score").desc(), "id").limit(3).select(F.col("id").alias("hit"), "score")
    edges = links.select(F.col("source_id").alias("hit"), F.col("target_id").alias("id")).unionByName(
        links.select(F.col("target_id").alias("hit"), F.col("source_id").alias("id"))
    )
    near = edges.join(F.broadcast(best), "hit").groupBy("id").agg(F.round(F.max("score") * 0.8, 6).alias("score"))  # three rows
    active = memories.where(F.col("status") == "active")
    active = active if category is None else active.where(F.col("category") == category)
    active = active if as_of is None else active.where(filters.listed_as_of(as_of))
    active = active if day is None else active.where(filters.on_day(day))
    near = active.select("id").join(near, "id").join(hits.select("id"), "id", "left_anti")
    return hits.select("id", "score").unionByName(near.select("id", "score")).orderBy(F.col("score").desc(), "id").limit(limit)


def media_limit(limit: int) -> int:
    """How many hits to fetch before a media filter."""
    return max(limit, 100)


def with_media(hits: DataFrame, files: DataFrame, kind: str, limit: int, part_of_mime: bool = False) -> DataFrame:
    """The first hits that have a file of a kind or MIME type (part_of_mime: a type that contains it); any and all: with any file."""
    k = kind.strip().lower()
    mime = F.lower("mime_type")
    fits = (F.lower("media_kind") == k) | (mime.contains(k) if part_of_mime else mime == k)
    wanted = files if k in ("any", "all") else files.where(fits)
    return hits.join(wanted.select(F.col("memory_id").alias("id")), "id", "left_semi").orderBy(F.col("score").desc(), "id").limit(limit)


def selected_first(hits: DataFrame, selected: DataFrame) -> DataFrame:
    """hits, with the record that an answer selected (one row with id) raised to score 1 and first."""
    mark = selected.select("id", F.lit(True).alias("_sel")).limit(1)
    rows = hits.join(F.broadcast(mark), "id", "left").withColumn("score", F.when(F.col("_sel"), 1.0).otherwise(F.col("score")))
    return rows.orderBy(F.col("_sel").desc_nulls_last(), F.col("score").desc(), "id").drop("_sel")
