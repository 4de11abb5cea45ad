"""Lexical retrieval: an inverted index, prefix-AND matching and BM25 ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memvault.functions.text import lexical_query, terms
from memvault.plans.cut import stored

K1, B = 1.2, 0.75
#: Least weight of a term that most records have.
FLOOR = 1e-6


def file_texts(memories: DataFrame, attachments: DataFrame) -> DataFrame:
    """memories with file_text, what the index knows of a record's files: name, kind, type, dimensions and hash, in order of name."""
    line = F.concat_ws(" ", "filename", "media_kind", "mime_type", "dimensions", "sha256")
    # a record's own file lines come together, never their bytes
    listed = attachments.groupBy(F.col("memory_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list(line)), " ").alias("file_text"))
    return memories.join(listed, "id", "left")


def indexed_text(memories: DataFrame) -> Column:
    """Title, content, the text of files if memories have file_text, and tags."""
    files = ["file_text"] if "file_text" in memories.columns else []
    return F.concat_ws(" ", "title", "content", *files, F.array_join("tags", " "))


def postings(memories: DataFrame) -> DataFrame:
    """(term, id, tf): the index as a table; write it partitioned by a hash of the term to serve many queries."""
    words = F.explode(terms(indexed_text(memories))).alias("term")
    return memories.select("id", words).groupBy("term", "id").agg(F.count("*").alias("tf"))


def _hits(words: Column, phrase: list[str]) -> Column:
    """Places where a phrase's terms follow each other, the last one as a prefix."""
    *whole, last = phrase
    if not whole:
        return F.size(F.filter(words, lambda t: t.startswith(last)))

    def here(_: Column, i: Column) -> Column:
        test = F.coalesce(F.get(words, i + len(whole)).startswith(last), F.lit(False))
        for k, term in enumerate(whole):
            test = test & (F.get(words, i + k) == term)
        return test

    return F.size(F.filter(words, here))


def scored(memories: DataFrame, query: str, eligible: Column | None = None) -> DataFrame:
    """(id, bm25, matched) for the eligible records that have all of a query's phrases, or any two of three to six if none has all.

    Statistics are those of the whole index. Texts are read and split once: the counts of each record are written, then summed and scored.
    """
    phrases = lexical_query(query)
    if not phrases:
        return memories.select("id", F.lit(0.0).alias("bm25"), F.lit(0).alias("matched")).limit(0)
    words = terms(indexed_text(memories))
    base = memories.select("id", (F.lit(True) if eligible is None else eligible).alias("_ok"), words.alias("_w"))
    tf = base.select("id", "_ok", F.size("_w").alias("dl"), *[_hits(F.col("_w"), p).alias(f"tf{i}") for i, p in enumerate(phrases)])
    tf = stored(tf)
    cols = [F.col(f"tf{i}") for i in range(len(phrases))]
    has = [F.when(c > 0, 1).otherwise(0) for c in cols]
    matched = sum(has[1:], has[0])
    stats = tf.agg(
        F.count("*").alias("n"),
        F.avg("dl").alias("avgdl"),
        *[F.count_if(c > 0).alias(f"df{i}") for i, c in enumerate(cols)],
        F.count_if((matched == len(phrases)) & F.col("_ok")).alias("full"),
    )
    least = F.when(F.col("full") > 0, len(phrases)).otherwise(2 if 3 <= len(phrases) <= 6 else len(phrases))
    score = F.lit(0.0)
    for i, c in enumerate(cols):
        df = F.col(f"df{i}")
        idf = F.greatest(F.lit(FLOOR), F.log((F.col("n") - df + 0.5) / (df + 0.5)))
        score = score + F.when(c > 0, idf * c * (K1 + 1) / (c + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))).otherwise(0.0)
    rows = tf.withColumn("matched", matched).where("matched > 0").join(F.broadcast(stats))  # one row
    return rows.where((F.col("matched") >= least) & F.col("_ok")).select("id", F.round(score, 6).alias("bm25"), "matched")


def top(memories: DataFrame, query: str, limit: int, eligible: Column | None = None) -> DataFrame:
    return scored(memories, query, eligible).orderBy(F.col("bm25").desc(), "id").limit(limit)
