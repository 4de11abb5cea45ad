"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line stripped of blanks at both ends with A-Z lower-cased;
only keys of ``min_chars`` code points or more count. Keys are compared by
their 128-bit XXH3 hash. ``LineRuns`` holds what is known of the keys as sorted
runs: each new batch is merge-anti-joined with the runs, adds its fresh keys
(with the largest doc_id that holds them) and its counts as a run of its own, and
``fanout`` runs of a level are compacted into one of the next. Runs are tables in the same number of buckets by
hash, each sorted, so that a batch meets them without moving their rows; these move when they are compacted. Batches come in
descending doc_id order here, but counts add and owners take the maximum, so
any order gives the same state.

Defined cases: a null or empty text is one empty line and loses nothing. Rows
without a doc_id are not counted and keep all lines. Rows that repeat a doc_id
count as one document, and each is rewritten on its own. Extra columns pass
through, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memvault.llm.common import BLANKS, drop, parallelism, shared_dir, tidy, written

_BLANKS = BLANKS.encode()
#: Keys in more than one in so many (document, key) pairs are hot: there are at most as many of them.
HOT_SHARE = 20_000


def line_hash(line: bytes, min_chars: int) -> bytes | None:
    """The hash of a line's key, or None if the key is too short to count."""
    key = line.strip(_BLANKS).lower()  # bytes.lower changes A-Z alone
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode()) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


def line_keys(documents: DataFrame, *, text: str = "text", min_chars: int = 20) -> DataFrame:
    """(doc_id, h): each document's distinct line keys."""
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.binary())])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = [], []
            for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = {line_hash(x, min_chars) for x in body.as_buffer().to_pybytes().split(b"\n")} - {None}
                ids += [doc_id] * len(found)
                hashes += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.binary())], schema=schema)

    body = F.col(f"`{text}`")
    rows = documents.where(F.col("doc_id").isNotNull() & body.isNotNull())
    return rows.select("doc_id", body.cast("binary").alias("b")).mapInArrow(keys, "doc_id long, h binary")


class LineRuns:
    """Sorted runs of (h, owner, n_docs) in levels; owner is null where a run only adds to the count."""

    def __init__(self, spark: SparkSession, fanout: int = 4):
        self.spark, self.fanout, self.buckets = spark, fanout, parallelism(spark)
        self.levels: list[list[str]] = []

    def _names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def _merged(self, names: list[str]) -> DataFrame:
        """One row per key over some runs, read as files: a union of bucketed tables would not be shuffled, and lose sums (Spark 4.1)."""
        rows = self.spark.read.schema("h binary, owner long, n_docs long").parquet(*(f"{shared_dir(self.spark)}/{name}" for name in names))
        return rows.groupBy("h").agg(F.max("owner").alias("owner"), F.sum("n_docs").alias("n_docs"))

    def merged(self) -> DataFrame | None:
        """One row per key over all runs."""
        return self._merged(self._names()) if self._names() else None

    def add(self, keys: DataFrame) -> None:
        """Merge-anti-joins a batch of distinct (doc_id, h) with the runs and adds its own run."""
        batch = keys.groupBy("h").agg(F.max("doc_id").alias("owner"), F.count("*").alias("n_docs"))
        had = []
        for i, name in enumerate(self._names()):
            batch = batch.join(self.spark.table(name).select("h", F.col("owner").alias(f"_had{i}")), "h", "left")
            had.append(F.col(f"_had{i}"))
        if had:
            known = F.greatest(*had, F.lit(None).cast("long"))  # nulls are passed over
            batch = batch.select("h", F.when(known.isNull() | (F.col("owner") > known), F.col("owner")).alias("owner"), "n_docs")
        self._push(0, batch)

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows of keys whose key no run holds."""
        for name in self._names():
            keys = keys.join(self.spark.table(name).select("h"), "h", "left_anti")
        return keys

    def _stored(self, rows: DataFrame, level: int) -> str:
        """Writes rows as a run; its name."""
        name = f"line_run_{level}_{uuid.uuid4().hex}"
        out = rows.write.option("compression", "zstd").bucketBy(self.buckets, "h").sortBy("h").format("parquet")
        with tidy(self.spark):
            out.option("path", f"{shared_dir(self.spark)}/{name}").saveAsTable(name)
        return name

    def _dropped(self, names: list[str]) -> None:
        for name in names:
            if (rows := self.spark.table(name)).inputFiles():
                drop(rows)
            self.spark.sql(f"DROP TABLE {name}")

    def close(self) -> None:
        """Drops all runs."""
        self._dropped(self._names())
        self.levels = []

    def _push(self, level: int, rows: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(self._stored(rows, level))
        if len(self.levels[level]) >= self.fanout:
            names, self.levels[level] = self.levels[level], []
            self._push(level + 1, self._merged(names))
            self._dropped(names)


def _cut(documents: DataFrame, n: int) -> list[int]:
    """n - 1 doc_ids that part the documents into ranges of about the same size."""
    found = documents.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 1000).alias("q")).first()["q"]
    return sorted(set(found or []))


def drops(keys: DataFrame, runs: LineRuns, min_docs: int) -> DataFrame:
    """(doc_id, drop): for each document that loses lines, the hashes of their keys.

    A hot key (at most HOT_SHARE of them can exist) meets its documents by broadcast, the others by shuffle.
    """
    state = written(runs.merged(), "line-state")
    runs.close()
    pairs = state.agg(F.sum("n_docs")).first()[0] or 0
    over = state.where(F.col("n_docs") >= min_docs).select("h", "owner", "n_docs")
    hot = F.col("n_docs") * HOT_SHARE > F.lit(pairs)
    least = max(min_docs, pairs // HOT_SHARE + 1)
    few = over.where(hot & (F.col("n_docs") >= least)).select("h", "owner")
    many = over.where(F.col("n_docs") < least).select("h", "owner")
    lost = keys.join(F.broadcast(few), "h").unionByName(keys.join(many, "h"))
    return (
        lost.where(F.col("doc_id") < F.col("owner"))
        .groupBy("doc_id")
        .agg(F.collect_set("h").alias("drop"))
    )


def _rewriter(min_chars: int):
    """A UDF (text as binary, dropped hashes) -> the lines that stay, and counts."""
    kind = T.StructType([T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType())])

    def rewrite(text: pa.Array, drop: pa.Array) -> pa.Array:
        totals, losses, kept = [], [], []
        for body, gone in zip(text, drop, strict=True):
            lines = body.as_buffer().to_pybytes().split(b"\n") if body.is_valid else [b""]
            stay = lines
            if gone.is_valid:
                lost = set(gone.as_py())
                stay = [x for x in lines if line_hash(x, min_chars) not in lost]
            totals.append(len(lines))
            losses.append(len(lines) - len(stay))
            kept.append(b"\n".join(stay))
        texts = pa.array(kept, pa.binary()).cast(pa.string())
        columns = [pa.array(totals, pa.int64()), pa.array(losses, pa.int64()), texts]
        return pa.StructArray.from_arrays(columns, kind.names)

    return F.arrow_udf(rewrite, kind)


def dedup_lines(
    documents: DataFrame,
    *,
    text: str = "text",
    min_chars: int = 20,
    min_docs: int = 3,
    batches: int = 4,
    fanout: int = 4,
    names: tuple[str, str] = ("n_lines", "n_dropped"),
) -> DataFrame:
    """documents with text rewritten, and under names its lines before and those dropped (in place of columns so called).

    Keys of min_chars or more found in min_docs documents or more lose all their
    lines except in the largest doc_id that holds them. The keys are taken from
    the texts once and then added to the runs in batches of doc_id ranges,
    largest first.
    """
    spark = documents.sparkSession
    cuts = _cut(documents, batches)
    number = F.lit(0)
    for cut in cuts:
        number = number + F.when(F.col("doc_id") > cut, 1).otherwise(0)
    keys = written(line_keys(documents, text=text, min_chars=min_chars).distinct().withColumn("batch", number), "line-keys")
    runs = LineRuns(spark, fanout)
    for i in range(len(cuts), -1, -1):
        runs.add(keys.where(F.col("batch") == i).select("doc_id", "h"))
    gone = drops(keys.select("doc_id", "h"), runs, min_docs).select(F.col("doc_id").alias("_id"), F.col("drop").alias("_drop"))
    rows = documents.select(
        F.struct("*").alias("_row"), F.col("doc_id").alias("_doc"), F.col(f"`{text}`").cast("binary").alias("_body")
    )
    joined = rows.join(gone, F.col("_doc") == F.col("_id"), "left")
    done = joined.withColumn("_new", _rewriter(min_chars)(F.col("_body"), F.col("_drop")))
    kept = [
        F.col("_new.kept").alias(text) if c == text else F.col(f"_row.`{c}`") for c in documents.columns if c not in names
    ]
    return done.select(*kept, F.col("_new.n_lines").alias(names[0]), F.col("_new.n_dropped").alias(names[1]))
