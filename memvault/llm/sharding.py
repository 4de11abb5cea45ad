"""Sharding by histogram sort, in built-in functions alone.

Documents are ordered by a key: a hash of the text, then a hash of the doc_id, so
that equal texts stand together. Shards are ranges of that order with nearly
equal bytes. The splitters are found by counting exact bytes below candidate
boundaries over all partitions: a round counts the bytes of up to 4096 sub-ranges of
each range that still holds an unsettled splitter, and a splitter settles when an
edge is within the tolerance of its target. A group of equal texts is only cut when
no edge outside it is near enough. Then the rows are exchanged once and numbered.

Defined cases: a null or empty text has size 1 and the checksum of no bytes. Rows
without a doc_id and repeated rows are placed like others. With fewer bytes than
shards some shards stay empty. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memvault.llm.common import written

#: Key bits that one round splits, so at most 2 ** BITS counts come back for each open splitter.
BITS = 12
#: Rows that are numbered together at most, apart from rows that agree in both hashes.
CELL = 50_000

Edge = tuple[int, int]  # the least (text hash, id hash) at or above a boundary
_LOW = -(1 << 63)


def keyed(documents: DataFrame, text: str = "text") -> DataFrame:
    """Written: (doc_id, size, text_crc32, h, d), the rows without their texts."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return written(
        documents.select(
            "doc_id",
            (F.octet_length(body) + 1).cast("long").alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            F.xxhash64(body).alias("h"),
            F.xxhash64(F.lit("id"), F.col("doc_id")).alias("d"),
        ),
        "shard-keys",
    )


def _children(rows: DataFrame, prefixes: list[tuple[int, int]]) -> dict[tuple[int, int], list[tuple[int, int, int]]]:
    """(part, bytes, rows) of the sub-ranges of open ranges. A range is (bits known, their value) of the 128-bit key h then d."""
    found: dict[tuple[int, int], list[tuple[int, int, int]]] = {p: [] for p in prefixes}
    known, which = F.lit(None).cast("int"), F.lit(None).cast("long")
    for number, (depth, value) in enumerate(prefixes):
        inside, part = _inside(depth, value), _part(depth)
        known = F.when(inside, F.lit(number)).otherwise(known)
        which = F.when(inside, part).otherwise(which)
    counts = rows.select(known.alias("p"), which.alias("c"), "size").where("p is not null").groupBy("p", "c").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    for row in counts.collect():  # at most 2 ** BITS rows for each open range
        found[prefixes[row["p"]]].append((row["c"], row["bytes"], row["n"]))
    return {p: sorted(c) for p, c in found.items()}


def _step(depth: int) -> int:
    """Bits to split at this depth: a step doesn't cross from h into d."""
    return min(BITS, 64 - depth % 64)


def _unsigned(column: str, shift: int, bits: int) -> Column:
    """bits of a signed hash above shift, as if the hash were shifted to start at 0."""
    raised = F.col(column).bitwiseXOR(F.lit(_LOW))
    return F.expr(f"shiftrightunsigned({column} ^ {_LOW}L, {shift})").bitwiseAND(F.lit((1 << bits) - 1)) if shift else raised.bitwiseAND(F.lit((1 << bits) - 1))


def _part(depth: int) -> Column:
    step = _step(depth)
    return _unsigned("h" if depth < 64 else "d", 64 - depth % 64 - step, step).cast("long")


def _inside(depth: int, value: int) -> Column:
    """Rows whose key begins with these bits."""
    if depth == 0:
        return F.lit(True)
    if depth <= 64:
        low = (value << (64 - depth)) + _LOW
        return F.col("h").between(low, low + (1 << (64 - depth)) - 1)
    h, d = (value >> (depth - 64)) + _LOW, value & ((1 << (depth - 64)) - 1)
    low = (d << (128 - depth)) + _LOW
    return (F.col("h") == h) & F.col("d").between(low, low + (1 << (128 - depth)) - 1)


def _edge(depth: int, value: int) -> Edge | None:
    """The least key that begins with these bits; None past the last key."""
    if value >= 1 << depth:
        return None
    key = value << (128 - depth)
    return (key >> 64) + _LOW, (key & ((1 << 64) - 1)) + _LOW


def splitters(rows: DataFrame, shards: int, tolerance: float) -> list[Edge | None]:
    """shards - 1 boundaries with about equal bytes between them; None: all rows lie below."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    near = tolerance * total / shards
    open_at: dict[int, tuple[int, int, int]] = dict.fromkeys(range(1, shards), (0, 0, 0))  # depth, value, bytes below
    edges: dict[int, Edge | None] = {}
    while open_at:
        ranges = sorted({(depth, value) for depth, value, _ in open_at.values()})
        counted = _children(rows, ranges)
        for s, (depth, value, below) in list(open_at.items()):
            target = total * s / shards
            step = _step(depth)
            parts = counted[(depth, value)]
            ends = []
            for part, size, n in parts:
                ends.append((below, below + size, part, n))
                below += size
            k = min(bisect_left([high for _, high, _, _ in ends], target), len(ends) - 1)
            if k < 0:
                edges[s] = None
                del open_at[s]
                continue
            low, high, part, n = ends[k]
            child = (value << step) + part
            if min(target - low, high - target) <= near or n == 1 or depth + step == 128:
                edges[s] = _edge(depth + step, child if target - low <= high - target else child + 1)
                del open_at[s]
            else:
                open_at[s] = (depth + step, child, low)
    return [edges[s] for s in range(1, shards)]


def _at_or_above(edge: Edge) -> Column:
    h, d = edge
    return (F.col("h") > h) | ((F.col("h") == h) & (F.col("d") >= d))


def shard(documents: DataFrame, *, text: str = "text", shards: int = 16, tolerance: float = 0.005) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) per row of documents."""
    rows = keyed(documents, text)
    number = F.lit(0)
    for edge in splitters(rows, shards, tolerance):
        if edge is not None:
            number = number + F.when(_at_or_above(edge), 1).otherwise(0)
    placed = rows.withColumn("shard", number.cast("int")).withColumn("bin", _unsigned("h", 64 - BITS, BITS).cast("int"))
    # cells: ranges of the order within a shard, of about CELL rows or fewer; large bins are cut by the id's hash
    bins = placed.groupBy("shard", "bin").agg(F.count("*").alias("n"))
    bins = bins.withColumn("cuts", F.ceil(F.col("n") / CELL).cast("int")).drop("n")
    cell = F.pmod("d", F.col("cuts")).cast("int").alias("cell")
    cut = placed.join(F.broadcast(bins), ["shard", "bin"]).select("doc_id", "size", "text_crc32", "h", "d", "shard", "bin", cell)
    before = Window.partitionBy("shard").orderBy("bin", "cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cut.groupBy("shard", "bin", "cell").agg(F.count("*").alias("n"))
    base = cells.select("shard", "bin", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # both broadcasts hold at most one row per bin and shard border, and one per CELL rows besides
    order = Window.partitionBy("shard", "bin", "cell").orderBy("h", "d", "doc_id", "text_crc32")
    numbered = cut.withColumn("place", F.row_number().over(order) - 1)
    out = numbered.join(F.broadcast(base), ["shard", "bin", "cell"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("place")).cast("long").alias("slot"))


def write_shards(documents: DataFrame, places: DataFrame, path: str) -> None:
    """The documents (unique doc_ids) under path, one folder per shard, by slot."""
    joined = documents.join(places.select("doc_id", "shard", "slot"), "doc_id")
    joined.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
