"""Ranked lexical search by bag deduplication.

A document matters to the items only through its bag, the counts of the items' terms in it, and
through m, which follows from its length. So each text becomes its bag once; documents with equal bag and equal m are one class, which is
scored once; its score is then that of its members, in order of their ids.

Steps, for each block of items of at most ``BLOCK_TERMS`` terms (one block at usual sizes):

1. The block's vocabulary, whose size is bounded so, goes to all tasks. Each text is cut into terms; its bag and
   its length are written. One more pass over the bags counts documents per term.
2. Members are combined where they are read: of a class, only the ``k`` least ids can be among an
   item's k best, so a task hands on at most k members per class. Classes meet by their hash, in as many parts per
   hash as keep a hot class from one task, then by hash alone. Rows of one hash are held against each other by their
   whole bags, so a collision parts them.
3. A task scores each class against all items through the items' postings and keeps each item's k
   best; the best of all tasks are merged.

Defined cases: a null text, or one without terms, is no document of the statistics and is never found. An item
without terms finds nothing. Rows that repeat an id are ranked each, also as items. Rows without a doc_id
come last among equal scores. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memvault.llm.common import drop, parallelism, written

#: Terms of a block of items, with repeats: what tasks hold of the items at a time.
BLOCK_TERMS = 1_000_000
#: Bytes of text that are cut into terms at a time.
SEGMENT = 1 << 22
#: Classes that a task combines before it hands them on, and classes scored at a time.
COMBINED, SCORED = 50_000, 256
_LETTERS = bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
#: Letters stay, A-Z lower-cased; all other bytes part terms.
_TERMS = bytes(ord(chr(b).lower()) if b < 0x80 and b in _LETTERS else b if b in _LETTERS else 0x20 for b in range(256))
_OTHER = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
_LAST = (1 << 63) - 1


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text in turn, a segment at a time."""
    start = 0
    while len(text) - start > SEGMENT and (cut := _OTHER.search(text, start + SEGMENT)):
        yield text[start : cut.start()].translate(_TERMS).split()
        start = cut.start()
    yield (text[start:] if start else text).translate(_TERMS).split()


def counted(text: bytes) -> Counter:
    """The terms of a text with their counts."""
    found: Counter = Counter()
    for some in terms(text):
        found.update(some)
    return found


@dataclass
class Items:
    """A block of items: their ids, and for each term of their vocabulary the items that hold it, with counts."""

    ids: list[int | None]
    vocabulary: dict[bytes, int]
    first: np.ndarray  # of each term's postings
    item: np.ndarray
    often: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int | None, bytes | None]]) -> Items:
        postings: dict[bytes, list[tuple[int, int]]] = {}
        for at, (_, text) in enumerate(rows):
            for term, often in counted(text or b"").items():
                postings.setdefault(term, []).append((at, often))
        flat = [x for term in postings for x in postings[term]]
        sizes = np.array([len(p) for p in postings.values()], np.int64)
        item, often = (np.array(flat, np.int64).reshape(-1, 2).T).copy()
        return cls([i for i, _ in rows], {t: k for k, t in enumerate(postings)}, np.append(0, np.cumsum(sizes)), item, often)


def blocks_of(items: DataFrame, *, item_id: str, text: str, block_terms: int) -> Iterator[list[tuple[int | None, bytes | None]]]:
    """The items in blocks of at most block_terms characters' worth of terms (or one item)."""
    held, size = [], 0
    rows = items.select(F.col(f"`{item_id}`").cast("long").alias("i"), F.col(f"`{text}`").cast("binary").alias("t"))
    for row in rows.toLocalIterator():  # a partition at a time: the stated query set, in blocks
        body = bytes(row["t"]) if row["t"] is not None else None
        most = len(body or b"") // 2 + 1  # terms are parted by a byte at least
        if held and size + most > block_terms:
            yield held
            held, size = [], 0
        held.append((row["i"], body))
        size += most
    if held:
        yield held


# --- bags -------------------------------------------------------------------------------------------


def bags(documents: DataFrame, items: Items, *, text: str = "text") -> DataFrame:
    """Written: (doc_id, n, bag) of each text with terms; a bag is sorted term numbers, then their counts."""
    vocabulary = documents.sparkSession.sparkContext.broadcast(items.vocabulary)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in batches:
            ids, ns, found = [], [], []
            for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not body.is_valid:
                    continue
                n, held = 0, Counter()
                for some in terms(body.as_py()):
                    n += len(some)
                    held.update(filter(known.__contains__, some))
                if n:
                    pairs = sorted((known[t], often) for t, often in held.items())
                    ids.append(doc_id)
                    ns.append(n)
                    found.append(np.array(pairs, "<u4").reshape(-1, 2).T.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(found, pa.binary())], names=["doc_id", "n", "bag"])

    rows = documents.select(F.col("doc_id").cast("long"), F.col(f"`{text}`").cast("binary").alias("b"))
    return written(rows.mapInArrow(cut, "doc_id long, n long, bag binary"), "rank-bags")


def bag_arrays(bag: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(term numbers, counts) of a bag; a row's text is too short for counts beyond 32 bits."""
    flat = np.frombuffer(bag, "<u4").astype(np.int64)
    return flat[: len(flat) // 2], flat[len(flat) // 2 :]


def document_counts(made: DataFrame, size: int) -> np.ndarray:
    """The number of documents with each term of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for bag in batch.column(0):
                total[bag_arrays(bag.as_buffer())[0]] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "df"])

    found = made.select("bag").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # a row a term of the block
    out = np.zeros(size, np.int64)
    out[found["term"].to_numpy()] = found["df"].to_numpy()
    return out


# --- classes ----------------------------------------------------------------------------------------

_MEMBER = "h binary, m long, bag binary, doc_id long"
_MEMBER_TYPES = [pa.binary(), pa.int64(), pa.binary(), pa.int64()]
_MEMBER_NAMES = [x.split()[0] for x in _MEMBER.split(", ")]


def _order(doc_id: int | None) -> int:
    return _LAST if doc_id is None else doc_id


def _batches(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def combined(made: DataFrame, documents: int, total: int, k: int) -> DataFrame:
    """Rows of _MEMBER: of each class that a task reads (in lots of COMBINED classes), the k least ids."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bytes], list[int]] = {}

        def given() -> pa.RecordBatch:
            rows = []
            for key, ids in held.items():
                h = hashlib.blake2b(key[1] + key[0].to_bytes(8, "little"), digest_size=16).digest()
                rows += [(h, *key, None if d == -_LAST else -d) for d in ids]
            return _batches(rows, _MEMBER_NAMES, _MEMBER_TYPES)

        for batch in batches:
            for doc_id, n, bag in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if not bag:
                    continue  # scores 0 with every item
                key = (25 + 75 * n * documents // total, bag)
                ids = held.setdefault(key, [])
                if len(ids) < k:
                    heapq.heappush(ids, -_order(doc_id))
                else:
                    heapq.heappushpop(ids, -_order(doc_id))
                if len(held) >= COMBINED:
                    yield given()
                    held = {}
        yield given()

    return made.mapInArrow(combine, _MEMBER)


def least(members: DataFrame, k: int) -> DataFrame:
    """The k least ids of each class among rows that are sorted by hash, m, bag and id."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            at = []
            for i, key in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                if key != last:
                    last, seen = key, 0
                seen += 1
                if seen <= k:
                    at.append(i)
            yield batch.take(pa.array(at, pa.int64()))

    return members.mapInArrow(keep, _MEMBER)


def weights(documents: int, counts: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in counts.tolist()], np.int64)


def scores(items: Items, weight: np.ndarray, classes: list[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
    """(classes, items): each class (m, term numbers, counts) scored with every item, in 64-bit integers."""
    sizes = [len(t) for _, t, _ in classes]
    term, often = np.concatenate([t for _, t, _ in classes]), np.concatenate([c for _, _, c in classes])
    of = np.repeat(np.arange(len(classes)), sizes)
    m = np.repeat(np.array([m for m, _, _ in classes], np.int64), sizes)
    share = weight[term] * (1_000_000_000 * often // (1000 * often + 8 * m))
    first, many = items.first[term], items.first[term + 1] - items.first[term]
    at = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
    out = np.zeros(len(classes) * len(items.ids), np.int64)
    np.add.at(out, np.repeat(of * len(items.ids), many) + items.item[at], np.repeat(share, many) * items.often[at])
    return out.reshape(len(classes), -1)


def ranked_block(documents: DataFrame, items: Items, *, text: str, k: int) -> DataFrame:
    """(item, doc_id, score): candidates of each item by its place in the block, a superset of its k best."""
    spark = documents.sparkSession
    made = bags(documents, items, text=text)
    n, total = made.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weight = weights(n, document_counts(made, len(items.vocabulary)))
    held = spark.sparkContext.broadcast((items, weight))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight = held.value
        best: list[list[tuple[int, int, int]]] = [[] for _ in items.ids]  # heaps of (score, -id, tie)
        bound = np.zeros(len(items.ids), np.int64)
        waiting: list[tuple[tuple[bytes, int, bytes], list[int]]] = []  # class and its members
        taken = 0

        def settle() -> None:
            nonlocal taken
            found = scores(items, weight, [(m, *bag_arrays(bag)) for (_, m, bag), _ in waiting])
            # an equal score may win by its id
            for at, item in zip(*(x.tolist() for x in np.nonzero((found >= bound) & (found > 0))), strict=True):
                value, heap = int(found[at, item]), best[item]
                for doc_id in waiting[at][1]:
                    taken += 1
                    entry = (value, -doc_id, taken)
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry <= heapq.heappushpop(heap, entry):
                        break  # members come by ascending id: no later one is better
                if len(heap) == k:
                    bound[item] = heap[0][0]
            waiting.clear()

        for batch in batches:
            for h, m, bag, doc_id in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if waiting and waiting[-1][0] == (h, m, bag):
                    waiting[-1][1].append(_order(doc_id))
                    continue
                if len(waiting) >= SCORED:
                    settle()
                waiting.append(((h, m, bag), [_order(doc_id)]))
        if waiting:
            settle()
        rows = [(item, None if d == -_LAST else -d, value) for item, heap in enumerate(best) for value, d, _ in heap]
        yield _batches(rows, ["item", "doc_id", "score"], [pa.int64()] * 3)

    keys = ["h", "m", "bag"]
    lots = max(1, math.isqrt(parallelism(spark)))
    members = combined(made, n, max(total, 1), k)
    number = F.pmod(F.xxhash64("doc_id"), F.lit(lots))
    # a hot class comes from all tasks: first by lots, then by class
    first = members.withColumn("lot", number).repartition("h", "lot").sortWithinPartitions(*keys, F.col("doc_id").asc_nulls_last()).drop("lot")
    classes = least(first, k).repartition("h").sortWithinPartitions(*keys, F.col("doc_id").asc_nulls_last())
    out = written(least(classes, k).mapInArrow(score, "item long, doc_id long, score long"), "rank-best")
    drop(made)
    return out


def rank(
    documents: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 10, block_terms: int = BLOCK_TERMS
) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k highest-scoring documents with a score above 0, equal scores by ascending doc_id."""
    spark = documents.sparkSession
    out, base, ids = None, 0, []
    for rows in blocks_of(items, item_id=item_id, text=item_text, block_terms=block_terms):
        block = Items.of(rows)
        found = ranked_block(documents, block, text=text, k=k)
        found = found.select((F.col("item") + base).alias("item"), "doc_id", "score")
        out = found if out is None else out.unionByName(found)
        ids += block.ids
        base += len(rows)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    best = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame(pa.table({"item": pa.array(range(len(ids)), pa.int64()), "item_id": pa.array(ids, pa.int64())}))
    return best.join(names, "item").select("item_id", "rank", "doc_id", "score")
