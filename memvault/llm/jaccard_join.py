"""N-gram Jaccard join with signature trees.

Documents are linked when the Jaccard similarity of their shingle sets is at least
``percent`` / 100. The join loses no link and never lists all pairs of a group:

1. Blocks. Two linked sets share one of the first n - ceil(percent n / 100) + 1
   shingles of each under any common order (prefix filter). The order puts frequent
   shingles last, so that shared passages seldom open a block. Sets are named by
   their hash, so exact copies are one member; blocks of the same members are one.
2. Signature trees. In each block a tree over the members' token bitmaps, in order
   of size: nodes hold the OR of their bitmaps and the range of sizes. A dual
   traversal drops node pairs whose largest possible overlap is too small. Blocks of
   more than ``PART`` members are dealt out by bands of size, in pairs of parts.
3. Links. The pairs that the trees leave make families, by connected components; each
   family's sets meet once (large families in parts, with the least member in each
   part; then sets outside the family's largest component visit the other parts). Members are
   compared with members of another component only, so a group of n near copies costs
   about n comparisons and gives at most n - 1 links a part.
4. Connected components of the links.

Defined cases: a null or blank text has an empty set and is linked with nothing; fewer
words than the shingle size make one shingle. Rows without a doc_id are judged like
others but give no component an id; a component of such rows alone has id null.
Rows that repeat a doc_id are rows of their own. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memvault.llm.common import written
from memvault.llm.components import components
from memvault.llm.shingles import mix, set_id, shingle_set

#: At most so many shingles are known as frequent (16 bytes each are broadcast).
FREQUENT = 1_000_000
#: Shingles that pass 1 gathers before it counts them.
GATHER = 4_000_000
#: Members of a block that meet in one task; a larger block is dealt out in parts of about this size.
PART = 1_000
#: Parts of a band have names of their own up to so many.
BAND = 1 << 32
#: Shingles of a family that meet in one task, of two parts at most twice as many; 8 bytes each.
PART_SHINGLES = 4_000_000
#: Members of a block that a task holds at once while it names the block; 8 bytes each.
NAMED = 1_000_000
#: Children of a tree node.
FAN = 16
#: Bits a shingle at least in bitmaps that are sent to blocks, and in those made for sets that a task holds.
SENT_BITS, HELD_BITS = 2, 16
#: Bits of the filter that tells which documents' sets are needed: NEED_SHARE for each of them, from 2^20 to 2^30.
NEED_SHARE = 16


def least_overlap(a: np.ndarray | int, b: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The smallest intersection that links sets of sizes a and b: 100 i >= percent (a + b - i)."""
    return -((-percent * (a + b)) // (100 + percent))


def frequent_shingles(documents: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes, and counts, of the most frequent shingles: at most FREQUENT, whatever the corpus.

    Counts leave out occurrences that are alone in their task's gathering; they set an order and nothing else.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def counted() -> pa.RecordBatch:
            found, times = np.unique(np.concatenate(held or [np.empty(0, np.uint64)]), return_counts=True)
            more = times > 1
            return pa.RecordBatch.from_arrays([pa.array(found[more].view(np.int64)), pa.array(times[more].astype(np.int64))], names=["h", "c"])

        for batch in batches:
            for body in batch.column(0):
                held.append(shingle_set(body.as_buffer(), size))
                n += len(held[-1])
                if n >= GATHER:
                    yield counted()
                    held, n = [], 0
        yield counted()

    rows = documents.where(F.col("_body").isNotNull()).select("_body").mapInArrow(count, "h long, c long")
    step = F.least(F.floor(F.log2("c") * 8), F.lit(511)).cast("int")
    counts = written(rows.groupBy("h").agg(F.sum("c").alias("c")).where("c >= 4").withColumn("step", step), "frequent")
    least, found = 512, 0
    for row in sorted(counts.groupBy("step").count().collect(), key=lambda r: -r["step"]):  # at most 512 rows
        found += row["count"]
        if found > FREQUENT:
            break
        least = row["step"]
    top = counts.where(F.col("step") >= least).select("h", "c").toPandas()  # at most FREQUENT rows
    h = top["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], top["c"].to_numpy(np.int64)[order]


def bitmap(hashes: np.ndarray, share: int) -> np.ndarray:
    """A set's bits: a power of two of at least share bits a shingle, as 64-bit words."""
    bits = max(64, 1 << int(share * len(hashes) - 1).bit_length())
    at = hashes & np.uint64(bits - 1)
    out = np.zeros(bits // 64, dtype=np.uint64)
    np.bitwise_or.at(out, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
    return out


def folded(words: np.ndarray, n_words: int) -> np.ndarray:
    """The bitmap a smaller filter would have had."""
    while len(words) > n_words:
        words = words[: len(words) // 2] | words[len(words) // 2 :]
    return words


def signatures(documents: DataFrame, percent: int, size: int) -> DataFrame:
    """Written: (doc_id, set_id, n, prefix, bits) per row; an empty set has n 0 and set_id null."""
    hashes, counts = frequent_shingles(documents, size)
    known = documents.sparkSession.sparkContext.broadcast((hashes, counts))
    names = ["doc_id", "set_id", "n", "prefix", "bits"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, times = known.value
        for batch in batches:
            ids, sizes, prefixes, bits = [], [], [], []
            for body in batch.column(1):
                s = shingle_set(body.as_buffer() if body.is_valid else b"", size)
                n = len(s)
                sizes.append(n)
                if not n:
                    ids.append(None)
                    prefixes.append(None)
                    bits.append(None)
                    continue
                ids.append(set_id(s))
                first = n - -(-percent * n // 100) + 1
                order = s
                if len(often):
                    at = np.searchsorted(often, s)
                    at[at == len(often)] = 0
                    count = np.where(often[at] == s, times[at], 0)
                    if count.any():
                        order = s[np.lexsort((s, count))]
                prefixes.append(order[:first].view(np.int64))
                bits.append(bitmap(s, SENT_BITS).tobytes())
            columns = [batch.column(0), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = documents.select("doc_id", "_body")
    return written(rows.mapInArrow(sign, "doc_id long, set_id long, n long, prefix array<long>, bits binary"), "signatures")


def blocks(signed: DataFrame) -> DataFrame:
    """Written: (block, members, id): the sets that share a prefix shingle, where there are two or more.

    The rows are shuffled once; sorted by shingle, they are read in turn. A block is named by
    its members, so that blocks of the same members become one; beyond ``NAMED``
    members it keeps its shingle's name and its rows are handed on as they come.
    """

    def rows_of(name: np.ndarray, members: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        columns = (np.asarray(c, dtype=np.int64) for c in (name, members, ids))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["block", "members", "id"])

    def named(shingle: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        """Whole blocks, sorted: those of two or more different ids, under the name of their members."""
        if len(ids):
            new = np.append(True, (shingle[1:] != shingle[:-1]) | (ids[1:] != ids[:-1]))
            shingle, ids = shingle[new], ids[new]
            first = np.flatnonzero(np.append(True, shingle[1:] != shingle[:-1]))
            size = np.diff(first, append=len(ids))
            name = np.repeat(np.bitwise_xor.reduceat(mix(ids.view(np.uint64)), first).view(np.int64), size)
            size = np.repeat(size, size)
            more = size > 1
            return rows_of(name[more], size[more], ids[more])
        return rows_of(ids, ids, ids)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, held, large = None, np.empty(0, np.int64), False  # the block that is open

        def closed() -> pa.RecordBatch:
            if large:
                return rows_of(np.full(len(held), shingle), np.full(len(held), -1), held)
            return named(np.full(len(held), shingle or 0), held)

        for batch in batches:
            of, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(of):
                continue
            starts = np.flatnonzero(of[1:] != of[:-1]) + 1
            begin = 0
            if shingle is not None and of[0] == shingle:
                begin = int(starts[0]) if len(starts) else len(of)
                held = np.concatenate([held, ids[:begin]])
                if begin == len(of):
                    if len(held) > NAMED:
                        large = True
                        yield closed()
                        held = held[:0]
                    continue
            yield closed()
            last = int(starts[-1]) if len(starts) else 0
            yield named(of[begin:last], ids[begin:last])
            shingle, held, large = of[last], ids[last:], False
        yield closed()

    rows = signed.where("n > 0").select(F.explode("prefix").alias("block"), F.col("set_id").alias("id"))
    dealt = rows.repartition("block").sortWithinPartitions("block", "id")
    found = written(dealt.mapInArrow(gather, "block long, members long, id long").distinct(), "members")
    large = found.where("members < 0").groupBy("block").agg(F.count("*").alias("members"))  # a row for NAMED rows at most
    sized = found.where("members < 0").drop("members").join(F.broadcast(large), "block").select("block", "members", "id")
    return found.where("members > 0").unionByName(sized)


def parted(members: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """members as (block, i, j, side, id): a block of at most PART members is one part (0, 0).

    A larger one is dealt out by size: members of a band of sizes, in parts of about PART,
    meet each other and those of the next band, for linked sets are less than a band apart.
    """
    small = members.where(f"members <= {PART}").select("block", *(F.lit(0).cast("long").alias(c) for c in ("i", "j", "side")), "id")
    width = math.log(100 / percent) * 1.001 if percent < 100 else 0.1  # a little more than the largest ratio of linked sizes
    sizes = signed.where("n > 0").select(F.col("set_id").alias("id"), F.floor(F.log("n") / width).alias("band")).distinct()
    large = members.where(f"members > {PART}").select("block", "id").join(sizes, "id")
    counts = large.groupBy("block", "band").agg(F.ceil(F.count("*") / PART).alias("parts"))
    near = large.join(counts, ["block", "band"])
    for name, step in (("above", 1), ("below", -1)):
        near = near.join(counts.select("block", (F.col("band") - step).alias("band"), F.col("parts").alias(name)), ["block", "band"], "left")

    def places(band: Column, parts: Column) -> Column:
        return F.when(parts.isNull(), F.array().cast("array<long>")).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda x: band * BAND + x))

    band = F.col("band")
    met = F.concat(places(band, F.col("parts")), places(band + 1, F.col("above")), places(band - 1, F.col("below")))
    dealt = near.select("block", "id", (band * BAND + F.pmod(F.xxhash64("id"), "parts")).alias("k"), F.explode(met).alias("o"))
    return small.unionByName(dealt.select("block", F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j"), F.col("k").alias("side"), "id"))


class Levels:
    """A signature tree over members in order of size: levels of (OR bitmaps, smallest size, largest size, most hidden)."""

    def __init__(self, sizes: np.ndarray, words: list[np.ndarray], width: int):
        matrix = np.stack([folded(w, width) for w in words])
        hidden = sizes - np.bitwise_count(matrix).sum(axis=1).astype(np.int64)
        self.levels = [(matrix, sizes, sizes, hidden)]
        while len(self.levels[-1][0]) > 1:
            m, lo, hi, hid = self.levels[-1]
            at = np.arange(0, len(m), FAN)
            self.levels.append(
                (np.bitwise_or.reduceat(m, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(hid, at))
            )

    def may_link(self, level: int, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """For node pairs (a, b) of a level: whether any of their members can be linked."""
        m, lo, hi, hid = self.levels[level]
        fits = (100 * hi[a] >= percent * lo[b]) & (100 * hi[b] >= percent * lo[a])
        shared = np.zeros(len(a), dtype=np.int64)
        some = np.flatnonzero(fits)
        for start in range(0, len(some), 4096):
            k = some[start : start + 4096]
            shared[k] = np.bitwise_count(m[a[k]] & m[b[k]]).sum(axis=1)
        # a shared shingle sets a shared bit; shingles hidden behind another's bit may be shared besides
        return fits & (shared + np.minimum(hid[a], hid[b]) >= least_overlap(lo[a], lo[b], percent))

    def pairs(self, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Dual traversal: batches of member pairs (a < b in order of size) that may be linked."""
        top = len(self.levels) - 1
        stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, a, b = stack.pop()
            keep = self.may_link(level, a, b, percent) if level else (a < b) & self.may_link(0, a, b, percent)
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            if not level:
                yield a, b
                continue
            n = len(self.levels[level - 1][0])
            for start in range(0, len(a), 256):
                x = (a[start : start + 256, None] * FAN + np.arange(FAN))[:, :, None]
                y = (b[start : start + 256, None] * FAN + np.arange(FAN))[:, None, :]
                x, y = (z.reshape(-1) for z in np.broadcast_arrays(x, y))
                ok = (x <= y) & (y < n)
                stack.append((level - 1, x[ok], y[ok]))


class Tree:
    """Signature trees over all members of a part, in order of size.

    Members of one bitmap width have a tree of their own; those that are near enough in size to
    wider ones share another, with bitmaps folded to the lesser width. So long texts
    are never folded to the width of a short one that is in the same block.
    """

    def __init__(self, sizes: np.ndarray, bits: list):
        self.order = np.argsort(sizes, kind="stable")
        self.sizes = sizes[self.order]
        self.words = [np.frombuffer(bits[i], dtype=np.uint64) for i in self.order]

    def pairs(self, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Batches of member pairs (a < b in order of size) that may be linked."""
        widths = np.array([len(w) for w in self.words])
        for width in np.unique(widths).tolist():
            own = np.flatnonzero(widths == width)
            wide = np.flatnonzero((widths > width) & (100 * self.sizes[own[-1]] >= percent * self.sizes))
            if len(own) > 1:
                for a, b in Levels(self.sizes[own], [self.words[i] for i in own], width).pairs(percent):
                    yield own[a], own[b]
            if len(wide):
                near = own[100 * self.sizes[own] >= percent * self.sizes[wide[0]]]
                both = np.append(near, wide)
                for a, b in Levels(self.sizes[both], [self.words[i] for i in both], width).pairs(percent):
                    across = (a < len(near)) & (b >= len(near))
                    yield both[a[across]], both[b[across]]


def _across(i: int, j: int, side: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In a pair of different parts, only members of different parts are compared."""
    return np.ones(len(a), bool) if i == j else side[a] != side[b]


def by_part(rows: DataFrame, work: Callable[[pa.Table], tuple], names: list[str], ddl: str) -> DataFrame:
    """work(rows of one (block, i, j)) -> columns of longs, for each of them.

    A part holds at most 2 * PART members; parts are sorted into the partitions and read in turn.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = (new if held is None else pa.concat_tables([held, new])).combine_chunks()
            keys = np.stack([held.column(k).to_numpy().astype(np.int64) for k in ("block", "i", "j")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            yield from done(held, [0, *cuts.tolist()])
            held = held.slice(int(cuts[-1])) if len(cuts) else held
        if held is not None and len(held):
            yield from done(held, [0, len(held)])

    def done(given: pa.Table, bounds: list[int]) -> Iterator[pa.RecordBatch]:
        found = [work(given.slice(x, y - x)) for x, y in zip(bounds, bounds[1:], strict=False)]
        columns = zip(*found, strict=True) if found else [[np.empty(0, np.int64)]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in columns], names=names)

    dealt = rows.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j")
    return dealt.mapInArrow(run, ddl)


def sketched(rows: DataFrame, signed: DataFrame) -> DataFrame:
    """rows (block, i, j, side, id) with n and a bitmap of each set."""
    ids = rows.select("id").distinct()
    sketch = signed.where("n > 0").select(F.col("set_id").alias("id"), "n", "bits").join(ids, "id", "left_semi")
    return rows.join(sketch.dropDuplicates(["id"]), "id").select("block", "i", "j", "side", "id", "n", "bits")


def _groups(group: pa.Table, percent: int) -> tuple[Tree, np.ndarray]:
    """A part's tree, and for each place in its order one member of its group: members that pairs it leaves connect."""
    tree = Tree(group["n"].to_numpy(), [x.as_buffer() for x in group["bits"]])
    side = group["side"].to_numpy()[tree.order]
    i, j = group["i"][0].as_py(), group["j"][0].as_py()
    groups = Groups(len(group))
    for a, b in tree.pairs(percent):
        ok = _across(i, j, side, a, b)
        for x, y in zip(a[ok].tolist(), b[ok].tolist(), strict=True):
            groups.join(x, y)
    return tree, groups.labels()


def may_be_linked(members: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """Written: (id, other): members that may have a partner in a part, each with one other of its group there."""

    def pair(group: pa.Table) -> tuple:
        tree, root = _groups(group, percent)
        alive = np.bincount(root, minlength=len(root))[root] > 1
        ids = group["id"].to_numpy()[tree.order]
        return ids[alive], ids[root[alive]]

    rows = sketched(parted(members, signed, percent), signed)
    return written(by_part(rows, pair, ["id", "other"], "id long, other long").where("id <> other").distinct(), "maybe")


class Groups:
    """Disjoint groups of n members: union by size, paths halved."""

    def __init__(self, n: int):
        self.root, self.size = list(range(n)), [1] * n

    def of(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether x and y were in different groups, which are one now."""
        x, y = self.of(x), self.of(y)
        if x == y:
            return False
        if self.size[x] < self.size[y]:
            x, y = y, x
        self.root[y] = x
        self.size[x] += self.size[y]
        return True

    def labels(self) -> np.ndarray:
        """One member of its group for each member."""
        out = np.array(self.root, np.int64)
        while (out[out] != out).any():
            out = out[out]
        return out


def families(maybe: DataFrame, signed: DataFrame) -> DataFrame:
    """Written: (id, family, part, parts, own): the components of pairs that may be linked.

    A family of more than PART_SHINGLES is dealt into parts, each with the family's least
    member besides; own marks the one row of an id that is not there in that role.
    """
    members = written(components(maybe.select(F.col("id").alias("a"), F.col("other").alias("b"))), "families")
    sizes = signed.where("n > 0").groupBy(F.col("set_id").alias("id")).agg(F.max("n").alias("n"))
    shingles = members.join(sizes, "id").groupBy(F.col("root").alias("family")).agg(F.sum("n").alias("n"))
    parts = shingles.select("family", F.ceil(F.col("n") / PART_SHINGLES).cast("int").alias("parts"))
    own = members.join(parts, F.col("root") == F.col("family")).select(
        "id", "family", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), "parts", F.lit(True).alias("own")
    )
    hubs = parts.select(
        F.col("family").alias("id"), "family", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "parts", F.lit(False).alias("own")
    )
    return written(own.unionByName(hubs.where("parts > 1")), "parts")


def needed_sets(documents: DataFrame, signed: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """Written: wanted (id, ...) with items, the sets made again from one document each.

    A bit filter tells which documents to read; those it lets pass needlessly are dropped by the join.
    """
    first = signed.where("n > 0").groupBy(F.col("set_id").alias("id")).agg(F.min("doc_id").alias("doc_id"))
    docs = written(first.join(wanted.select("id").distinct(), "id"), "needed")
    need_bits = 1 << min(30, max(20, (NEED_SHARE * docs.count()).bit_length()))
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(need_bits))
    marked = docs.select(bit.alias("bit")).selectExpr("bit div 64 AS w", "shiftleft(1L, cast(bit % 64 AS int)) AS b")
    words = marked.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()  # at most need_bits / 64 rows
    table = np.zeros(need_bits // 64, dtype=np.int64)
    table[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64)
    known = documents.sparkSession.sparkContext.broadcast(table)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known.value
        for batch in batches:
            doc_ids, at = batch.column(0), batch.column(1).to_numpy()
            hit = (table[at >> 6] >> (at & 63)) & 1
            taken, ids, items = [], [], []
            for k in np.flatnonzero(hit).tolist():
                s = shingle_set(batch.column(2)[k].as_buffer(), size)
                if len(s):
                    taken.append(doc_ids[k])
                    ids.append(set_id(s))
                    items.append(s.tobytes())
            columns = [pa.array([x.as_py() for x in taken], pa.int64()), pa.array(ids, pa.int64()), pa.array(items, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "id", "items"])

    rows = documents.where(F.col("_body").isNotNull()).select("doc_id", bit.alias("bit"), "_body")
    made = rows.mapInArrow(sets, "doc_id long, id long, items binary")
    # one document per set; rows that repeat a doc_id and a text give the set twice, which does no harm
    chosen = docs.join(wanted, "id")
    here = made["id"].eqNullSafe(chosen["id"]) & made["doc_id"].eqNullSafe(chosen["doc_id"])
    return written(made.join(chosen, here).select(chosen["*"], "items").drop("doc_id"), "sets")


def block_links(full: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that span the components of each part's rows (block, i, j, side, id, items)."""

    def link(group: pa.Table) -> tuple:
        i, j = group["i"][0].as_py(), group["j"][0].as_py()
        items = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in group["items"]]
        tree = Tree(np.array(list(map(len, items))), [bitmap(x, HELD_BITS).tobytes() for x in items])
        ids, side = group["id"].to_numpy()[tree.order], group["side"].to_numpy()[tree.order]
        items = [items[k] for k in tree.order]
        groups = Groups(len(ids))
        ends: tuple[list[int], list[int]] = ([], [])

        def compare(x: int, y: int) -> None:
            if groups.of(x) == groups.of(y):
                return
            small, big = sorted((items[x], items[y]), key=len)
            at = np.searchsorted(big, small)
            at[at == len(big)] = 0
            shared = int((big[at] == small).sum())
            if shared >= least_overlap(len(items[x]), len(items[y]), percent):
                ends[0].append(ids[x])
                ends[1].append(ids[y])
                groups.join(x, y)

        if i == j:  # most groups hang on one member: it is tried first
            hub = len(ids) // 2
            for k in range(len(ids)):
                compare(hub, k)
        for a, b in tree.pairs(percent):
            ok = _across(i, j, side, a, b)
            for x, y in zip(a[ok].tolist(), b[ok].tolist(), strict=True):
                compare(x, y)
        return np.array(ends[0], np.int64), np.array(ends[1], np.int64)

    return by_part(full, link, ["a", "b"], "a long, b long")


_TO_MEET = ["block", "i", "j", "side", "id", "items"]


def _inside(sets: DataFrame) -> DataFrame:
    """The sets of each part of a family, to meet there."""
    part = F.col("part").cast("long")
    return sets.select(F.col("family").alias("block"), part.alias("i"), part.alias("j"), F.lit(0).cast("long").alias("side"), "id", "items")


def _between(sets: DataFrame, roots: DataFrame) -> DataFrame | None:
    """The sets that are still to meet across the parts of families that aren't one component yet; None if there are none.

    Two sets of a component need not meet. So those outside their family's largest component
    are guests in the other parts, in lots of about PART_SHINGLES; all sets of the family are hosts
    at home, once for each lot.
    """
    large = sets.where(F.col("own") & (F.col("parts") > 1))
    placed = large.select("family", "id", "part", "parts", F.expr("octet_length(items) div 8").alias("n")).join(roots, "id", "left")
    placed = written(placed.select("family", "id", "part", "parts", "n", F.coalesce("root", "id").alias("root")), "placed-sets")
    sizes = placed.groupBy("family", "root").agg(F.count("*").alias("c"))
    most = sizes.groupBy("family").agg(F.max(F.struct("c", "root")).alias("most")).select("family", F.col("most.root").alias("most"))
    outside = placed.join(most, "family").where("root <> most")
    lots = outside.groupBy("family").agg(F.ceil(F.sum("n") / PART_SHINGLES).alias("lots"))
    guests = written(outside.join(lots, "family").select("family", "id", "part", "parts", F.pmod(F.xxhash64("id"), "lots").alias("lot")), "guests")
    if guests.isEmpty():
        return None
    items, home = large.select("id", "items"), F.col("part").cast("long")
    other = F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1), lambda o: o != home))
    as_guests = guests.select(F.col("family").alias("block"), other.alias("i"), F.col("parts") + F.col("lot"), F.lit(1).cast("long").alias("side"), "id")
    at_home = placed.join(lots, "family").select(
        F.col("family").alias("block"), home.alias("i"), F.explode(F.sequence(F.col("parts").cast("long"), F.col("parts") + F.col("lots") - 1)), F.lit(0).cast("long").alias("side"), "id"
    )
    both = as_guests.toDF(*_TO_MEET[:-1]).unionByName(at_home.toDF(*_TO_MEET[:-1]))
    return both.join(items, "id").select(*_TO_MEET)


def jaccard_components(documents: DataFrame, *, text: str = "text", percent: int = 80, size: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of documents."""
    docs = documents.select(F.col("doc_id"), F.col(f"`{text}`").cast("binary").alias("_body"))
    signed = signatures(docs, percent, size)
    spark = documents.sparkSession
    members = blocks(signed)
    wanted = families(may_be_linked(members, signed, percent), signed)
    sets = needed_sets(docs, signed, wanted, size)
    links = written(block_links(_inside(sets), percent), "links")
    roots = components(links)
    rows = _between(sets, roots)
    if rows is not None:
        roots = components(links.unionByName(written(block_links(rows, percent), "links")))
    base = signed.select("doc_id", "n", "set_id")
    placed = written(
        base.join(roots, base["set_id"] == roots["id"], "left").select("doc_id", "n", F.coalesce("root", "set_id").alias("c")), "placed"
    )
    least = placed.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("least"))
    out = placed.join(least, "c", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def one_of_each(documents: DataFrame, *, text: str = "text", percent: int = 80, size: int = 5) -> DataFrame:
    """documents without those of a component but its smallest doc_id.

    Rows without a doc_id and rows that repeat the smallest doc_id stay.
    """
    groups = jaccard_components(documents, text=text, percent=percent, size=size)
    others = groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return documents.join(others, "doc_id", "left_anti").select(*[f"`{c}`" for c in documents.columns])
