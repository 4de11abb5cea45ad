"""A Merkle manifest of a dataset, its subtrees stored in van Emde Boas order.

A leaf hashes the fields of one row. Rows of one group, by order key, are the leaves of the
group's tree: every two consecutive nodes (the last run: maybe one) become the hash of their
hexadecimal digests until one node is left. The groups' roots, in order of the groups, are the
leaves of one more tree, whose root is that of the manifest.

Each tree is cut into aligned blocks of 2^``HEIGHT`` leaves. A block is one row that holds its whole
subtree as one binary: the tree's levels are split at half height, the upper half is stored first and
then each lower subtree, both in the same way again. ``address`` gives a node's place by arithmetic;
construction writes through it, and paths read siblings through it. The blocks' roots are the leaves
of the next level of blocks, until each tree has a single block. Going down again, a block hands each of
its leaves the path above it, so no task ever holds more than a block and its own path.

Rows get their rank by a range sort whose runs' sizes are summed up, so a hot group is many
runs like any other, and equal rows are parted by the place in which they were written.

Defined cases: a null field is hashed as ``-``; a null group is a group of its own and comes first, as
do rows without an order key in their group; rows with equal keys stand in order of their leaves; repeated rows are
leaves of their own. An empty table has no root, and no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memvault.llm.common import written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Height of a block's subtree.
HEIGHT = 12
#: Bytes of a digest; of a step of a path: which side the sibling is on (0: there is none), and its digest.
DIGEST, STEP = 32, 33
_NONE, _RIGHT, _LEFT = 0, 1, 2
_BLOCK = "tree binary, block long, n int, size long, nodes binary, ids array<long>, keys array<binary>, changed array<binary>"
_NAMES = [x.split()[0] for x in _BLOCK.split(", ")]
_TYPES = [pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.binary())]


# --- van Emde Boas order ------------------------------------------------------------------------


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """The places of the nodes index of a depth (0: the root) in a complete tree of so many levels."""
    index = np.asarray(index, np.int64)
    at = np.zeros_like(index)
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
        else:
            levels, depth = levels - top, depth - top
            at += (1 << top) - 1 + (index >> depth) * ((1 << levels) - 1)
            index = index & ((1 << depth) - 1)
    return at


def height_of(size: int, height: int) -> int:
    """Levels above the leaves of a block of a tree of size leaves."""
    return height if size > 1 << height else (size - 1).bit_length()


def node(children: bytes) -> bytes:
    """The digest of a run of digests."""
    return hashlib.sha256(children.hex().encode()).digest()


def subtree(leaves: np.ndarray, high: int) -> bytes:
    """The nodes over leaves (rows of 32 bytes), high levels of them, in van Emde Boas order; places without a node are zero."""
    nodes = np.zeros(((2 << high) - 1, DIGEST), np.uint8)
    level = leaves
    for depth in range(high, -1, -1):
        nodes[address(high + 1, depth, np.arange(len(level)))] = level
        if depth:
            flat = level.tobytes()
            parents = b"".join(node(flat[k : k + 2 * DIGEST]) for k in range(0, len(flat), 2 * DIGEST))
            level = np.frombuffer(parents, np.uint8).reshape(-1, DIGEST)
    return nodes.tobytes()


def own_steps(nodes: bytes, n: int, high: int) -> np.ndarray:
    """(n, high, STEP): each leaf's siblings inside its block, from the bottom up."""
    stored = np.frombuffer(nodes, np.uint8).reshape(-1, DIGEST)
    steps = np.zeros((n, high, STEP), np.uint8)
    at, there = np.arange(n), n
    for up in range(high):
        beside = at ^ 1
        has = beside < there
        steps[has, up, 0] = np.where(beside > at, _RIGHT, _LEFT)[has]
        steps[has, up, 1:] = stored[address(high + 1, high - up, beside[has])]
        at, there = at >> 1, (there + 1) >> 1
    return steps


def fold(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and its path give."""
    for k in range(0, len(path), STEP):
        beside = path[k + 1 : k + STEP]
        leaf = node(leaf + beside if path[k] == _RIGHT else beside + leaf if path[k] == _LEFT else leaf)
    return leaf


def proof(path: bytes) -> str:
    """The hash of the siblings on a path, bottom up."""
    steps = np.frombuffer(path, np.uint8).reshape(-1, STEP)
    return hashlib.sha256(steps[steps[:, 0] != _NONE, 1:].tobytes().hex().encode()).hexdigest()


# --- leaves and ranks ---------------------------------------------------------------------------


def leaf(**fields: Column) -> Column:
    """The digest of fields in their order: "-" for null, else the UTF-8 byte count, ":" and the value."""
    said = [F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in fields.values()]
    return F.unhex(F.sha2(F.concat(*said), 256))


def tree_key(group: Column) -> Column:
    """A group as bytes that sort null first, then bytewise."""
    return F.when(group.isNull(), F.lit(b"")).otherwise(F.concat(F.lit(b"\x01"), group.cast("string").cast("binary")))


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """rows (tree, ...) with rank, from 0 in their tree by order, and the tree's size."""
    spread = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    schema = spread.schema

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            trees = batch.column("tree").to_pylist()
            at = np.empty(len(trees), np.int64)
            for k, tree in enumerate(trees):
                if tree != last:
                    last, seen = tree, 0
                at[k] = seen
                seen += 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(trees), run, np.int32)), pa.array(at)], names=[*batch.schema.names, "run", "at"]
            )

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema) + ", run int, at long"
    runs = written(spread.mapInArrow(number, fields), "merkle-runs")
    # a row per run and tree that it holds: as many as runs and trees together
    sizes = runs.groupBy("tree", "run").agg(F.count("*").alias("n"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("tree", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(tree).alias("size"))
    return runs.join(base, ["tree", "run"]).withColumn("rank", F.col("base") + F.col("at")).drop("run", "at", "base")


# --- blocks ---------------------------------------------------------------------------------------


def _blocks(rows: DataFrame, height: int, label: str) -> DataFrame:
    """Written: the blocks over rows (tree, rank, size, leaf, id, key, changed)."""

    def build(group: pa.Table) -> pa.Table:
        group = group.sort_by("rank")
        n, size = group.num_rows, group["size"][0].as_py()
        leaves = np.frombuffer(b"".join(group["leaf"].to_pylist()), np.uint8).reshape(n, DIGEST)
        values = [group["tree"][0].as_py(), group["block"][0].as_py(), n, size, subtree(leaves, height_of(size, height)), *(group[c].to_pylist() for c in ("id", "key", "changed"))]
        return pa.Table.from_arrays([pa.array([v], t) for v, t in zip(values, _TYPES, strict=True)], names=_NAMES)

    given = rows.select("tree", F.shiftright("rank", height).alias("block"), "rank", "size", "leaf", "id", "key", "changed")
    return written(given.groupBy("tree", "block").applyInArrow(build, _BLOCK), label)


def _levels(rows: DataFrame, height: int, label: str) -> list[DataFrame]:
    """The levels of blocks over rows, the lowest first; in the last one every tree has a single block."""
    out = [_blocks(rows, height, f"{label}-0")]
    while (out[-1].agg(F.max("size")).first()[0] or 0) > 1 << height:
        more = out[-1].where(F.col("size") > 1 << height)
        nothing = {"id": F.lit(None).cast("long"), "key": F.lit(None).cast("binary"), "changed": F.lit(None).cast("binary")}
        roots = more.select(
            "tree", F.col("block").alias("rank"), F.ceil(F.col("size") / (1 << height)).cast("long").alias("size"), F.substring("nodes", 1, DIGEST).alias("leaf")
        ).withColumns(nothing)
        out.append(_blocks(roots, height, f"{label}-{len(out)}"))
    return out


def _roots(levels: list[DataFrame], height: int) -> DataFrame:
    """(tree, leaf): the trees' roots."""
    found = [b.where(F.col("size") <= 1 << height).select("tree", F.substring("nodes", 1, DIGEST).alias("leaf")) for b in levels]
    return reduce(DataFrame.unionByName, found)


@dataclass
class Manifest:
    """Stored trees: lower[k], upper[k] are the k-th levels of blocks of the groups' trees and of the tree over them."""

    lower: list[DataFrame]
    upper: list[DataFrame]
    height: int
    root: bytes | None

    def subroots(self) -> DataFrame:
        """(tree, leaf): one row per group."""
        return _roots(self.lower, self.height)

    def _descend(self, blocks: DataFrame, fields: str, give) -> DataFrame:
        """give(block's row as a dict, own steps, path above) -> rows, for each block with its path above."""
        height = self.height
        names = [x.split()[0] for x in fields.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kinds = {"tree": pa.binary(), "block": pa.int64(), "path": pa.binary(), "sub": pa.binary(), "id": pa.int64(), "verified": pa.bool_()}
            for batch in batches:
                for k in range(batch.num_rows):
                    row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                    steps = own_steps(row["nodes"], row["n"], height_of(row["size"], height))
                    columns = zip(*give(row, steps, row["above"] or b""), strict=True)
                    arrays = [pa.array(c, kinds.get(f, pa.string())) for c, f in zip(columns, names, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, names=names)

        return blocks.mapInArrow(run, fields)

    def _paths(self) -> list[DataFrame]:
        """The lower levels' blocks, each with the path above it, and sub, the root of its tree."""
        height = self.height

        def to_blocks(row, steps, above):
            first = row["block"] << height
            return [(row["tree"], first + i, row.get("sub"), s.tobytes() + above) for i, s in enumerate(steps)]

        def to_trees(row, steps, above):
            return [(key, s.tobytes() + above) for key, s in zip(row["keys"], steps, strict=True)]

        nothing, inner = F.lit(None).cast("binary").alias("above"), "tree binary, block long, sub binary, path binary"
        given = None  # of the level above: (tree, block, path)
        for k in range(len(self.upper) - 1, -1, -1):
            blocks = self.upper[k].drop("ids", "changed")
            held = blocks.select("*", nothing) if given is None else blocks.join(given.drop("sub").withColumnRenamed("path", "above"), ["tree", "block"])
            given = self._descend(held, "tree binary, path binary" if k == 0 else inner, to_trees if k == 0 else to_blocks)
        subs = self.subroots().withColumnRenamed("leaf", "sub")
        trees = written(given.withColumnRenamed("path", "above").join(subs, "tree"), "merkle-tops")
        out, given = [], None
        for k in range(len(self.lower) - 1, -1, -1):
            blocks = self.lower[k]
            held = blocks.where(F.col("size") <= 1 << height).join(trees, "tree")
            if given is not None:
                held = held.unionByName(blocks.where(F.col("size") > 1 << height).join(given.withColumnRenamed("path", "above"), ["tree", "block"]))
            out.append(held)
            if k:
                given = written(self._descend(held, inner, to_blocks), f"merkle-paths-{k}")
        return out[::-1]

    def proofs(self) -> DataFrame:
        """(id, leaf, subroot, root, proof_sha256, folded_root, verified) per leaf; a changed leaf is folded in place of the stored one.

        Digests are in hexadecimal.
        """
        fields = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        if self.root is None:
            return self.lower[0].sparkSession.createDataFrame([], fields)
        root, said = self.root, self.root.hex()

        def to_leaves(row, steps, above):
            high, stored, sub = steps.shape[1], row["nodes"], row["sub"].hex()
            out = []
            for i, (at, s) in enumerate(zip(address(high + 1, high, np.arange(len(steps))).tolist(), steps, strict=True)):
                own, path = stored[DIGEST * at : DIGEST * (at + 1)], s.tobytes() + above
                folded = fold(row["changed"][i] or own, path)
                out.append((row["ids"][i], own.hex(), sub, said, proof(path), folded.hex(), folded == root))
            return out

        return self._descend(self._paths()[0].drop("keys"), fields, to_leaves)


def manifest(leaves: DataFrame, *, height: int = HEIGHT) -> Manifest:
    """The manifest of leaves (tree, id, leaf, changed): see leaf() and tree_key(); changed is null where the row is as stored."""
    # equal rows are told apart by the place they were written to
    rows = written(leaves.select("tree", "id", "leaf", "changed", F.monotonically_increasing_id().alias("seq")), "merkle-leaves")
    lower = _levels(ranked(rows, "id", "leaf", "seq").withColumn("key", F.lit(None).cast("binary")), height, "merkle-lower")
    tops = _roots(lower, height).select(F.lit(b"").alias("tree"), F.col("tree").alias("key"), "leaf")
    nothing = {"id": F.lit(None).cast("long"), "changed": F.lit(None).cast("binary")}
    upper = _levels(ranked(tops, "key").withColumns(nothing), height, "merkle-upper")
    root = _roots(upper, height).first()  # one row
    return Manifest(lower, upper, height, bytes(root["leaf"]) if root else None)


def dataset_proofs(documents: DataFrame, changed: Column, changed_chars: Column, *, height: int = HEIGHT) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) per row of documents, a tree per lang.

    Where changed holds, the row is folded as if n_chars were changed_chars.
    """
    fields = {c: F.col(f"`{c}`") for c in FIELDS}
    tampered = F.when(F.coalesce(changed, F.lit(False)), leaf(**(fields | {"n_chars": changed_chars})))
    leaves = documents.select(tree_key(F.col("lang")).alias("tree"), F.col("doc_id").cast("long").alias("id"), leaf(**fields).alias("leaf"), tampered.alias("changed"))
    return manifest(leaves, height=height).proofs().withColumnRenamed("id", "doc_id")
