"""Best-fit packing by a grouping genetic algorithm on islands.

Each document's ids with an end id are one item; a longer one than a sequence is cut into
whole sequences, which need no packing, and a first piece of what is left over. The items are dealt
to islands of about ``ISLAND`` items, so their number grows with the corpus and no task holds more.

A chromosome is a list of bins. Crossover takes whole well-filled bins of one parent into another:
the other's bins that share an item with them are dissolved, so no item is there twice, and the items
that have lost their bin are put back by best fit, largest first. A mutation dissolves the worst bins and a few
others. Fewer bins are fitter, then a larger sum of squared fills: it gathers the free room in few bins. After each epoch every island's elite
migrates to the next island as the sizes of its full bins; there, own items of these sizes fill the bins, and
the rest is best-fitted. At last each island gives up its worst bins, and the islands of a group pack these
items together in the same way, until one island is left: so what doesn't fill a sequence on one
island is filled from others.

Chance comes from fixed seeds and the items' order, so a lost task gives the same result again.

Defined cases: a null or empty text is its end id alone. Rows without a doc_id and repeated rows are packed
like any other. An empty table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memvault.llm import tokens
from memvault.llm.common import drop, written

#: Items of an island, islands whose worst bins meet on one, and most items in the worst bins that an island gives up.
ISLAND, GROUP, GIVEN_UP = 20_000, 64, 1_000
_PIECE = "seq long, doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECE_NAMES = [x.split()[0] for x in _PIECE.split(", ")]
_PIECE_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
#: Kinds of rows between epochs: a chromosome of the island, and the elite of another one.
_OWN, _MIGRANT = 0, 1
_STATE = "island long, kind int, genes binary"


# --- chromosomes ------------------------------------------------------------------------------------


@dataclass
class Packing:
    """bin_of[i] is item i's bin, fills the bins' contents."""

    bin_of: np.ndarray
    fills: np.ndarray

    def fitness(self) -> tuple[int, int]:
        return -len(self.fills), int(np.square(self.fills).sum())


def best_fit(sizes: np.ndarray, items: np.ndarray, packing: Packing, capacity: int) -> Packing:
    """packing with items put, in turn, into the bin that they leave the least room in, or into a new one."""
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    fills, bin_of = packing.fills.tolist(), packing.bin_of.copy()
    open_rooms = 0  # bit r: some bin has room r
    for b, fill in enumerate(fills):
        if fill < capacity:
            rooms[capacity - fill].append(b)
            open_rooms |= 1 << (capacity - fill)
    placed = []
    for size in sizes[items].tolist():
        enough = open_rooms >> size
        if enough:
            room = size + (enough & -enough).bit_length() - 1
            same = rooms[room]
            b = same.pop()
            if not same:
                open_rooms ^= 1 << room
            fills[b] += size
        else:
            b, room = len(fills), capacity
            fills.append(size)
        placed.append(b)
        room -= size
        if room:
            rooms[room].append(b)
            open_rooms |= 1 << room
    bin_of[items] = placed
    return Packing(bin_of, np.array(fills, np.int64))


def largest_first(sizes: np.ndarray, items: np.ndarray, rng: np.random.Generator, noise: float = 0.0) -> np.ndarray:
    """items by falling size, equal ones by chance; noise shifts sizes by up to such a share."""
    keys = sizes[items] * (1 + noise * rng.random(len(items)))
    mixed = rng.permutation(len(items))
    return items[mixed[np.argsort(-keys[mixed], kind="stable")]]


def without(packing: Packing, gone: np.ndarray) -> tuple[Packing, np.ndarray]:
    """packing without the bins marked in gone, whose items have bin -1, and these items."""
    number = np.cumsum(~gone) - 1
    lost = gone[packing.bin_of] & (packing.bin_of >= 0)
    return Packing(np.where(lost | (packing.bin_of < 0), -1, number[packing.bin_of]), packing.fills[~gone]), np.flatnonzero(lost)


def crossover(sizes: np.ndarray, host: Packing, donor: Packing, capacity: int, rng: np.random.Generator) -> Packing:
    """host with a section of donor's well-filled bins."""
    well = np.flatnonzero(donor.fills >= np.quantile(donor.fills, 0.5))
    share = rng.uniform(0.02, 0.3)
    section = rng.choice(well, max(1, int(share * len(donor.fills))), replace=True)
    injected = np.zeros(len(donor.fills), bool)
    injected[section] = True
    inside = injected[donor.bin_of]
    twice = np.zeros(len(host.fills), bool)
    twice[host.bin_of[inside]] = True
    child, _ = without(host, twice)
    number = np.cumsum(injected) - 1 + len(child.fills)
    child.bin_of[inside] = number[donor.bin_of[inside]]
    child.fills = np.append(child.fills, donor.fills[injected])
    return best_fit(sizes, largest_first(sizes, np.flatnonzero(child.bin_of < 0), rng, 0.2 * rng.random()), child, capacity)


def mutated(sizes: np.ndarray, packing: Packing, capacity: int, rng: np.random.Generator) -> Packing:
    """packing without its worst bins and a few others, their items best-fitted anew."""
    n = len(packing.fills)
    gone = np.zeros(n, bool)
    gone[np.argsort(packing.fills, kind="stable")[: max(1, n // 50)]] = True
    gone[rng.integers(0, n, max(1, n // 50))] = True
    left, items = without(packing, gone)
    return best_fit(sizes, largest_first(sizes, items, rng), left, capacity)


def patterns(sizes: np.ndarray, packing: Packing, capacity: int) -> bytes:
    """The sizes in each full bin, a zero after each."""
    full = np.flatnonzero(packing.fills == capacity)
    items = np.flatnonzero(np.isin(packing.bin_of, full))
    order = items[np.argsort(packing.bin_of[items], kind="stable")]
    bins = packing.bin_of[order]
    ends = np.flatnonzero(np.diff(bins, append=-1))
    return np.insert(sizes[order], ends + 1, 0).astype("<u4").tobytes()


def settled(sizes: np.ndarray, genes: bytes, capacity: int, rng: np.random.Generator) -> Packing:
    """A migrant on this island: own items of the sizes in its bins, the others by best fit."""
    free: dict[int, list[int]] = {}
    for i, size in enumerate(sizes.tolist()):
        free.setdefault(size, []).append(i)
    bin_of, fills = np.full(len(sizes), -1, np.int64), []
    taken: list[int] = []
    whole = True
    for size in np.frombuffer(genes, "<u4").tolist():
        if size:
            if whole and free.get(size):
                taken.append(free[size].pop())
            else:
                whole = False
            continue
        if whole and taken:
            bin_of[taken] = len(fills)
            fills.append(capacity)
        else:
            for i in taken:
                free[int(sizes[i])].append(i)
        taken, whole = [], True
    return best_fit(sizes, largest_first(sizes, np.flatnonzero(bin_of < 0), rng), Packing(bin_of, np.array(fills, np.int64)), capacity)


def perfect(packing: Packing, capacity: int) -> bool:
    """Whether all bins but one are full: nothing is fitter."""
    return int((packing.fills < capacity).sum()) <= 1


def evolved(sizes: np.ndarray, given: list[Packing], capacity: int, rng: np.random.Generator, *, population: int, generations: int) -> list[Packing]:
    """The population after some generations, the fittest first; given ones are taken in, others are made by noisy best fit."""
    herd = list(given)
    nobody = Packing(np.full(len(sizes), -1, np.int64), np.empty(0, np.int64))
    while len(herd) < population:
        herd.append(best_fit(sizes, largest_first(sizes, np.arange(len(sizes)), rng, 0.0 if not herd else 0.1), nobody, capacity))
    herd.sort(key=Packing.fitness, reverse=True)
    for _ in range(generations):
        if perfect(herd[0], capacity):
            break
        young = []
        for _ in range(max(1, population // 2)):
            a, b = (int(min(rng.integers(0, len(herd), 2))) for _ in range(2))  # tournaments: the herd is sorted
            young.append(crossover(sizes, herd[a], herd[b], capacity, rng) if a != b else mutated(sizes, herd[a], capacity, rng))
        herd = sorted([*herd, *young], key=Packing.fitness, reverse=True)[:population]
    return herd[:population]


# --- pieces -------------------------------------------------------------------------------------------


def pieces(documents: DataFrame, tokenizer: str, *, text: str = "text", length: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Written: one row per piece of a document (with_ids: and its ids); seq tells rows apart."""
    end = np.array([end_id], dtype="<u4").tobytes()
    names, types = (_PIECE_NAMES + ["ids"], _PIECE_TYPES + [pa.binary()]) if with_ids else (_PIECE_NAMES, _PIECE_TYPES)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, known = TaskContext.get().partitionId() << 36, tokens.part_ids(tokenizer)
        for batch in batches:
            rows = []
            for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = memoryview((known.text_ids(body.as_py()) if body.is_valid and len(body.as_py()) else b"") + end)
                n, start = len(data) // 4, 0
                for piece in range(-(-n // length)):
                    size = (n % length or length) if piece == 0 else length
                    own = data[4 * start : 4 * (start + size)]
                    row = (seq, doc_id, piece, start, size, zlib.crc32(own))
                    rows.append((*row, bytes(own)) if with_ids else row)
                    start, seq = start + size, seq + 1
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    rows = documents.select(F.col("doc_id").cast("long"), F.col(f"`{text}`"))
    return written(rows.mapInArrow(cut, _PIECE + (", ids binary" if with_ids else "")), "packing-pieces")


# --- islands ------------------------------------------------------------------------------------------


def _rng(island: int, epoch: int) -> np.random.Generator:
    return np.random.default_rng((island, epoch))


def _epoch(capacity: int, islands: int, epoch: int, population: int, generations: int):
    """(items, state) of an island -> its population, and its elite for the next island."""

    def run(items: pa.Table, state: pa.Table) -> pa.Table:
        if not items.num_rows:
            return pa.Table.from_pylist([], pa.schema([("island", pa.int64()), ("kind", pa.int32()), ("genes", pa.binary())]))
        island = items["island"][0].as_py()
        rng, sizes = _rng(island, epoch), items.sort_by("seq")["length"].to_numpy()
        herd = evolved(sizes, _given(sizes, state, capacity, rng), capacity, rng, population=population, generations=generations)
        rows = [(island, _OWN, p.bin_of.astype("<i4").tobytes()) for p in herd]
        rows.append(((island + 1) % islands, _MIGRANT, patterns(sizes, herd[0], capacity)))
        columns = zip(*rows, strict=True)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int32(), pa.binary()], strict=True)], names=["island", "kind", "genes"])

    return run


def _given(sizes: np.ndarray, state: pa.Table, capacity: int, rng: np.random.Generator) -> list[Packing]:
    """The chromosomes that an island has or gets."""
    out = []
    for kind, genes in zip(state["kind"].to_pylist(), state["genes"].to_pylist(), strict=True):
        if kind == _OWN:
            bin_of = np.frombuffer(genes, "<i4").astype(np.int64)
            out.append(Packing(bin_of, np.bincount(bin_of, weights=sizes).astype(np.int64)))
        else:
            out.append(settled(sizes, genes, capacity, rng))
    out.sort(key=Packing.fitness, reverse=True)
    return out


def _settle(capacity: int, depth: int, given_up: int, population: int, generations: int, epoch: int):
    """(items, state) of an island -> its items with their bins by the fittest chromosome; items of given-up bins have none."""

    def run(items: pa.Table, state: pa.Table) -> pa.Table:
        names = ["seq", "length", "island", "sequence_id", "offset"]
        if not items.num_rows:
            return pa.Table.from_arrays([pa.array([], pa.int64())] * 5, names=names)
        island, items = items["island"][0].as_py(), items.sort_by("seq")
        rng, sizes = _rng(island, epoch), items["length"].to_numpy()
        best = evolved(sizes, _given(sizes, state, capacity, rng), capacity, rng, population=population, generations=generations)[0]
        worst = np.argsort(best.fills, kind="stable")
        held = np.cumsum(np.bincount(best.bin_of, minlength=len(worst))[worst])
        up = np.zeros(len(best.fills), bool)
        up[worst[(held <= given_up) & (best.fills[worst] < capacity)]] = True
        order = np.argsort(best.bin_of, kind="stable")
        ends = np.cumsum(sizes[order])
        before = ends - sizes[order]
        firsts = np.flatnonzero(np.diff(best.bin_of[order], prepend=-1))
        offset = np.empty(len(sizes), np.int64)
        offset[order] = before - np.repeat(before[firsts], np.diff(firsts, append=len(sizes)))
        number = (depth << 56) + (island << 24) + best.bin_of
        lost = up[best.bin_of]
        columns = [items["seq"], items["length"], items["island"], pa.array(number, mask=lost), pa.array(offset, mask=lost)]
        return pa.Table.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names=names)

    return run


def packed(items: DataFrame, capacity: int, *, island: int = ISLAND, epochs: int = 3, population: int = 6, generations: int = 4, given_up: int = GIVEN_UP) -> DataFrame:
    """(seq, sequence_id, offset) for items (seq, length) that each fit into a sequence of capacity."""
    n = items.count()
    islands, depth, out = max(1, -(-n // island)), 0, []
    left = items.select(F.pmod(F.xxhash64("seq"), F.lit(islands)).alias("island"), "seq", "length")
    while True:
        state = left.sparkSession.createDataFrame([], _STATE)
        for epoch in range(epochs - 1):
            new = left.groupBy("island").cogroup(state.groupBy("island")).applyInArrow(_epoch(capacity, islands, epoch, population, generations), _STATE)
            new = written(new, f"packing-epoch-{epoch}")
            if epoch:
                drop(state)
            state = new
        last = _settle(capacity, depth, given_up if islands > 1 else 0, population, generations, epochs)
        done = left.groupBy("island").cogroup(state.groupBy("island")).applyInArrow(last, "seq long, length long, island long, sequence_id long, offset long")
        done = written(done, f"packing-depth-{depth}")
        out.append(done.where("sequence_id is not null").select("seq", "sequence_id", "offset"))
        if islands == 1:
            return reduce(DataFrame.unionByName, out)
        # each island's worst bins meet those of its group
        left = done.where("sequence_id is null").select(F.floor(F.col("island") / GROUP).cast("long").alias("island"), "seq", "length")
        islands, depth = -(-islands // GROUP), depth + 1


def pack(documents: DataFrame, tokenizer: str, *, text: str = "text", length: int = 2048, end_id: int = 0, with_ids: bool = False, **settings: int) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (with_ids: and its ids as binary).

    settings are those of packed().
    """
    made = pieces(documents, tokenizer, text=text, length=length, end_id=end_id, with_ids=with_ids)
    whole = made.where(F.col("length") == length).withColumns({"sequence_id": -1 - F.col("seq"), "offset": F.lit(0).cast("long")})
    rest = made.where(F.col("length") < length)
    placed = rest.join(packed(rest.select("seq", "length"), length, **settings), "seq")
    return whole.unionByName(placed).drop("seq")
