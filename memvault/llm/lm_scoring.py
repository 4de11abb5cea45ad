"""Language-model scores by a weighted backoff automaton trained on the corpus.

Training counts every token of every training text: words, then one end per text. The arcs
are all words, and all pairs and triples that occur at least ``LEAST`` times; no bound depends on the
size of the corpus. Probabilities are interpolated absolute discounting down to add-one
unigrams, hence p(. | context) sums to 1. A state is the longest suffix of the tokens read (two at
most) that is a context; a missing arc follows the failure arc to the next shorter state and
pays its weight.

No table is held whole anywhere. Texts become blocks of about ``BLOCK`` tokens, written once; a
longer text is cut, and each of its blocks carries the state that it starts in: the last two tokens before it.
For each order a block sends its distinct n-grams, with their counts, to the parts that own ranges
of their hashes; a part of about ``PART`` n-grams adds up what all blocks sent and answers each in the
order of its question. So a hot n-gram is one entry a block, however often it occurs. Steps:

1. Pairs are asked for by 32 bits (hash and count) each: which occur ``least`` times? False
   positives only cost a later question.
2. Triples whose two pairs both pass, then the passed pairs, then words: full hashes, counts, and
   the key of the context; each part hands on what the contexts of its arcs keep.
3. A block has the automaton of its own tokens then: states, arcs with weights and targets, failure arcs. Texts are
   read left to right once, a token of each at a time; each carries its state on. A long text is read in lanes of ``LANE``
   tokens, which reach the state that they begin in by reading the two tokens before.

Words and n-grams are compared by 64-bit hash. Defined cases: a null or blank text is its end alone;
a null doc_id counts as the empty text in the fold; repeated rows are trained on and
scored as often as they occur. With no training rows N and V are 0. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from memvault.llm.common import drop, parallelism, written
from memvault.llm.shingles import batch_words, mix

#: Occurrences that an n-gram of two or three words needs, unless score() is told otherwise.
LEAST = 2
DISCOUNT = 0.75
#: Tokens of a block, and n-grams of a part, about.
BLOCK, PART = 1_000_000, 1_000_000
END = np.array([0x9E3779B97F4A7C15], dtype=np.uint64)
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: Tokens that a lane reads.
LANE = 1024
#: Tokens of context that a state holds.
_CARRIED = 2
#: Kinds of rows that parts give: answers to blocks, what contexts keep, numbers of tokens and words.
_ANSWER, _KEPT, _TOTAL = 0, 1, 2
_GIVEN = "kind int, block long, part int, n long, a binary, b binary, c binary"
_GIVEN_NAMES = [x.split()[0] for x in _GIVEN.split(", ")]
_GIVEN_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
_ASKED = "part int, block long, h binary, start binary, c binary"
_ASKED_NAMES = [x.split()[0] for x in _ASKED.split(", ")]
_ASKED_TYPES = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def gram(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The keys of n-grams from those of their first n - 1 words and of their last n - 1 words."""
    return mix(context * _STEP + word)


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _array(buffer: pa.Scalar, kind: str) -> np.ndarray:
    return np.frombuffer(buffer.as_buffer(), kind)


def _planes(values: np.ndarray) -> bytes:
    """The values' bytes, all lowest ones first: small numbers compress better so."""
    return np.ascontiguousarray(values.view("u1").reshape(len(values), -1).T).tobytes()


def _from_planes(buffer: pa.Scalar, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(_array(buffer, "u1").reshape(size, -1).T).reshape(-1).view(kind)


def _steps(sorted_keys: np.ndarray) -> bytes:
    return _planes(np.diff(sorted_keys, prepend=np.uint64(0)))


def _from_steps(buffer: pa.Scalar) -> np.ndarray:
    return np.cumsum(_from_planes(buffer, "<u8"), dtype=np.uint64)


# --- blocks -----------------------------------------------------------------------------------


def blocks(documents: DataFrame) -> DataFrame:
    """Written: rows of (doc_id, held_out, body) as blocks of segments, each with its distinct tokens and their codes.

    A segment is a text, or a piece of one with the tokens carried into it.
    """
    ddl = "block long, n long, rows binary, ids array<long>, held array<boolean>, sizes binary, carried binary, pieces binary, words binary, codes binary"
    names = [x.split()[0] for x in ddl.split(", ")]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = block = TaskContext.get().partitionId() << 36
        held: list[tuple] = []  # (row, doc_id, held out, tokens, carried, pieces)
        n = 0

        def built() -> pa.RecordBatch:
            rows, ids, out, tokens, carried, pieces = zip(*held, strict=True)
            flat = np.concatenate(tokens)
            words, codes, often = np.unique(flat, return_inverse=True, return_counts=True)
            by_count = np.argsort(-often, kind="stable")  # frequent words get small codes, which compress
            place = np.empty_like(by_count)
            place[by_count] = np.arange(len(words))
            sizes = np.array([len(t) for t in tokens], "<i8")
            values = [block, len(flat), np.array(rows, "<i8").tobytes(), list(ids), list(out), sizes.tobytes(), np.array(carried, "<i8").tobytes(), np.array(pieces, "<i8").tobytes(), words[by_count].tobytes(), _planes(place[codes].astype("<u4"))]
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.bool_()), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

        for batch in batches:
            for first, tokens, counts in batch_words(batch.column(2)):
                stops = np.cumsum(counts)
                for k, (stop, count) in enumerate(zip(stops.tolist(), counts.tolist(), strict=True), start=first):
                    t = np.append(tokens[stop - count : stop], END)
                    doc_id, out = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                    pieces = -(-len(t) // BLOCK)
                    for start in range(0, len(t), BLOCK):
                        carried = min(start, _CARRIED)
                        held.append((number, doc_id, out, t[start - carried : start + BLOCK], carried, pieces))
                        n += len(held[-1][3])
                        if n >= BLOCK:
                            yield built()
                            held, n, block = [], 0, block + 1
                    number += 1
        if held:
            yield built()

    return written(documents.mapInArrow(build, ddl), "lm-blocks")


@dataclass
class Block:
    """One block's tokens and n-grams, each n-gram by the place of its last token."""

    name: int
    words: np.ndarray
    codes: np.ndarray
    sizes: np.ndarray
    place: np.ndarray  # of each token in its segment
    own: np.ndarray  # tokens that aren't carried
    counts: np.ndarray  # own tokens of training texts
    keys: list[np.ndarray]  # of the words, pairs and triples that end here, where there are that many tokens

    @classmethod
    def of(cls, row: pa.Table | pa.RecordBatch) -> Block:
        sizes, carried = _array(row["sizes"][0], "<i8"), _array(row["carried"][0], "<i8")
        words, codes = _array(row["words"][0], "<u8"), _from_planes(row["codes"][0], "<u4")
        order = np.argsort(words)
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        words, codes = words[order], place[codes]
        place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        own = place >= np.repeat(carried, sizes)
        trained = ~np.array(row["held"][0].as_py(), bool)
        keys = [words[codes]]
        for _ in range(_CARRIED):
            keys.append(np.append(keys[-1][:1], gram(keys[-1][:-1], keys[-1][1:])))
        return cls(row["block"][0].as_py(), words, codes, sizes, place, own, own & np.repeat(trained, sizes), keys)

    def distinct(self, k: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the k-grams that end at the places at: sorted keys, which of them each is, training counts, keys of contexts."""
        keys, which = np.unique(self.keys[k - 1][at], return_inverse=True)
        counts = np.bincount(which, weights=self.counts[at], minlength=len(keys)).astype(np.int64)
        start = np.zeros(len(keys), np.uint64)
        if k > 1:
            start[which] = self.keys[k - 2][at - 1]
        return keys, which, counts, start

    def pairs(self) -> np.ndarray:
        return np.flatnonzero(self.place >= 1)

    def passed(self, row: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """The places of pairs that pass, and of triples both of whose pairs do."""
        passes = np.unpackbits(_array(row["passes"][0], "u1"), count=len(self.codes)).astype(bool)
        return np.flatnonzero(passes), np.flatnonzero(passes & np.append(False, passes[:-1]) & (self.place >= 2))


# --- questions and answers --------------------------------------------------------------------


def _spans(h: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """(part, from, to) of sorted hashes: parts are equal ranges."""
    edges = np.searchsorted((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))
    return [(p, x, y) for p, (x, y) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if x < y]


def _questions(block: int, parts: int, h: np.ndarray, start: np.ndarray, c: np.ndarray) -> pa.Table:
    rows = [(p, block, _steps(h[x:y]), start[x:y].tobytes(), _planes(c[x:y])) for p, x, y in _spans(h, parts)]
    return _table(rows, _ASKED_NAMES, _ASKED_TYPES)


def _answers_for(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A block's counts, and the log10 weights of the failure arcs from its n-grams, in the order in which it asked."""
    parts = np.argsort(answers["part"].to_numpy()).tolist()
    c, sums, kinds = (np.concatenate([_from_planes(answers[x][i], "<i8") for i in parts] or [np.empty(0, np.int64)]) for x in "abc")
    stays = sums - DISCOUNT * kinds
    # rounding may take the kept shares of a context past 1
    return c, np.where(stays > 0, np.log10(np.maximum(1 - stays / np.maximum(c, 1), 1e-12)), 0.0)


def _mask_for(answers: pa.Table) -> np.ndarray:
    parts = np.argsort(answers["part"].to_numpy()).tolist()
    bits = [np.unpackbits(_array(answers["a"][i], "u1"), count=answers["n"][i].as_py()) for i in parts]
    return np.concatenate(bits or [np.empty(0, "u1")]).astype(bool)


def asked(blocks: DataFrame, ask: Callable[[pa.RecordBatch], pa.Table]) -> DataFrame:
    """The questions of all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from ask(batch.slice(k, 1)).to_batches()

    return blocks.mapInArrow(run, _ASKED)


def _ask_whether(parts: int) -> Callable[[pa.RecordBatch], pa.Table]:
    def ask(row: pa.RecordBatch) -> pa.Table:
        block = Block.of(row)
        keys, _, counts, _ = block.distinct(2, block.pairs())
        short = (keys & np.uint64(0x3FFFFFFF)) << np.uint64(2) | np.minimum(counts, 3).astype(np.uint64)
        rows = [(p, block.name, short[x:y].astype("<u4").tobytes(), None, None) for p, x, y in _spans(keys, parts)]
        return _table(rows, _ASKED_NAMES, _ASKED_TYPES)

    return ask


def _tell_whether(least: int) -> Callable[[pa.Table], pa.Table]:
    def tell(asked: pa.Table) -> pa.Table:
        short = [_array(x, "<u4") for x in asked["h"]]
        flat = np.concatenate(short)
        _, which = np.unique(flat >> 2, return_inverse=True)
        often = (np.bincount(which, weights=flat & 3) >= min(least, 3))[which]
        ends = np.cumsum([len(x) for x in short]).tolist()
        part = asked["part"][0].as_py()
        rows = [(_ANSWER, b, part, len(x), np.packbits(often[e - len(x) : e]).tobytes(), None, None) for b, x, e in zip(asked["block"].to_pylist(), short, ends, strict=True)]
        return _table(rows, _GIVEN_NAMES, _GIVEN_TYPES)

    return tell


def _with_passes(row: pa.Table, answers: pa.Table) -> pa.Table:
    """A block with a bit for each place: whether the pair that ends there passes."""
    if not row.num_rows:
        return row.append_column("passes", pa.array([], pa.binary()))
    block = Block.of(row)
    passes, at = np.zeros(len(block.codes), bool), block.pairs()
    if len(at):
        passes[at] = _mask_for(answers)[block.distinct(2, at)[1]]
    return row.append_column("passes", pa.array([np.packbits(passes).tobytes()], pa.binary()))


def _ask(k: int, parts: int) -> Callable[[pa.RecordBatch], pa.Table]:
    def ask(row: pa.RecordBatch) -> pa.Table:
        block = Block.of(row)
        if k == 1:
            counts = np.bincount(block.codes, weights=block.counts, minlength=len(block.words)).astype(np.int64)
            return _questions(block.name, parts, block.words, np.empty(0, np.uint64), counts)
        keys, _, counts, start = block.distinct(k, block.passed(row)[k - 2])
        return _questions(block.name, parts, keys, start, counts)

    return ask


def _tell(k: int, parts: int, least: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """One part's totals: answers for the blocks, and what contexts keep for the next shorter order."""

    def tell(asked: pa.Table, kept: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return _table([], _GIVEN_NAMES, _GIVEN_TYPES)
        hashes = [_from_steps(x) for x in asked["h"]]
        keys, which = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(which, weights=np.concatenate([_from_planes(x, "<i8") for x in asked["c"]]), minlength=len(keys)).astype(np.int64)
        arc = total >= (least if k > 1 else 1)
        total[~arc] = 0
        stays = np.zeros((2, len(keys)), np.int64)
        if kept.num_rows:
            context, at = np.unique(np.concatenate([_from_steps(x) for x in kept["a"]]), return_inverse=True)
            place = np.searchsorted(context, keys)
            place[place == len(context)] = 0
            for row, column in enumerate(("b", "c")):
                sums = np.bincount(at, weights=np.concatenate([_from_planes(x, "<i8") for x in kept[column]])).astype(np.int64)
                stays[row] = np.where(context[place] == keys, sums[place], 0)
        part, rows = asked["part"][0].as_py(), []
        ends = np.cumsum([len(x) for x in hashes]).tolist()
        for block, h, end in zip(asked["block"].to_pylist(), hashes, ends, strict=True):
            own = which[end - len(h) : end]
            rows.append((_ANSWER, block, part, len(h), *(_planes(x[own]) for x in (total, *stays))))
        if k > 1:
            starts = np.zeros(len(keys), np.uint64)
            starts[which] = np.concatenate([_array(x, "<u8") for x in asked["start"]])
            context, at = np.unique(starts[arc], return_inverse=True)
            sums, kinds = np.bincount(at, weights=total[arc]).astype(np.int64), np.bincount(at)
            rows += [(_KEPT, None, p, y - x, _steps(context[x:y]), _planes(sums[x:y]), _planes(kinds[x:y].astype(np.int64))) for p, x, y in _spans(context, parts)]
        else:
            rows.append((_TOTAL, None, part, 0, np.array([total.sum(), arc.sum()], "<i8").tobytes(), None, None))
        return _table(rows, _GIVEN_NAMES, _GIVEN_TYPES)

    return tell


# --- scores -----------------------------------------------------------------------------------


@dataclass
class Automaton:
    """The states and arcs that a block's tokens need.

    State 0 is the root, 1 + w the word w, then come the pairs. A place's arcs into pairs and by triples are known by
    their numbers, -1 where there is none; the root has an arc for every word.
    """

    n_words: int
    root_log: np.ndarray  # of each word's arc from the root
    fail_to: np.ndarray  # of each state but the root
    fail_log: np.ndarray
    pair_log: np.ndarray  # arcs from words; pair p leads to the state of the pair p
    triple_log: np.ndarray  # arcs from pairs
    triple_to: np.ndarray
    pair_at: np.ndarray  # of each place
    triple_at: np.ndarray

    @classmethod
    def of(cls, block: Block, row: pa.Table, answers: dict[int, tuple[np.ndarray, np.ndarray]], n: int, v: int) -> Automaton:
        size, n_words = len(block.codes), len(block.words)
        words, fail_word = answers[1]
        root_log = np.log10((words + 1) / (n + v + 1))
        at: list[np.ndarray] = []
        ends: list[np.ndarray] = []  # a place where each arc's n-gram ends
        counts: list[np.ndarray] = []
        fails: list[np.ndarray] = []
        for k, places in zip((2, 3), block.passed(row), strict=True):
            which = block.distinct(k, places)[1]
            count, fail = answers[k]
            arc = count > 0
            number = np.where(arc, np.cumsum(arc) - 1, -1)
            own, end = np.full(size, -1, np.int64), np.zeros(len(count), np.int64)
            own[places] = number[which]
            end[which] = places
            at.append(own)
            ends.append(end[arc])
            counts.append(count[arc])
            fails.append(fail[arc])
        pair_at, triple_at = at
        last, before = block.codes[ends[0]], block.codes[ends[0] - 1]
        pair_log = np.log10((counts[0] - DISCOUNT) / words[before] + 10 ** (fail_word[before] + root_log[last]))
        end = ends[1]
        last, before = block.codes[end], block.codes[end - 1]
        first, second = pair_at[end - 1], pair_at[end]  # a triple's pairs occur as often as it does
        shorter = np.where(second >= 0, pair_log[second] if len(pair_log) else 0.0, fail_word[before] + root_log[last])
        of_first, fail_first = (counts[0][first], fails[0][first]) if len(pair_log) else (np.ones(len(first)), np.zeros(len(first)))
        triple_log = np.log10((counts[1] - DISCOUNT) / of_first + 10 ** (fail_first + shorter))
        fail_to = np.concatenate([np.zeros(n_words + 1, np.int64), 1 + block.codes[ends[0]].astype(np.int64)])
        fail_log = np.concatenate([[0.0], fail_word, fails[0]])
        return cls(n_words, root_log, fail_to, fail_log, pair_log, triple_log, 1 + n_words + second, pair_at, triple_at)

    def step(self, state: np.ndarray, word: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after a word of each text, and the weights of the arcs taken, failure arcs included."""
        first_pair = 1 + self.n_words
        log = np.zeros(len(state))
        arc = self.triple_at[place]
        taken = (state >= first_pair) & (arc >= 0)
        log[taken] = self.triple_log[arc[taken]]
        after = np.where(taken, self.triple_to[arc] if len(self.triple_to) else 0, 0)
        fails = ~taken & (state >= first_pair)
        log[fails] += self.fail_log[state[fails]]
        state = np.where(fails, self.fail_to[state], state)
        arc = self.pair_at[place]
        open_ = ~taken & (state > 0)
        hit = open_ & (arc >= 0)
        log[hit] += self.pair_log[arc[hit]]
        after = np.where(hit, first_pair + arc, after)
        fails = open_ & ~hit
        log[fails] += self.fail_log[state[fails]]
        at_root = ~taken & ~hit
        log[at_root] += self.root_log[word[at_root]]
        return np.where(at_root, 1 + word, after), log

    def read(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """log10 p of each token of texts that lie one after another."""
        first = np.cumsum(sizes) - sizes
        lanes = -(-sizes // LANE)
        start = np.repeat(first, lanes) + LANE * (np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes))
        begin = np.maximum(start - _CARRIED, np.repeat(first, lanes))
        length = np.minimum(start + LANE, np.repeat(first + sizes, lanes)) - begin
        order = np.argsort(-length, kind="stable")
        begin, warm, length = begin[order], (start - begin)[order], length[order]
        out, state = np.zeros(len(codes)), np.zeros(len(begin), np.int64)
        active = np.searchsorted(-length, -np.arange(1, length.max(initial=0) + 1), side="right")  # lanes longer than t
        for t, n in enumerate(active.tolist()):
            place = begin[:n] + t
            state[:n], log = self.step(state[:n], codes[place], place)
            if t < _CARRIED:
                own = warm[:n] <= t
                place, log = place[own], log[own]
            out[place] = log
        return out


def _read(n: int, v: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    names = ["row", "doc_id", "held_out", "pieces", "n_tokens", "n_known", "base_score", "score"]

    def read(row: pa.Table, answers: pa.Table) -> pa.Table:
        if not row.num_rows:
            return _table([], names, [pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 3, pa.float64(), pa.float64()])
        block = Block.of(row)
        order = answers["k"].to_numpy()
        found = {k: _answers_for(answers.filter(pa.array(order == k))) for k in (1, 2, 3)}
        machine, codes = Automaton.of(block, row, found, n, v), block.codes.astype(np.int64)
        known, base, log = found[1][0][codes] > 0, machine.root_log[codes], machine.read(codes, block.sizes)
        first = np.cumsum(block.sizes) - block.sizes
        sums = [np.add.reduceat(np.where(block.own, x, 0), first) for x in (np.ones(len(known), np.int64), known.astype(np.int64), base, log)]
        columns = [pa.array(_array(row["rows"][0], "<i8")), row["ids"][0].values, row["held"][0].values, pa.array(_array(row["pieces"][0], "<i8")), *map(pa.array, sums)]
        return pa.Table.from_arrays(columns, names=names)

    return read


def score(documents: DataFrame, *, text: str = "text", least: int = LEAST) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of documents.

    Pairs and triples count from least occurrences on (1 to 3).
    """
    if not 1 <= least <= 3:
        raise ValueError("least lies between 1 and 3")
    spark = documents.sparkSession
    made = blocks(documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(f"`{text}`").cast("binary").alias("body")))
    tokens = made.agg(F.sum("n")).first()[0] or 0
    parts = max(parallelism(spark), -(-tokens // PART))
    mask = written(asked(made, _ask_whether(parts)).groupBy("part").applyInArrow(_tell_whether(least), _GIVEN), "lm-mask")
    fields = StructType([*made.schema.fields, StructField("passes", BinaryType())])
    masked = written(made.groupBy("block").cogroup(mask.groupBy("block")).applyInArrow(_with_passes, fields), "lm-masked")
    for table in (made, mask):
        drop(table)
    given: dict[int, DataFrame] = {}
    kept = spark.createDataFrame([], _GIVEN)
    for k in (3, 2, 1):
        told = asked(masked, _ask(k, parts)).groupBy("part").cogroup(kept.groupBy("part")).applyInArrow(_tell(k, parts, least), _GIVEN)
        given[k] = written(told, f"lm-order{k}")
        kept = given[k].where(F.col("kind") == _KEPT)
    sums = given[1].where(F.col("kind") == _TOTAL).select("a").collect()  # two numbers a part
    n, v = (int(x) for x in sum((np.frombuffer(r["a"], "<i8") for r in sums), np.zeros(2, np.int64)))
    answers = [rows.where(F.col("kind") == _ANSWER).select(F.lit(k).alias("k"), "block", "part", "a", "b", "c") for k, rows in given.items()]
    answers = answers[0].unionByName(answers[1]).unionByName(answers[2])
    ddl = "row long, doc_id long, held_out boolean, pieces long, n_tokens long, n_known long, base_score double, score double"
    rows = written(masked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_read(n, v), ddl), "lm-rows")
    for table in (masked, *given.values()):
        drop(table)
    cut = rows.where("pieces > 1").groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score"))
    )
    whole = rows.where("pieces = 1").drop("pieces").unionByName(cut)
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
