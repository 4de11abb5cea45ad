"""Best-fit packing, ranked lexical search and the Merkle manifest against plain versions."""

import hashlib
import math
import os
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from memvault.llm import genetic_packing, lexical_rank, merkle, queries, tokens  # noqa: E402
from memvault.llm.common import tokenizer  # noqa: E402

SF = "/root/testdata/sf0.001"
DDL = "doc_id long, source string, lang string, n_chars long, text string"
#: Nulls in every column, an empty and a long text, copies, ties, repeated rows, groups of one.
ROWS = [
    (None, None, None, None, None), (None, "s", "en", 1, "null id"), (1, "s", "en", 5, ""), (2, None, "en", None, "The cat's hat"), (3, "s", None, 5, "the cat"),
    (4, "s", "en", 7, "the cat"), (4, "s", "en", 7, "the cat"), (4, "s", "en", 7, "the cat"), (5, "s", "", 3, "cat cat HAT"), (6, "s", "ßé", 3, "Ünï cat\x00hat\nÉé"),
    (7, "s", "de", 2**62, "hat " * 30_000), *[(k, "s", "fr", k, f"filler {k % 3} hat") for k in range(10, 47)],
]


@pytest.fixture(scope="module")
def rows(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    return [(r[0] + 1000, *r[1:]) for r in given.collect()] + ROWS


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DDL).withColumns({c: F.lit("x") for c in ("tree", "seq", "island", "n", "bag", "id", "leaf", "rank", "size", "h")}).repartition(3).cache()


# --- op11 ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("island", [40, 20_000])
def test_packing(docs, rows, island):
    path = tokenizer("byte_bpe_50k.json")
    lib = tokens.load(path)
    want = Counter()
    for d, _, _, _, t in rows:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        start = 0
        for piece in range(-(-len(ids) // 2048)):
            size = (len(ids) % 2048 or 2048) if piece == 0 else 2048
            want[d, piece, start, size, zlib.crc32(ids[start : start + size].tobytes())] += 1
            start += size
    got = genetic_packing.pack(docs, path, island=island).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(k[3] * n for k, n in want.items()) // 2048) + 1


def test_whole_ids_come_with_pieces(docs):
    got = genetic_packing.pack(docs, tokenizer("byte_bpe_50k.json"), with_ids=True)
    assert got.where("octet_length(ids) <> 4 * length or crc32(ids) <> ids_crc32").count() == 0


def _nothing(n):
    return genetic_packing.Packing(np.full(n, -1, np.int64), np.empty(0, np.int64))


def test_evolution_beats_best_fit_where_that_is_poor():
    """Triples that sum up to the capacity: best fit decreasing needs more bins than the evolved packing."""
    rng = np.random.default_rng(5)
    sizes = []
    for _ in range(60):
        a, b = int(rng.integers(380, 490)), int(rng.integers(255, 300))
        sizes += [a, b, 1000 - a - b]
    sizes = np.array(sizes, np.int64)
    plain = genetic_packing.best_fit(sizes, genetic_packing.largest_first(sizes, np.arange(len(sizes)), rng), _nothing(len(sizes)), 1000)
    herd = genetic_packing.evolved(sizes, [], 1000, rng, population=30, generations=100)
    assert len(herd[0].fills) < len(plain.fills)
    for p in herd:
        assert (np.bincount(p.bin_of, weights=sizes) == p.fills).all() and p.fills.max() <= 1000


def test_crossover_keeps_each_item_once_and_whole_bins_of_the_donor():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 600, 500)
    host, donor = (genetic_packing.best_fit(sizes, rng.permutation(500), _nothing(500), 1000) for _ in range(2))
    child = genetic_packing.crossover(sizes, host, donor, 1000, rng)
    assert (child.bin_of >= 0).all() and (np.bincount(child.bin_of, weights=sizes) == child.fills).all() and child.fills.max() <= 1000
    groups = lambda p: {frozenset(np.flatnonzero(p.bin_of == b).tolist()) for b in range(len(p.fills))}
    assert len(groups(child) & groups(donor)) >= 1


def test_migrants_settle_on_other_items():
    rng = np.random.default_rng(3)
    sizes, others = rng.integers(1, 1000, 3000), rng.integers(1, 1000, 3000)
    elite = genetic_packing.evolved(sizes, [], 1000, rng, population=3, generations=2)[0]
    settled = genetic_packing.settled(others, genetic_packing.patterns(sizes, elite, 1000), 1000, rng)
    assert (np.bincount(settled.bin_of, weights=others) == settled.fills).all() and settled.fills.max() <= 1000
    same = genetic_packing.settled(sizes, genetic_packing.patterns(sizes, elite, 1000), 1000, rng)
    assert (same.fills == 1000).sum() >= (elite.fills == 1000).sum()


# --- op12 ---------------------------------------------------------------------------------------------


def _terms(text):
    return [t.translate(brute.LOW) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def _ranked(docs, items, k=10):
    bags = [(d, Counter(_terms(t)), len(_terms(t))) for d, t in docs if _terms(t)]
    n, total = len(bags), sum(x[2] for x in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item, text in items:
        asked, found = Counter(_terms(text)), []
        for d, bag, size in bags:
            m = 100 - 75 + ((75 * size * n) // total)
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 8 * m)) for t, q in asked.items() if t in bag)
            if score > 0:
                found.append((-score, math.inf if d is None else d))
        out += [(item, r, None if d == math.inf else d, -s) for r, (s, d) in enumerate(sorted(found)[:k], start=1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_terms", [50, 1_000_000])
def test_lexical_rank(spark, docs, rows, block_terms):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").limit(12).collect()]
    items += [(900, None), (901, "..."), (902, "cat"), (902, "cat"), (None, "HAT hat filler"), (903, "nowhere"), (904, "É ünï")]
    got = lexical_rank.rank(docs, spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(1)), block_terms=block_terms)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == _ranked([(r[0], r[4]) for r in rows], items)


def test_rank_without_items_or_documents(spark):
    nothing = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical_rank.rank(some.withColumnRenamed("item_id", "doc_id"), nothing).count() == 0
    assert lexical_rank.rank(nothing.withColumnRenamed("item_id", "doc_id"), some).count() == 0


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(lexical_rank, "SEGMENT", 7)
    text = "Ünï-one, TWO  three;x y z" * 20
    assert sum(lexical_rank.terms(text.encode()), []) == [t.encode() for t in _terms(text)]


def test_classes_keep_their_least_members(spark):
    """A class that many tasks hold keeps k members, equal hashes or not."""
    made = spark.createDataFrame([(k, 3, b"\1\0\0\0\2\0\0\0") for k in range(500)], "doc_id long, n long, bag binary").repartition(8)
    members = lexical_rank.combined(made, 500, 1500, 5)
    assert members.count() <= 8 * 5
    one = members.repartition(1).sortWithinPartitions("h", "m", "bag", "doc_id")
    assert [r["doc_id"] for r in lexical_rank.least(one, 5).collect()] == [0, 1, 2, 3, 4]
    collided = spark.createDataFrame([(b"h", 1, b"a", 1), (b"h", 1, b"a", 2), (b"h", 1, b"b", 1), (b"h", 2, b"b", 1)], lexical_rank._MEMBER).coalesce(1)
    assert lexical_rank.least(collided, 1).count() == 3


# --- op13 ---------------------------------------------------------------------------------------------


def _h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def _leaf(d, source, lang, n_chars, text):
    return _h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, source, lang, n_chars, text)))


def _tree(leaves):
    """(root, [[sibling or None and whether it is on the right] per level] per leaf)."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for k, path in enumerate(paths):
            beside = at[k] ^ 1
            path.append((level[beside] if beside < len(level) else None, beside > at[k]))
            at[k] //= 2
        level = [_h("".join(level[i : i + 2])) for i in range(0, len(level), 2)]
    return level[0], paths


def _proofs(rows):
    trees = defaultdict(list)
    for r in rows:
        trees[r[2]].append(r)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    ordered = {t: sorted(trees[t], key=lambda r: (r[0] is not None, r[0] or 0, _leaf(*r))) for t in names}
    built = {t: _tree([_leaf(*r) for r in ordered[t]]) for t in names}
    root, tops = _tree([built[t][0] for t in names])
    out = []
    for t, top in zip(names, tops, strict=True):
        for r, path in zip(ordered[t], built[t][1], strict=True):
            d, source, lang, n_chars, text = r
            hit = d is not None and n_chars is not None and zlib.crc32(str(d).encode()) % 7 == 0
            node = _leaf(d, source, lang, n_chars + hit if n_chars is not None else None, text)
            for beside, right in path + top:
                node = _h(node if beside is None else node + beside if right else beside + node)
            out.append((d, _leaf(*r), built[t][0], root, _h("".join(b for b, _ in path + top if b)), node, node == root))
    return Counter(out)


@pytest.mark.parametrize("height", [1, 3, 12])
def test_merkle_manifest(docs, rows, height):
    tampered, more = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars").cast("decimal(20,0)") + 1
    got = merkle.dataset_proofs(docs, tampered, more, height=height)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(tuple(r) for r in got.collect()) == _proofs(rows)


def test_merkle_of_one_row_and_none(spark):
    one = spark.createDataFrame([(5, "s", "en", 1, "t")], DDL)
    row = merkle.dataset_proofs(one, F.lit(False), F.col("n_chars")).first()
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"] and row["verified"] and row["proof_sha256"] == _h("")
    assert merkle.dataset_proofs(one.where("false"), F.lit(True), F.col("n_chars")).count() == 0


@pytest.mark.parametrize("levels", range(1, 11))
def test_addresses_are_a_van_emde_boas_order(levels):
    """Each half-height subtree is one stretch, upper half first."""

    def layout(depth, index, n):
        if n == 1:
            return [(depth, index)]
        top = n // 2
        below = [x for k in range(1 << top) for x in layout(depth + top, (index << top) + k, n - top)]
        return layout(depth, index, top) + below

    want = {x: k for k, x in enumerate(layout(0, 0, levels))}
    for depth in range(levels):
        got = merkle.address(levels, depth, np.arange(1 << depth))
        assert got.tolist() == [want[depth, i] for i in range(1 << depth)]


def test_registered_queries_of_the_three(spark):
    """They read their whole tables."""
    known = queries.queries()
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert known["op13_merkle_manifest"](spark, SF).count() == n
    assert known["op11_best_fit_packing"](spark, SF).select("doc_id").distinct().count() == n
    assert known["op12_lexical_rank"](spark, SF).select("item_id").distinct().count() == spark.read.parquet(f"{SF}/benchmark.parquet").count()
