"""The training-data operators against plain versions, on the smallest tables and on awkward rows."""

import hashlib
import math
import os
import random
import sys
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from memvault.llm import (  # noqa: E402
    components,
    fingerprints,
    jaccard_join,
    line_dedup,
    lm_scoring,
    packing,
    quality_rules,
    queries,
    sentencepieces,
    sharding,
    shingles,
    token_counts,
    tokens,
    url_filter,
)
from memvault.llm.common import tokenizer  # noqa: E402

SF = "/root/testdata/sf0.001"
LINE = "This very line stands in many documents."
BASE = " ".join(f"word{i}" for i in range(200))
#: Awkward rows: nulls, blanks, copies, near copies, a text without blanks, special strings, odd spaces.
AWKWARD = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "One"), (6, "a b c d"), (7, BASE), (8, BASE), (9, BASE.replace("word7 ", "other ")), (10, BASE.upper()),
    (11, LINE + "\nalpha"), (12, "  " + LINE.upper() + "\nbeta"), (13, LINE + "\n" + LINE), (14, "x" * 5000), (15, "a <|endoftext|> b<|startoftext|>"),
    (16, "tab\there  two\n\n spaces \u00a0 é e\u0301 \u2003Σ İ"), (17, "a b a b a b a b a b"), (18, "### $$$ | | <>"), (19, "ünï " * 60), (-5, LINE), (2**40, BASE + " tail"),
]


def table(spark, rows, ids="long"):
    return spark.createDataFrame(rows, f"doc_id {ids}, text string")


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()] + [(d + 10_000 if 0 < d < 100 else d, t) for d, t in AWKWARD]


@pytest.fixture(scope="module")
def df(spark, docs):
    return table(spark, docs).repartition(3).cache()


EMPTY_OPS = {
    "tokens": lambda d: token_counts.with_token_counts(d, tokenizer("word_bpe_49k.json")),
    "pieces": lambda d: sentencepieces.joined(sentencepieces.encode(d, tokenizer("piece_bpe_32k.model")), tokenizer("piece_bpe_32k.model")),
    "lines": line_dedup.dedup_lines,
    "jaccard": jaccard_join.jaccard_components,
    "quality": quality_rules.judge,
    "fingerprints": fingerprints.fingerprints,
    "sharding": sharding.shard,
    "packing": lambda d: packing.pack(d, tokenizer("byte_bpe_50k.json")),
    "scoring": lm_scoring.score,
}


@pytest.mark.parametrize("name", EMPTY_OPS)
def test_empty_table(spark, name):
    assert EMPTY_OPS[name](table(spark, [])).count() == 0


@pytest.mark.parametrize("name", EMPTY_OPS)
def test_nulls_repeats_and_clashing_columns(spark, name):
    """Null ids and texts, a row three times, and extra columns with names that the operators use inside."""
    rows = [(None, "some text here with words"), (None, None), (1, None), *[(2, "same row " * 4)] * 3, (3, "last")]
    extra = {c: F.lit("x") for c in ("id", "h", "n", "block", "_text", "_body", "_row", "bin", "ids", "part", "drop", "_id", "batch", "h2", "row", "chunk")}
    out = EMPTY_OPS[name](table(spark, rows).withColumns(extra))
    if name == "packing":
        assert out.agg(F.sum("length")).first()[0] >= len(rows)
    else:
        assert out.count() == len(rows)


def test_token_counts(df, docs):
    lib = tokens.load(tokenizer("word_bpe_49k.json"))
    got = {r["doc_id"]: r for r in token_counts.with_token_counts(df, tokenizer("word_bpe_49k.json")).collect()}
    for d, t in docs:
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert (got[d]["n_bytes"], got[d]["n_tokens"], got[d]["over_limit"]) == (len((t or "").encode()), n, n > 2048)


@pytest.mark.parametrize("seed", range(3))
def test_parts_encode_like_whole_texts(seed):
    rng = random.Random(seed)
    signs = [" ", "  ", "\n", " \n", "\t", "a", "B", "é", "'s", "'", "12", "|", "<|endoftext|>", "\u00a0", "\x1c", "日本", "e\u0301", ".", " the", " of", "Σ", " İ", "\x85", " 😀", " <|"]
    byte_level, ids = tokens.load(tokenizer("byte_bpe_50k.json")), tokens.PartIds(tokenizer("byte_bpe_50k.json"))
    words = tokens.load(tokenizer("word_bpe_49k.json"))
    for _ in range(2000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(1, 16)))
        assert np.frombuffer(ids.text_ids(text), "<u4").tolist() == byte_level.encode(text, add_special_tokens=False).ids, repr(text)
        assert token_counts.count_tokens(text, tokenizer("word_bpe_49k.json"), {"": 0}) == len(words.encode(text, add_special_tokens=False).ids), repr(text)


def test_long_texts_are_segmented(monkeypatch):
    text = " ".join(f"w{i}  x" for i in range(400))
    assert "".join(tokens.segments(text, 50)) == text
    assert len(list(tokens.segments(text, 50))) > 10


def test_sentencepieces(df, docs):
    path = tokenizer("piece_bpe_32k.model")
    lib = sentencepieces.load(path)
    encoded = sentencepieces.encode(df, path, size=300)  # so that many texts are cut
    got = {r["doc_id"]: r for r in sentencepieces.joined(encoded, path).collect()}
    assert encoded.where("chunks > 1").count() > 10
    for d, t in docs:
        ids = lib.encode(t or "")
        assert np.frombuffer(got[d]["ids"], "<u4").tolist() == ids
        assert got[d]["text"] == lib.decode(ids)


def test_line_dedup(df, docs):
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in line_dedup.dedup_lines(df).collect()}
    assert got == brute.dedup_lines(docs)


def test_line_runs_compact_and_anti_join(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    for k in range(5):
        runs.add(spark.createDataFrame([(10 - k, bytes([k])), (10 - k, b"all")], "doc_id long, h binary"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    state = {bytes(r["h"]): (r["owner"], r["n_docs"]) for r in runs.merged().collect()}
    assert state[b"all"] == (10, 5) and state[bytes([4])] == (6, 1)
    assert all(state[bytes([k])] == (10 - k, 1) for k in range(5))
    new = spark.createDataFrame([(1, b"all"), (1, b"new")], "doc_id long, h binary")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = runs.unseen(new)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Bucketed: true") == 2  # the batch moves, the runs don't
    assert [bytes(r["h"]) for r in runs.unseen(new).collect()] == [b"new"]


def test_jaccard_components(df, docs):
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(df).collect())
    assert got == sorted(brute.components(docs))


@pytest.mark.parametrize("part", [1000, 3])
def test_jaccard_groups_in_parts(spark, monkeypatch, part):
    """Chains and groups of near copies, whole and dealt out in parts of three."""
    monkeypatch.setattr(jaccard_join, "PART", part)
    monkeypatch.setattr(jaccard_join, "PART_SHINGLES", 70 * part)
    rng = random.Random(5)
    rows, text = [], [f"t{i}" for i in range(60)]
    for i in range(40):
        text = list(text)
        text[rng.randrange(60)] = f"new{i}"
        rows.append((i, " ".join(text)))
    rows += [(100 + i, " ".join([f"g{k}" for k in range(80)] + [f"end{i}"])) for i in range(25)]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(table(spark, rows)).collect())
    assert got == sorted(brute.components(rows))


def test_tree_loses_no_pair():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, size=rng.integers(3, 40), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(150)]
    tree = jaccard_join.Tree(np.array(list(map(len, sets))), [jaccard_join.bitmap(s, 2).tobytes() for s in sets])
    found = {frozenset((int(tree.order[x]), int(tree.order[y]))) for a, b in tree.pairs(50) for x, y in zip(a, b)}
    for i in range(150):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 50 * (len(sets[i]) + len(sets[j]) - both):
                assert frozenset((i, j)) in found


def test_components_match_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    ends = {x for a, b in edges if a != b for x in (a, b)}
    got = {r["id"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in ends}


def test_word_hashes_of_blocks(monkeypatch):
    text = ("Wörd " * 50 + "x" * 700 + " end\n").encode() * 3
    whole = shingles.word_hashes(text)
    monkeypatch.setattr(shingles, "_BLOCK", 64)
    assert (shingles.word_hashes(text) == whole).all() and len(set(whole.tolist())) == 3


def _oracle(sql, name, rows):
    con = duckdb.connect()
    con.register("rows_", rows)
    con.execute(f"CREATE TABLE {name} AS SELECT * FROM rows_")
    return con.sql(sql)


def test_url_filter(spark):
    import pandas as pd

    urls = [
        None, "", "no scheme", "https://Example.ORG/es/a", "https://a.b.example.org/es", "http://example.org/en/12?x", "http://example.org/en/2", "http://example.org?x=/es/",
        "http://notexample.org/es/1", "https://x.com/fr/", "https://com/de/", "https://y.com/de/z#f", "http://q.net/fr/", "ftp://u@host.org:80/x", "http://a://b.org/c", "http:///fr/", "x\ny://k.com/fr/1",
        "http://..org/", "http://example.org./es/", "HTTP://EXAMPLE.COM/FR/",
    ]
    pages = pd.DataFrame({"page_id": range(len(urls)), "url": urls})
    got = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), queries.URL_RULES)
    names = ["page_id", "host", "path", "rule", "verdict"]
    want = _oracle(queries.OP5, "pages", pages).project(", ".join(names)).fetchall()
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == sorted(want)
    assert url_filter.judge(got.limit(0).select("page_id", F.lit("").alias("url")), queries.URL_RULES).count() == 0


def test_url_ties_and_clashing_names(spark):
    rules = url_filter.Rules(allow=("org/bcd",), block=("a.org/b",))
    pages = spark.createDataFrame([(1, "http://a.org/bcdef"), (2, "http://org/bcdef"), (2, "http://org/bcdef"), (None, None)], "page_id long, url string")
    extra = {c: F.lit("x") for c in ("host", "path", "rule", "verdict", "key", "a", "b", "_keys", "_allow")}
    got = url_filter.judge(pages.withColumns(extra), rules).orderBy("page_id").collect()
    assert [(r["host"], r["rule"], r["verdict"], r["_keys"]) for r in got] == [("", None, "allow", "x"), ("a.org", "a.org/b", "block", "x"), *[("org", "org/bcd", "allow", "x")] * 2]


def test_groups_are_those_of_the_pairs():
    rng = random.Random(1)
    groups, label = jaccard_join.Groups(300), list(range(300))
    for _ in range(250):
        x, y = rng.randrange(300), rng.randrange(300)
        assert groups.join(x, y) == (label[x] != label[y])
        label = [label[x] if v == label[y] else v for v in label]
    labels = groups.labels()
    assert all((labels[x] == labels[y]) == (label[x] == label[y]) for x in range(300) for y in range(300))


def test_line_dedup_of_a_dotted_column(spark):
    rows = spark.createDataFrame([(i, LINE + f"\nrest {i}") for i in range(3)], "doc_id long, `my.text` string")
    got = {r["doc_id"]: r["my.text"] for r in line_dedup.dedup_lines(rows, text="my.text").collect()}
    assert got == {0: "rest 0", 1: "rest 1", 2: LINE + "\nrest 2"}


def test_cascade_is_exact_over_its_universe(spark, monkeypatch):
    """A first level that is far too small, so that several levels are needed."""
    monkeypatch.setattr(url_filter, "MAX_BITS", 256)
    keys = spark.range(2000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    hashed = keys.select("key", F.xxhash64("key").alias("a"), F.xxhash64(F.lit("second"), F.col("key")).alias("b"))
    listed = hashed.where("cast(substr(key, 2) as int) % 40 = 0")
    levels = url_filter.cascade(listed, hashed)
    assert len(levels) > 2
    rows = hashed.toPandas()
    inside = url_filter._inside(levels, rows["a"].to_numpy(np.int64).view(np.uint64), rows["b"].to_numpy(np.int64).view(np.uint64))
    assert {k for k, x in zip(rows["key"], inside) if x} == {f"k{i}" for i in range(0, 2000, 40)}


def _halves(spark, n):
    keys = spark.range(n).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), "id")
    hashed = keys.select("key", F.xxhash64("key").alias("a"), F.xxhash64(F.lit("second"), F.col("key")).alias("b"), "id")
    return hashed.where("id % 2 = 0").drop("id"), hashed.drop("id")


def test_full_levels_grow(spark, monkeypatch):
    """64 bits for 2,000 of 4,000 keys let all pass."""
    monkeypatch.setattr(url_filter, "MAX_BITS", 64)
    listed, universe = _halves(spark, 4000)
    levels = url_filter.cascade(listed, universe)
    rows = universe.toPandas()
    inside = url_filter._inside(levels, rows["a"].to_numpy(np.int64).view(np.uint64), rows["b"].to_numpy(np.int64).view(np.uint64))
    assert {k for k, x in zip(rows["key"], inside) if x} == {f"k{i}" for i in range(0, 4000, 2)}
    assert len({len(x.words) for x in levels}) > 1 or len(levels[0].words) > 1


def test_levels_that_cannot_grow_are_refused(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_BITS", 64)
    monkeypatch.setattr(url_filter, "MOST_BITS", 128)
    with pytest.raises(ValueError, match="128 bits"):
        url_filter.cascade(*_halves(spark, 4000))


def test_lists_of_a_million_keys(spark):
    block = spark.range(1_000_000).select(F.concat(F.lit("h"), "id", F.lit(".net/"), F.when(F.col("id") % 2 == 0, "x/").otherwise("")).alias("key"))
    allow = spark.createDataFrame([("h4.net/x/y",), (None,), ("h4.net/x/y",)], "key string")
    urls = ["http://h4.net/x/y/z", "http://h4.net/x/z", "http://a.h6.net/x/", "http://h6.net/y", "http://h7.net/", "http://h1000001.net/x/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filter.judge(pages, url_filter.Rules(allow=allow, block=block)).orderBy("page_id").collect()
    assert [(r["rule"], r["verdict"]) for r in got] == [("h4.net/x/y", "allow"), ("h4.net/x/", "block"), ("h6.net/x/", "block"), (None, "allow"), ("h7.net/", "block"), (None, "allow")]


@pytest.mark.parametrize("few", [32, 0])
def test_quality_rules(df, docs, monkeypatch, few):
    monkeypatch.setattr(quality_rules, "FEW_WINDOWS", few)
    for r in quality_rules.judge(df).collect():
        n, chars, symbols, dup, rep = brute.quality(dict(docs)[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, rep)
        assert r["base_failed"] == (n < 50 or 100 * rep > 50 * n) and (not r["kept"] or not r["base_failed"])


def test_ablation(spark, df):
    ledger = quality_rules.ledger(df)
    bits = [r["fail_bits"] for r in ledger.collect()]
    for r in quality_rules.ablate(ledger, (quality_rules.BASE, quality_rules.STANDARD)).collect():
        policy = {"base": quality_rules.BASE, "standard": quality_rules.STANDARD}[r["policy"]]
        bit = 1 << quality_rules.RULES[r["rule"]]
        assert r["n_failed"] == sum(bool(b & bit) for b in bits) and r["n_only"] == sum(b & policy.mask == bit for b in bits)


def test_clean_documents_are_kept(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = quality_rules.judge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).join(labels, "doc_id")
    clean = judged.where("quality = 1 and not base_failed")
    assert clean.where("not kept").count() == 0
    assert judged.where("quality = 0 and not kept").count() > 0


def test_fingerprints(df, docs):
    order = sorted(docs, key=lambda x: -x[0])
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(df).collect()}
    errors = []
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for k, (d, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        r = got[d]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = (brute.shingles(x, lower=False) for x in (t, edited, nxt))
        errors += [r["near_edited"] - alike(a, b), r["near_next"] - alike(a, c)]
    assert np.mean(np.abs(errors)) < 0.03 and abs(np.mean(errors)) < 0.01
    same = defaultdict(set)
    for d, t in docs:
        same[t or ""].add(got[d]["fingerprint"])
    assert all(len(v) == 1 for v in same.values())


def test_densified_bins_need_no_luck(spark):
    """One shingle fills all bins; all orders name every other bin."""
    row = spark.createDataFrame([("a b c d e",), ("",)], "t string").select(fingerprints.packed(F.col("t")).alias("f")).collect()
    assert len(row[0]["f"]) == 16 and len(set(row[0]["f"])) == 1 and row[1]["f"] == []
    assert all(sorted([k, *o]) == list(range(fingerprints.BINS)) for k, o in enumerate(fingerprints._orders()))


def test_sharding(spark, docs, df):
    rows = sharding.shard(df).collect()
    by = defaultdict(list)
    for r in rows:
        body = (dict(docs)[r["doc_id"]] or "").encode()
        assert r["size"] == len(body) + 1 and r["text_crc32"] == zlib.crc32(body)
        by[r["shard"]].append(r)
    assert len(rows) == len(docs) and set(by) <= set(range(16))
    assert all(sorted(x["slot"] for x in v) == list(range(len(v))) for v in by.values())


def test_shards_are_even_with_a_hot_text(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL", 50)
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.concat(F.lit("some text "), F.col("id").cast("string"))).alias("text"))
    out = sharding.shard(rows, tolerance=0.01)
    sizes = {r["shard"]: r["b"] for r in out.groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    assert len(sizes) == 16 and max(sizes.values()) < 1.06 * min(sizes.values())
    assert out.groupBy("shard").agg((F.max("slot") + 1 - F.count("*")).alias("x"), (F.countDistinct("slot") - F.count("*")).alias("y")).where("x <> 0 or y <> 0").count() == 0


def test_packing(spark, docs, df):
    lib = tokens.load(tokenizer("byte_bpe_50k.json"))
    want = brute.pieces(docs, lambda t: lib.encode(t, add_special_tokens=False).ids)
    pieces = packing.pack(df, tokenizer("byte_bpe_50k.json"), with_ids=True).cache()
    rows = pieces.collect()
    seen, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert brute.crc(ids) == r["ids_crc32"] and r["doc_tokens"] == len(want[r["doc_id"]]) and bytes(r["ids"]) == ids.tobytes()
        seen[r["doc_id"]].append((r["start"], r["length"]))
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans, total in [*((seen[d], len(ids)) for d, ids in want.items()), *((w, 1024 if s < max(windows) else None) for s, w in windows.items())]:
        at = 0
        for start, size in sorted(spans):
            assert start == at
            at += size
        assert total is None or at == total
    made = packing.sequences(pieces).collect()
    assert len(made) == len(windows) and sum(r["n_ids"] for r in made) == sum(map(len, want.values()))
    assert all(len(r["ids"]) in (4096, 4 * r["n_ids"]) for r in made)


def _model(docs):
    token = {d: [*brute.words((t or "").translate(brute.LOW)), "\0"] for d, t in docs}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in token}
    count = Counter(w for d in token if not held[d] for w in token[d])
    return token, held, count


def test_lm_scores(df, docs):
    token, held, count = _model(docs)
    n, v = sum(count.values()), len(count)
    grams = [None, {(w,): c for w, c in count.items()}]
    for k in (2, 3):
        found = Counter(tuple(t[i : i + k]) for d, t in token.items() if not held[d] for i in range(len(t) - k + 1))
        grams.append({g: c for g, c in found.items() if c >= 2})
    left = defaultdict(lambda: 1.0)
    for k in (2, 3):
        for g, c in grams[k].items():
            left[g[:-1]] -= (c - lm_scoring.DISCOUNT) / grams[k - 1][g[:-1]]

    def p(context, w):
        if not context:
            return (count[w] + 1) / (n + v + 1)
        g = (*context, w)
        if g in grams[len(g)]:
            return (grams[len(g)][g] - lm_scoring.DISCOUNT) / grams[len(context)][context] + left[context] * p(context[1:], w)
        return left.get(context, 1.0) * p(context[1:], w)

    for r in lm_scoring.score(df).collect():
        t = token[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(t), sum(count[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), rel=1e-9)
        assert r["score"] == pytest.approx(sum(math.log10(p(tuple(t[max(0, i - 2) : i]), w)) for i, w in enumerate(t)), rel=1e-9)
    some = [w for w, c in count.most_common(3)]
    for context in [(), (some[0],), (some[0], some[1])]:
        assert sum(p(context, w) for w in count) + p(context, "unseen") == pytest.approx(1.0)


def test_lm_beats_the_base_on_held_out_texts(spark):
    out = lm_scoring.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > out[1]


@pytest.mark.parametrize("name", sorted(set(queries.oracle_sql())))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    rows = queries.queries()[name](spark, SF)
    columns = sorted(rows.columns)
    found = con.sql(queries.oracle_sql()[name])
    assert sorted(found.columns) == columns
    places = [found.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in rows.collect()), key=repr) == sorted((tuple(r[i] for i in places) for r in found.fetchall()), key=repr)
