"""Rules and scoring, case by case from the rule tables and the formulas."""

import itertools
import json
import random
import struct
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from memvault import schema
from memvault.functions import media, rules, text
from memvault.operators import answer, conflict, dedup, filters, fusion, graph, lexical, observe, vectors
from memvault.sources import importers


def memories(spark, rows):
    """rows: dicts with id and any other fields of a record."""
    blank = {"category": "fact", "title": "", "content": "", "tags": [], "confidence": 0.9, "status": "active", "provenance": "p", "created_at": "2024-03-01", "expired_at": None}
    made = [{**blank, **r} for r in rows]
    names = [*blank, "id"]
    given = spark.createDataFrame([tuple(r[c] for c in names) for r in made], "category string, title string, content string, tags array<string>, confidence double, status string, provenance string, created_at string, expired_at string, id string")
    times = {c: F.col(c).cast("timestamp_ntz") for c in ("created_at", "expired_at")}
    return spark.createDataFrame([], schema.MEMORIES).unionByName(given.withColumns(times).withColumn("updated_at", F.col("created_at")))


def column(spark, values, expression, kind="string"):
    """expression over a table of one column x, in order."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, x {kind}")
    return [r["y"] for r in rows.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


# --- rule tables: each entry, and just outside it ------------------------------------------------------


def _first_category(low):
    for category, beginnings, parts in rules.CATEGORY_RULES:
        if parts is None:
            hit = any("://" in w and "@" in w and w.count(":") >= 2 for w in low.split())
        else:
            hit = low.startswith(beginnings) or any(p in low for p in parts)
        if hit:
            return category
    return "fact"


def test_each_category_rule(spark):
    cases = []
    for _, beginnings, parts in rules.CATEGORY_RULES:
        for b in beginnings:
            cases += [b.upper() + "QQ", "qq" + b[:-1] + "_"]
        for p in parts or ():
            cases += [f"qq {p}qq", f"qq {p[:-1]}"]
    cases += ["ftp://u:p@qq", "qq ftp://u:p@qq:1/x qq", "ftp://u@qq", "u:p:@qq", "qq"]
    got = column(spark, cases, rules.category_of)
    assert got == [_first_category(text_.strip().lower()) for text_ in cases]
    assert set(got) == set(schema.CATEGORIES)


def test_each_lenient_synonym(spark):
    cases = [*schema.CATEGORIES, *(c.upper() for c in schema.CATEGORIES), *rules.NO_CATEGORY, "", " ", "qq"]
    for _, parts, whole in rules.SYNONYMS:
        cases += [*(f"q{p}q" for p in parts), *whole, *(f"q{w}q" for w in whole)]

    def want(name):
        low = name.strip().lower()
        if low in ("", *rules.NO_CATEGORY):
            return None
        if low in schema.CATEGORIES:
            return low
        return next((c for c, parts, whole in rules.SYNONYMS if any(p in low for p in parts) or low in whole), None)

    assert column(spark, cases, rules.lenient_category) == [want(c) for c in cases]


def test_each_ttl_unit(spark):
    cases = {f"{n}{gap}{u.upper() if n % 2 else u}": n * ms for (u, ms), n, gap in itertools.product(text.TTL_UNITS.items(), (1, 38), ("", " "))}
    cases |= {"17": 17_000, "+3": 3_000, "0h": None, "-4m": None, "": None, "h": None, "1.5h": None, "2y": None, "99999999999999999999": None}
    assert column(spark, list(cases), text.ttl_ms) == list(cases.values())


def test_each_sentence_rule(spark):
    """A sentence of four words or more around each sign gets the category of the first rule that it fits."""
    said, want = [], []
    for category, _, parts, beginnings in rules.SENTENCE_RULES:
        for sign, begins in [*((p, False) for p in parts), *((b, True) for b in beginnings)]:
            sentence = f"{sign.strip()} zebra crossing stripes" if begins else f"Zebras {sign.strip()} crossing stripes"
            low = sentence.lower()
            if low.startswith(rules.QUESTIONS):
                continue
            fits = [c for c, _, p, b in rules.SENTENCE_RULES if low.startswith(b) and b or any(x in low for x in p)]
            if fits:
                said.append(sentence)
                want.append(fits[0])
            assert category in [c for c, *_ in rules.SENTENCE_RULES]
    turns = spark.createDataFrame([(i, 0, None, s) for i, s in enumerate(said)], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r["category"] for r in observe.candidates(turns, threshold=0.0).collect()}
    assert [got.get(i) for i in range(len(said))] == want


def test_questions_acknowledgements_and_short_turns_are_dropped(spark):
    said = [*(f"{q}we decided zebras" for q in rules.QUESTIONS), "we decided zebras?", *rules.ACKNOWLEDGEMENTS, "too short", "qq zz ww vv uu"]
    turns = spark.createDataFrame([(i, 0, None, s) for i, s in enumerate(said)], "conv_id long, turn long, role string, text string")
    assert observe.candidates(turns, threshold=0.0).count() == 0


def test_each_rewrite_and_speaker(spark):
    rows = [(i, k, role, f"{b}zebras in decision is made") for i, (b, _) in enumerate(rules.REWRITES) for k, role in enumerate(("user", "human", "agent"))]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("conv_id", F.col("conv_id") * 10 + F.col("turn"))
    got = {r["conv_id"]: r["content"] for r in observe.candidates(turns, threshold=0.0).collect()}
    for i, (b, new) in enumerate(rules.REWRITES):
        assert got[10 * i] == got[10 * i + 1] == f"{new}zebras in decision is made"
        assert got[10 * i + 2] == f"{b}zebras in decision is made"


def test_fillers_come_off_and_repeats_count_once(spark):
    rows = [(0, k, "user", f"{f} zebras, we decided on stripes") for k, f in enumerate(rules.FILLERS)]
    (row,) = observe.candidates(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert (row["turn"], row["content"], row["category"]) == (0, "zebras, we decided on stripes", "decision")


def test_turns_of_text(spark):
    cases = [
        '[{"role": "x", "content": "aa"}, {"speaker": "y", "text": "bb"}, {"text": "cc"}, {"content": 5}, "dd"]',
        '{"speaker": "y", "text": "bb"}\n{"role": 4, "content": "ee"}\nplain words that are long',
        "[not json\n- a bullet of words\n• short\n\n  plain words here  ",
        '{"speaker": "y", "text": "only texts count as lines"}',
        "[]\nnothing else but this",
    ]
    rows = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = defaultdict(list)
    for r in observe.turns_of_text(rows).orderBy("doc_id", "turn").collect():
        got[r["doc_id"]].append((r["role"], r["text"]))
    assert got == {
        0: [("x", "aa"), ("y", "bb"), ("user", "cc")],
        1: [("user", "ee")],
        2: [(None, "a bullet of words"), (None, "plain words here")],
        3: [(None, cases[3])],
        4: [(None, "nothing else but this")],
    } | ({2: [(None, "[not json"), (None, "a bullet of words"), (None, "plain words here")]} if len("[not json") >= observe.TURN else {})


@pytest.mark.parametrize("option", text.SECRET_OPTIONS)
def test_secrets_are_redacted(spark, option):
    cases = {
        (option, "two words", "x"): f"{option} [REDACTED] x",
        (f"{option}=a b", option): f"{option}=[REDACTED] {option}",
        (option, option, "x"): f"{option} [REDACTED] x",
        (option[1:], "x", f"{option}s=a b", 'q "r"'): f'{option[1:]} x "{option}s=a b" "q \\"r\\""',
        (): "",
    }
    rows = spark.createDataFrame([(["p", *k], v) for k, v in cases.items()], "x array<string>, y string")
    assert not [r for r in rows.select(text.redacted(F.col("x"), "cmd").alias("got"), "y").collect() if r["got"] != ("cmd " + r["y"]).strip()]
    assert column(spark, [[]], lambda x: text.redacted(x, "cmd"), "array<string>") == ["cmd"]


# --- lexical lane ------------------------------------------------------------------------------------


def test_lexical_queries():
    word = "zq"
    assert text.lexical_query(f"{word}-{word}_{word}") == [[word] * 3]
    assert text.lexical_query(f"({word}) -- {word.upper()}/9") == [[word], [word], ["9"]]
    assert text.lexical_query(" ".join(text.LEXICAL_STOP[:4])) == [[w] for w in text.LEXICAL_STOP[:4]]
    assert text.lexical_query(" ".join([*text.LEXICAL_STOP, word])) == [[word]]
    assert text.lexical_query("*?!") == []


def test_bm25_is_okapi_over_all_records(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["ab", "abc", "cd", "ef", "gh"]) for _ in range(rng.randint(1, 9))) for _ in range(40)]
    rows = memories(spark, [{"id": f"m{i:02}", "content": t, "status": "active" if i % 3 else "expired"} for i, t in enumerate(texts)])
    words = [t.split() for t in texts]
    hits = {p: [sum(w.startswith(p) for w in ws) for ws in words] for p in ("ab", "cd")}
    n, avg = len(texts), sum(map(len, words)) / len(texts)
    want = {}
    for i, ws in enumerate(words):
        if i % 3 and all(h[i] for h in hits.values()):
            score = 0.0
            for h in hits.values():
                df = sum(x > 0 for x in h)
                idf = max(1e-6, np.log((n - df + 0.5) / (df + 0.5)))
                score += idf * h[i] * 2.2 / (h[i] + 1.2 * (0.25 + 0.75 * len(ws) / avg))
            want[f"m{i:02}"] = round(score, 6)
    got = {r["id"]: r["bm25"] for r in lexical.scored(rows, "ab cd", F.col("status") == "active").collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want)


def test_any_two_phrases_of_three_to_six_stand_in_for_all(spark):
    rows = memories(spark, [{"id": "a", "content": "pq rs"}, {"id": "b", "content": "pq"}, {"id": "c", "content": "rs tu zz"}])
    ids = lambda q: {r["id"] for r in lexical.scored(rows, q).collect()}
    assert ids("pq rs vw") == {"a"} and ids("pq tu") == set() and ids("pq rs tu") == {"a", "c"} and ids("p q r s t u v") == set()


# --- recall --------------------------------------------------------------------------------------------


def _score(bm25, vrank, gain, any_words, bare=False):
    rrf = round((1 / (60 + bm25) if bm25 else 0) + (1 / (60 + vrank) if vrank else 0), 9)
    extra = 1 / (70 + vrank) if any_words and not bm25 and vrank and vrank <= 5 and gain >= 0.06 - 1e-5 else 0
    base = (rrf + extra) * 61 / 2 + (0.5 if bare and not bm25 and gain >= 0.12 - 1e-5 else 0)
    effective = gain if gain >= 0.12 - 1e-5 or bm25 or vrank == 1 else 0.2 * gain
    return round(min(1, max(0, 0.85 * base + 0.15 * effective / 0.35)), 6)


def test_scores_follow_the_formula(spark):
    at = {"w": [0.3, 0.4, 0.5], "v": [0.9, 0.1, 0.0], "x": [0.8, 0.0, 0.2], "n": [-1.0, 0.0, 0.0]}
    rows = memories(spark, [{"id": "w", "content": "quartz mine"}, {"id": "v", "content": "slate"}, {"id": "x", "content": "granite", "tags": ["quartz-like"]}, {"id": "n", "content": "basalt"}])
    hits = fusion.recall(rows, spark.createDataFrame(list(at.items()), "id string, embedding array<float>"), fusion.Request("quartz", [1.0, 0.0, 0.0])).collect()
    want = {"w": _score(1, 3, 0.06, True), "v": _score(0, 1, 0, True), "x": _score(2, 2, 0.06, True)}
    got = {h["id"]: h["score"] for h in hits}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in ("w", "v", "x"))


def test_initials_lift_what_neither_lane_finds(spark):
    rng = np.random.default_rng(9)
    n = 95
    near = rng.uniform(0.3, 0.9, n)
    at = [(f"f{k}", [float(c), float(np.sqrt(1 - c * c)), 0.0]) for k, c in enumerate(near)] + [("deep", [0.05, 0.0, 0.99875])]
    rows = memories(spark, [*({"id": f"f{k}", "content": f"row {k}"} for k in range(n)), {"id": "deep", "content": "zinc vapour yield"}])
    hits = fusion.recall(rows, spark.createDataFrame(at, "id string, embedding array<float>"), fusion.Request("zvy", [1.0, 0.0, 0.0], limit=3)).collect()
    assert hits[0]["id"] == "deep" and hits[0]["score"] == pytest.approx(_score(0, n + 1, 0.12, False, bare=True), abs=1e-6)


@pytest.mark.parametrize("bad", [{"query": " "}, {"limit": -1}, {"min_similarity": 1.01}, {"min_similarity": -0.01}])
def test_requests_are_checked(bad):
    with pytest.raises(ValueError):
        fusion.Request(**({"query": "q", "vector": [1.0]} | bad))


def test_cosine(spark):
    rng = np.random.default_rng(1)
    pairs = [(rng.normal(size=5).astype("f4").tolist(), rng.normal(size=5).astype("f4").tolist()) for _ in range(20)]
    odd = [([float("nan"), 1.0], [1.0, 1.0]), ([0.0] * 3, [1.0] * 3), ([1.0], [1.0, 2.0]), ([], []), ([float("inf"), 1.0], [1.0, 1.0])]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs + odd)], "i long, a array<float>, b array<float>")
    got = [r["c"] for r in rows.select("i", vectors.cosine(F.col("a"), F.col("b")).alias("c")).orderBy("i").collect()]
    want = [float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)) for a, b in pairs] + [0.0] * len(odd)
    assert got == pytest.approx(want, abs=1e-6)


def test_hash_embedder_sums_words_and_pairs():
    def fnv(s):
        h = 14695981039346656037
        for b in s.encode():
            h = (h ^ b) * 1099511628211 % 2**64
        return h

    said = "Slate quarry"
    row = np.zeros(384)
    for word in said.lower().split():
        row[fnv(word) % 384] += 1 if fnv(word) >> 16 & 1 else -1
        for a, b in itertools.pairwise(word):
            row[fnv(a + b) % 384] += 0.5
    assert vectors.HashEmbedder().embed_batch([said])[0] == pytest.approx(row / np.linalg.norm(row), abs=1e-6)


@pytest.mark.parametrize("least", [0.8, 0.2, -0.5])
def test_similar_pairs_are_exact(spark, least):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(300, 8)), rng.normal(size=(1, 8)) + 0.05 * rng.normal(size=(40, 8))]).astype(np.float32)
    rows = spark.createDataFrame([(f"v{i:03}", [float(v) for v in row]) for i, row in enumerate(x)], "id string, embedding array<float>")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = {(f"v{i:03}", f"v{j:03}") for i in range(len(x)) for j in range(i + 1, len(x)) if round(float(u[i] @ u[j]), 6) >= least}
    assert {(r["a"], r["b"]) for r in vectors.similar_pairs(rows, least).collect()} == want


# --- time, duplicates, conflicts -----------------------------------------------------------------------


def test_filters_in_time(spark):
    """All states of a record around one moment, against the rules in words."""
    moment = "2024-03-05 12:00:00"
    rows = [
        {"id": f"{status}/{created}/{expired}", "status": status, "created_at": created, "expired_at": expired}
        for status, created, expired in itertools.product(("active", "expired"), ("2024-03-05 12:00:00", "2024-03-05 12:00:01"), (None, "2024-03-05 12:00:00", "2024-03-05 12:00:01"))
    ]
    df = memories(spark, rows)
    there = lambda r: r["created_at"] <= moment
    listed = {r["id"] for r in rows if there(r) and (r["expired_at"] is None or r["expired_at"] > moment)}
    found = {r["id"] for r in rows if there(r) and ((r["status"] == "active" and r["expired_at"] is None) or (r["expired_at"] or "") > moment)}
    ids = lambda d: {r["id"] for r in d.collect()}
    assert ids(filters.select(df, as_of=moment, status="active")) == listed
    assert ids(filters.select(df, as_of=moment, search=True)) == found
    assert ids(filters.select(df, as_of="2024-03-05")) == {r["id"] for r in rows if r["expired_at"] is None}
    due = filters.expire_due(df, moment).where("status = 'active'")
    assert ids(due) == {r["id"] for r in rows if r["status"] == "active" and (r["expired_at"] is None or r["expired_at"] > moment)}


def test_pages():
    assert filters.page_info(41, 3, 20) == {"total": 41, "page": 3, "total_pages": 3, "has_more": False}
    assert filters.page_info(41, 2, 20)["has_more"] and filters.page_info(7, 1, 0) == {"total": 7, "page": 1, "total_pages": 1, "has_more": False}


@pytest.mark.parametrize("kind", ["any", "ALL ", "image"])
def test_media_filter(spark, kind):
    rows = memories(spark, [{"id": x} for x in "abc"])
    files = spark.createDataFrame([("a", "image"), ("b", "audio"), ("b", "audio")], "memory_id string, media_kind string")
    assert {r["id"] for r in filters.with_media(rows, files, kind).collect()} == ({"a"} if kind == "image" else {"a", "b"})
    with pytest.raises(ValueError, match="code"):
        filters.with_media(rows, files, "code")


@pytest.mark.parametrize("seed", range(3))
def test_merged_fields(spark, seed):
    """Random groups against a merge one record after another."""
    rng = random.Random(seed)
    rows = []
    for i in range(60):
        content = rng.choice(["slate roof", "Slate roof", " slate roof\n", "tin roof", "tin  roof"])
        title = rng.choice([content.strip(), "Roof", "Roofs...", "Top"])
        rows.append({"id": f"m{i:02}", "category": rng.choice(["fact", "goal"]), "content": content, "title": title, "tags": rng.sample(["A", "a", "b", "C", "c"], 2),
                     "confidence": rng.random(), "created_at": f"2024-03-{rng.randint(1, 28):02}", "status": rng.choice(["active", "active", "expired"])})
    groups = defaultdict(list)
    for r in sorted((r for r in rows if r["status"] == "active"), key=lambda r: (r["created_at"], r["id"])):
        groups[r["category"], r["content"].strip()].append(r)
    want = {}
    for group in groups.values():
        own = [r["title"] for r in group if not (r["title"] == r["content"].strip() or r["title"].endswith("..."))]
        tags = []
        for t in (t for r in group for t in r["tags"]):
            tags += [t] if t.lower() not in [x.lower() for x in tags] else []
        want[group[0]["id"]] = (own[0] if own else group[0]["title"], max(r["confidence"] for r in group), tags, len(group))
    got = {r["id"]: (r["title"], r["confidence"], r["tags"], r["n_merged"]) for r in dedup.merged(memories(spark, rows)).collect()}
    assert got == want


def test_conflicts_need_shared_words_and_a_difference(spark):
    rows = memories(spark, [
        {"id": "old", "content": "Quarry lift carries 40 tons daily"}, {"id": "new", "content": "Quarry lift carries 55 tons daily", "created_at": "2024-03-09"},
        {"id": "far", "content": "Nothing here shares any term"},
    ])
    (pair,) = conflict.nearest(rows).collect()
    tokens = lambda t: {w.lower() for w in t.split() if len(w) > 1 and w.lower() not in text.MEANING_STOP}
    a, b = tokens("Quarry lift carries 40 tons daily"), tokens("Quarry lift carries 55 tons daily")
    assert (pair["older_id"], pair["newer_id"]) == ("old", "new")
    assert pair["overlap_ratio"] == pytest.approx(len(a & b) / max(len(a), len(b)), abs=1e-6)


@pytest.mark.parametrize("seed", range(3))
def test_greedy_resolution(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(14)]
    given = {tuple(rng.sample(names, 2)) for _ in range(30)}
    pairs = [(a, b, round(rng.random(), 2), 1.0) for a, b in sorted(given)]
    kept, retired = set(), set()
    for a, b, _, _ in sorted(pairs, key=lambda r: (-r[2], r[0], r[1])):
        if not {a, b} & retired:
            kept.add((a, b))
            retired.add(a)
    rows = spark.createDataFrame(pairs, "older_id string, newer_id string, similarity double, overlap_ratio double")
    assert {(r["older_id"], r["newer_id"]) for r in conflict.resolved(rows).collect()} == kept


# --- graph ---------------------------------------------------------------------------------------------


def test_wikilinks(spark):
    said = ["x [[a b]] y [[ c|d ]]", "[[a\nb]]", "[[p [[q]] r]]", "[[ ]] [[|z]] [x]", "no links"]
    assert column(spark, said, graph.wikilinks) == [["a b", "c"], ["a\nb"], ["q"], [], []]


@pytest.mark.parametrize("seed", range(2))
def test_traversal_against_a_search_by_hand(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(9)]
    rows = [{"id": n, "status": "expired" if n == "n4" else "active"} for n in names]
    edges = {(a, b, rng.choice("rs")): round(rng.uniform(0.1, 2), 2) for a, b in (rng.sample(names, 2) for _ in range(14))}
    links = spark.createDataFrame([(*k, w) for k, w in edges.items()], "source_id string, target_id string, relation string, weight double")
    df = memories(spark, rows)
    near = defaultdict(list)
    for (a, b, r), w in edges.items():
        if "n4" not in (a, b):
            near[a].append((0, r, b, w))
            near[b].append((1, r + " (incoming)", a, w))
    want, seen, frontier = {}, {"n0"}, [("n0", 1.0, [])]
    for hop in range(1, 4):
        found = {}
        for node, score, path in frontier:
            for _, label, other, w in sorted(near[node]):
                if other not in seen and other not in found:
                    found[other] = (score * w / hop, [*path, label])
        for other, (score, path) in found.items():
            want[other] = (hop, round(score, 6), " > ".join(path))
        seen |= set(found)
        frontier = [(o, *found[o]) for o in found]
    got = {r["id"]: (r["distance"], r["score"], r["path"]) for r in graph.related(df, links, df.where("id = 'n0'").select("id"), 3).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    single = {k for k, v in want.items() if v[0] == 1}
    assert all(got[k][1] == pytest.approx(want[k][1]) and got[k][2] == want[k][2] for k in single)


def test_weights_are_clamped(spark):
    links = spark.createDataFrame([("a", "b", "r", w) for w in (0.0,)] + [("a", "c", "r", 1e6), ("a", "a", "r", 1.0)], "source_id string, target_id string, relation string, weight double")
    assert {(r["target_id"], r["weight"]) for r in graph.add_links(links.limit(0), links).collect()} == {("b", schema.WEIGHTS[0]), ("c", schema.WEIGHTS[1])}


@pytest.mark.parametrize("title", [*rules.GENERIC_TITLES, "abc", "slate"])
def test_generic_and_short_titles_link_nothing(spark, title):
    rows = memories(spark, [{"id": "a", "title": title.upper()}, {"id": "b", "content": f"on {title}, twice"}])
    links = graph.title_mentions(rows, generic=rules.GENERIC_TITLES).collect()
    assert [(r["source_id"], r["target_id"]) for r in links] == ([("b", "a")] if title == "slate" else [])


def test_generic_tags_link_nothing(spark):
    rows = memories(spark, [{"id": "a", "tags": ["Auto", "x"]}, {"id": "b", "tags": ["auto", "X "]}, {"id": "c", "tags": ["x", "Y"]}, {"id": "d", "tags": ["y", "x"]}])
    assert [(r["source_id"], r["target_id"]) for r in graph.shared_tags(rows, rules.GENERIC_TAGS).collect()] == [("d", "c")]


# --- import --------------------------------------------------------------------------------------------


def parsed(spark, objects):
    files = spark.createDataFrame([(f"{i}.json", o if isinstance(o, str) else json.dumps(o)) for i, o in enumerate(objects)], "path string, text string")
    return importers.json_candidates(importers.json_objects(files)).orderBy("path", "place").collect()


@pytest.mark.parametrize("family", ["CONTENT_KEYS", "TITLE_KEYS", "ID_KEYS", "PROVENANCE_KEYS"])
def test_keys_win_in_their_order(spark, family):
    """Each key wins over all later ones, and any of them over the same in a nested object."""
    keys = getattr(importers, family)
    field = {"CONTENT_KEYS": "content", "TITLE_KEYS": "title", "ID_KEYS": "id", "PROVENANCE_KEYS": "provenance"}[family]
    base = {} if field == "content" else {"content": "c"}
    objects = [base | {k: f"by {k}" for k in reversed(keys[i:])} | {"meta": {keys[0]: "nested"}} for i in range(len(keys))] + [base | {n: {keys[-1]: "deep"}} for n in importers.NESTED]
    rows = spark.createDataFrame([(f"{i:02}", json.dumps([o])) for i, o in enumerate(objects)], "path string, text string")
    got = [r[field] for r in importers.json_candidates(importers.json_objects(rows)).orderBy("path").collect()]
    assert got == [f"by {k}" for k in keys] + ["deep"] * len(importers.NESTED)


def test_wrappers_lines_and_graphs(spark):
    for wrapper in importers.WRAPPERS:
        assert [r["content"] for r in parsed(spark, [{wrapper: [{"body": "p"}, {"body": "q"}]}])] == ["p", "q"]
    assert [r["content"] for r in parsed(spark, ['{"body": "p"}\r\n\r\n{"body": "q"}'])] == ["p", "q"]
    one, two = parsed(spark, [{"entities": [{"name": "N", "entityType": "T", "observations": [" p ", "", "q"]}], "relations": [{"from": "x", "to": "y", "relation_type": "z"}]}])
    assert (one["title"], one["content"], one["tags"]) == ("N", "p; q", ["t"])
    assert (two["title"], two["content"], two["category"]) == ("x -> y", "x z y", "relationship")


def test_the_longest_other_string_stands_in_for_a_content(spark):
    (row,) = parsed(spark, [{"k": "short one", "l": "the longer one of the two", "title": "T" * 60, "uuid": "u" * 60, "n": 5}])
    assert (row["content"], row["tags"], row["title"]) == ("the longer one of the two", ["short one"], "T" * 60)


def test_bad_lines_are_named(spark):
    with pytest.raises(Exception, match="Invalid JSON at line 3 of 0.json"):
        parsed(spark, ['{"body": "p"}\n\n{"body": '])


def test_links_of_json_files(spark):
    whole = {"source_id": "a", "target_id": "b", "relation": "r", "weight": 2, "created_at": "2024-05-01T00:00:00Z"}
    files = [
        {"links": [whole, whole | {"target_id": "c"}]}, {"links": [whole, {k: v for k, v in whole.items() if k != "weight"}]}, {"links": [whole | {"created_at": "soon"}]},
        {"relations": [{"source": "a", "target": "d", "weight": "heavy"}, {"from": "a"}, {"payload": {"from": "a", "to": 7}, "relation": "q", "weight": 0.5}]}, [whole], whole,
    ]
    rows = spark.createDataFrame([(f"{i}.json", json.dumps(f)) for i, f in enumerate(files)], "path string, text string")
    got = sorted((r["source_id"], r["target_id"], r["relation"], r["weight"]) for r in importers.json_links(rows).collect())
    assert got == [("a", "7", "q", 0.5), ("a", "b", "r", 2.0), ("a", "c", "r", 2.0), ("a", "d", "relates_to", 1.0)]


def test_heads(spark):
    cases = {
        "---\ntitle: 'A b'\ntags:\n- x\n  - \"y\"\nid: 7\n- z\n---\nBody\n---\nmore": ("7", "A b", "Body\n---\nmore", ["x", "y"], 0.9),
        "\n\n---\ntype: goal\r\n  tags:\n - p\nconfidence: .5\n---Body": (None, "Body", "Body", ["p"], 0.5),
        "---\nname: x\n---\nBody": None,
        "---\ntitle: x\n---\n \n": None,
        "---\ntitle: x\nBody": None,
        "---\ntitle: x\n---\nBody\n### y": None,
        "--- \ntitle:\n---\nBody": (None, "", "Body", [], 0.9),
        f"---\ntitle: x\n---\n# All{importers.INDEX_MARK}": None,
    }
    rows = spark.createDataFrame([(f"{i}.md", t) for i, t in enumerate(cases)], "path string, text string")
    got = {int(r["path"][0]): (r["id"], r["title"], r["content"], r["tags"], r["confidence"]) for r in importers.front_matter(rows).collect()}
    assert [got.get(i) for i in range(len(cases))] == list(cases.values())


def test_sections(spark):
    said = (
        "lost\n## Choices\n- lost\n### One\n- **ID:** `i1`\n> quoted\n>\n  kept as it is\n- **Tags:** a, `b`,\n- plain bullet\n- **Else:** gone\n---\nlost\n"
        "### Two\n*Confidence: 0.5 | Tags: `c`*\n*Confidence: open\ntext\n## Errors\n### Empty\n\n###  \nlost\n### Three\nlast"
    )
    rows = spark.createDataFrame([("f.md", said)], "path string, text string")
    got = [(r["id"], r["category"], r["title"], r["content"], r["tags"], r["confidence"]) for r in importers.sectioned(rows).orderBy("place").collect()]
    assert got == [
        ("i1", "decision", "One", "quoted\n\n  kept as it is\n- plain bullet", ["a", "b"], 0.9),
        (None, "decision", "Two", "*Confidence: open\ntext", ["c"], 0.5),
        (None, "error", "Empty", "###  \nlost", [], 0.9),
        (None, "error", "Three", "last", [], 0.9),
    ]


def test_folders_with_a_dot_are_not_imported(spark, tmp_path):
    for name in ("a.md", "sub/b.json", ".hidden/c.md", "sub/.d.md", "index.md", "e.txt"):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text("x")
    assert sorted(r["path"].rsplit("/", 1)[1] for r in importers.read_files(spark, str(tmp_path / "in")).collect()) == ["a.md", "b.json"]


# --- files and answers ---------------------------------------------------------------------------------


def test_media_headers(spark):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 33, 44)
    wav = b"RIFF" + bytes(4) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, 8000, 16000, 2, 16) + b"data" + struct.pack("<I", 24000)
    rows = spark.createDataFrame([("p.png", bytearray(png)), ("w", bytearray(wav)), ("n", bytearray(b"\xfe\xff\x00"))], "f string, d binary")
    out = rows.withColumn("x", media.detected(F.col("d"), F.col("f"))).select("f", "x.kind", media.dimensions(F.col("d"), F.col("x.mime")).alias("dim"), media.seconds(F.col("d"), F.col("x.mime")).alias("sec"))
    assert {r["f"]: tuple(r)[1:] for r in out.collect()} == {"p.png": ("image", "33x44", None), "w": ("audio", None, 1.5), "n": ("binary", None, None)}


def test_tag_lists(spark):
    assert column(spark, ["a, b ,,c", '["x y", "z"]', " [1]", ""], text.tag_list) == [["a", "b", "c"], ["x y", "z"], ["1"], []]


def test_entity_shortcut(spark):
    hits = spark.createDataFrame([("m", 0.8), ("n", 0.7)], "id string, score double")
    slots = spark.createDataFrame([("m", "mine_depth", "70"), ("m", "rock", "slate"), ("m", "rock", "tin"), ("m", "same", "Same"), ("q", "owner", "Z")], "memory_id string, entity_name string, entity_val string")
    ask = lambda q: [r["answer"] for r in answer.entity_answer(hits, slots, q).collect()]
    assert ask("Mine-depth please") == ["70"] and ask("mine depth of 70?") == [] and ask("which rock?") == ["slate"] and ask("same?") == [] and ask("owner?") == []


def test_slots_that_other_hits_speak_of_do_not_answer(spark):
    hits = spark.createDataFrame([("m", 0.8), ("n", 0.7)], "id string, score double")
    slots = spark.createDataFrame([("m", "depth", "70"), ("m", "rock type", "slate"), ("n", "Rock-Type", "tin"), ("n", "owner", "Z")], "memory_id string, entity_name string, entity_val string")
    rows = memories(spark, [{"id": "m", "content": "x", "confidence": 0.97}, {"id": "n", "content": "its Depth varies", "confidence": 0.2}, {"id": "o", "content": "owner"}])
    ask = lambda q: [tuple(r) for r in answer.entity_answer(hits, slots, q, rows).collect()]
    assert ask("depth and owner?") == [("owner", "Z", "n", 0.95)] and ask("rock type?") == [] and ask("depth?") == []
    assert [tuple(r) for r in answer.entity_answer(hits, slots, "depth?").collect()] == [("depth", "70", "m", 0.95)]


def test_spans_of_several_records(spark):
    rows = [("which rock", 0, "a", 0.2, "slate", 10.5), ("which rock", 1, "b", 0.9, "tin", 10.4), ("early", 0, "a", 0.0, "slate", 11.0), ("early", 1, "b", 1.0, "tin", 15.0), ("none", 0, "a", 1.0, "slate", 1.0)]
    got = answer.span_answers(spark.createDataFrame(rows, "question string, place long, id string, score double, span string, margin double"))
    want = {"which rock": ("tin", "b", 10.85), "early": ("slate", "a", 11.0)}
    found = {r["question"]: (r["answer"], r["selected"], r["confidence"]) for r in got.collect()}
    assert {k: v[:2] for k, v in found.items()} == {k: v[:2] for k, v in want.items()}
    assert all(found[k][2] == pytest.approx(1 / (1 + np.exp(-want[k][2] / 5))) for k in want)


def test_a_category_given_and_extra_tags(spark):
    turns = spark.createDataFrame([(0, 0, None, "we decided on zebra stripes"), (0, 1, None, "I learned that we decided on zebra stripes")], "conv_id long, turn long, role string, text string")
    (one, two) = observe.candidates(turns, category="goal", extra_tags=(" Zoo", "DECISION", "", "zoo")).orderBy("turn").collect()
    assert one["category"] == two["category"] == "goal" and one["tags"][0] == "decision" and one["tags"][-1] == "zoo" and one["tags"].count("zoo") == 1


@pytest.mark.parametrize("phrase", [*answer.SUMMARY_WORDS, *answer.LIST_PHRASES, "what do i have"])
def test_each_sign_of_a_summary(spark, phrase):
    assert column(spark, [f"please {phrase.strip()} x" if not phrase.startswith("what do") else phrase, f"q{phrase.strip()}q"], answer.is_synthesis) == [True, False]


def test_spans(spark):
    cleaned = {" 'slate', ": "slate", "(tin)": "tin", "(tin": "tin", "tin)": "tin", "Rock type: slate": "slate", "at 9:30": "at 9:30", "http://q:1": "http://q:1"}
    assert column(spark, list(cleaned), answer.clean_span) == list(cleaned.values())
    cases = [("slate", 4.5, True), ("slate", 4.49, False), ("slt-42", 1.5, True), ("not recorded", 20.0, False), ("which rock", 20.0, False), ("rock slate", 9.9, False), ("rock slate", 10.0, True)]
    rows = spark.createDataFrame(cases, "s string, m double, ok boolean")
    assert not [r for r in rows.select("*", answer.is_valid_span(F.col("s"), F.col("m"), F.lit("which rock")).alias("got")).collect() if r["got"] != r["ok"]]
    rng = np.random.default_rng(2)
    scores = [(rng.normal(size=12).tolist(), rng.normal(size=12).tolist()) for _ in range(10)]
    rows = spark.createDataFrame([(i, *s) for i, s in enumerate(scores)], "i long, s array<double>, e array<double>")
    got = {r["i"]: r["b"] for r in rows.select("i", answer.best_span(F.col("s"), F.col("e"), 4).alias("b")).collect()}
    for i, (s, e) in enumerate(scores):
        best = max(((s[a] + e[b], a, b) for a in range(1, 12) for b in range(a, min(12, a + 4))))
        assert (got[i]["start"], got[i]["end"]) == best[1:] and got[i]["margin"] == pytest.approx(best[0] - s[0] - e[0])


def test_grounding(spark):
    cases = [("70 m", "depth is 70 m.", True), ("7", "depth is 70 m", False), ("slate tin", "tin over slate", True), ("slate", "slates", False), ("depth zinc", "depth is 70", False)]
    rows = spark.createDataFrame(cases, "a string, c string, ok boolean")
    assert not [r for r in rows.select("*", answer.is_grounded(F.col("a"), F.lit(""), F.col("c")).alias("got")).collect() if r["got"] != r["ok"]]
    joint = [("quarries at 70 and slate", "quarry slate 70 quarries", True), ("slate at 71", "slate 70", False), ("iron copper zinc slate", "slate", False)]
    rows = spark.createDataFrame(joint, "a string, c string, ok boolean")
    assert not [r for r in rows.select("*", answer.is_synthesis_grounded(F.col("a"), F.col("c")).alias("got")).collect() if r["got"] != r["ok"]]


def test_similar_pairs_of_two_sizes_and_two_sides(spark):
    rng = np.random.default_rng(4)
    x = [rng.normal(size=3 + i % 2).tolist() for i in range(60)]
    rows = spark.createDataFrame([(i, i % 5 == 0, v) for i, v in enumerate(x)], "id long, asks boolean, embedding array<float>")
    near = {(i, j) for i in range(60) for j in range(i + 1, 60) if len(x[i]) == len(x[j]) and np.dot(x[i], x[j]) >= 0.6 * np.linalg.norm(x[i]) * np.linalg.norm(x[j])}
    assert sorted((r["a"], r["b"]) for r in vectors.similar_pairs(rows, 0.6).collect()) == sorted(near)
    sides = {(i, j) for i, j in near if (i % 5 == 0) != (j % 5 == 0)}
    assert sorted((r["a"], r["b"]) for r in vectors.similar_pairs(rows, 0.6, "asks").collect()) == sorted(sides)


def test_titles_of_any_length_are_found(spark):
    """Titles of 1 to 20 terms, whole and with their last term cut or carried on."""
    titles = {n: " ".join(f"term{n}x{i}" for i in range(n)) for n in (1, 2, 3, 4, 7, 8, 9, 20)}
    rows = [{"id": f"t{n}", "title": t.title(), "content": "-"} for n, t in titles.items()]
    rows += [{"id": f"c{n}", "content": f"so, {t.upper()}; end"} for n, t in titles.items()] + [{"id": f"d{n}", "content": f"so {t}1 {t[:-1]}"} for n, t in titles.items()]
    got = {(r["source_id"], r["target_id"]) for r in graph.title_mentions(memories(spark, rows)).collect()}
    assert {g for g in got if g[0][0] != "t" and g[1][0] == "t"} == {(f"c{n}", f"t{n}") for n in titles}


def test_the_lexical_lane_splits_texts_once(spark):
    rows = spark.createDataFrame([(f"r{i}", "t", f"deep sea {i}", ["a"]) for i in range(4)], "id string, title string, content string, tags array<string>")
    found = lexical.scored(rows, "deep sea")
    assert "split(" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 4
