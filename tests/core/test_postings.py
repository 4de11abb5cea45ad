"""The stored index against scans of all texts, and stems against published ones."""

import random
import re

import pytest
from pyspark.sql import functions as F

from memvault.functions.stem import stem
from memvault.functions.text import lexical_query
from memvault.operators import fusion, lexical, postings
from memvault.vault import Vault

# fixed values: words and stems of the published description of the rules
PUBLISHED = (
    "caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat "
    "troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat "
    "conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ vileli vile "
    "analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous "
    "formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope "
    "goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit "
    "replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog "
    "effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll generalizations gener oscillators oscil deploys deploi deploying deploi"
).split()


@pytest.mark.parametrize("word, want", list(zip(PUBLISHED[::2], PUBLISHED[1::2], strict=True)))
def test_published_stems(word, want):
    assert stem(word) == want


@pytest.mark.parametrize("word", ["a", "is", "b2", "é", "port5432", ""])
def test_other_terms_stay(word):
    assert stem(word) == word


WORDS = ["deploy", "deploys", "deploying", "dep", "node", "nodes", "no", "7", "71", "b2", "rate", "rates", "zeta"]


def scan(spark, vault, query, eligible):
    """scored() over all texts with stems in place of words."""
    stemmed = F.udf(lambda t: " ".join(stem(w) for w in re.split(r"[^\w]+|_", t.lower()) if w), "string")
    rows = vault.table("memories").select("id", F.lit("").alias("title"), stemmed(lexical.indexed_text(vault.table("memories"))).alias("content"), F.array().cast("array<string>").alias("tags"), *postings.STATE)
    said = " ".join("-".join(stem(t) for t in p) for p in lexical_query(query))
    return {r["id"]: (r["bm25"], r["matched"]) for r in lexical.scored(rows, said, eligible).collect()}


def test_index_equals_a_scan_after_every_commit(spark, tmp_path):
    rng = random.Random(8)
    vault = Vault(spark, str(tmp_path / "v"), buckets=2)
    queries = ["deploys", "node rate", "no dep zeta", "7.b2", "d", "b2_71 rates"]
    active = F.col("status") == "active"
    for step in range(6):
        rows = [(f"m{rng.randint(0, 25)}", rng.choice(["fact", "goal"]), "-".join(rng.choices(WORDS, k=rng.randint(1, 9)))) for _ in range(6)]
        vault.remember(spark.createDataFrame(rows, "id string, category string, content string"), f"2024-01-0{step + 1}")
        if step == 3:
            vault.forget(vault.table("memories").select("id").limit(2), "2024-01-05")
        if step == 4:
            vault.forget(vault.table("memories").select("id").limit(2), "2024-01-06", hard=True)
        if step in (0, 3, 5):
            index = postings.Index.of(vault.entry["index"])
            for query in queries:
                got = {r["id"]: (r["bm25"], r["matched"]) for r in postings.scored(spark, index, query, vault._path, active).collect()}
                want = scan(spark, vault, query, active)
                assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want), query
    assert len(index.segments) < 6 and max(s[1] for s in index.segments) > 0  # some were merged
    assert index.records == vault.table("memories").count()
    hits = vault.recall("deployed nodes", category="fact").collect()
    words = postings.top(spark, index, "deployed nodes", 80, vault._path, fusion.eligible(fusion.Request("q", [1.0], category="fact")))
    assert {h["id"] for h in hits if h["bm25_rank"]} <= {r["id"] for r in words.collect()}
    vault.vacuum(keep=1)
    assert Vault(spark, vault.path).recall("deployed nodes", category="fact").count() == len(hits)
    before = postings.scored(spark, index, "node rate", vault._path).count()
    vault.reindex_words()
    index = postings.Index.of(vault.entry["index"])
    assert len(index.segments) == 1 and not index.deleted and postings.scored(spark, index, "node rate", vault._path).count() == before


def test_a_query_reads_its_folders_only(spark, tmp_path):
    vault = Vault(spark, str(tmp_path / "v"))
    vault.remember(spark.createDataFrame([(f"m{i}", f"w{i:02x}{chr(97 + i % 26)} x{chr(97 + i % 26)}") for i in range(60)], "id string, content string"), "2024-01-01")
    index = postings.Index.of(vault.entry["index"])
    found = postings.scored(spark, index, "w05f", vault._path)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*folder", plan) and "StringStartsWith(term" in plan
    assert [r["id"] for r in found.collect()] == ["m5"]
    files = {f for f in found.inputFiles()}
    assert len({re.search(r"folder=(\d+)", f)[1] for f in files}) > 1  # of which the plan reads one
