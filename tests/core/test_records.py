"""Lookups, links, merges and model texts on small cases."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from memvault.functions import modeltext
from memvault.operators import answer, conflict, dedup, filters, fusion, graph
from memvault.schema import MEMORIES
from memvault.sources import exporters, importers
from memvault.vault import Vault


def made(spark, *rows):
    """rows: (id, title, content, status, tags, confidence); each is a minute younger than the one before."""
    start = dt.datetime(2024, 1, 1)
    full = [(i, "fact", t, c, list(g), float(f), s, "explicit_statement", start + dt.timedelta(minutes=n), start, None) for n, (i, t, c, s, g, f) in enumerate(rows)]
    return spark.createDataFrame(full, MEMORIES)


def linked(spark, *rows):
    return spark.createDataFrame(list(rows), "source_id string, target_id string, relation string, weight double")


@pytest.fixture(scope="module")
def three(spark):
    return made(spark, ("a1", "Basalt", "x", "active", (), 0.5), ("a2", "Slate", "y", "expired", (), 0.5), ("b1", "slate", "z [[BASALT]] [[Slate|s]]", "active", (), 0.5))


def test_for_restore_finds_archived_records_and_refuses_ambiguity(three):
    assert [r["id"] for r in filters.for_restore(three, " a2 ").collect()] == ["a2"]
    assert [r["id"] for r in filters.for_restore(three, "b").collect()] == ["b1"]
    assert filters.for_restore(three, "  ").count() == 0
    assert filters.for_restore(three, "none").count() == 0
    for several in ("a", "SLATE"):
        with pytest.raises(Exception, match="several records"):
            filters.for_restore(three, several).collect()


def test_links_of_expired_nodes_show_all(spark, three):
    links = linked(spark, ("a1", "a2", "r", 1.0), ("b1", "a1", "r", 1.0), ("a2", "gone", "r", 1.0))
    found = {(r["node"], r["source_id"], r["target_id"]) for r in graph.links_of(three, links, three).collect()}
    assert found == {("a1", "b1", "a1"), ("b1", "b1", "a1"), ("a2", "a1", "a2"), ("a2", "a2", "gone")}


def test_restored_links_resolve_titles_and_clamp(spark, three):
    back = linked(spark, ("BASALT", "b1", " ", 99.0), ("a1", "nothing", "r", 1.0), ("a1", "Basalt", "r", 1.0), ("a1", "slate", "r", 0.0))
    found = {tuple(r) for r in graph.restored(linked(spark, ("a1", "b1", "relates_to", 1.0)), three, back).collect()}
    assert found == {("a1", "b1", "relates_to", 10.0), ("a1", "a2", "r", 0.01)}


def test_backlinks_are_whole_titles_of_active_records(three):
    assert [tuple(r) for r in graph.backlinks(three).collect()] == [("b1", "a1")]


def test_neighbourhood_counts_inside_links(spark):
    rows = made(spark, *[(c, "", "", "active", (), 0.5) for c in "abcd"], ("e", "", "", "expired", (), 0.5))
    links = linked(spark, ("a", "b", "r", 1.0), ("b", "c", "r", 1.0), ("c", "d", "r", 1.0), ("a", "e", "r", 1.0))
    nodes, edges = graph.neighbourhood(rows, links, rows.where("id = 'a'"), 2)
    assert {tuple(r) for r in nodes.collect()} == {("a", 1), ("b", 2), ("c", 1)}
    assert edges.count() == 2


def test_chains_of_conflicts_end_in_one_survivor(spark):
    rows = made(spark, ("a", "A", "one", "active", ("Red", "x"), 0.9), ("b", " ", "two", "active", ("red", "y"), 0.2), ("c", " ", " ", "active", ("z",), 0.4))
    pairs = spark.createDataFrame([("a", "b"), ("b", "c")], "older_id string, newer_id string")
    into = conflict.survivors(pairs)
    assert {tuple(r) for r in into.collect()} == {("a", "c"), ("b", "c")}
    out = {r["id"]: r for r in conflict.merged_pairs(into, rows, "2024-02-01 00:00:00").collect()}
    assert [out[i]["status"] for i in "abc"] == ["expired", "expired", "active"]
    c = out["c"]
    assert (c["title"], c["content"], c["confidence"]) == (" ", "two", 0.9)
    assert c["tags"][0] == "z" and {t.lower() for t in c["tags"]} == {"z", "red", "x", "y"} and len(c["tags"]) == 4


def test_peers_take_older_records_of_the_category(spark):
    said = "the turbine at dock seven spins at forty rounds"
    rows = made(spark, ("a", "", said, "active", (), 0.5), ("b", "", said.upper(), "active", (), 0.5), ("c", "", said + " again", "active", (), 0.5), ("d", "", "unlike", "active", (), 0.5))
    found = {r["id"]: (r["older_id"], r["similarity"]) for r in conflict.peers(rows, rows).collect()}
    assert found == {"b": ("a", 1.0), "c": ("a", 0.92)}
    assert conflict.peers(rows.withColumn("category", F.lit("goal")), rows).count() == 0
    assert conflict.peers(rows.limit(0), rows).count() == 0


def test_file_tags_know_case_and_missing_extensions(spark):
    rows = made(spark, ("a", "", "", "active", ("PDF",), 0.5), ("b", "", "", "active", (), 0.5))
    files = spark.createDataFrame([("a", "x.pdf", "document"), ("a", "noext", "document"), ("a", ".env", "code")], "memory_id string, filename string, media_kind string")
    assert {r["id"]: r["tags"] for r in dedup.file_tags(rows, files).collect()} == {"a": ["PDF", "code", "document"], "b": []}


def test_requests_are_checked():
    for bad in ({"query": " "}, {"query": "x", "min_similarity": 1.5}, {"query": "x", "min_similarity": float("nan")}, {"query": "x", "limit": -1}):
        with pytest.raises(ValueError):
            fusion.Request(vector=[1.0], **bad)


def test_backups_refuse_other_formats(spark, three):
    lines = exporters.backup(three).selectExpr("'p' AS path", "value AS text")
    assert sorted(map(str, importers.backup(lines).collect())) == sorted(map(str, three.collect()))
    for bad, message in (({"format": "other-v1", "memories": []}, "unsupported backup format"), ({"format": "memvault-backup-v1"}, "backup without memories")):
        with pytest.raises(Exception, match=message):
            importers.backup(spark.createDataFrame([("p", json.dumps(bad))], "path string, text string")).collect()


@pytest.mark.parametrize(
    "raw, found",
    [("x [1, [2]] y", "[1, [2]]"), ('say ["]", 1]', '["]", 1]'), (r'["\"]"]', r'["\"]"]'), ("[bad] [3]", "[3]"), ("[1", None), ("none", None), ("", None), (None, None),
     ("<think>[1]</think> [2]", "[2]"), ("[4]</think> ", "[4]"), ("[" * 5000, None)],
)
def test_json_slices(spark, raw, found):
    rows = spark.createDataFrame([(raw,)], "raw string")
    assert rows.select(modeltext.json_slice(F.col("raw"))).first()[0] == found


def test_entities_leave_out_repeats_and_tautologies(spark):
    listed = [{"name": " Home Town ", "val": "Oslo"}, {"key": "home_town", "value": "Oslo"}, {"entity": "x_y", "val": "X y"}, {"name": "", "val": "v"}, {"name": "n", "val": 7}, {"name": "k"}]
    rows = spark.createDataFrame([("a", json.dumps(listed)), ("b", None), ("c", "no list"), ("d", "[]")], "id string, raw string")
    assert {tuple(r) for r in modeltext.entities_of(rows, "raw", "id").collect()} == {("a", "home_town", "Oslo"), ("a", "n", "7")}


def test_vaults_keep_children_and_embed_changed_cards_only(spark, tmp_path):
    vault = Vault(spark, f"file://{tmp_path}/one")
    vault.remember(spark.createDataFrame([("a", "the turbine at dock seven spins"), ("b", "a quiet harbour")], "id string, content string"), "2024-01-01 00:00:00")
    assert vault.version == 1 and vault.table("vectors").count() == 2
    vault.commit(entities=spark.createDataFrame([("a", "place", "dock")], "memory_id string, entity_name string, entity_val string"))
    vault.remember(spark.createDataFrame([("c", "the turbine at dock seven spins fast")], "id string, content string"), "2024-01-02 00:00:00")
    assert vault.version == 3 and vault.table("vectors").count() == 3
    assert [tuple(r)[:2] for r in vault.peers(spark.createDataFrame([("c",)], "id string")).collect()] == [("c", "a")]
    assert [tuple(r)[:2] for r in vault.resolve_conflicts("2024-01-03 00:00:00").collect()] == [("a", "c")]
    assert [r["memory_id"] for r in vault.table("entities").collect()] == ["c"]
    assert {r["id"] for r in vault.table("vectors").collect()} == {"b", "c"}
    other = Vault(spark, f"file://{tmp_path}/two")
    other.merge(vault)
    assert other.table("memories").count() == 3 and other.table("entities").count() == 1


def test_model_answers_must_be_borne_out(spark):
    told = [
        ('{"answer": "port 5432", "memory_index": 0, "confidence": 7}', "port 5432", 1, 1.0),  # the named record doesn't have it
        ('{"answer": " \\"Port 5432\\" ", "memory_index": "[1]"}', "Port 5432", 1, 0.85),
        ('{"answer": "- amber lamp\\n- port 5432", "memory_index": ["0", 1], "confidence": 0.001}', "- amber lamp\n- port 5432", 0, 0.05),
        ('{"answer": "port 5432", "memory_index": 9, "confidence": "0.2"}', "port 5432", 1, 0.85),
        ('{"answer": "N/A", "memory_index": 0}', None, None, None),
        ('{"answer": "port 9999 on lamp", "memory_index": 1}', None, None, None),
        ('{"answer": 5432}', None, None, None),
        ("no JSON", None, None, None),
        (None, None, None, None),
    ]
    rows = spark.createDataFrame([(k, t[0]) for k, t in enumerate(told)], "k int, raw string")
    gated = F.expr("array(named_struct('title', 'Light', 'content', 'The amber lamp burns'), named_struct('title', 'Base', 'content', 'It is on port 5432 now'))")
    got = {r["k"]: (r["answer"], r["memory_index"], r["confidence"]) for r in answer.model_answers(rows.withColumn("g", gated), "raw", "g").collect()}
    assert got == {k: t[1:] for k, t in enumerate(told)}
