"""Exports read back, and links by titles, on contents that are blank or odd."""

import duckdb
import pytest

from memvault.operators import graph
from memvault.plans import registry

TEXTS = [
    None, "", " \n\t", "\nfirst line blank", " " * 85 + "late", "　\nwide", "plain", "plain", '{"content": "z"}', 'a "b" \\n', "  lead", "x" * 79 + " y", "open [[Plain", "see [[plain]] and [[[plain]]",
    "a [[b]] c", "see [[A [[B]] C]]", "x]", "see [[x]]]", "[[", "PLAIN\nmore", "q [[plain\n]] [[]]",
]


@pytest.fixture
def odd(spark, tmp_path):
    """A folder of odd documents: the texts, twice, with and without a language or source."""
    rows = [(i, t, None if i % 11 == 10 else "en", None if i % 13 == 12 else f"src{i % 3}", len(t or "")) for i, t in enumerate(TEXTS * 2)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def agrees(spark, folder, name):
    """The rows of a query, which are those of its SQL."""
    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    found = con.sql(registry.oracle_sql()[name])
    got = sorted((tuple(r[c] for c in found.columns) for r in registry.queries()[name](spark, folder).collect()), key=repr)
    assert got == sorted(found.fetchall(), key=repr)
    return got


def test_exports_lose_no_blank_record(spark, odd):
    """Blank titles stay blank, and records without a content come back."""
    got = agrees(spark, odd, "export_json_roundtrip")
    assert len(got) == 2 * len(TEXTS) and len([r for r in got if r[2] == ""]) >= 12


def test_backlinks_are_those_of_the_sql(spark, odd):
    """Titles and links with brackets of their own, unclosed ones, and records without a partner."""
    assert agrees(spark, odd, "backlinks")


def test_backlinks_move_no_content_and_deal_out_common_titles(spark, odd, monkeypatch):
    want = agrees(spark, odd, "backlinks")
    monkeypatch.setattr(graph, "MET", 2)
    assert agrees(spark, odd, "backlinks") == want
    plan = registry.backlinks(spark, odd)._jdf.queryExecution().optimizedPlan().toString()
    assert "quality" not in plan  # no labels are joined
    joined = [line for line in plan.splitlines() if "Join" in line]
    assert joined and "_open" in plan


def test_titles_meet_contents_on_all_their_terms(spark):
    """A content that only begins like a title doesn't meet it, whatever the title's length; whole titles are found."""
    words = [f"w{i}" for i in range(90)]
    rows = [(f"t{n:02}", " ".join(words[:n]), "") for n in (1, 2, 3, 5, 8, 13, 16, 17, 33, 64, 90)]
    contents = {"c-none": "w1 w0 w5", "c-two": "so w0, w1. w9 w2", "c-three": "w0 w1! w2 w9", "c-all": "x " + " ".join(words) + " y", "c-glued": "xw0 w1"}
    table = spark.createDataFrame([(i, t, c, "active") for i, t, c in rows + [(i, "", c) for i, c in contents.items()]], "id string, title string, content string, status string")
    met = {(r["id"], r["target_id"]) for r in graph.title_runs(table, 1).collect()}
    assert met == {("c-none", "t01"), *[("c-two", t) for t in ("t01", "t02")], *[("c-three", t) for t in ("t01", "t02", "t03")], *[("c-all", i) for i, *_ in rows]}
    found = {tuple(r) for r in graph.title_mentions(table, 1).collect()}
    assert found == met - {("c-two", "t02"), ("c-three", "t03")}
