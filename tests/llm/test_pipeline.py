"""The pipeline against plain versions of its stages."""

import os
import sys

import corpus_pipeline
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from memvault.llm import tokens  # noqa: E402
from memvault.llm.common import tokenizer  # noqa: E402


def _run(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return corpus_pipeline.run(spark, str(tmp_path))


def test_pipeline(spark, tmp_path):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in given.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    base = "A line that is long enough to count here.\n" + " ".join(f"word{i}" for i in range(120))
    rows += [(1000 + i, base + f" end{i}", "en", "s", 1) for i in range(4)] + [(2000, None, None, None, None), (2001, "short", "en", "s", 5)]
    texts = {r[0]: r[1] for r in rows}
    kept = {}
    for d, t in texts.items():
        n, chars, symbols, dup, rep = brute.quality(t)
        caps = sum("A" <= c <= "Z" for c in t or "")
        if n >= 50 and 100 * rep <= 50 * n and 2 * n <= chars <= 20 * n and 5 * symbols <= n and 2 * dup <= len((t or "").split("\n")) and 2 * caps <= chars:
            kept[d] = t
    lines = brute.dedup_lines(list(kept.items()))
    assert lines[1000][1] == 1 and lines[1003][1] == 0
    groups = brute.components([(d, x[2]) for d, x in lines.items()])
    left = {d: lines[d][2] for d, _, c in groups if d == c}
    lib = tokens.load(tokenizer("byte_bpe_50k.json"))
    want = {d: len(lib.encode(t, add_special_tokens=False).ids) + 1 for d, t in left.items()}
    got = _run(spark, tmp_path, rows).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert {r["doc_id"]: r["n"] for r in got} == want and all(r["n"] == r["m"] for r in got)


def test_empty_corpus(spark, tmp_path):
    assert _run(spark, tmp_path, []).count() == 0


def test_stages_keep_the_columns(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x " * 3, "en", "s", 6, 1), (None, " ".join(f"w{i}" for i in range(60)), None, None, None, 2)], "doc_id long, text string, lang string, source string, n_chars long, id int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, "")
        assert out.columns == rows.columns
        rows = out
    assert rows.count() == 1
