"""Language-model scores against a plain model that cuts no word and no n-gram that occurs often enough."""

import math
import os
import sys
import zlib
from collections import Counter, defaultdict

import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from memvault.llm import lm_scoring, queries  # noqa: E402

SF = "/root/testdata/sf0.001"


def expected(docs, least):
    """{doc: (n_tokens, n_known, base_score, score)}."""
    token = {d: [*brute.words((t or "").translate(brute.LOW)), "\0"] for d, t in docs}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in token}
    grams = [None]
    for k in (1, 2, 3):
        found = Counter(tuple(t[i : i + k]) for d, t in token.items() if not held[d] for i in range(len(t) - k + 1))
        grams.append({g: c for g, c in found.items() if k == 1 or c >= least})
    n, v = sum(grams[1].values()), len(grams[1])
    left = defaultdict(lambda: 1.0)
    for k in (2, 3):
        for g, c in grams[k].items():
            left[g[:-1]] -= (c - lm_scoring.DISCOUNT) / grams[k - 1][g[:-1]]

    def p(g):
        if len(g) == 1:
            return (grams[1].get(g, 0) + 1) / (n + v + 1)
        if g in grams[len(g)]:
            return (grams[len(g)][g] - lm_scoring.DISCOUNT) / grams[len(g) - 1][g[:-1]] + left[g[:-1]] * p(g[1:])
        return left.get(g[:-1], 1.0) * p(g[1:])

    out = {}
    for d, t in token.items():
        base = sum(math.log10(p((w,))) for w in t)
        out[d] = len(t), sum((w,) in grams[1] for w in t), base, sum(math.log10(p(tuple(t[max(0, i - 2) : i + 1]))) for i in range(len(t)))
    return out


@pytest.mark.parametrize("block, lane, least", [(lm_scoring.BLOCK, lm_scoring.LANE, 2), (lm_scoring.BLOCK, 7, 1), (70, 3, 2), (70, 1000, 1), (lm_scoring.BLOCK, 1, 3)])
def test_no_count_is_lost(spark, monkeypatch, block, lane, least):
    """Whole texts in a block, and texts cut into blocks and lanes that carry the state on; parts of few n-grams; all n-grams, too."""
    monkeypatch.setattr(lm_scoring, "LANE", lane)
    monkeypatch.setattr(lm_scoring, "BLOCK", block)
    monkeypatch.setattr(lm_scoring, "PART", 3 * block)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = expected(docs, least)
    given = spark.read.parquet(f"{SF}/documents.parquet")
    got = (queries.op10_lm_scoring(spark, SF) if least == lm_scoring.LEAST else lm_scoring.score(given, least=least)).collect()
    assert len(got) == len(docs)
    for r in got:
        n_tokens, n_known, base, score = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"]) == (n_tokens, n_known)
        assert (r["base_score"], r["score"]) == (pytest.approx(base, rel=1e-9), pytest.approx(score, rel=1e-9))


def test_awkward_rows(spark):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert lm_scoring.score(frame([])).count() == 0
    rows = [(None, "some text here with words"), (None, None), (1, None), *[(2, "same row " * 4)] * 3, (3, "last"), (4, " \t\n")]
    assert lm_scoring.score(frame(rows)).count() == len(rows)
