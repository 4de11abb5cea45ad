"""The queries of the training-data operators, one per operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from memvault.llm import (
    fingerprints,
    genetic_packing,
    jaccard_join,
    lexical_rank,
    line_dedup,
    lm_scoring,
    merkle,
    packing,
    quality_rules,
    sentencepieces,
    sharding,
    token_counts,
    url_filter,
)
from memvault.llm.common import table, tokenizer

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.with_token_counts(documents, tokenizer("word_bpe_49k.json")).drop("text")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: pieces, a checksum of their ids, and the text that they decode to, by its hash."""
    model = tokenizer("piece_bpe_32k.model")
    done = sentencepieces.joined(sentencepieces.encode(table(spark, sf_dir, "documents"), model), model)
    return done.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_pieces"),
        F.crc32("ids").alias("ids_crc32"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id",
        "n_lines",
        "n_dropped",
        F.sha2("text", 256).alias("kept_sha256"),
    )


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


#: The rules of op5_url_filter.
URL_RULES = url_filter.Rules(allow=("org/", "com/fr/"), block=("example.org/es/", "example.org/en/1", "com/de/"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"))
    return placed.select("*", F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genetic_packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op12_lexical_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_rank.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id's checksum 7 divides are tampered with: one more character than they have."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    return merkle.dataset_proofs(table(spark, sf_dir, "documents"), tampered, more)


def queries() -> dict[str, Query]:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_token_counts": op1_token_counts,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_line_dedup": op3_line_dedup,
        "op4_jaccard_join": op4_jaccard_join,
        "op5_url_filter": op5_url_filter,
        "op6_quality_rules": op6_quality_rules,
        "op7_fingerprints": op7_fingerprints,
        "op8_sharding": op8_sharding,
        "op9_packing": op9_packing,
        "op10_lm_scoring": op10_lm_scoring,
        "op11_best_fit_packing": op11_best_fit_packing,
        "op12_lexical_rank": op12_lexical_rank,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


_BLANK = r"[\x20\x09-\x0D]+"
_TRIM = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP3 = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (SELECT *, translate(trim(line, {_TRIM}), {_AZ}) AS k FROM lines),
hot AS (
  SELECT k, max(doc_id) AS owner FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT doc_id, pos, line, coalesce(doc_id <> owner, false) AS gone
  FROM keyed LEFT JOIN hot USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP5 = f"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS u FROM pages),
q AS (
  SELECT page_id,
         translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), {_AZ}) AS host,
         regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM p),
rules(rh, rp, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
hits AS (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC, length(rh) DESC) AS n
  FROM q LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rh || rp AS rule, coalesce(verdict, 'allow') AS verdict FROM hits WHERE n = 1
"""

OP6 = f"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{_BLANK}'), lambda w: w <> '') AS w
  FROM documents),
tri AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM split)),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p
    FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM tri) WHERE n >= 2)
  GROUP BY doc_id),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(string_split(t, chr(10))) AS BIGINT) AS n_lines,
         list_filter(string_split(t, chr(10)), lambda x: trim(x, {_TRIM}) <> '') AS full_lines,
         CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words,
         CAST(length(regexp_replace(t, '[^A-Z]', '', 'g')) AS BIGINT) AS n_capitals
  FROM split LEFT JOIN rep USING (doc_id)),
r AS (
  SELECT *, CAST(len(full_lines) - len(list_distinct(full_lines)) AS BIGINT) AS n_dup_lines FROM m),
b AS (
  SELECT *, CAST((n_words < 50)::INT * 1 + (100 * n_repeat_words > 50 * n_words)::INT * 2
    + (word_chars < 2 * n_words OR word_chars > 20 * n_words)::INT * 4
    + (100 * n_symbols > 20 * n_words)::INT * 8 + (100 * n_dup_lines > 50 * n_lines)::INT * 16
    + (2 * n_capitals > word_chars)::INT * 32 AS BIGINT) AS fail_bits FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_capitals, fail_bits,
       (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept
FROM b
"""


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

OP12 = f"""
WITH items AS (SELECT row_number() OVER () AS item, item_id, text FROM benchmark),
asked AS (
  SELECT item, item_id, term, count(*) AS often FROM (
    SELECT item, item_id, unnest(regexp_extract_all(translate(text, {_AZ}), '{_TERM}')) AS term FROM items)
  GROUP BY ALL),
docs AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, {_AZ}), '{_TERM}') AS t FROM documents),
sized AS (SELECT row, doc_id, len(t)::BIGINT AS n, t FROM docs WHERE len(t) > 0),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM sized),
tf AS (
  SELECT row, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT row, doc_id, n, unnest(t) AS term FROM sized)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
w AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term),
scored AS (
  SELECT item, item_id, row, doc_id,
         sum(often * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN w USING (term), total GROUP BY ALL),
best AS (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM best WHERE rank <= 10
"""

_FIELDS = " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END" for c in merkle.FIELDS)

OP13 = f"""
WITH RECURSIVE sums AS (
  SELECT DISTINCT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
    lambda s, c: list_reduce(list_prepend(xor(s, c), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
      lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) AS crc
  FROM documents WHERE doc_id IS NOT NULL),
docs AS (
  SELECT doc_id, coalesce('1' || lang, '') AS tree, sha256({_FIELDS}) AS leaf,
         sha256({_FIELDS.replace("n_chars", "(n_chars + (crc % 7 = 0)::INT)")}) AS used
  FROM documents LEFT JOIN sums USING (doc_id)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM docs),
low(tree, lvl, pos, h, n) AS (
  SELECT tree, 0, pos, leaf, n FROM placed
  UNION ALL
  SELECT tree, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (min(n) + 1) // 2
  FROM low WHERE n > 1 GROUP BY tree, lvl, pos // 2),
subs AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
high(lvl, pos, h, n) AS (
  SELECT 0, pos, h, n FROM subs
  UNION ALL
  SELECT lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (min(n) + 1) // 2
  FROM high WHERE n > 1 GROUP BY lvl, pos // 2),
steps AS (
  SELECT a.tree, a.pos, l.lvl AS step, (a.pos >> l.lvl) & 1 AS side, s.h
  FROM placed a JOIN (SELECT DISTINCT tree, lvl FROM low WHERE n > 1) l USING (tree)
  LEFT JOIN low s ON s.tree = a.tree AND s.lvl = l.lvl AND s.pos = xor(a.pos >> l.lvl, 1)
  UNION ALL
  SELECT a.tree, a.pos, 1000 + l.lvl, (t.pos >> l.lvl) & 1, s.h
  FROM placed a JOIN subs t USING (tree) CROSS JOIN (SELECT DISTINCT lvl FROM high WHERE n > 1) l
  LEFT JOIN high s ON s.lvl = l.lvl AND s.pos = xor(t.pos >> l.lvl, 1)),
paths AS (
  SELECT tree, pos, sha256(coalesce(string_agg(h, '' ORDER BY step), '')) AS proof,
         list({{'side': side, 'h': h}} ORDER BY step) AS path
  FROM steps GROUP BY tree, pos),
folded AS (
  SELECT a.*, coalesce(p.proof, sha256('')) AS proof_sha256,
         list_reduce(list_prepend({{'side': 0, 'h': a.used}}, coalesce(path, [])), lambda x, s:
           {{'side': 0, 'h': sha256(CASE WHEN s.h IS NULL THEN x.h WHEN s.side = 1 THEN s.h || x.h ELSE x.h || s.h END)}}).h AS folded_root
  FROM placed a LEFT JOIN paths p USING (tree, pos))
SELECT f.doc_id, f.leaf, t.h AS subroot, r.h AS root, f.proof_sha256, f.folded_root, f.folded_root = r.h AS verified
FROM folded f JOIN subs t USING (tree) CROSS JOIN (SELECT h FROM high WHERE n = 1) r
"""


def oracle_sql() -> dict[str, str]:
    whole = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return whole | {"op3_line_dedup": OP3, "op5_url_filter": OP5, "op6_quality_rules": OP6, "op12_lexical_rank": OP12, "op13_merkle_manifest": OP13}
