"""DuckDB SQL for the registered queries, written apart from the Spark plans."""

from __future__ import annotations

from memvault.functions import rules
from memvault.functions.text import FUNCTION_WORDS, MEANING_STOP
from memvault.schema import CATEGORIES
from memvault.sources.corpus import PREFIXES

HYBRID_QUERY = "thonthe ndtion"
LEXICAL_QUERY = "thor reon"
PAIR_QUERY = "zzzz thor reon"


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_BLANKS = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '||chr(133)||chr(160)||chr(5760)||chr(8192)||chr(8193)||chr(8194)||chr(8195)||chr(8196)||chr(8197)||chr(8198)||chr(8199)||chr(8200)||chr(8201)||chr(8202)||chr(8232)||chr(8233)||chr(8239)||chr(8287)||chr(12288)"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _memories(content: str = "coalesce(text, '')") -> str:
    return f"""mem AS (
  SELECT 'doc-' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS id, {content} AS content,
         left(string_split({content}, chr(10))[1], 80) AS title, lang, source, [lang, source] AS tags,
         CAST(coalesce(0.5 + 0.5 * quality, 0.9) AS DOUBLE) AS confidence,
         CASE WHEN doc_id % 7 = 0 THEN 'expired' ELSE 'active' END AS status,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id AS INTEGER)) AS created_at,
         CASE WHEN doc_id % 7 = 0 AND doc_id % 2 <> 0
              THEN TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id AS INTEGER)) + INTERVAL 30 DAY END AS expired_at,
         ({_list(CATEGORIES)})[doc_id % {len(CATEGORIES)} + 1] AS category, doc_id
  FROM documents LEFT JOIN (SELECT doc_id, quality FROM labels) USING (doc_id))"""


MEM = "WITH " + _memories()
_DECORATED = f"({_list(PREFIXES)})[doc_id % {len(PREFIXES)} + 1] || coalesce(text, '') || CASE WHEN doc_id % 5 = 0 THEN ' [[doc-' || lpad(CAST(doc_id * 7 % 1000 AS VARCHAR), 8, '0') || '|see]]' ELSE '' END"
DECORATED = "WITH " + _memories(_DECORATED)
VEC = """vec AS (SELECT 'doc-' || lpad(CAST(vec_id AS VARCHAR), 8, '0') AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
near AS (
  SELECT id, round(greatest(-1, least(1, list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))))), 6) AS similarity
  FROM vec, (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0))"""
LINKS = """n AS (SELECT max(vec_id) + 1 AS n FROM embeddings),
pick AS (
  SELECT vec_id AS s, (vec_id * (k + 2) + k * 17) % n AS t, k FROM embeddings, n, (VALUES (1), (2), (3)) v(k)),
links AS (
  SELECT 'doc-' || lpad(CAST(s AS VARCHAR), 8, '0') AS source_id, 'doc-' || lpad(CAST(t AS VARCHAR), 8, '0') AS target_id,
         'relates_to' AS relation, CAST(0.5 + 0.5 / min(k) AS DOUBLE) AS weight
  FROM pick WHERE s <> t GROUP BY s, t)"""
FILES = """files AS (
  SELECT 'doc-' || lpad(CAST(page_id AS VARCHAR), 8, '0') AS memory_id, CAST(page_id AS VARCHAR) || '.html' AS filename,
         html, sha256(html) AS sha256, CAST(strlen(html) AS BIGINT) AS size_bytes FROM pages)"""
HISTORY = """history AS (
  SELECT event_id AS id, event_type AS subcommand, CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
         CAST(floor(value * 1000) AS BIGINT) AS duration_ms FROM events)"""
FOUND = "created_at <= TIMESTAMP '{0}' AND ((status = 'active' AND expired_at IS NULL) OR expired_at > TIMESTAMP '{0}')"


def _bm25(phrases: list[str], eligible: str = "status = 'active'") -> str:
    """CTEs ending in bm(id, bm25) for single-term prefix phrases."""
    n = len(phrases)
    tfs = ", ".join(f"CAST(len(list_filter(w, lambda t: starts_with(t, '{p}'))) AS BIGINT) AS tf{i}" for i, p in enumerate(phrases))
    has = " + ".join(f"(tf{i} > 0)::INT" for i in range(n))
    dfs = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(n))
    score = " + ".join(
        f"CASE WHEN tf{i} > 0 THEN greatest(1e-6, ln((n - df{i} + 0.5) / (df{i} + 0.5))) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END"
        for i in range(n)
    )
    least = 2 if 3 <= n <= 6 else n
    return f"""terms AS (
  SELECT *, list_filter(regexp_split_to_array(lower(title || ' ' || content || ' ' || lang || ' ' || source), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS w FROM mem),
tf AS (SELECT id, ({eligible}) AS ok, len(w) AS dl, {tfs} FROM terms),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl, {dfs}, count(*) FILTER (ok AND {has} = {n}) AS whole FROM tf),
bm AS (SELECT id, round({score}, 6) AS bm25 FROM tf, st WHERE ok AND {has} >= CASE WHEN whole > 0 THEN {n} ELSE {least} END)"""


def _recall(eligible: str = "status = 'active'", min_similarity: float | None = None, extra: str = "", limit: int = 10) -> str:
    """Hybrid recall for HYBRID_QUERY, a query of two tokens that are too long for initials."""
    tokens = HYBRID_QUERY.split()
    gain = " + ".join(
        f"CASE WHEN list_contains(w, '{t}') OR len(list_filter(tags, lambda x: lower(x) = '{t}' OR starts_with(lower(x), '{t}-'))) > 0 THEN 0.06 ELSE 0 END" for t in tokens
    )
    fetch = max(80, 6 * limit)
    floor = f"WHERE similarity >= {min_similarity}" if min_similarity is not None else ""
    return f"""{MEM}, {VEC}, {_bm25(tokens, eligible)},
lex AS (SELECT id, row_number() OVER (ORDER BY bm25 DESC, id) AS bm25_rank FROM bm QUALIFY bm25_rank <= {fetch}),
cand AS (SELECT near.* FROM near JOIN mem USING (id) WHERE similarity > 0 AND ({eligible})),
vlane AS (SELECT id, similarity, row_number() OVER (ORDER BY similarity DESC, id) AS vector_rank FROM cand QUALIFY vector_rank <= {fetch}),
lanes AS (SELECT coalesce(lex.id, vlane.id) AS id, bm25_rank, vector_rank, similarity FROM lex FULL JOIN vlane ON lex.id = vlane.id),
fused AS (SELECT *, round(coalesce(1 / (60 + bm25_rank), 0) + coalesce(1 / (60 + vector_rank), 0), 9) AS rrf FROM lanes),
one AS (
  SELECT fused.*, w, tags FROM fused JOIN terms USING (id)
  QUALIFY row_number() OVER (PARTITION BY category, trim(content, {_BLANKS}) ORDER BY rrf DESC, fused.id) = 1),
boosted AS (SELECT *, least(0.35, {gain}) AS gain, EXISTS (FROM lex) AS lexical FROM one {floor}),
based AS (
  SELECT *, (rrf + CASE WHEN lexical AND bm25_rank IS NULL AND coalesce(vector_rank, 999) <= 5 AND gain >= 0.06 - 1e-5
    THEN 1 / (70 + vector_rank) ELSE 0 END) * 61 / 2 AS base,
    CASE WHEN gain >= 0.12 - 1e-5 OR bm25_rank IS NOT NULL OR vector_rank = 1 THEN gain ELSE 0.2 * gain END AS eff FROM boosted),
hits AS (
  SELECT id, round(greatest(0, least(1, 0.85 * base + 0.15 * eff / 0.35)), 6) AS score, bm25_rank, vector_rank
  FROM based ORDER BY score DESC, id LIMIT {limit})
{extra or 'SELECT * FROM hits'}"""


def _category_case(text: str) -> str:
    """CASE over the rule table; text is trimmed and lower-cased."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    whens = []
    for category, beginnings, parts in rules.CATEGORY_RULES:
        if parts is None:
            test = f"len(list_filter(regexp_split_to_array({text}, '\\s+'), lambda t: contains(t, '://') AND contains(t, '@') AND len(string_split(t, ':')) >= 3)) > 0"
        else:
            test = " OR ".join([f"starts_with({text}, {q(b)})" for b in beginnings] + [f"contains({text}, {q(p)})" for p in parts])
        whens.append(f"WHEN {test} THEN '{category}'")
    return "CASE " + " ".join(whens) + " ELSE 'fact' END"


def _lenient_case(text: str) -> str:
    whens = [f"WHEN {text} IN ('', {', '.join(map(repr, rules.NO_CATEGORY))}) THEN NULL", f"WHEN {text} IN ({', '.join(map(repr, CATEGORIES))}) THEN {text}"]
    for category, parts, whole in rules.SYNONYMS:
        whens.append("WHEN " + " OR ".join([f"contains({text}, '{p}')" for p in parts] + [f"{text} = '{w}'" for w in whole]) + f" THEN '{category}'")
    return "CASE " + " ".join(whens) + " END"


_KEYED = f"{MEM}, act AS (SELECT *, trim(content, {_BLANKS}) AS k FROM mem WHERE status = 'active')"
_MERGED = f"""{MEM}, act AS (
  SELECT *, trim(content, {_BLANKS}) AS k, row_number() OVER (PARTITION BY trim(content, {_BLANKS}) ORDER BY created_at, id) AS n FROM mem WHERE status = 'active'),
tag AS (SELECT k, n, unnest(tags) AS tag, generate_subscripts(tags, 1) AS p FROM act),
first_tag AS (SELECT k, lower(tag) AS low, min(n * 10 + p) AS pos, arg_min(tag, n * 10 + p) AS tag FROM tag GROUP BY k, lower(tag)),
tags AS (SELECT k, string_agg(tag, ',' ORDER BY pos) AS tags FROM first_tag GROUP BY k)"""
_CONFLICT = f"""{MEM}, raw AS (
  SELECT *, translate(trim(content, {_BLANKS}), '{_UP}', '{_LOW}') AS k FROM mem),
cls AS (
  SELECT k, arg_max(id, (created_at, id)) AS id, arg_min(content, (created_at, id)) AS content, max(created_at) AS created_at FROM raw GROUP BY k),
second AS (
  SELECT raw.k, max(raw.id) AS id FROM raw JOIN cls ON raw.k = cls.k AND raw.id <> cls.id GROUP BY raw.k),
tok AS (
  SELECT k, id, list_distinct(list_filter(list_transform(regexp_split_to_array(content, '[^\\p{{L}}\\p{{N}}_.\\-]+'), lambda w: lower(trim(w, '.-_'))),
    lambda w: strlen(w) > 1 AND NOT list_contains({_list(MEANING_STOP)}, w))) AS t FROM cls),
wt AS (SELECT *, list_filter(t, lambda w: regexp_matches(w, '\\p{{L}}')) AS w FROM tok),
ew AS (SELECT id, unnest(w) AS w FROM wt), et AS (SELECT id, unnest(t) AS t FROM wt),
inter AS (SELECT a.id AS a, b.id AS b, count(*) AS n FROM ew a JOIN ew b ON a.w = b.w AND a.id < b.id GROUP BY 1, 2),
pre AS (
  SELECT i.a, i.b, i.n / least(len(x.w), len(y.w)) AS lo, i.n / greatest(len(x.w), len(y.w)) AS hi, least(len(x.t), len(y.t)) AS mt
  FROM inter i JOIN wt x ON x.id = i.a JOIN wt y ON y.id = i.b),
hit AS (SELECT * FROM pre WHERE round(0.92 * lo, 6) >= 0.78 AND lo >= 0.55 AND hi >= 0.45),
pairs AS (
  SELECT hit.a, hit.b, round(0.92 * any_value(lo), 6) AS similarity, round(least(1.0, count(*) / any_value(mt)), 6) AS overlap_ratio
  FROM hit JOIN et x ON x.id = hit.a JOIN et y ON y.id = hit.b AND x.t = y.t GROUP BY hit.a, hit.b)"""
_NEAREST = f"""{_CONFLICT}, both_ways AS (
  SELECT a AS me, b AS other, similarity, overlap_ratio FROM pairs UNION ALL SELECT b, a, similarity, overlap_ratio FROM pairs
  UNION ALL SELECT cls.id, second.id, 1.0, 1.0 FROM cls JOIN second USING (k)),
best AS (SELECT * FROM both_ways QUALIFY row_number() OVER (PARTITION BY me ORDER BY similarity DESC, other DESC) = 1)
SELECT DISTINCT least(me, other) AS older_id, greatest(me, other) AS newer_id, similarity, overlap_ratio FROM best"""
_ACTIVE_EDGES = f"""{MEM}, {LINKS}, ok AS (
  SELECT l.* FROM links l JOIN mem a ON a.id = source_id AND a.status = 'active' JOIN mem b ON b.id = target_id AND b.status = 'active')"""
_VAULTS = f"""{MEM}, held AS (SELECT id, title FROM mem WHERE doc_id % 3 <> 0),
other AS (SELECT id, 'new ' || title AS title FROM mem WHERE doc_id % 3 <> 1)"""
_CARD = "'[' || upper(category) || '] ' || title || chr(10) || chr(10) || content || chr(10) || chr(10) || 'Tags: ' || lang || ', ' || source"

_EXPANDED = f""", {LINKS}, best AS (SELECT id AS hit, score FROM hits ORDER BY score DESC, id LIMIT 3),
edge AS (SELECT source_id AS hit, target_id AS id FROM links UNION ALL SELECT target_id, source_id FROM links),
more AS (SELECT edge.id, round(max(score) * 0.8, 6) AS score FROM edge JOIN best USING (hit) JOIN mem ON mem.id = edge.id AND status = 'active' {{}}
  WHERE edge.id NOT IN (SELECT id FROM hits) GROUP BY edge.id)
SELECT * FROM (SELECT id, score FROM hits UNION ALL SELECT * FROM more) ORDER BY score DESC, id LIMIT 12"""
_WITH_FILES = ", files AS (SELECT 'doc-' || lpad(CAST(page_id AS VARCHAR), 8, '0') AS memory_id FROM pages) SELECT id, score FROM hits WHERE id IN (SELECT memory_id FROM files) ORDER BY score DESC, id LIMIT 10"
_KHOP = f"""WITH RECURSIVE {MEM.removeprefix('WITH ')}, {LINKS}, ok AS (
  SELECT l.* FROM links l JOIN mem a ON a.id = source_id AND a.status = 'active' JOIN mem b ON b.id = target_id AND b.status = 'active'),
e AS (SELECT source_id AS x, target_id AS y FROM ok UNION SELECT target_id, source_id FROM ok),
walk(id, d) AS (SELECT id, 0 FROM mem WHERE doc_id % 100 = 0 AND status = 'active' UNION SELECT y, d + 1 FROM walk JOIN e ON x = walk.id WHERE d < 2),
near AS (SELECT DISTINCT id FROM walk), inside AS (SELECT * FROM links WHERE source_id IN (FROM near) AND target_id IN (FROM near))"""

_TOKENS = f"""list_distinct(list_filter(list_transform(regexp_split_to_array({{}}, '[^\\p{{{{L}}}}\\p{{{{N}}}}]+'), lambda w: lower(w)), lambda t: t <> '' AND (strlen(t) > 1 OR regexp_matches(t, '[0-9]')) AND NOT list_contains({_list(FUNCTION_WORDS)}, t)))"""

#: The distinct tags of a list of lists of tags, in any case the first spelling.
_FOLDED = "list_reduce(list_prepend(CAST([] AS VARCHAR[]), flatten(list_transform(flatten({}), lambda x: [[x]]))), lambda a, x: CASE WHEN list_contains(list_transform(a, lambda y: lower(y)), lower(x[1])) THEN a ELSE a || x END)"

SQL: dict[str, str] = {
    "recall_vector_topk": f"WITH {VEC} SELECT * FROM near WHERE similarity > 0 ORDER BY similarity DESC, id LIMIT 10",
    "recall_vector_filtered": f"{MEM}, {VEC} SELECT near.id, similarity FROM near JOIN mem USING (id) WHERE similarity > 0 AND category = 'decision' AND {FOUND.format('2024-01-31 06:00:00')} ORDER BY similarity DESC, near.id LIMIT 10",
    "recall_bm25_topk": f"{MEM}, {_bm25(LEXICAL_QUERY.split())} SELECT * FROM bm ORDER BY bm25 DESC, id LIMIT 20",
    "recall_bm25_pair_fallback": f"{MEM}, {_bm25(PAIR_QUERY.split())} SELECT * FROM bm ORDER BY bm25 DESC, id LIMIT 20",
    "lexical_postings": f"""{MEM}, t AS (SELECT id, unnest(regexp_split_to_array(lower(title || ' ' || content || ' ' || lang || ' ' || source), '[^\\p{{L}}\\p{{N}}]+')) AS term FROM mem)
SELECT term, count(DISTINCT id) AS df, count(*) AS cf FROM t WHERE term <> '' GROUP BY term""",
    "recall_hybrid": _recall(),
    "recall_as_of": _recall(FOUND.format("2024-01-31 06:00:00")),
    "recall_day": _recall("status = 'active' AND CAST(created_at AS DATE) = DATE '2024-01-01'"),
    "recall_min_similarity": _recall(min_similarity=0.1),
    "recall_category": _recall("status = 'active' AND category = 'decision'"),
    "recall_expanded": _recall(extra=_EXPANDED.format("")),
    "list_page": f"{MEM} SELECT id, category, created_at FROM mem WHERE status = 'active' ORDER BY created_at DESC, id LIMIT 20 OFFSET 20",
    "list_as_of": f"{MEM} SELECT id, status FROM mem WHERE created_at <= TIMESTAMP '2024-01-15 23:59:59' AND (expired_at IS NULL OR expired_at > TIMESTAMP '2024-01-15 23:59:59')",
    "search_as_of": f"{MEM} SELECT id, status FROM mem WHERE {FOUND.format('2024-01-15 23:59:59')}",
    "list_day": f"{MEM} SELECT id FROM mem WHERE CAST(created_at AS DATE) = DATE '2024-01-01'",
    "list_media": f"{MEM}, {FILES} SELECT id FROM mem WHERE status = 'active' AND id IN (SELECT memory_id FROM files)",
    "count_filtered": f"{MEM} SELECT count(*) AS n FROM mem WHERE category = 'decision' AND status = 'active'",
    "ttl_expire": f"""{MEM}, t AS (SELECT *, nullif(doc_id % 50, 0) * ([1, 1000, 60000, 3600000, 86400000, 604800000])[doc_id % 6 + 1] AS ttl_ms FROM mem)
SELECT id, CAST(ttl_ms AS BIGINT) AS ttl_ms, CASE WHEN created_at + to_milliseconds(ttl_ms) <= TIMESTAMP '2024-01-03' THEN 'expired' ELSE status END AS status FROM t""",
    "mime_detect": f"WITH {FILES} SELECT memory_id, 'text/html' AS mime_type, 'code' AS media_kind, CAST(NULL AS VARCHAR) AS dimensions FROM files",
    "model_answers": """WITH w AS (
  SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN nullif(regexp_extract(coalesce(text, ''), '(?:^| )([a-z]{5,})(?: |$)', 1), '') END AS answer FROM documents)
SELECT 'doc-' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS id, answer, CASE WHEN answer IS NOT NULL THEN 1 END AS memory_index,
  CASE WHEN answer IS NOT NULL THEN CAST(0.6 AS DOUBLE) END AS confidence FROM w""",
    "import_links": """WITH e AS (SELECT event_id % 5 AS turn, CAST(event_id AS VARCHAR) AS s, CAST(event_id - event_id % 3 AS VARCHAR) AS t, event_type AS k FROM events)
SELECT s AS source_id, t AS target_id, k AS relation, CAST(unnest([1.0, 0.25]) AS DOUBLE) AS weight FROM e WHERE turn = 0
UNION ALL SELECT s, t, k, 2.5 FROM e WHERE turn = 1 UNION ALL SELECT s, t, 'relates_to', 4.0 FROM e WHERE turn = 2""",
    "import_front_matter": f"""SELECT CAST(doc_id AS VARCHAR) AS path, 'd' || doc_id AS id, 'T ' || doc_id AS title, 'decision' AS category,
  CASE WHEN doc_id % 5 = 1 THEN '' ELSE array_to_string(list_filter([lang, source, 'last'], lambda x: x <> ''), ',') END AS tags, CAST(0.25 AS DOUBLE) AS confidence,
  coalesce(nullif(source, ''), 'imported:okf') AS provenance, CAST(epoch(TIMESTAMP '2024-03-01') AS BIGINT) AS "at", md5(trim(text, {_BLANKS})) AS content_md5
FROM documents WHERE doc_id % 5 <> 0 AND trim(coalesce(text, ''), {_BLANKS}) <> '' AND NOT contains(chr(10) || text, chr(10) || '### ')""",
    "import_sections": f"""SELECT CAST(doc_id AS VARCHAR) AS path, 'r' || doc_id AS id, 'decision' AS category, 'Of ' || doc_id AS title, md5(trim(text, {_BLANKS})) AS content_md5,
  array_to_string(list_filter([source, 'b'], lambda x: x <> ''), ',') AS tags, CAST(0.5 AS DOUBLE) AS confidence, CAST(epoch(TIMESTAMP '2024-03-01') AS BIGINT) AS "at"
FROM documents WHERE trim(coalesce(text, ''), {_BLANKS}) <> ''
UNION ALL SELECT CAST(doc_id AS VARCHAR), NULL, 'goal', 'Second', md5('- plain' || chr(10) || '  item ' || doc_id), array_to_string(list_filter(['a', source], lambda x: x <> ''), ','),
  0.25, CAST(epoch(TIMESTAMP '2024-01-02 03:04:05') AS BIGINT) FROM documents""",
    "attachment_decode": f"WITH {FILES} SELECT memory_id, filename, sha256, CAST(size_bytes AS INTEGER) AS size_bytes FROM files",
    "conversation_turns": f"""WITH c AS (SELECT conv_id || '/' || turn AS doc_id, turn % 3 AS shape, coalesce(role, 'user') AS role, coalesce(text, '') AS said FROM conversations),
p AS (SELECT doc_id, list_filter(list_transform(list_filter(list_transform(string_split('- ' || said, chr(10)), lambda x: trim(x, {_BLANKS})), lambda x: x <> ''),
  lambda x: regexp_replace(x, '^(- |\\* |• )', '')), lambda x: strlen(x) >= 10) AS l FROM c WHERE shape = 2)
SELECT doc_id, unnest([0, 1]) AS turn, role, md5(said) AS text_md5 FROM c WHERE shape = 0
UNION ALL SELECT doc_id, unnest([0, 1]), unnest([role, 'x']), md5(unnest([said, 'by x'])) FROM c WHERE shape = 1
UNION ALL SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER), NULL, md5(unnest(l)) FROM p""",
    "redacted_args": """SELECT event_id, 'memvault add --api-key [REDACTED] --openai-api-key=[REDACTED] --note "a \\"b\\" ' || event_type
  || '" --ollama-api-key [REDACTED] --tag=' || event_type || ' --token ' || event_id || ' "--x=y ' || event_type || '"' AS args FROM events""",
    "grounding_check": f"""{MEM}, said AS (
  SELECT id, content, array_to_string(list_slice(string_split(content, ' '), 2, 3), ' ') AS said,
    list_transform(regexp_split_to_array(content, '[^\\p{{L}}\\p{{N}}]+'), lambda w: lower(w)) AS w FROM mem)
SELECT id, regexp_matches(content, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])' || regexp_escape(said) || '(?:$|[^\\p{{L}}\\p{{N}}_])') AS grounded,
  CAST(len(list_distinct(list_filter(w, lambda t: t <> '' AND (strlen(t) > 1 OR regexp_matches(t, '[0-9]')) AND NOT list_contains({_list(FUNCTION_WORDS)}, t)))) AS INTEGER) AS n_tokens
FROM said""",
    "media_headers": """SELECT CAST(page_id AS BIGINT) AS page_id,
  (['image/jpeg', 'image/webp', 'video/mp4', 'audio/wav', 'image/gif'])[page_id % 5 + 1] AS mime_type,
  CASE WHEN page_id % 5 <> 3 THEN (page_id % 3000 + 1) || 'x' || (page_id % 2000 + 1) END AS dimensions,
  CASE WHEN page_id % 5 IN (2, 3) THEN CAST((page_id % 3000 + 1) / 2 AS DOUBLE) END AS seconds FROM pages""",
    "sha_base64": f"WITH {FILES} SELECT memory_id, sha256, size_bytes, md5(base64(encode(html))) AS base64_md5 FROM files",
    "media_breakdown": f"WITH {FILES} SELECT 'code' AS media_kind, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM files",
    "bundle_manifest": f"""{MEM}, {LINKS}, {FILES}
SELECT (SELECT count(*) FROM mem) AS records, (SELECT count(*) FROM mem WHERE status = 'active') AS active, (SELECT count(*) FROM files) AS files,
  (SELECT CAST(sum(size_bytes) AS BIGINT) FROM files) AS bytes, 'code=' || (SELECT count(*) FROM files) AS kinds, (SELECT count(*) FROM links) AS links""",
    "stats_overview": f"{MEM} SELECT count(*) AS total, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'expired') AS expired, (SELECT count(*) FROM embeddings) AS vectors FROM mem",
    "stats_by_category": f"{MEM} SELECT category, count(*) AS n FROM mem GROUP BY category",
    "vault_overview": f"{MEM} SELECT source AS scope, count(*) AS total, count(*) FILTER (status = 'active') AS active, max(created_at) AS last_update FROM mem GROUP BY source",
    "get_by_prefix": f"{MEM} SELECT id FROM mem WHERE starts_with(id, 'doc-0000012') ORDER BY id LIMIT 2",
    "get_by_title": f"""{MEM}, k AS (SELECT title AS t FROM mem WHERE doc_id = 5), r AS (
  SELECT id, title, CASE WHEN id = t THEN 0 WHEN starts_with(id, t) THEN 1 WHEN status = 'active' AND lower(title) = lower(t) THEN 2
    WHEN status = 'active' AND contains(lower(title), lower(t)) THEN 3 END AS rank FROM mem, k)
SELECT id, title FROM r WHERE rank = (SELECT min(rank) FROM r) ORDER BY id LIMIT 2""",
    "find_by_entity": f"{MEM} SELECT id FROM mem WHERE status = 'active' AND source = 'src3'",
    "find_by_sha": f"WITH {FILES} SELECT memory_id, filename FROM files WHERE sha256 = (SELECT sha256 FROM files WHERE memory_id = 'doc-00000003')",
    "hydrated": f"{MEM}, {FILES} SELECT id, sha256 AS hashes, 'lang=' || lang || ';source=' || source AS slots FROM mem LEFT JOIN files ON memory_id = id",
    "dedup_groups": f"{_KEYED} SELECT id, first_value(id) OVER (PARTITION BY k ORDER BY created_at, id) AS primary_id FROM act",
    "dedup_merged": f"""{_MERGED} SELECT arg_min(id, n) AS id, coalesce(arg_min(title, n) FILTER (title <> left(string_split(k, chr(10))[1], 80) AND NOT ends_with(title, '...')), arg_min(title, n)) AS title,
  any_value(tags.tags) AS tags, max(confidence) AS confidence, min(created_at) AS created_at, max(created_at) AS updated_at, count(*) AS n_merged
FROM act JOIN tags USING (k) GROUP BY k""",
    "ingest_merge": f"""{_KEYED} SELECT arg_min(id, (created_at, id)) AS id, max(confidence) AS confidence, min(created_at) AS created_at,
  CAST(count(*) FILTER (doc_id % 2 = 1) + bool_or(doc_id % 2 = 0)::INT AS BIGINT) AS n_merged FROM act GROUP BY k""",
    "rehomed_links": f"""{_KEYED}, {LINKS}, g AS (SELECT id, first_value(id) OVER (PARTITION BY k ORDER BY created_at, id) AS p FROM act),
m AS (SELECT coalesce(a.p, source_id) AS source_id, coalesce(b.p, target_id) AS target_id, relation, weight
  FROM links LEFT JOIN g a ON a.id = source_id LEFT JOIN g b ON b.id = target_id)
SELECT source_id, target_id, relation, max(weight) AS weight FROM m WHERE source_id <> target_id GROUP BY ALL""",
    "meaningful_tokens": f"""{MEM}, t AS (SELECT id, list_distinct(list_filter(list_transform(regexp_split_to_array(content, '[^\\p{{L}}\\p{{N}}_.\\-]+'), lambda w: lower(trim(w, '.-_'))),
    lambda w: strlen(w) > 1 AND NOT list_contains({_list(MEANING_STOP)}, w))) AS t FROM mem)
SELECT id, CAST(len(t) AS INTEGER) AS n_tokens, CAST(len(list_filter(t, lambda w: regexp_matches(w, '\\p{{L}}'))) AS INTEGER) AS n_words FROM t""",
    "conflicts_pairs": f"{_CONFLICT} SELECT * FROM pairs",
    "conflicts_nearest": _NEAREST,
    "conflicts_resolved": f"""WITH RECURSIVE {_NEAREST.removeprefix('WITH ').replace('SELECT DISTINCT least(me', ', near AS (SELECT DISTINCT least(me').replace('best AS (', 'best AS (', 1)}),
con AS (SELECT * FROM near UNION SELECT raw.id, cls.id, 1.0, 1.0 FROM raw JOIN cls USING (k) WHERE raw.id <> cls.id),
ord AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, older_id, newer_id) AS n FROM con),
walk(n, gone, kept) AS (
  SELECT 0::BIGINT, CAST([] AS VARCHAR[]), FALSE
  UNION ALL
  SELECT o.n, CASE WHEN list_contains(gone, older_id) OR list_contains(gone, newer_id) THEN gone ELSE list_append(gone, older_id) END,
    NOT (list_contains(gone, older_id) OR list_contains(gone, newer_id))
  FROM walk JOIN ord o ON o.n = walk.n + 1)
SELECT older_id, newer_id, similarity, overlap_ratio FROM walk JOIN ord USING (n) WHERE kept""",
    "links_all": f"WITH {LINKS} SELECT * FROM links",
    "graph_related": f"""WITH RECURSIVE {MEM.removeprefix('WITH ')}, {LINKS}, ok AS (
  SELECT l.* FROM links l JOIN mem a ON a.id = source_id AND a.status = 'active' JOIN mem b ON b.id = target_id AND b.status = 'active'),
e AS (SELECT source_id AS x, target_id AS y FROM ok UNION SELECT target_id, source_id FROM ok),
walk(start, id, d) AS (SELECT id, id, 0 FROM mem WHERE doc_id % 100 = 0 AND status = 'active'
  UNION SELECT start, y, d + 1 FROM walk JOIN e ON x = walk.id WHERE d < 3)
SELECT start, id, min(d) AS distance FROM walk GROUP BY start, id HAVING min(d) > 0""",
    "graph_related_paths": f"""WITH RECURSIVE {MEM.removeprefix('WITH ')}, {LINKS}, ok AS (
  SELECT l.* FROM links l JOIN mem a ON a.id = source_id AND a.status = 'active' JOIN mem b ON b.id = target_id AND b.status = 'active'),
e AS (
  SELECT source_id AS x, target_id AS y, relation AS label, weight, 0 AS back FROM ok
  UNION ALL SELECT target_id, source_id, relation || ' (incoming)', weight, 1 FROM ok),
far(start, id, d) AS (SELECT id, id, 0 FROM mem WHERE doc_id % 100 = 0 AND status = 'active' UNION SELECT start, y, d + 1 FROM far JOIN e ON x = far.id WHERE d < 2),
dist AS (SELECT start, id, min(d) AS d FROM far GROUP BY start, id),
walk(start, id, d, score, path, ord) AS (
  SELECT start, id, 0, 1.0::DOUBLE, CAST([] AS VARCHAR[]), '' FROM dist WHERE d = 0
  UNION ALL
  SELECT w.start, y, w.d + 1, score * weight / (w.d + 1), list_append(path, label), ord || '/' || back || ':' || label || ':' || y
  FROM walk w JOIN e ON x = w.id JOIN dist t ON t.start = w.start AND t.id = y AND t.d = w.d + 1
  QUALIFY row_number() OVER (PARTITION BY w.start, y ORDER BY ord || '/' || back || ':' || label || ':' || y) = 1)
SELECT start, id, d AS distance, round(score, 6) AS score, array_to_string(path, ' > ') AS path FROM walk WHERE d > 0""",
    "graph_snapshot": f"{_ACTIVE_EDGES} SELECT * FROM ok",
    "node_degree": f"{_ACTIVE_EDGES}, e AS (SELECT source_id AS id FROM ok UNION ALL SELECT target_id FROM ok) SELECT mem.id, count(e.id) AS degree FROM mem LEFT JOIN e USING (id) WHERE status = 'active' GROUP BY mem.id",
    "node_cards": f"{MEM} SELECT id, CASE WHEN title <> '' THEN title ELSE left(content, 30) END AS label, CASE WHEN length(content) > 140 THEN left(content, 140) || '...' ELSE content END AS snippet FROM mem",
    "link_upsert": f"WITH {LINKS} SELECT source_id, target_id, relation, CASE WHEN weight = 1 THEN 10.0 ELSE weight END::DOUBLE AS weight FROM links",
    "autolink_titles": f"""{MEM}, act AS (SELECT * FROM mem WHERE status = 'active'),
t AS (SELECT lower(trim(title, {_BLANKS})) AS t, min(id) AS target_id FROM act WHERE length(trim(title, {_BLANKS})) >= 4 GROUP BY 1),
p AS (SELECT act.id AS source_id, target_id, lower(content) AS c, t, strpos(lower(content), t) AS pos FROM act, t WHERE contains(lower(content), t) AND act.id <> target_id)
SELECT DISTINCT source_id, target_id FROM p WHERE (pos = 1 OR NOT regexp_matches(c[pos - 1], '[\\p{{L}}\\p{{N}}]')) AND NOT regexp_matches(c[pos + length(t)], '[\\p{{L}}\\p{{N}}]')
  AND regexp_matches(t, '[\\p{{L}}\\p{{N}}]')""",
    "autolink_tags": f"{MEM} SELECT id AS source_id, p AS target_id FROM (SELECT id, min(id) OVER (PARTITION BY lower(lang), lower(source)) AS p FROM mem WHERE status = 'active') WHERE id <> p",
    "autolink_semantic": f"""WITH {VEC}, pair AS (SELECT a.id AS a, b.id AS b, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6) AS s FROM vec a JOIN vec b ON a.id <> b.id)
SELECT a AS source_id, b AS target_id, round(s, 2) AS weight FROM pair WHERE s >= 0.35""",
    "wikilinks": f"{DECORATED} SELECT DISTINCT a.id AS source_id, b.id AS target_id FROM mem a JOIN mem b ON b.doc_id = a.doc_id * 7 % 1000 AND b.status = 'active' WHERE a.status = 'active' AND a.doc_id % 5 = 0 AND a.id <> b.id",
    "dangling_links": f"{MEM}, {LINKS}, ids AS (SELECT id FROM mem WHERE doc_id % 7 <> 0) SELECT source_id, target_id FROM links WHERE source_id NOT IN (FROM ids) OR target_id NOT IN (FROM ids)",
    "categorize": f"{DECORATED}, low AS (SELECT id, lower(trim(content, {_BLANKS})) AS t FROM mem) SELECT id, {_category_case('t')} AS category FROM low",
    "lenient_categories": f"SELECT event_id, {_lenient_case('lower(event_type)')} AS category FROM events",
    "answer_top1": _recall(extra="SELECT title AS answer, hits.id AS selected, score AS confidence, 'top1' AS engine FROM (SELECT * FROM hits ORDER BY score DESC, id LIMIT 1) hits JOIN mem USING (id) WHERE bm25_rank IS NOT NULL OR score >= 0.35"),
    "answer_gate": _recall(extra="SELECT id, score FROM hits WHERE bm25_rank IS NOT NULL OR score >= 0.35"),
    "answer_entity_index": _recall(extra=""", named AS (SELECT hits.id, score, doc_id % 7 AS kind, source, content, confidence FROM hits JOIN mem USING (id)),
alone AS (SELECT *, ' ' || trim(regexp_replace(lower(content), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' ' AS w FROM named),
n AS (SELECT a.kind, count(*) AS n FROM (SELECT DISTINCT kind FROM alone) a JOIN alone b ON a.kind = b.kind OR contains(b.w, ' kind ' || a.kind || ' ') GROUP BY a.kind)
SELECT 'kind-' || kind AS slot, source AS answer, id AS selected, greatest(confidence, 0.95) AS confidence FROM alone JOIN n USING (kind) WHERE n = 1 ORDER BY score DESC, id LIMIT 1"""),
    "answer_spans": f"""WITH t AS (
  SELECT 'of ' || conv_id AS question, turn AS place, conv_id || '/' || turn AS id, length(text) % 100 / 100 AS score, CAST(length(text) % 13 AS DOUBLE) AS margin,
    array_to_string(list_slice(string_split(text, ' '), 1, 2), ' ') AS span FROM conversations WHERE text IS NOT NULL),
k AS (SELECT *, {_TOKENS.format('span')} AS tok, {_TOKENS.format('question')} AS asked FROM t),
e AS (SELECT *, len(list_intersect(tok, asked)) AS echo, NOT contains(span, ' ') AND strlen(span) >= 6 AND regexp_matches(span, '[A-Za-z]') AND regexp_matches(span, '[0-9]') AS code FROM k),
ok AS (
  SELECT *, place = 0 AND margin >= 11 AS early, margin + score * 0.5 AS joint FROM e
  WHERE margin >= CASE WHEN code THEN 1.5 ELSE 4.5 END AND NOT regexp_matches(lower(span), 'not been |not recorded|not specified|not provided|x0000x|xxxx|\\*\\*\\*')
    AND NOT (len(tok) > 0 AND echo = len(tok)) AND NOT (margin < 10 AND echo > 0)),
r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY early DESC, joint DESC, place) AS n FROM ok)
SELECT question, span AS answer, id AS selected, round(greatest(0.05, least(0.99, 1 / (1 + exp(-(CASE WHEN early THEN margin ELSE joint END) / 5)))), 6) AS confidence FROM r WHERE n = 1""",
    "history_filter": f"WITH {HISTORY} SELECT id, subcommand, status, (SELECT count(*) FROM history) AS total FROM history WHERE status = 'error' ORDER BY id DESC LIMIT 50",
    "history_prune": f"WITH {HISTORY}, k AS (SELECT id FROM history ORDER BY id DESC LIMIT 700) SELECT count(*) AS kept, min(id) AS oldest FROM k",
    "history_latency": f"""WITH {HISTORY}, r AS (SELECT *, row_number() OVER (PARTITION BY subcommand ORDER BY duration_ms, id) - 1 AS r, count(*) OVER (PARTITION BY subcommand) AS n FROM history)
SELECT subcommand, max(duration_ms) FILTER (r = least(floor(n * 0.5), n - 1)) AS p50, max(duration_ms) FILTER (r = least(floor(n * 0.95), n - 1)) AS p95,
  max(duration_ms) FILTER (r = least(floor(n * 0.99), n - 1)) AS p99 FROM r GROUP BY subcommand""",
    "merge_vaults_skip": f"{_VAULTS} SELECT * FROM held UNION ALL SELECT * FROM other WHERE id NOT IN (SELECT id FROM held)",
    "merge_vaults_replace": f"{_VAULTS} SELECT * FROM other UNION ALL SELECT * FROM held WHERE id NOT IN (SELECT id FROM other)",
    "merge_vaults_links": f"""{_VAULTS}, {LINKS}, acc AS (SELECT id FROM other WHERE id NOT IN (SELECT id FROM held))
SELECT * FROM links WHERE weight = 1 OR (source_id IN (FROM acc) AND target_id IN (FROM acc))""",
    "hash_embedding": f"""{MEM}, card AS (SELECT id, lower({_CARD}) AS t FROM mem),
w AS (SELECT id, unnest(list_filter(regexp_split_to_array(t, '[\\s' || {_BLANKS} || ']+'), lambda x: x <> '')) AS w FROM card),
word AS (SELECT w, id, count(*) AS n FROM w GROUP BY ALL),
grams AS (
  SELECT DISTINCT w, w AS g, TRUE AS whole, 1 AS often FROM word
  UNION ALL SELECT w, g, FALSE, count(*) FROM (SELECT w, unnest(list_transform(range(1, length(w)), lambda i: w[i:i + 1])) AS g FROM (SELECT DISTINCT w FROM word)) GROUP BY w, g),
bytes AS (SELECT g, list_transform(range(1, strlen(g) + 1), lambda i: ('0x' || substr(hex(encode(g)), 2 * i - 1, 2))::INT::UHUGEINT) AS b FROM (SELECT DISTINCT g FROM grams)),
fnv AS (SELECT g, list_reduce(list_prepend(14695981039346656037::UHUGEINT, b), lambda h, c: (xor(h, c) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) AS h FROM bytes),
part AS (
  SELECT w, (h % 384)::INT AS i, sum(CASE WHEN NOT whole THEN 0.5 * often WHEN (h // 65536) % 2 = 1 THEN 1.0 ELSE -1.0 END)::DOUBLE AS x FROM grams JOIN fnv USING (g) GROUP BY ALL),
v AS (SELECT id, i, sum(n * x) AS x FROM word JOIN part USING (w) GROUP BY id, i)
SELECT id, 384 AS dims, 1.0::DOUBLE AS norm, CAST(count(*) FILTER (x <> 0) AS INTEGER) AS filled, round(sum(abs(x)) / sqrt(sum(x * x)), 2) AS amount FROM v GROUP BY id""",
    "card_texts": f"{MEM} SELECT id, md5({_CARD}) AS card_md5 FROM mem",
    "card_texts_whole": f"""{MEM}, {FILES} SELECT id, md5('[' || upper(category) || '] ' || title || chr(10) || chr(10) || content
  || coalesce(chr(10) || chr(10) || 'Attachments: ' || filename || ' (code, text/html, ' || size_bytes || ' bytes, sha256:' || left(sha256, 12) || ')', '')
  || chr(10) || chr(10) || 'Entities: lang: ' || lang || '; source: ' || source || chr(10) || chr(10) || 'Tags: ' || lang || ', ' || source) AS card_md5
FROM mem LEFT JOIN files ON memory_id = id""",
    "import_json": f"""WITH e AS (SELECT CAST(event_id AS VARCHAR) AS id, event_type AS kind, event_id % 4 AS turn, 'we decided on ' || event_type AS said FROM events)
SELECT id AS path, id,
  CASE turn WHEN 0 THEN coalesce({_lenient_case('lower(kind)')}, 'decision') WHEN 3 THEN 'relationship' ELSE 'decision' END AS category,
  CASE turn WHEN 1 THEN 'S ' || kind WHEN 2 THEN said || '; twice' WHEN 3 THEN kind || ' -> Y' ELSE said END AS title,
  CASE turn WHEN 2 THEN said || '; twice' WHEN 3 THEN kind || ' leads to Y' ELSE said END AS content,
  CASE turn WHEN 1 THEN 'a,' || kind WHEN 2 THEN lower(kind) ELSE '' END AS tags FROM e""",
    "export_markdown": f"""{MEM}, {LINKS}, act AS (SELECT *, CAST(list_position({_list(CATEGORIES)}, category) AS INTEGER) AS place FROM mem WHERE status = 'active')
SELECT place, category, id, md5('### ' || title || chr(10) || chr(10) || content || chr(10) || chr(10)) AS seen_md5 FROM act
UNION ALL SELECT DISTINCT place, category, '', md5('## ' || upper(category) || chr(10)) FROM act
UNION ALL SELECT 0, '', '', md5('---' || chr(10) || 'format: "memvault-markdown-v1"' || chr(10) || '---' || chr(10) || chr(10))
UNION ALL SELECT {len(CATEGORIES) + 1}, '', source_id || '/' || target_id || '/' || relation, md5('') FROM links""",
    "export_json_roundtrip": f"{MEM} SELECT id, category, trim(title, {_BLANKS}) AS title, md5(trim(content, {_BLANKS})) AS content_md5, lang || ',' || source AS tags FROM mem",
    "get_many": f"{MEM}, {LINKS} SELECT id, title FROM mem WHERE id IN (SELECT target_id FROM links WHERE weight = 1)",
    "restore_lookup": f"{MEM} SELECT id, status FROM mem WHERE id = 'doc-00000007'",
    "node_links": f"""{MEM}, {LINKS}, side AS (SELECT source_id AS node, target_id AS other, links.* FROM links UNION ALL SELECT target_id, source_id, links.* FROM links)
SELECT node, source_id, target_id, relation, weight FROM side JOIN mem a ON a.id = node LEFT JOIN mem b ON b.id = other
WHERE a.doc_id % 100 = 0 AND (a.status <> 'active' OR b.status = 'active')""",
    "links_restored": f"""{MEM}, {LINKS}, ok AS (SELECT source_id, target_id, 'relates_to' AS relation, weight * 3 AS weight FROM links
  WHERE CAST(source_id[5:] AS INTEGER) % 5 > 1 AND source_id IN (SELECT id FROM mem) AND target_id IN (SELECT id FROM mem))
SELECT * FROM ok UNION ALL SELECT * FROM links l WHERE NOT EXISTS (FROM ok WHERE ok.source_id = l.source_id AND ok.target_id = l.target_id)""",
    "graph_khop_nodes": f"{_KHOP} SELECT near.id, (SELECT count(*) FROM inside WHERE source_id = near.id) + (SELECT count(*) FROM inside WHERE target_id = near.id) AS degree FROM near",
    "graph_khop_edges": f"{_KHOP} SELECT source_id, target_id, weight FROM inside",
    "backlinks": f"""{MEM}, act AS (
  SELECT a.id, a.status, trim(translate(a.title, '{_UP}', '{_LOW}')) AS t, translate(a.content || ' [[' || trim(b.title) || ']]', '{_UP}', '{_LOW}') AS c
  FROM mem a LEFT JOIN mem b ON b.doc_id = a.doc_id * 7 % (SELECT count(*) FROM mem) WHERE a.status = 'active')
SELECT a.id AS source_id, b.id AS target_id FROM act a JOIN act b ON a.id <> b.id AND b.t <> '' AND contains(a.c, '[[' || b.t || ']]')""",
    "write_time_peers": f"""{MEM}, {VEC}, tok AS (
  SELECT id, doc_id, status, translate(trim(content, {_BLANKS}), '{_UP}', '{_LOW}') AS same,
    list_distinct(list_filter(list_transform(regexp_split_to_array(content, '[^\\p{{L}}\\p{{N}}_.\\-]+'), lambda w: lower(trim(w, '.-_'))),
    lambda w: strlen(w) > 1 AND NOT list_contains({_list(MEANING_STOP)}, w) AND regexp_matches(w, '\\p{{L}}'))) AS w FROM mem),
x AS (SELECT id, unnest(w) AS w FROM tok WHERE doc_id % 100 = 0), y AS (SELECT id, unnest(w) AS w FROM tok WHERE status = 'active'),
shared AS (SELECT x.id, y.id AS older_id, count(*) AS n FROM x JOIN y ON x.w = y.w AND y.id < x.id GROUP BY ALL),
sized AS (
  SELECT s.id, older_id, n / least(len(a.w), len(b.w)) AS lo, n / greatest(len(a.w), len(b.w)) AS hi, a.same = b.same AS same, c.e AS e1, d.e AS e2
  FROM shared s JOIN tok a ON a.id = s.id JOIN tok b ON b.id = older_id LEFT JOIN vec c ON c.id = s.id LEFT JOIN vec d ON d.id = older_id),
hit AS (
  SELECT id, older_id, round(CASE WHEN same THEN 1.0 ELSE greatest(0.92 * lo,
    coalesce(list_dot_product(e1, e2) / (sqrt(list_dot_product(e1, e1)) * sqrt(list_dot_product(e2, e2))), 0)) END::DOUBLE, 6) AS similarity
  FROM sized WHERE lo >= 0.55 AND hi >= 0.45)
SELECT id, older_id, similarity FROM hit WHERE similarity >= 0.72 QUALIFY row_number() OVER (PARTITION BY id ORDER BY similarity DESC, older_id) = 1""",
    "conflict_merged": f"""{MEM} SELECT n.id, CASE WHEN o.id IS NOT NULL AND trim(n.title, {_BLANKS}) = '' THEN o.title ELSE n.title END AS title,
  md5(CASE WHEN o.id IS NOT NULL AND trim(n.content, {_BLANKS}) = '' THEN o.content ELSE n.content END) AS content_md5,
  n.lang || ',' || n.source || CASE WHEN lower(o.lang) NOT IN (lower(n.lang), lower(n.source)) THEN ',' || o.lang ELSE '' END
    || CASE WHEN lower(o.source) NOT IN (lower(n.lang), lower(n.source)) THEN ',' || o.source ELSE '' END AS tags,
  greatest(n.confidence, coalesce(o.confidence, 0)) AS confidence, CASE WHEN n.doc_id % 2 = 0 AND n.doc_id + 1 IN (SELECT doc_id FROM mem) THEN 'expired' ELSE n.status END AS status
FROM mem n LEFT JOIN mem o ON n.doc_id % 2 = 1 AND o.doc_id = n.doc_id - 1""",
    "rehomed_entities": f"""{_KEYED}, g AS (SELECT id, first_value(id) OVER (PARTITION BY k ORDER BY created_at, id) AS p FROM act),
m AS (SELECT coalesce(p, mem.id) AS memory_id, lang, source FROM mem LEFT JOIN g ON g.id = mem.id)
SELECT memory_id, 'lang' AS entity_name, lang AS entity_val FROM m UNION SELECT memory_id, 'source', source FROM m""",
    "batch_files": f"WITH {FILES} SELECT memory_id, sha256, min(filename) AS filename, 'code' AS media_kind, 2 * count(*) AS copies, sha256 IN (SELECT sha256 FROM files WHERE CAST(memory_id[5:] AS INTEGER) % 2 = 0) AS known FROM files GROUP BY memory_id, sha256",
    "file_tags": f"""{MEM}, {FILES} SELECT DISTINCT id, lang || ',' || source || CASE WHEN memory_id IS NULL THEN '' ELSE
  (CASE WHEN 'code' IN (lower(lang), lower(source)) THEN '' ELSE ',code' END) || (CASE WHEN 'html' IN (lower(lang), lower(source)) THEN '' ELSE ',html' END) END AS tags FROM mem LEFT JOIN files ON memory_id = id""",
    "file_texts": f"{MEM}, {FILES}, f AS (SELECT memory_id, string_agg(filename || ' code text/html ' || sha256, ' ' ORDER BY filename) AS t FROM files GROUP BY memory_id) SELECT id, md5(t) AS text_md5 FROM mem LEFT JOIN f ON memory_id = id",
    "recall_expanded_as_of": _recall(FOUND.format("2024-01-31 06:00:00"), extra=_EXPANDED.format("AND created_at <= TIMESTAMP '2024-01-31 06:00:00' AND (expired_at IS NULL OR expired_at > TIMESTAMP '2024-01-31 06:00:00')")),
    "recall_media": _recall(limit=100, extra=_WITH_FILES),
    "recall_media_part": _recall(limit=100, extra=_WITH_FILES),
    "recall_precision": _recall(extra="SELECT id, CASE WHEN row_number() OVER (ORDER BY score DESC, id) = 1 AND (bm25_rank IS NOT NULL OR score >= 0.35) THEN 1.0 ELSE score END::DOUBLE AS score FROM hits"),
    "backup_roundtrip": f"{MEM} SELECT id, category, status, md5(content) AS content_md5, lang || ',' || source AS tags, confidence, created_at, expired_at FROM mem",
    "entity_json": f"""{MEM}, e AS (SELECT id, 'lang_code' AS entity_name, lang AS v FROM mem UNION ALL SELECT id, 'source', source FROM mem UNION ALL SELECT id, 'n', CAST(doc_id AS VARCHAR) FROM mem)
SELECT id, entity_name, v AS entity_val FROM e WHERE v <> '' AND lower(v) NOT IN (entity_name, replace(entity_name, '_', ' '))""",
    "markdown_roundtrip": f"""{MEM} SELECT id || '.md' AS path, id, category, title, md5(content) AS content_md5, lang || ',' || source AS tags, confidence, 'explicit_statement' AS provenance FROM mem WHERE status = 'active'""",
    "backup_children": f"""{MEM}, {LINKS}, {FILES}
SELECT 'entities' AS kind, id AS a, unnest(['lang', 'source']) AS b, unnest([lang, source]) AS c FROM mem
UNION ALL SELECT 'links', source_id, target_id, relation FROM links
UNION ALL SELECT 'attachments', memory_id, filename, sha256 FROM files JOIN mem ON id = memory_id""",
    "keyed_upsert": f"""{MEM}, m AS (
  SELECT doc_id, id, CASE WHEN doc_id % 2 = 0 THEN 'fact' ELSE 'goal' END AS category, title, content, trim(content, {_BLANKS}) AS k, tags, confidence, created_at, status,
    (title = left(string_split(trim(content, {_BLANKS}), chr(10))[1], 80) OR ends_with(title, '...')) AS auto FROM mem),
h0 AS (SELECT *, row_number() OVER (PARTITION BY category, k ORDER BY created_at, id) AS n FROM m WHERE doc_id % 3 = 0 AND status = 'active'),
h AS (  -- the held records: active ones merged, expired ones as they are
  SELECT f.id, category, coalesce(o.title, f.title) AS title, f.content, k, {_FOLDED.format('o.tt')} AS tags, o.confidence, o.created_at, 'active' AS status
  FROM (SELECT * FROM h0 WHERE n = 1) f JOIN (
    SELECT category, k, min_by(title, n) FILTER (NOT auto) AS title, max(confidence) AS confidence, min(created_at) AS created_at, list(tags ORDER BY n) AS tt FROM h0 GROUP BY category, k) o USING (category, k)
  UNION ALL SELECT id, category, title, content, k, tags, confidence, created_at, status FROM m WHERE doc_id % 3 = 0 AND status <> 'active'),
i0 AS (SELECT *, 'doc-' || lpad(CAST(doc_id - doc_id % 4 AS VARCHAR), 8, '0') AS new_id FROM m WHERE doc_id % 3 <> 0 AND k <> ''),
i AS (SELECT * EXCLUDE (id, new_id), new_id AS id, new_id IN (SELECT id FROM h) AS exact FROM (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY doc_id DESC) AS n FROM i0) WHERE n = 1),
r AS (
  SELECT category, k, id, k AS content, title, auto, tags, confidence, created_at, [0, -doc_id] AS o, CASE WHEN exact THEN [0, -doc_id] ELSE [2, doc_id] END AS g FROM i
  UNION ALL
  SELECT h.category, h.k, h.id, h.content, h.title, (h.title = left(string_split(h.k, chr(10))[1], 80) OR ends_with(h.title, '...')), h.tags, h.confidence, h.created_at,
    [1, epoch_us(h.created_at)], [1, epoch_us(h.created_at)]
  FROM h LEFT JOIN i USING (id) WHERE h.status = 'active' AND (i.id IS NULL OR (i.category = h.category AND i.k = h.k)) AND (h.category, h.k) IN (SELECT (category, k) FROM i)),
made AS (
  SELECT min_by(id, g) AS id, category, coalesce(min_by(title, o) FILTER (NOT auto), min_by(title, o)) AS title, 'active' AS status, max(confidence) AS confidence,
    md5(k) AS content_md5, list(tags ORDER BY o) AS t, min(created_at) AS created_at FROM r GROUP BY category, k)
SELECT id, category, title, status, confidence, 'explicit_statement' AS provenance, content_md5,
  array_to_string({_FOLDED.format('t')}, ',') AS tags,
  created_at FROM made
UNION ALL
SELECT h.id, h.category, h.title, h.status, h.confidence, 'explicit_statement', md5(h.k), array_to_string(h.tags, ','), h.created_at FROM h
WHERE h.id NOT IN (SELECT id FROM i) AND h.id NOT IN (SELECT id FROM r)""",
}
