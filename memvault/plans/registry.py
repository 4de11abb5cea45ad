"""The registered queries of the record store; their DuckDB twins are in oracles.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memvault.functions import media, modeltext, rules, text
from memvault.operators import answer, conflict, dedup, filters, fusion, graph, lexical, observe, stats, vectors
from memvault.plans import oracles
from memvault.sources import corpus, exporters, importers

Query = Callable[[SparkSession, str], DataFrame]

DAY = "2024-01-01"
LATER = "2024-01-31 06:00:00"


def _mem(spark: SparkSession, sf: str, rated: bool = True) -> DataFrame:
    return corpus.memories(spark, sf, rated=rated)


def _vector(spark: SparkSession, sf: str) -> list[float]:
    """The stored vector 0, as a query vector."""
    return corpus.table(spark, sf, "embeddings").where("vec_id = 0").select("embedding").first()[0]


def _request(spark: SparkSession, sf: str, query: str = oracles.HYBRID_QUERY, **more) -> fusion.Request:
    return fusion.Request(query=query, vector=_vector(spark, sf), **more)


def recall_vector_topk(spark, sf):
    return vectors.nearest(corpus.vectors(spark, sf), _vector(spark, sf), 10)


def recall_vector_filtered(spark, sf):
    seen = _mem(spark, sf).where((F.col("category") == "decision") & filters.found_as_of(LATER)).select("id")
    return vectors.nearest(corpus.vectors(spark, sf).join(seen, "id", "left_semi"), _vector(spark, sf), 10)


def recall_bm25_topk(spark, sf):
    return lexical.top(_mem(spark, sf), oracles.LEXICAL_QUERY, 20, F.col("status") == "active").select("id", "bm25")


def recall_bm25_pair_fallback(spark, sf):
    return lexical.top(_mem(spark, sf), oracles.PAIR_QUERY, 20, F.col("status") == "active").select("id", "bm25")


def lexical_postings(spark, sf):
    index = lexical.postings(_mem(spark, sf))
    return index.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def _hits(spark, sf, **more):
    return fusion.recall(_mem(spark, sf), corpus.vectors(spark, sf), _request(spark, sf, **more)).select("id", "score", "bm25_rank", "vector_rank")


def recall_hybrid(spark, sf):
    return _hits(spark, sf)


def recall_as_of(spark, sf):
    return _hits(spark, sf, as_of=LATER)


def recall_day(spark, sf):
    return _hits(spark, sf, day=DAY)


def recall_min_similarity(spark, sf):
    return _hits(spark, sf, min_similarity=0.1)


def recall_category(spark, sf):
    return _hits(spark, sf, category="decision")


def recall_expanded(spark, sf):
    return fusion.expanded(_hits(spark, sf), _mem(spark, sf), corpus.links(spark, sf), 12)


def list_page(spark, sf):
    return filters.page(filters.select(_mem(spark, sf), status="active"), 2, 20).select("id", "category", "created_at")


def list_as_of(spark, sf):
    return filters.select(_mem(spark, sf), as_of="2024-01-15", status="active").select("id", "status")


def search_as_of(spark, sf):
    return filters.select(_mem(spark, sf), as_of="2024-01-15", search=True).select("id", "status")


def list_day(spark, sf):
    return filters.select(_mem(spark, sf), day=DAY).select("id")


def list_media(spark, sf):
    files = _files(spark, sf)
    return filters.with_media(_mem(spark, sf).where("status = 'active'"), files, "all").select("id")


def count_filtered(spark, sf):
    return filters.select(_mem(spark, sf), category="decision", status="active").agg(F.count("*").alias("n"))


def ttl_expire(spark, sf):
    rows = _mem(spark, sf)
    ttl = text.ttl_ms(F.concat((F.col("doc_id") % 50).cast("string"), F.element_at(F.array(*map(F.lit, ("ms", "s", "m", "h", "d", "w"))), (F.col("doc_id") % 6 + 1).cast("int"))))
    due = rows.withColumn("ttl_ms", ttl)
    due = due.withColumn("expired_at", F.col("created_at") + F.make_dt_interval(secs=(F.col("ttl_ms") / 1000).cast("decimal(18,6)")))
    return filters.expire_due(due, "2024-01-03 00:00:00").select("id", "ttl_ms", "status")


def _files(spark, sf):
    found = corpus.attachments(spark, sf).withColumn("_d", media.detected(F.col("data"), F.col("filename")))
    return found.withColumn("mime_type", F.col("_d.mime")).withColumn("media_kind", F.col("_d.kind")).drop("_d")


def mime_detect(spark, sf):
    return _files(spark, sf).select("memory_id", "mime_type", "media_kind", media.dimensions(F.col("data"), F.col("mime_type")).alias("dimensions"))


def media_headers(spark, sf):
    files = corpus.media_files(spark, sf).withColumn("x", media.detected(F.col("data"), F.col("filename")))
    length = F.round(media.seconds(F.col("data"), F.col("x.mime")), 6)
    return files.select("page_id", F.col("x.mime").alias("mime_type"), media.dimensions(F.col("data"), F.col("x.mime")).alias("dimensions"), length.alias("seconds"))


def sha_base64(spark, sf):
    files = filters.verified(corpus.attachments(spark, sf))
    return files.select("memory_id", "sha256", "size_bytes", F.md5(F.regexp_replace(F.base64("data"), "\r\n", "")).alias("base64_md5"))


def media_breakdown(spark, sf):
    return stats.media_breakdown(_files(spark, sf))


def bundle_manifest(spark, sf):
    return exporters.manifest(_mem(spark, sf), _files(spark, sf), corpus.links(spark, sf))


def stats_overview(spark, sf):
    return stats.overview(_mem(spark, sf), corpus.vectors(spark, sf))


def stats_by_category(spark, sf):
    return stats.by_category(_mem(spark, sf))


def vault_overview(spark, sf):
    return stats.per_scope(_mem(spark, sf), F.element_at("tags", 2))


def get_by_prefix(spark, sf):
    return filters.by_id_or_prefix(_mem(spark, sf), "doc-0000012").select("id")


def get_by_title(spark, sf):
    rows = _mem(spark, sf)
    return filters.by_id_or_title(rows, rows.where("doc_id = 5").select("title").first()[0]).select("id", "title")


def find_by_entity(spark, sf):
    return filters.by_entity(_mem(spark, sf), corpus.entities(spark, sf), "SOURCE", "src3").select("id")


def find_by_sha(spark, sf):
    files = corpus.attachments(spark, sf)
    wanted = files.where("memory_id = 'doc-00000003'").select("sha256")
    return files.join(wanted, "sha256", "left_semi").select("memory_id", "filename")


def hydrated(spark, sf):
    rows = filters.hydrated(_mem(spark, sf), corpus.attachments(spark, sf), corpus.entities(spark, sf))
    slots = F.array_join(F.transform("entities", lambda e: F.concat_ws("=", e["entity_name"], e["entity_val"])), ";")
    return rows.select("id", F.array_join("attachment_hashes", ",").alias("hashes"), slots.alias("slots"))


def dedup_groups(spark, sf):
    return dedup.groups(_mem(spark, sf).withColumn("category", F.lit("fact")))


def dedup_merged(spark, sf):
    rows = dedup.merged(_mem(spark, sf).withColumn("category", F.lit("fact")))
    return rows.select("id", "title", F.array_join("tags", ",").alias("tags"), "confidence", "created_at", "updated_at", "n_merged")


def ingest_merge(spark, sf):
    """Odd documents arrive in a vault that holds the even ones."""
    rows = _mem(spark, sf).withColumn("category", F.lit("fact"))
    held = dedup.merged(rows.where("doc_id % 2 = 0")).withColumn("status", F.lit("active"))
    both = held.unionByName(rows.where("doc_id % 2 = 1").drop("doc_id"), allowMissingColumns=True)
    return dedup.merged(both).select("id", "confidence", "created_at", "n_merged")


def rehomed_links(spark, sf):
    groups = dedup.groups(_mem(spark, sf).withColumn("category", F.lit("fact")))
    return dedup.rehomed(corpus.links(spark, sf), groups)


def meaningful_tokens(spark, sf):
    tokens = text.meaningful_tokens(F.col("content"))
    return _mem(spark, sf).select("id", F.size(tokens).alias("n_tokens"), F.size(text.word_tokens(tokens)).alias("n_words"))


def conflicts_pairs(spark, sf):
    rows = conflict.content_pairs(_mem(spark, sf, rated=False), vectors=corpus.vectors(spark, sf))
    return rows.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b"), "similarity", F.round("overlap_ratio", 6).alias("overlap_ratio"))


def conflicts_nearest(spark, sf):
    return conflict.nearest(_mem(spark, sf, rated=False), vectors=corpus.vectors(spark, sf))


def conflicts_resolved(spark, sf):
    return conflict.resolved(conflict.conflicts(_mem(spark, sf, rated=False), vectors=corpus.vectors(spark, sf)))


def links_all(spark, sf):
    return corpus.links(spark, sf)


def graph_related(spark, sf):
    starts = _mem(spark, sf).where("doc_id % 100 = 0").select("id")
    return graph.related(_mem(spark, sf), corpus.links(spark, sf), starts, 3).select("start", "id", "distance")


def graph_related_paths(spark, sf):
    return graph.related(_mem(spark, sf), corpus.links(spark, sf), _mem(spark, sf).where("doc_id % 100 = 0").select("id"), 2)


def graph_snapshot(spark, sf):
    active = _mem(spark, sf).where("status = 'active'").select("id")
    return graph.snapshot_edges(corpus.links(spark, sf), active)


def node_degree(spark, sf):
    return graph.degrees(corpus.links(spark, sf), _mem(spark, sf).where("status = 'active'").select("id"))


def node_cards(spark, sf):
    return graph.cards(_mem(spark, sf))


def link_upsert(spark, sf):
    links = corpus.links(spark, sf)
    new = links.where("weight = 1.0").withColumn("weight", F.lit(99.0))
    return graph.add_links(links, new)


def autolink_titles(spark, sf):
    return graph.title_mentions(_mem(spark, sf, rated=False), generic=rules.GENERIC_TITLES)


def autolink_tags(spark, sf):
    return graph.shared_tags(_mem(spark, sf), rules.GENERIC_TAGS)


def autolink_semantic(spark, sf):
    return graph.semantic(corpus.vectors(spark, sf), 0.35)


def wikilinks(spark, sf):
    return graph.wiki_edges(corpus.memories(spark, sf, decorated=True))


def dangling_links(spark, sf):
    return exporters.dangling(_mem(spark, sf).where("doc_id % 7 <> 0"), corpus.links(spark, sf)).select("source_id", "target_id")


def categorize(spark, sf):
    rows = corpus.memories(spark, sf, decorated=True)
    return rows.select("id", rules.category_of(F.col("content")).alias("category"))


def lenient_categories(spark, sf):
    return corpus.table(spark, sf, "events").select("event_id", rules.lenient_category(F.col("event_type")).alias("category"))


def observe_conversations(spark, sf):
    turns = corpus.table(spark, sf, "conversations")
    said = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("We decided "), "text")).when(F.col("turn") % 3 == 1, F.concat(F.lit("I prefer "), "text")).otherwise(F.col("text"))
    found = observe.candidates(turns.withColumn("text", said))
    return found.select("conv_id", "turn", "place", "category", "title", "content", F.array_join("tags", ",").alias("tags"), "confidence")


def answer_top1(spark, sf):
    return answer.top_answer(_hits(spark, sf).join(_mem(spark, sf).select("id", "title"), "id"))


def answer_gate(spark, sf):
    return answer.gated(_hits(spark, sf)).select("id", "score")


def answer_entity_index(spark, sf):
    """Ten hits whose records have a slot named by doc_id % 7 each: names that two of them have don't answer."""
    rows = _mem(spark, sf)
    slots = rows.select(F.col("id").alias("memory_id"), F.concat(F.lit("Kind-"), F.col("doc_id") % 7).alias("entity_name"), F.element_at("tags", 2).alias("entity_val"))
    question = "what are " + ", ".join(f"kind {k}" for k in range(7)) + "?"
    return answer.entity_answer(_hits(spark, sf), slots, question, rows)


def answer_spans(spark, sf):
    """The first words of each conversation's turns as spans with margins that follow from their lengths."""
    turns = corpus.table(spark, sf, "conversations").where("text is not null")
    span = F.substring_index("text", " ", 2)
    rows = turns.select(
        F.concat(F.lit("of "), "conv_id").alias("question"), F.col("turn").cast("long").alias("place"), F.concat_ws("/", "conv_id", "turn").alias("id"),
        (F.char_length("text") % 100 / 100).alias("score"), span.alias("span"), (F.char_length("text") % 13).cast("double").alias("margin"),
    )
    return answer.span_answers(rows).select("question", "answer", "selected", F.round("confidence", 6).alias("confidence"))


def grounding_check(spark, sf):
    rows = _mem(spark, sf)
    said = F.concat_ws(" ", F.slice(F.split("content", " "), 2, 2))
    return rows.select("id", answer.grounded(said, F.col("content")).alias("grounded"), F.size(text.content_tokens(F.col("content"))).alias("n_tokens"))


def model_answers(spark, sf):
    """What a model might answer from each document: a word of it, nothing, a word that is not in it, or no JSON."""
    docs = corpus.table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("content"))
    word = F.regexp_extract("content", "(?:^| )([a-z]{5,})(?: |$)", 1)
    turn = F.col("doc_id") % 4
    said = F.when(turn == 0, word).when(turn == 1, "Not recorded").otherwise("zzqqzz")
    told = F.concat(F.lit("<think>{}</think> Here {it} is: "), F.to_json(F.struct(said.alias("answer"), (F.col("doc_id") % 8 / 4).cast("int").alias("memory_index"), F.lit(0.6).alias("confidence"))))
    memory = lambda title, content: F.struct(title.alias("title"), content.alias("content"))
    gated = F.array(memory(F.lit("-"), F.lit("-")), memory(F.lit("own"), F.col("content")))
    rows = docs.select(corpus.doc_key("doc_id").alias("id"), F.when(turn == 3, "no answer").otherwise(told).alias("raw"), gated.alias("gated"))
    return answer.model_answers(rows, "raw", "gated").select("id", "answer", "memory_index", "confidence")


def history_filter(spark, sf):
    return stats.history_page(corpus.history(spark, sf), status="failed", limit=50).select("id", "subcommand", "status", "total")


def history_prune(spark, sf):
    return stats.pruned(corpus.history(spark, sf), 700).agg(F.count("*").alias("kept"), F.min("id").alias("oldest"))


def history_latency(spark, sf):
    return stats.latency(corpus.history(spark, sf))


def _two_vaults(spark, sf):
    rows = _mem(spark, sf)
    held = rows.where("doc_id % 3 <> 0")
    other = rows.where("doc_id % 3 <> 1").withColumn("title", F.concat(F.lit("new "), "title"))
    return held, other


def merge_vaults_skip(spark, sf):
    held, other = _two_vaults(spark, sf)
    return dedup.merge_vaults(held, other, replace=False)[0].select("id", "title")


def merge_vaults_replace(spark, sf):
    held, other = _two_vaults(spark, sf)
    return dedup.merge_vaults(held, other, replace=True)[0].select("id", "title")


def merge_vaults_links(spark, sf):
    held, other = _two_vaults(spark, sf)
    links = corpus.links(spark, sf)
    accepted = dedup.merge_vaults(held, other, replace=False)[1]
    return dedup.accepted_links(links.where("weight = 1.0"), links, accepted)


def card_vectors(memories: DataFrame) -> DataFrame:
    """(id, embedding) of records' cards, whole contents included."""
    cards = memories.select("id", text.card_text(F.col("category"), F.col("title"), F.col("content"), F.col("tags")).alias("card"))
    return vectors.embedded(cards, vectors.HashEmbedder())


def hash_embedding(spark, sf):
    """Of each card's vector: its size, its norm, the places that are not zero, and the sum of their amounts."""
    found = card_vectors(_mem(spark, sf))
    filled = F.filter("embedding", lambda x: x != 0)
    amount = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.abs(x).cast("double"))
    norm = F.round(vectors.dot(F.col("embedding"), F.col("embedding")), 3)
    return found.select("id", F.size("embedding").alias("dims"), norm.alias("norm"), F.size(filled).alias("filled"), F.round(amount, 2).alias("amount"))


def card_texts(spark, sf):
    return _mem(spark, sf).select("id", F.md5(text.card_text(F.col("category"), F.col("title"), F.col("content"), F.col("tags"))).alias("card_md5"))


def card_texts_whole(spark, sf):
    """Cards with files and entities."""
    cards = vectors.cards(_mem(spark, sf), _files(spark, sf).withColumns({"dimensions": F.lit(None).cast("string"), "duration_secs": F.lit(None).cast("double")}), corpus.entities(spark, sf))
    return cards.select("id", F.md5("card").alias("card_md5"))


def import_json(spark, sf):
    """Events as foreign JSON lines."""
    events = corpus.table(spark, sf, "events")
    ident, kind = F.col("event_id").cast("string"), F.col("event_type")
    said = F.concat(F.lit("we decided on "), kind)
    shapes = (
        F.struct(ident.alias("uuid"), kind.alias("type"), F.struct(said.alias("body")).alias("payload")),
        F.struct(ident.alias("_id"), F.concat(F.lit("S "), kind).alias("summary"), said.alias("value"), F.lit("shadowed").alias("message"), F.concat(F.lit("a, "), kind).alias("categories")),
        F.struct(ident.alias("id"), F.upper(kind).alias("entityType"), F.array(said, F.lit(" twice ")).alias("observations")),
        F.struct(ident.alias("memory_id"), kind.alias("from"), F.lit("leads to").alias("relation_type"), F.lit("Y").alias("to")),
    )
    turn = F.pmod("event_id", F.lit(4))
    line = F.coalesce(*(F.when(turn == k, F.to_json(shape)) for k, shape in enumerate(shapes)))
    files = events.select(F.col("event_id").cast("string").alias("path"), line.alias("text"))
    return importers.json_candidates(importers.json_objects(files)).select("path", "id", "category", "title", "content", F.array_join("tags", ",").alias("tags"))


def import_links(spark, sf):
    """Each event as a file of links, in five shapes; two of them hold none that counts."""
    events = corpus.table(spark, sf, "events")
    one, two, kind = F.col("event_id").cast("string"), (F.col("event_id") - F.col("event_id") % 3).cast("string"), F.col("event_type")
    whole = F.struct(one.alias("source_id"), two.alias("target_id"), kind.alias("relation"), F.lit(0.25).alias("weight"), F.lit("2024-01-02T03:04:05Z").alias("created_at"))
    shapes = (
        F.struct(F.array(F.struct(one.alias("from"), two.alias("to"), kind.alias("relationType"))).alias("relations"), F.array(whole).alias("links")),
        F.struct(F.array(F.struct(one.alias("source"), two.alias("target"), kind.alias("relation_type"), F.lit("2.5").alias("weight"))).alias("relations")),
        F.struct(F.array(F.struct(F.struct(one.alias("source_id"), two.alias("target_id"), F.lit(4).alias("weight")).alias("meta"))).alias("relations"), F.array(whole.dropFields("created_at")).alias("links")),
        F.struct(one.alias("from"), two.alias("to"), kind.alias("relation")),
        F.struct(F.array(F.struct(one.alias("from"), F.lit(" ").alias("to"))).alias("relations")),
    )
    line = F.coalesce(*(F.when(F.col("event_id") % 5 == k, F.to_json(shape)) for k, shape in enumerate(shapes)))
    return importers.json_links(events.select(one.alias("path"), line.alias("text"))).select("source_id", "target_id", "relation", "weight")


def import_front_matter(spark, sf):
    """Each document as a Markdown file with a head; every fifth head names neither type nor title, others have their tags in brackets."""
    docs = corpus.table(spark, sf, "documents")
    turn, source = F.col("doc_id") % 5, F.coalesce("source", F.lit(""))
    named = F.when(turn == 0, "kind: Decision\n").otherwise(F.concat(F.lit('type: Decision\ntitle: "T '), "doc_id", F.lit('"\n')))
    tags = F.when(turn == 1, "tags: [a, b]\n").otherwise(F.concat(F.lit("tags:\n  - "), F.coalesce("lang", F.lit("")), F.lit("\n  - \""), source, F.lit('"\n- - last\n')))
    rest = F.concat(F.lit("id: 'd"), "doc_id", F.lit("'\nconfidence: 0.25\nconfidence: high\nprovenance: "), source, F.lit("\nat: 2024-03-01T00:00:00Z\n- no tag\n---\n"))
    files = docs.select(F.col("doc_id").cast("string").alias("path"), F.concat(F.lit("\n---\n"), named, tags, rest, F.coalesce("text", F.lit(""))).alias("text"))
    found = importers.front_matter(files)
    return found.select("path", "id", "title", "category", F.array_join("tags", ",").alias("tags"), "confidence", "provenance", F.unix_timestamp("created_at").alias("at"), F.md5("content").alias("content_md5"))


def import_sections(spark, sf):
    """Each document, whole, as a quotation in a Markdown file with two sections and lines that belong to no record."""
    docs = corpus.table(spark, sf, "documents")
    source, quoted = F.coalesce("source", F.lit("")), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n> "))
    one = F.concat(F.lit("# All\nlost\n\n## Decisions\n### Of "), "doc_id", F.lit("\n- **ID:** `r"), "doc_id", F.lit("`\n- **Tags:** `"), source, F.lit("`, , b\n- **Confidence:** 0.5\n- **Created:** 2024-03-01T00:00:00Z\n- **More:** x\n\n> "), quoted)
    two = F.concat(F.lit("\n>\n---\nlost\n## Goal\n- read me\n### \nlost\n### Second\n*Confidence: 0.25 | Status: active | Created: 2024-01-02T03:04:05 | Tags: `a`, `"), source, F.lit("`*\n- plain\n  item "), "doc_id", F.lit("\n"))
    found = importers.sectioned(docs.select(F.col("doc_id").cast("string").alias("path"), F.concat(one, two).alias("text")))
    return found.select("path", "id", "category", "title", F.md5("content").alias("content_md5"), F.array_join("tags", ",").alias("tags"), "confidence", F.unix_timestamp("created_at").alias("at"))


def attachment_decode(spark, sf):
    files = corpus.attachments(spark, sf).select("memory_id", "filename", "sha256", F.base64("data").alias("base64"))
    return importers.attachments(files).select("memory_id", "filename", "sha256", F.octet_length("data").alias("size_bytes"))


def conversation_turns(spark, sf):
    """Each turn as a JSON array, as JSON lines, or as plain lines; numbers, and texts on JSON lines, don't count as turns."""
    rows = corpus.table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("said"))
    one, two = F.to_json(F.struct("role", F.col("said").alias("content"))), F.to_json(F.struct(F.col("role").alias("speaker"), F.col("said").alias("text")))
    array = F.concat(F.lit(" ["), one, F.lit(", 5, "), two, F.lit(', {"content": 7}]'))
    shape = F.col("turn") % 3
    text = F.when(shape == 0, array).when(shape == 1, F.concat_ws("\n", two, one, F.lit('{"role": "x", "content": "by x"}'))).otherwise(F.concat(F.lit("- "), "said"))
    found = observe.turns_of_text(rows.select(F.concat_ws("/", "conv_id", "turn").alias("doc_id"), text.alias("text")))
    return found.select("doc_id", "turn", "role", F.md5("text").alias("text_md5"))


def redacted_args(spark, sf):
    events = corpus.table(spark, sf, "events")
    kind, ident = F.col("event_type"), F.col("event_id").cast("string")
    args = F.array(
        F.lit("memvault"), F.lit("add"), F.lit("--api-key"), F.concat(kind, F.lit(" two words")), F.concat(F.lit("--openai-api-key="), ident), F.lit("--note"),
        F.concat(F.lit('a "b" '), kind), F.lit("--ollama-api-key"), F.lit("--api-key"), F.concat(F.lit("--tag="), kind), F.lit("--token"), ident, F.concat(F.lit("--x=y "), kind),
    )
    return events.select("event_id", text.redacted(args).alias("args"))


def export_markdown(spark, sf):
    rows = exporters.markdown(_mem(spark, sf).drop("doc_id"), links=corpus.links(spark, sf))
    seen = F.substring_index("value", "<!-- record", 1)
    return rows.select("place", "category", "id", F.md5(F.when(F.col("place") == exporters.LINKS_PLACE, F.lit("")).otherwise(seen)).alias("seen_md5"))


def markdown_roundtrip(spark, sf):
    """Each block of an export as a file of its own, read back."""
    rows = exporters.markdown(_mem(spark, sf).drop("doc_id"), entities=corpus.entities(spark, sf)).where("id <> ''")
    files = rows.select(F.concat("id", F.lit(".md")).alias("path"), F.concat(F.lit(exporters.MARKDOWN_HEAD), "value").alias("text"))
    back = importers.candidates(files)
    return back.select("path", "id", "category", "title", F.md5("content").alias("content_md5"), F.array_join("tags", ",").alias("tags"), "confidence", "provenance")


def keyed_upsert(spark, sf):
    """Two thirds of the documents arrive in a vault that holds the others; pairs of them share an id, and some have the id of a held record."""
    rows = _mem(spark, sf).withColumn("category", F.when(F.col("doc_id") % 2 == 0, "fact").otherwise("goal"))
    new = F.col("doc_id") % 3 != 0
    held = dedup.merged(rows.where(~new)).withColumn("status", F.lit("active")).unionByName(rows.where(~new & (F.col("status") != "active")), allowMissingColumns=True)
    incoming = rows.where(new).withColumn("_four", F.col("doc_id") - F.col("doc_id") % 4)
    incoming = incoming.withColumns({"id": corpus.doc_key("_four"), "place": F.col("doc_id").cast("long"), "status": F.lit("active"), "content": text.trim(F.col("content"))}).where("content <> ''").drop("doc_id", "_four")
    records, _ = dedup.keyed_upsert(held.select(*[c for c in incoming.columns if c != "place"]), incoming)
    return records.select("id", "category", "title", "status", "confidence", "provenance", F.md5(text.trim(F.col("content"))).alias("content_md5"), F.array_join("tags", ",").alias("tags"), "created_at")


def export_json_roundtrip(spark, sf):
    lines = exporters.json_lines(_mem(spark, sf).select("id", "category", "title", "content", "tags"))
    files = lines.select(F.md5("value").alias("path"), F.col("value").alias("text"))
    back = importers.json_candidates(importers.json_objects(files))
    tags = F.when(F.forall("tags", lambda t: t.isNotNull()), F.array_join("tags", ","))
    return back.select("id", "category", "title", F.md5("content").alias("content_md5"), tags.alias("tags"))


def get_many(spark, sf):
    wanted = corpus.links(spark, sf).where("weight = 1.0").select(F.col("target_id").alias("id"))
    return filters.by_ids(_mem(spark, sf), wanted).select("id", "title")


def restore_lookup(spark, sf):
    return filters.for_restore(_mem(spark, sf), "doc-00000007").select("id", "status")


def node_links(spark, sf):
    return graph.links_of(_mem(spark, sf), corpus.links(spark, sf), _mem(spark, sf).where("doc_id % 100 = 0"))


def links_restored(spark, sf):
    """A backup of all links whose ends and relations are damaged in turn."""
    links = corpus.links(spark, sf)
    turn = F.substring("source_id", 5, 8).cast("int") % 5
    target = F.when(turn == 0, "doc-99999999").when(turn == 1, F.col("source_id")).otherwise(F.col("target_id"))
    relation = F.when(turn == 2, " ").otherwise(F.col("relation"))
    back = links.select("source_id", target.alias("target_id"), relation.alias("relation"), (F.col("weight") * 3).alias("weight"))
    return graph.restored(links, _mem(spark, sf), back)


def graph_khop_nodes(spark, sf):
    rows = _mem(spark, sf)
    return graph.neighbourhood(rows, corpus.links(spark, sf), rows.where("doc_id % 100 = 0"))[0]


def graph_khop_edges(spark, sf):
    rows = _mem(spark, sf)
    return graph.neighbourhood(rows, corpus.links(spark, sf), rows.where("doc_id % 100 = 0"))[1].select("source_id", "target_id", "weight")


def backlinks(spark, sf):
    """Each content ends in another record's title, in capitals, as a wikilink."""
    rows = _mem(spark, sf, rated=False)
    n = rows.agg(F.count("*").alias("_n"))
    titles = rows.select(F.col("doc_id").alias("_t"), F.concat(F.lit(" [["), F.translate(F.trim("title"), graph.LOWER, graph.UPPER), F.lit("]]")).alias("_link"))
    # what stands before a content's first brackets is in no link, so it stays where it is read
    open_ = F.expr("substr(content, nullif(instr(content, '[['), 0))")
    ends = rows.where("status = 'active'").select(F.col("id").alias("source_id"), "doc_id", F.coalesce(open_, F.lit("")).alias("_open"))
    named = ends.join(F.broadcast(n)).withColumn("_t", F.col("doc_id") * 7 % F.col("_n")).join(titles, "_t")  # one row
    return graph.backlinks(rows, named.select("source_id", F.concat("_open", "_link").alias("content")))


def write_time_peers(spark, sf):
    rows = _mem(spark, sf, rated=False).withColumn("category", F.lit("fact"))
    return conflict.peers(rows.where("doc_id % 100 = 0"), rows, vectors=corpus.vectors(spark, sf))


def conflict_merged(spark, sf):
    """Every record with an odd doc_id takes the one before it."""
    rows = _mem(spark, sf)
    pairs = rows.where("doc_id % 2 = 1").withColumn("_before", F.col("doc_id") - 1).select(corpus.doc_key("_before").alias("older_id"), F.col("id").alias("newer_id"))
    return conflict.merged_pairs(pairs, rows, LATER).select("id", "title", F.md5("content").alias("content_md5"), F.array_join("tags", ",").alias("tags"), "confidence", "status")


def rehomed_entities(spark, sf):
    groups = dedup.groups(_mem(spark, sf).withColumn("category", F.lit("fact")))
    return dedup.rehomed_children(corpus.entities(spark, sf), groups, ["entity_name", "entity_val"])


def batch_files(spark, sf):
    """Every file comes twice, under two names."""
    files = _files(spark, sf)
    held = files.where(F.substring("memory_id", 5, 8).cast("int") % 2 == 0)
    return dedup.batch_files(files.unionByName(files.withColumn("filename", F.concat(F.lit("x"), "filename"))), held)


def file_tags(spark, sf):
    return dedup.file_tags(_mem(spark, sf), _files(spark, sf)).select("id", F.array_join("tags", ",").alias("tags"))


def file_texts(spark, sf):
    files = _files(spark, sf).withColumn("dimensions", media.dimensions(F.col("data"), F.col("mime_type")))
    return lexical.file_texts(_mem(spark, sf), files).select("id", F.md5("file_text").alias("text_md5"))


def recall_expanded_as_of(spark, sf):
    return fusion.expanded(_hits(spark, sf, as_of=LATER), _mem(spark, sf), corpus.links(spark, sf), 12, as_of=LATER)


def recall_media(spark, sf):
    hits = _hits(spark, sf, limit=fusion.media_limit(10))
    return fusion.with_media(hits, _files(spark, sf), "text/html", 10).select("id", "score")


def recall_media_part(spark, sf):
    hits = _hits(spark, sf, limit=fusion.media_limit(10))
    return fusion.with_media(hits, _files(spark, sf), "HTM", 10, part_of_mime=True).select("id", "score")


def recall_precision(spark, sf):
    hits = _hits(spark, sf)
    selected = answer.top_answer(hits.join(_mem(spark, sf).select("id", "title"), "id")).select(F.col("selected").alias("id"))
    return fusion.selected_first(hits, selected).select("id", "score")


def backup_roundtrip(spark, sf):
    lines = exporters.backup(_mem(spark, sf).drop("doc_id"))
    back = importers.backup(lines.select(F.md5("value").alias("path"), F.col("value").alias("text")))
    return back.select("id", "category", "status", F.md5("content").alias("content_md5"), F.array_join("tags", ",").alias("tags"), "confidence", "created_at", "expired_at")


def backup_children(spark, sf):
    """What hangs on records, and links, read back from a backup."""
    files = _files(spark, sf).withColumns({"dimensions": F.lit(None).cast("string"), "duration_secs": F.lit(None).cast("double")})
    lines = exporters.backup(_mem(spark, sf).drop("doc_id"), files, corpus.entities(spark, sf), corpus.links(spark, sf).withColumn("created_at", F.lit(None).cast("timestamp_ntz")))
    parts = importers.backup_parts(lines.select(F.md5("value").alias("path"), F.col("value").alias("text")))
    kind = lambda name, *columns: parts[name].select(F.lit(name).alias("kind"), *[F.col(c).alias(n) for c, n in zip(columns, "abc", strict=True)])
    rows = kind("entities", "memory_id", "entity_name", "entity_val").unionByName(kind("links", "source_id", "target_id", "relation"))
    return rows.unionByName(kind("attachments", "memory_id", "filename", "sha256"))


def entity_json(spark, sf):
    """Entities of each document as a model might tell them."""
    docs = corpus.table(spark, sf, "documents")
    code = F.to_json(F.struct(F.lit("Lang Code").alias("name"), F.concat(F.lit(" "), "lang").alias("val")))
    source = F.to_json(F.struct(F.lit("source").alias("key"), F.col("source").alias("value")))
    same = F.lit('{"entity": "x y", "val": "X Y"}')
    number = F.to_json(F.struct(F.lit("n").alias("name"), F.col("doc_id").alias("val")))
    listed = F.concat(F.lit("<think>[1, 2]</think> [not json] Here: ["), F.concat_ws(", ", code, source, same, number, code), F.lit("] and ]"))
    return modeltext.entities_of(docs.select(corpus.doc_key("doc_id").alias("id"), listed.alias("raw")), "raw", "id")


def queries() -> dict[str, Query]:
    found = (
        recall_vector_topk, recall_vector_filtered, recall_bm25_topk, recall_bm25_pair_fallback, lexical_postings, recall_hybrid,
        recall_as_of, recall_day, recall_min_similarity, recall_category, recall_expanded, list_page, list_as_of, search_as_of, list_day,
        list_media, count_filtered, ttl_expire, mime_detect, media_headers, sha_base64, media_breakdown, bundle_manifest, stats_overview,
        stats_by_category, vault_overview, get_by_prefix, get_by_title, find_by_entity, find_by_sha, hydrated, dedup_groups, dedup_merged,
        ingest_merge, rehomed_links, meaningful_tokens, conflicts_pairs, conflicts_nearest, conflicts_resolved, links_all, graph_related,
        graph_related_paths, graph_snapshot, node_degree, node_cards, link_upsert, autolink_titles, autolink_tags, autolink_semantic,
        wikilinks, dangling_links, categorize, lenient_categories, observe_conversations, answer_top1, answer_gate,
        answer_entity_index, answer_spans, grounding_check, model_answers, history_filter, history_prune, history_latency, merge_vaults_skip,
        merge_vaults_replace, merge_vaults_links, hash_embedding, card_texts, card_texts_whole, import_json, import_links, import_front_matter, import_sections, attachment_decode, conversation_turns, redacted_args, export_markdown, export_json_roundtrip,
        get_many, restore_lookup, node_links, links_restored, graph_khop_nodes, graph_khop_edges, backlinks, write_time_peers, conflict_merged,
        rehomed_entities, keyed_upsert, markdown_roundtrip, batch_files, file_tags, file_texts, recall_expanded_as_of, recall_media, recall_media_part, recall_precision,
        backup_roundtrip, backup_children, entity_json,
    )
    return {q.__name__: q for q in found}


def oracle_sql() -> dict[str, str]:
    return oracles.SQL


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall_hybrid(spark, sf_dir)
