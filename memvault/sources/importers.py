"""Readers of foreign formats: lenient JSON, front-matter Markdown, sectioned Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memvault.functions import rules
from memvault.functions.text import BLANKS, title_of, trim
from memvault.schema import ATTACHMENTS, BACKUP_FORMAT, CATEGORIES, JSON_FORMAT, LINKS, MARKDOWN_FORMAT, MEMORIES

# fixed values: keys under which others keep contents, titles, categories, tags, ids and more, the first one first
CONTENT_KEYS = ("content", "memory", "text", "value", "document", "body", "message", "data", "statement")
TITLE_KEYS = ("title", "name", "summary", "heading", "subject")
CATEGORY_KEYS = ("category", "memory_type", "type", "kind", "type_name")
ENTITY_KEYS = ("entityType", "entity_type")
RELATION_KEYS = ("relationType", "relation_type")
TAG_KEYS = ("tags", "labels", "keywords", "categories")
ID_KEYS = ("id", "memory_id", "uuid", "_id")
PROVENANCE_KEYS = ("provenance", "source")
CREATED_KEYS = ("created_at", "timestamp", "date", "created")
CONFIDENCE_KEYS = ("confidence", "score", "weight")
# fixed values: keys whose strings are never taken as a content for want of another
NO_CONTENT = (*ID_KEYS, *TITLE_KEYS, *CATEGORY_KEYS, *ENTITY_KEYS, *RELATION_KEYS, *PROVENANCE_KEYS, *CREATED_KEYS)
# fixed values: keys that wrap an array of records; nested objects that are searched too
WRAPPERS = ("memories", "data", "items", "results", "documents", "records", "messages")
NESTED = ("metadata", "payload", "meta", "attributes", "info")
#: Bytes up to which another string of an object becomes a tag.
TAG_BYTES = 32


#: Marks a body that is an index of other files.
INDEX_MARK = " — OKF bundle"
#: What a record's provenance says if its Markdown doesn't.
MARKDOWN_PROVENANCE = "imported:okf"
#: Plurals that name a category in a heading.
PLURALS = {f"{c}s": c for c in CATEGORIES}
#: Lines of a file that may say its format.
FORMAT_LINES = 8


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of importable files under a folder, but for index.md and what lies in folders or files with a leading dot."""
    found = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    root = path.rstrip("/").rsplit("/", 1)[-1]
    below = F.element_at(F.split("path", rf"/\Q{root}\E/", 2), -1)
    name = F.element_at(F.split("path", "/"), -1)
    return found.where(name.rlike(r"(?i)\.(md|okf|json|jsonl)$") & ~below.rlike(r"(?:^|/)\.") & (name != "index.md"))


def candidates(files: DataFrame) -> DataFrame:
    """The records in files (path, text), told by their names: JSON, JSON lines, or one of the kinds of Markdown.

    (path, place, id, category, title, content, tags, confidence, provenance, created_at)
    """
    json = F.lower("path").rlike(r"\.jsonl?$")
    own = is_own_markdown(F.col("text"))
    marked = files.where(~json)
    told = own_records(marked.where(own)).select(
        "path", "place", "id", "category", "title", "content", "tags", "confidence", "provenance", F.col("created_at").cast("timestamp").alias("created_at")
    )
    plain = marked.where(~own)
    found = json_candidates(json_objects(files.where(json))).unionByName(told)
    return found.unionByName(front_matter(plain)).unionByName(sectioned(plain.where(~has_head(F.col("text")))))


def file_links(files: DataFrame) -> DataFrame:
    """(path, source_id, target_id, relation, weight) of the links in files (path, text)."""
    json = F.lower("path").rlike(r"\.jsonl?$")
    return json_links(files.where(json)).unionByName(own_links(files.where(~json)))


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"\r$", ""))


def _number(text: Column) -> Column:
    return F.when(trim(text).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), trim(text).cast("double"))


def _moment(text: Column) -> Column:
    """A time with its offset."""
    return F.when(text.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"), text.try_cast("timestamp"))


def json_objects(files: DataFrame) -> DataFrame:
    """(path, place, object): objects of an array, of a wrapper's array, of entities and relations, of one object, or of lines."""
    text = trim(F.col("text"))
    parsed = files.select("path", text.alias("text"), F.try_parse_json(text).alias("whole"))
    whole, array = F.col("whole"), "array<variant>"
    entities, relations = F.try_variant_get(whole, "$.entities", array), F.try_variant_get(whole, "$.relations", array)
    none = F.array().cast(array)
    graph = F.when(entities.isNotNull() | relations.isNotNull(), F.concat(F.coalesce(entities, none), F.coalesce(relations, none)))
    tries = [F.try_variant_get(whole, "$", array), graph, *(F.try_variant_get(whole, f"$.{w}", array) for w in WRAPPERS)]
    tries.append(F.when(whole.isNotNull() & F.col("text").startswith("{"), F.array(whole)))
    wrong = lambda i: F.raise_error(F.concat(F.lit("Invalid JSON at line "), (i + 1).cast("string"), F.lit(" of "), F.col("path"))).cast("variant")
    read = lambda x, i: F.when(trim(x) != "", F.coalesce(F.try_parse_json(x), wrong(i)))
    lines = F.filter(F.transform(F.split("text", r"\r?\n"), read), lambda v: v.isNotNull())
    # the parser stops after a first object, so objects on lines of their own are told by the first line
    first = F.substring_index("text", "\n", 1)
    by_line = whole.isNull() | ((first != F.col("text")) & first.startswith("{") & F.try_parse_json(first).isNotNull())
    found = F.when(by_line, lines).otherwise(F.coalesce(*tries))
    return parsed.select("path", F.posexplode(found).alias("place", "object"))


_ENTRIES = "map<string, variant>"


def _texts(entries: Column) -> Column:
    """The filled strings, numbers and booleans of an object's entries, by their keys."""
    plain = lambda v: ~F.schema_of_variant(v).rlike("^(OBJECT|ARRAY)")
    text = lambda v: F.when(plain(v), F.nullif(trim(F.try_variant_get(v, "$", "string")), F.lit("")))
    return F.transform_values(entries, lambda _, v: text(v))


def _settled(rows: DataFrame) -> DataFrame:
    """rows, whose columns are worked out once: no later filter or column is merged into their expressions."""
    return rows.select(F.inline(F.array(F.struct("*"))))


def _opened(objects: DataFrame) -> DataFrame:
    """objects with the texts of each object (own) and of its nested objects in order (nested), taken apart once for all keys."""
    read = objects.withColumn("entries", F.try_variant_get("object", "$", _ENTRIES))
    there = F.filter(F.array(*map(F.lit, NESTED)), lambda n: F.map_contains_key("entries", n))
    inner = F.transform(there, lambda n: _texts(F.try_variant_get(F.element_at("entries", n), "$", _ENTRIES)))
    return _settled(_settled(read).withColumn("own", _texts(F.col("entries"))).withColumn("nested", F.when(F.size(there) > 0, inner)))


def _field(keys: tuple[str, ...]) -> Column:
    """The first of keys that holds a filled string, a number or a boolean, here or in a nested object (of _opened)."""
    listed = F.split(F.lit(" ".join(keys)), " ")
    first = lambda texts: F.get(F.filter(texts, lambda x: x.isNotNull()), F.lit(0))
    each = lambda m: F.transform(listed, lambda k: F.try_element_at(m, k))
    inner = F.flatten(F.transform(F.filter("nested", lambda m: m.isNotNull()), each))
    return F.coalesce(first(each(F.col("own"))), F.when(F.col("nested").isNotNull(), first(inner)))


def _strings(obj: Column, path: str) -> Column:
    """The strings of the array at a path; null if there is none."""
    listed = F.filter(F.try_variant_get(obj, path, "array<variant>"), lambda v: F.schema_of_variant(v) == "STRING")
    return F.transform(listed, lambda v: F.variant_get(v, "$", "string"))


def _tags(obj: Column, path: str) -> Column:
    """The strings of an array, or the parts of a string; empty if there is neither."""
    is_text = F.schema_of_variant(F.try_variant_get(obj, path, "variant")) == "STRING"
    parts = F.filter(F.transform(F.split(F.try_variant_get(obj, path, "string"), ","), trim), lambda x: x != "")
    return F.coalesce(_strings(obj, path), F.when(is_text, parts), F.array().cast("array<string>"))


def _longest(obj: Column) -> Column:
    """(content, tags): the longest string of an object under no key of NO_CONTENT, the first one of equals; others that are short."""
    entries = F.map_entries(F.try_variant_get(obj, "$", "map<string, variant>"))
    own = F.filter(entries, lambda e: ~e["key"].isin(*NO_CONTENT) & (F.schema_of_variant(e["value"]) == "STRING"))
    named = F.transform(own, lambda e: F.struct(e["key"].alias("key"), trim(F.variant_get(e["value"], "$", "string")).alias("v")))
    filled = F.array_sort(F.filter(named, lambda e: e["v"] != ""))
    best = F.array_max(F.transform(filled, lambda e, i: F.struct(F.octet_length(e["v"]).alias("n"), (-i).alias("i"))))
    short = F.filter(filled, lambda e, i: (i != -best["i"]) & (F.octet_length(e["v"]) <= TAG_BYTES))
    return F.struct(F.get(filled, -best["i"])["v"].alias("content"), F.transform(short, lambda e: F.lower(e["v"])).alias("tags"))


def json_candidates(objects: DataFrame) -> DataFrame:
    """(path, place, id, category, title, content, tags, confidence, provenance, created_at) of objects that hold any text.

    A content is the first filled of its keys, else the observations, else what a relation says, else the longest other string.
    Lines of exporters.json_lines are told by their format: their titles, contents and tags are kept, blank ones too.
    created_at is null unless it is a time with its offset.
    """
    obj, blank = F.col("object"), F.array().cast("array<string>")
    observed = F.filter(F.transform(F.when(F.map_contains_key("entries", "observations"), _strings(obj, "$.observations")), trim), lambda x: x != "")
    start, end, relation = _field(("from",)), _field(("to",)), _field(RELATION_KEYS)
    kept = F.element_at("own", "format").eqNullSafe(JSON_FORMAT)
    said = lambda key: F.when(kept & F.map_contains_key("entries", key), F.coalesce(F.element_at("own", key), F.lit("")))
    found = _opened(objects).select(
        "path",
        "place",
        _field(ID_KEYS).alias("id"),
        F.coalesce(said("title"), _field(TITLE_KEYS)).alias("t"),
        _field(CATEGORY_KEYS).alias("kind"),
        F.coalesce(said("content"), _field(CONTENT_KEYS)).alias("plain"),
        F.when(F.size(observed) > 0, F.array_join(observed, "; ")).alias("observed"),
        F.lower(_field(ENTITY_KEYS)).alias("entity"),
        F.concat(start, F.lit(" "), relation, F.lit(" "), end).alias("related"),
        F.concat(start, F.lit(" -> "), end).alias("ends"),
        "object",
        F.coalesce(
            F.when(kept, F.try_variant_get(obj, "$.tags", "array<string>")),
            F.concat(*[F.when(F.map_contains_key("entries", k), _tags(obj, f"$.{k}")).otherwise(blank) for k in TAG_KEYS]),
        ).alias("tags"),
        F.when(F.map_contains_key("entries", "metadata"), _tags(obj, "$.metadata.tags")).otherwise(blank).alias("more_tags"),
        F.coalesce(_field(CONFIDENCE_KEYS).try_cast("double"), F.lit(0.9)).alias("confidence"),
        F.coalesce(_field(PROVENANCE_KEYS), F.lit("imported")).alias("provenance"),
        _field(CREATED_KEYS).alias("made"),
    )
    found = _settled(found)
    found = found.withColumn("longest", F.when(F.coalesce("plain", "observed", "related").isNull(), _longest(obj))).drop("object")
    found = _settled(found)
    by_observation, by_relation = F.col("plain").isNull() & F.col("observed").isNotNull(), F.coalesce("plain", "observed").isNull() & F.col("related").isNotNull()
    content = F.coalesce("plain", "observed", "related", "longest.content")
    guessed = F.when(by_observation & F.col("entity").isNotNull(), F.array("entity")).when(F.coalesce("plain", "observed", "related").isNull(), F.col("longest.tags")).otherwise(blank)
    made = _moment(F.col("made"))
    return found.where(content.isNotNull()).select(
        "path",
        "place",
        "id",
        F.coalesce(rules.lenient_category(F.col("kind")), F.when(by_relation, "relationship"), rules.category_of(content)).alias("category"),
        F.coalesce("t", F.when(by_relation, F.col("ends")), title_of(content)).alias("title"),
        content.alias("content"),
        F.when(F.size("tags") > 0, F.col("tags")).when(F.size("more_tags") > 0, F.col("more_tags")).otherwise(guessed).alias("tags"),
        "confidence",
        "provenance",
        made.alias("created_at"),
    )


def _envelopes(files: DataFrame, name: str) -> DataFrame:
    """(b): the envelopes in files (path, text), one each; any other format fails with the path."""
    children = f"attachments array<struct<{ATTACHMENTS.removeprefix('memory_id string, ').removesuffix('data binary')} base64 string>>, entities array<struct<entity_name string, entity_val string>>"
    read = files.select("path", F.from_json("text", f"format string, memories array<struct<{MEMORIES}, {children}>>, links array<struct<{LINKS}>>").alias("b"))
    known = F.when(F.coalesce(F.col("b.format"), F.lit("")) != name, F.raise_error(F.concat(F.lit("unsupported backup format in "), "path")))
    known = known.when(F.col("b.memories").isNull(), F.raise_error(F.concat(F.lit("backup without memories: "), "path"))).otherwise(True)
    return read.where(known).select("b")


def backup(files: DataFrame, name: str = BACKUP_FORMAT) -> DataFrame:
    """The records in files (path, text) that each hold one envelope {format, memories}; any other format fails with the path."""
    rows = _envelopes(files, name).select(F.explode("b.memories").alias("m")).select("m.*")
    return rows.drop("attachments", "entities")


def backup_parts(files: DataFrame, name: str = BACKUP_FORMAT) -> dict[str, DataFrame]:
    """The tables in the envelopes of exporters.backup: memories, attachments, whose bytes must agree with their hashes, entities and links."""
    read = _envelopes(files, name)
    rows = read.select(F.explode("b.memories").alias("m"))
    said = rows.select(F.col("m.id").alias("memory_id"), F.explode("m.attachments").alias("a")).select("memory_id", "a.*").withColumn("data", F.unbase64("base64"))
    whole = F.when(F.sha2("data", 256) == F.lower("sha256"), True).otherwise(F.raise_error(F.concat(F.lit("damaged attachment "), "filename")))
    return {
        "memories": rows.select("m.*").drop("attachments", "entities"),
        "attachments": said.where(whole).drop("base64"),
        "entities": rows.select(F.col("m.id").alias("memory_id"), F.explode("m.entities").alias("e")).select("memory_id", "e.*"),
        "links": read.select(F.explode("b.links").alias("l")).select("l.*"),
    }


def json_links(files: DataFrame) -> DataFrame:
    """(path, source_id, target_id, relation, weight) of the links in files (path, text) that are one JSON object.

    links counts only if each of its items is a whole link: two ends, relation, weight and created_at. Of relations, each item
    with two ends counts; its relation is relates_to and its weight 1 unless it says so.
    """
    whole = F.try_parse_json("text")
    parsed = files.select("path", F.try_variant_get(whole, "$.links", "array<variant>").alias("links"), F.try_variant_get(whole, "$.relations", "array<variant>").alias("relations"))
    is_text = lambda v, k: F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")) == "STRING", F.lit(False))
    text = lambda v, k: F.try_variant_get(v, f"$.{k}", "string")
    number = lambda v, k: F.when(~F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")).isin("STRING", "BOOLEAN"), F.try_variant_get(v, f"$.{k}", "double"))
    full = lambda v: is_text(v, "source_id") & is_text(v, "target_id") & is_text(v, "relation") & number(v, "weight").isNotNull() & _moment(text(v, "created_at")).isNotNull()
    links = F.transform(
        F.when(F.forall("links", full), F.col("links")),
        lambda v: F.struct(text(v, "source_id").alias("source_id"), text(v, "target_id").alias("target_id"), text(v, "relation").alias("relation"), number(v, "weight").alias("weight")),
    )
    related = _opened(parsed.select("path", F.explode("relations").alias("object"))).select(
        "path",
        _field(("from", "source", "source_id")).alias("source_id"),
        _field(("to", "target", "target_id")).alias("target_id"),
        F.coalesce(_field((*RELATION_KEYS, "relation")), F.lit("relates_to")).alias("relation"),
        F.coalesce(_number(_field(("weight",))), F.lit(1.0)).alias("weight"),
    )
    rows = parsed.select("path", F.explode(links).alias("l")).select("path", "l.*").unionByName(related)
    return rows.where("source_id is not null and target_id is not null")


def _head(text: Column) -> tuple[Column, Column]:
    """What stands between a first --- and the next line that begins so, and what follows; null without these."""
    after = F.substring(F.ltrim(text, F.lit(BLANKS)), 4, 1 << 30)
    end = F.instr(after, "\n---")
    there = F.ltrim(text, F.lit(BLANKS)).startswith("---") & (end > 0)
    return F.when(there, F.substring(after, F.lit(1), end - 1)), F.when(there, trim(F.substring(after, end + 4, F.lit(1 << 30))))


def _unquoted(text: Column) -> Column:
    return F.btrim(F.btrim(trim(text), F.lit("'")), F.lit('"'))


def _facts(head: Column) -> Column:
    """What the lines of a head say: (in_tags, type, title, id, confidence, provenance, at, tags); a later line overrides an earlier one."""
    none = F.lit(None)
    start = F.struct(
        F.lit(False).alias("in_tags"), *[none.cast("string").alias(k) for k in ("type", "title", "id")], F.lit(0.9).alias("confidence"),
        F.lit(MARKDOWN_PROVENANCE).alias("provenance"), none.cast("timestamp").alias("at"), F.array().cast("array<string>").alias("tags"),
    )

    def step(s: Column, line: Column) -> Column:
        t = trim(line)
        item = s["in_tags"] & t.startswith("- ")
        tag = _unquoted(F.regexp_replace(t, "^(?:- )+", ""))
        said = lambda key: F.when(~item & t.startswith(f"{key}:"), F.substring(t, len(key) + 2, 1 << 30))
        goes_on = item | ((line.startswith(" ") | line.startswith("-")) & s["in_tags"])
        return F.struct(
            (goes_on | (t == "tags:")).alias("in_tags"),
            *[F.coalesce(_unquoted(said(k)), s[k]).alias(k) for k in ("type", "title", "id")],
            F.coalesce(_number(said("confidence")), s["confidence"]).alias("confidence"),
            F.coalesce(F.nullif(_unquoted(said("provenance")), F.lit("")), s["provenance"]).alias("provenance"),
            F.coalesce(_moment(_unquoted(said("at"))), s["at"]).alias("at"),
            F.when(item & (tag != ""), F.concat(s["tags"], F.array(tag))).otherwise(s["tags"]).alias("tags"),
        )

    return F.aggregate(_lines(head), start, step)


def has_head(text: Column) -> Column:
    """Whether a Markdown file is one record with a head that names its type or title, and a body."""
    head, body = _head(text)
    facts = _facts(head)
    index = body.startswith("# ") & body.contains(INDEX_MARK)
    return F.coalesce(~text.contains("\n### ") & (body != "") & ~index & (facts["type"].isNotNull() | facts["title"].isNotNull()), F.lit(False))


def front_matter(files: DataFrame) -> DataFrame:
    """The records of Markdown files (path, text) with a head, as in candidates().

    Block lists under tags: give the tags; unlike lists in brackets, which don't count.
    """
    head, body = _head(F.col("text"))
    rows = files.where(has_head(F.col("text"))).select("path", body.alias("content"), _facts(head).alias("h"))
    return rows.select(
        "path",
        F.lit(0).alias("place"),
        "h.id",
        F.coalesce(rules.lenient_category(F.col("h.type")), rules.category_of(F.col("content"))).alias("category"),
        F.coalesce("h.title", title_of(F.col("content"))).alias("title"),
        "content",
        "h.tags",
        "h.confidence",
        "h.provenance",
        F.col("h.at").alias("created_at"),
    )


def sectioned(files: DataFrame) -> DataFrame:
    """The records of Markdown files (path, text) with ## categories and ### titles, as in candidates().

    A record's text goes on to the next heading or ---; without a title before it, text belongs to no record. Lines that begin with - ** hold
    its id, tags, confidence and time of creation, as a last line in asterisks may; marks of quotations are taken off.
    """
    lines = files.select("path", F.posexplode(_lines(F.col("text"))).alias("n", "line")).withColumn("t", trim(F.col("line")))
    t = F.col("t")
    heading, name = t.startswith("## "), t.startswith("### ")
    ends = heading | name | (t == "---")
    by = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)  # one file's lines
    kind = F.lower(trim(F.substring(t, 4, 1 << 30)))
    plural = F.lit(None).cast("string")
    for word, category in PLURALS.items():
        plural = F.when(kind == word, category).otherwise(plural)
    rows = lines.withColumn("category", F.last(F.when(heading, F.coalesce(plural, rules.lenient_category(kind), F.lit("fact"))), True).over(by))
    rows = rows.withColumn("card", F.last(F.when(ends, F.struct("n", F.when(name, F.nullif(trim(F.substring(t, 5, 1 << 30)), F.lit(""))).alias("title"))), True).over(by))
    bare = F.regexp_replace(t, "`", "")
    after = lambda x, mark: F.when(x.startswith(mark), trim(F.substring(x, len(mark) + 1, 1 << 30)))
    footer = t.startswith("*Confidence:") & t.endswith("*")
    parts = F.when(footer, F.transform(F.split(F.btrim(bare, F.lit("*")), r"\|"), trim))
    of_footer = lambda mark: F.try_element_at(F.filter(F.transform(parts, lambda x: after(x, mark)), lambda x: x.isNotNull()), F.lit(-1))
    local = lambda x: F.when(x.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d$"), F.concat(x, F.lit("+00:00")).try_cast("timestamp"))
    tags = F.coalesce(after(bare, "- **Tags:**"), of_footer("Tags:"))
    meta = t.startswith("- **") | footer
    quoted = F.when(F.col("line").startswith("> "), F.substring("line", 3, 1 << 30)).when(t == ">", "").otherwise(F.col("line"))
    told = rows.where(F.col("card.title").isNotNull() & ~ends).select(
        "path",
        F.col("card.n").alias("place"),
        F.col("card.title").alias("title"),
        F.coalesce("category", F.lit("fact")).alias("category"),
        "n",
        F.when(~meta, quoted).alias("text"),
        after(bare, "- **ID:**").alias("id"),
        tags.alias("tags"),
        F.coalesce(_number(after(bare, "- **Confidence:**")), _number(of_footer("Confidence:"))).alias("confidence"),
        F.coalesce(_moment(after(bare, "- **Created:**")), _moment(of_footer("Created:")), local(of_footer("Created:"))).alias("made"),
    )
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("n")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("n", "text")))), lambda x: x["text"]), "\n")
    done = told.groupBy("path", "place", "title", "category").agg(
        trim(body).alias("content"), last("id").alias("id"), last("tags").alias("_tags"), last("confidence").alias("confidence"), last("made").alias("created_at")
    )
    listed = F.filter(F.transform(F.split("_tags", ","), trim), lambda x: x != "")
    return done.where("content <> ''").select(
        "path", F.col("place").cast("int").alias("place"), "id", "category", "title", "content", F.coalesce(listed, F.array().cast("array<string>")).alias("tags"),
        F.coalesce("confidence", F.lit(0.9)).alias("confidence"), F.lit(MARKDOWN_PROVENANCE).alias("provenance"), "created_at",
    )


def is_own_markdown(text: Column) -> Column:
    """Whether a file says in its first lines that it is of exporters.markdown."""
    return F.exists(F.slice(_lines(text), 1, FORMAT_LINES), lambda x: trim(x) == F.lit(f'format: "{MARKDOWN_FORMAT}"'))


def _comments(files: DataFrame, name: str) -> DataFrame:
    """(path, place, said): the JSON in the comments of a name, a line each; a comment that doesn't end fails."""
    rows = files.select("path", F.posexplode(_lines(F.col("text"))).alias("place", "line")).where(F.col("line").startswith(f"<!-- {name} "))
    whole = F.when(F.col("line").endswith(" -->"), True).otherwise(F.raise_error(F.concat(F.lit("malformed record in "), "path")))
    said = F.regexp_replace("line", rf"^<!-- {name} (.*) -->$", "$1")
    return rows.where(whole).select("path", "place", said.alias("said"))


def own_records(files: DataFrame) -> DataFrame:
    """(path, place, and the columns of memories, attachments and entities) of exporters.markdown's files."""
    kind = f"{MEMORIES}, attachments array<struct<filename:string,sha256:string,base64:string>>, entities array<struct<entity_name:string,entity_val:string>>"
    return _comments(files, "record").select("path", "place", F.from_json("said", kind, {"mode": "FAILFAST"}).alias("r")).select("path", "place", "r.*")


def own_links(files: DataFrame) -> DataFrame:
    """(path, source_id, target_id, relation, weight) of exporters.markdown's files."""
    kind = "source_id string, target_id string, relation string, weight double"
    return _comments(files, "link").select("path", F.from_json("said", kind, {"mode": "FAILFAST"}).alias("l")).select("path", "l.*")


def attachments(rows: DataFrame) -> DataFrame:
    """(memory_id, filename, data, sha256) of base64 attachments; fails on a wrong hash or a path in a file name."""
    data = F.unbase64("base64")
    ok = (F.col("sha256").isNull() | (F.sha2(data, 256) == F.col("sha256"))) & F.col("filename").rlike(r"^[^/\\]+$") & (trim(F.col("filename")) != "") & ~F.col("filename").contains("..")
    checked = rows.where(F.when(ok, True).otherwise(F.raise_error(F.concat(F.lit("bad attachment "), "filename"))))
    return checked.select("memory_id", "filename", data.alias("data"), F.sha2(data, 256).alias("sha256"))
