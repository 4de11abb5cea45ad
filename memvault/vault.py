"""A vault: versioned tables of records, vectors, links, attachments and entities under one folder.

Every write makes new files for the parts of tables that it changes and publishes the next version in the
commit log; readers keep the version that they opened, and an old one may be opened by its number. Records are dealt into
buckets by category and content, what hangs on an id into buckets by id, so that a write reads and
replaces only the buckets that its rows fall into. Writers don't wait for each other: one that finds newer
versions goes on from the newest if these changed no table that it has read or written, and fails otherwise.
"""

from __future__ import annotations

import uuid
from dataclasses import asdict, dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memvault import schema
from memvault.commits import CommitLog, ConcurrentWrite
from memvault.functions import rules, text
from memvault.operators import conflict, dedup, filters, fusion, graph, lexical, postings, stats, vectors
from memvault.sources import exporters, files, importers

TABLES = {
    "memories": schema.MEMORIES,
    "vectors": schema.VECTORS,
    "links": schema.LINKS,
    "attachments": schema.ATTACHMENTS,
    "entities": schema.ENTITIES,
    "history": schema.HISTORY,
}
#: Buckets of a new vault; a vault keeps the number that it began with.
BUCKETS = 16
#: What a table's buckets go by; the other tables have one part.
_BY_ID = {"vectors": "id", "attachments": "memory_id", "entities": "memory_id"}
#: The part of a table without buckets.
_WHOLE = "all"


@dataclass
class Part:
    """Rows that take the place of some buckets of a table."""

    rows: DataFrame
    buckets: set[int]


class Remembered(NamedTuple):
    """A version, and (id, older_id, similarity) of what its new records may contradict, found when it is read."""

    version: int
    peers: DataFrame


class Vault:
    """Verbs over one vault; ``now`` is always given, never read from a clock."""

    def __init__(self, spark: SparkSession, path: str, embedder: vectors.Embedder | None = None, version: int | None = None, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        self.embedder = embedder or vectors.HashEmbedder()
        self.log = CommitLog(spark, path)
        self.version = self.log.newest() if version is None else version
        self.entry = self.log.read(self.version)
        self.buckets = self.entry.get("buckets", buckets)
        self._read: set[str] = set()

    # tables and versions

    def table(self, name: str, buckets: set[int] | None = None) -> DataFrame:
        """A table of this version, or some of its buckets."""
        self._read.add(name)
        parts = self.entry["tables"].get(name, {})
        paths = [f"{self.path}/{p}" for b, p in parts.items() if buckets is None or b == _WHOLE or int(b) in buckets]
        return self.spark.read.schema(TABLES[name]).parquet(*paths) if paths else self.spark.createDataFrame([], TABLES[name])

    def _bucket(self, name: str) -> Column | None:
        if name == "memories":
            return F.pmod(F.xxhash64("category", text.trim(F.col("content"))), F.lit(self.buckets)).cast("int")
        return F.pmod(F.xxhash64(_BY_ID[name]), F.lit(self.buckets)).cast("int") if name in _BY_ID else None

    def _touched(self, name: str, rows: DataFrame) -> set[int]:
        """The buckets of a table that rows fall into: as many numbers as there are buckets, at most."""
        return {r[0] for r in rows.select(self._bucket(name)).distinct().collect()}

    def _holding(self, ids: DataFrame) -> set[int]:
        """The buckets of records that hold ids."""
        bucket = F.regexp_extract("_metadata.file_path", r"/bucket=(\d+)/", 1)
        if not self.entry["tables"].get("memories"):
            return set()
        held = self.table("memories").select("id", bucket.alias("bucket")).join(ids.select("id"), "id", "left_semi")
        return {int(r[0]) for r in held.select("bucket").distinct().collect()}

    def _written(self, name: str, rows: DataFrame) -> dict[str, str]:
        """Writes rows of a table; its new parts."""
        where, by = f"tables/{name}-{uuid.uuid4().hex}", self._bucket(name)
        known = self.spark.createDataFrame([], TABLES[name])
        rows = known.unionByName(rows.select(*[c for c in known.columns if c in rows.columns]), allowMissingColumns=True)
        if by is None:
            rows.write.parquet(f"{self.path}/{where}")
            return {_WHOLE: where}
        rows.withColumn("bucket", by).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{where}")
        found = self.log.folders(f"{self.path}/{where}")
        return {f.removeprefix("bucket="): f"{where}/{f}" for f in found if f.startswith("bucket=")}

    def commit(self, **changed: DataFrame | Part) -> int:
        """Writes what changed, whole tables or parts of them, and publishes the next version."""
        new: dict[str, dict[str, str]] = {}
        for name, value in changed.items():
            new[name] = self._written(name, value.rows if isinstance(value, Part) else value)
        index = self._indexed(changed) if "memories" in changed else None
        base, at = self.entry, self.version
        while True:
            newest = self.log.newest()
            for version in range(at + 1, newest + 1):
                others = set(self.log.read(version)["changed"])
                if clash := others & (self._read | set(changed)):
                    raise ConcurrentWrite(f"the vault moved on from version {self.version} to {newest}, which changed {', '.join(sorted(clash))}")
            base, at = (self.log.read(newest), newest) if newest != at else (base, at)
            tables = dict(base["tables"])
            for name, parts in new.items():
                value = changed[name]
                kept = {b: p for b, p in tables.get(name, {}).items() if isinstance(value, Part) and int(b) not in value.buckets}
                tables[name] = kept | parts
            entry = {**base, "tables": tables, "changed": sorted(changed), "buckets": self.buckets}
            if "vectors" in changed:
                entry["embedder"] = self.identity
            if index is not None:
                entry["index"] = asdict(index)
            if self.log.publish(at + 1, entry):
                self.version, self.entry, self._read = at + 1, entry, set()
                return self.version

    def vacuum(self, keep: int = 10, unused_before_ms: int = 0) -> int:
        """Drops all versions but the newest keep, and the files that no other version names; the number of folders that went.

        Folders that no version names may belong to a write under way: they go only if last changed before unused_before_ms.
        """
        versions = self.log.versions()
        old, left = versions[: max(0, len(versions) - max(1, keep))], versions[-max(1, keep) :]

        def folders(some: list[int]) -> set[str]:
            entries = [self.log.read(v) for v in some]
            tables = {p for e in entries for parts in e["tables"].values() for p in parts.values()}
            indexes = [postings.Index.of(e.get("index")) for e in entries]
            return {p.split("/")[1] for p in tables | {x[-1] for i in indexes for x in i.segments + i.deleted}}

        used, retired = folders(left), folders(old)
        gone = [f for f, at in self.log.folders(f"{self.path}/tables").items() if f not in used and (f in retired or at < unused_before_ms)]
        for version in old:
            self.log.drop(version)
        for folder in gone:
            self.log.delete(f"{self.path}/tables/{folder}")
        return len(gone)

    def _path(self, name: str) -> str:
        return f"{self.path}/{name}"

    def _indexed(self, changed: dict[str, DataFrame | Part]) -> postings.Index:
        """The stored index after a change of records (and their files)."""
        value, index = changed["memories"], postings.Index.of(self.entry.get("index"))
        part = isinstance(value, Part)
        before, after = self.table("memories", value.buckets if part else None), value.rows if part else value
        whole = self.spark.createDataFrame([], TABLES["memories"])
        after = whole.unionByName(after.select(*[c for c in whole.columns if c in after.columns]), allowMissingColumns=True)
        files, new = self.table("attachments"), changed.get("attachments")
        if new is not None or self.entry["tables"].get("attachments"):
            if isinstance(new, Part):
                new = self.table("attachments", set(range(self.buckets)) - new.buckets).unionByName(new.rows, allowMissingColumns=True)
            before, after = lexical.file_texts(before, files), lexical.file_texts(after, files if new is None else files.select("memory_id").limit(0).unionByName(new, allowMissingColumns=True))
        changes = graph.cut(postings.delta(before, after))
        return postings.updated(index, changes, self._path, lambda kind: f"tables/{kind}-{uuid.uuid4().hex}")

    def reindex_words(self) -> int:
        """Builds the stored index anew, after files alone were committed or the rules of terms have changed."""
        rows = self.table("memories")
        self.entry = {**self.entry, "tables": {k: v for k, v in self.entry["tables"].items() if k != "memories"}, "index": None}
        return self.commit(memories=graph.cut(rows))

    @property
    def identity(self) -> str:
        """What vectors must share to be compared: the embedder and its number of dimensions."""
        return f"{self.embedder.identity}/{self.embedder.dims}"

    def _check_identity(self, entry: dict | None = None) -> None:
        """Vectors of different embedders never mix; a vault without vectors takes any."""
        entry = self.entry if entry is None else entry
        if "vectors" in entry["tables"] and entry.get("embedder") != self.identity:
            raise ValueError(f"the vectors are of {entry.get('embedder', 'an unknown embedder')}, not of {self.identity}; reindex first")

    # writing

    def remember(self, incoming: DataFrame, now: str, attached: DataFrame | None = None, links: DataFrame | None = None, supersede: bool = False) -> Remembered:
        """Adds records (content, and any of the other fields) with what is attached to them (as in the table attachments), and merges duplicates.

        links, whose ends are ids or titles of records, old or new, are put in with them as restore_links does.
        See dedup.keyed_upsert; records come in the order of their rows. A record without an id is named by its category, key and now.
        supersede retires the held records that new ones contradict.
        """
        self._check_identity()
        have = incoming.columns
        column = lambda name, value: F.coalesce(F.col(name), value) if name in have else value
        content = text.trim(F.col("content"))
        expires = F.lit(None).cast("timestamp_ntz")
        if "ttl" in have:
            expires = filters.stamp(now) + F.make_dt_interval(secs=(text.ttl_ms(F.col("ttl")) / 1000).cast("decimal(18,6)"))
        category = column("category", rules.category_of(content))
        rows = incoming.where(content != "").select(
            column("id", F.sha2(F.concat_ws("|", category, content, F.lit(now)), 256)).alias("id"),
            category.alias("category"),
            column("title", text.title_of(content)).alias("title"),
            content.alias("content"),
            column("tags", F.array().cast("array<string>")).alias("tags"),
            column("confidence", F.lit(0.9)).cast("double").alias("confidence"),
            F.lit("active").alias("status"),
            column("provenance", F.lit("explicit_statement")).alias("provenance"),
            column("created_at", filters.stamp(now)).cast("timestamp_ntz").alias("created_at"),
            filters.stamp(now).alias("updated_at"),
            expires.alias("expired_at"),
            F.monotonically_increasing_id().alias("place"),
        )
        rows = graph.cut(rows)
        buckets = self._touched("memories", rows) | self._holding(rows)
        held = self.table("memories", buckets)
        hashes = self.table("attachments").select(F.col("memory_id").alias("id"), "sha256")
        if attached is not None:
            given = attached.join(rows.select(F.col("id").alias("memory_id")), "memory_id", "left_semi")
            hashes = hashes.unionByName(given.select(F.col("memory_id").alias("id"), "sha256"))
        records, moved = (graph.cut(x) for x in dedup.keyed_upsert(held, rows, hashes))
        children = self._rehomed(moved)
        if attached is not None:
            to = moved.select(F.col("id").alias("memory_id"), F.col("primary_id").alias("_p"))
            mine = given.join(to, "memory_id", "left").withColumn("memory_id", F.coalesce("_p", "memory_id")).drop("_p")
            both = children.get("attachments", self.table("attachments")).unionByName(mine, allowMissingColumns=True)
            children["attachments"] = both.dropDuplicates(["memory_id", "sha256"])
        if links is not None:
            others = self.table("memories", set(range(self.buckets)) - buckets)
            children["links"] = graph.restored(children.get("links", self.table("links")), others.unionByName(records), links)
        self.commit(memories=Part(records, buckets), vectors=self._vectors_part(held, records, children), **children)
        came = rows.select("id").join(moved, "id", "left").select(F.coalesce("primary_id", "id").alias("id")).distinct()
        peers = self.peers(came)
        if supersede:
            older = graph.cut(peers.select(F.col("older_id").alias("id")))
            if not older.isEmpty():
                self.forget(older, now)
        return Remembered(self.version, peers)

    def import_files(self, path: str, now: str) -> Remembered:
        """Takes in the records and links of all importable files under a folder, in the order of their paths, as one version."""
        files = importers.read_files(self.spark, path)
        found = importers.candidates(files).orderBy("path", "place")
        made = F.expr("convert_timezone(current_timezone(), 'UTC', cast(created_at as timestamp_ntz))")
        return self.remember(found.withColumn("created_at", made), now, links=importers.file_links(files))

    def export_markdown(self, path: str) -> None:
        """Writes the active records and all links as Markdown files that import_files reads back."""
        blocks = exporters.markdown(self.table("memories"), links=self.table("links"))
        head = F.when(F.col("place") > 0, F.lit(exporters.MARKDOWN_HEAD)).otherwise("")
        parts = blocks.repartitionByRange("place", "id").sortWithinPartitions("place", "id")
        first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0  # of its file
        named = parts.select(F.concat(F.when(first, head).otherwise(""), "value").alias("value"))
        exporters.write_text(named, path, ".md")

    def export_backup(self, path: str) -> None:
        """Writes all records, with what hangs on them, and all links as JSON envelopes, one a line."""
        names = ("memories", "attachments", "entities", "links")
        exporters.backup(*(self.table(n) for n in names)).write.text(path)

    def import_backup(self, path: str) -> int:
        """Puts the records of a backup, by id, with what hangs on them and their links into the vault, as one version."""
        lines = self.spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
        parts = {name: graph.cut(rows) for name, rows in importers.backup_parts(lines).items()}
        came = parts["memories"].select(F.col("id").alias("memory_id")).distinct()
        records = dedup.upserted(self.table("memories"), parts["memories"])
        children = {n: self.table(n).join(came, "memory_id", "left_anti").unionByName(parts[n], allowMissingColumns=True) for n in ("attachments", "entities")}
        links = graph.restored(self.table("links"), records, parts["links"])
        return self.commit(memories=records, links=links, vectors=self._vectors_part(self.table("memories"), records, children), **children)

    def _rehomed(self, mapping: DataFrame) -> dict[str, DataFrame]:
        """The tables of children with those of id given to primary_id."""
        if mapping.isEmpty():
            return {}
        return {
            "links": dedup.rehomed(self.table("links"), mapping),
            "attachments": dedup.rehomed_children(self.table("attachments"), mapping, ["sha256"]),
            "entities": dedup.rehomed_children(self.table("entities"), mapping, ["entity_name", "entity_val"]),
        }

    def _cards(self, rows: DataFrame, children: dict[str, DataFrame] | None = None) -> DataFrame:
        """What is embedded of active records, with what hangs on them: as it is stored, or as children have it."""
        held = {n: self.table(n) for n in ("attachments", "entities") if self.entry["tables"].get(n)} | {n: t for n, t in (children or {}).items() if n in ("attachments", "entities")}
        return vectors.cards(rows.where("status = 'active'"), held.get("attachments"), held.get("entities"))

    def _vectors_part(self, before: DataFrame, after: DataFrame, children: dict[str, DataFrame] | None = None) -> Part:
        """The buckets of vectors whose records' cards differ between two states of some records; only changed cards are embedded.

        children are the new tables of what hangs on records, where they change too.
        """
        self._check_identity()
        old, new = self._cards(before), self._cards(after, children)
        changed = graph.cut(new.join(old, ["id", "card"], "left_anti"))
        stale = changed.select("id").unionByName(old.join(new, "id", "left_anti").select("id"))
        missing = new.join(self.table("vectors").select("id"), "id", "left_anti").join(changed, "id", "left_anti")
        fresh = vectors.embedded(changed.unionByName(missing), self.embedder)
        dirty = graph.cut(stale.unionByName(missing.select("id")))
        buckets = self._touched("vectors", dirty)
        kept = self.table("vectors", buckets).join(dirty, "id", "left_anti")
        return Part(kept.unionByName(fresh), buckets)

    def reindex(self) -> int:
        """Embeds the cards of all active records anew."""
        return self.commit(vectors=vectors.embedded(self._cards(self.table("memories")), self.embedder))

    def _retouched(self, rows: DataFrame, buckets: set[int]) -> int:
        """Commits new states of the records of some buckets."""
        after = graph.cut(rows)
        return self.commit(memories=Part(after, buckets), vectors=self._vectors_part(self.table("memories", buckets), after))

    def forget(self, ids: DataFrame, now: str, hard: bool = False) -> int:
        """Soft: records become expired. Hard: they go, with their vectors, links, attachments and entities. Ids may repeat."""
        gone = graph.cut(ids.select("id").distinct())
        buckets = self._holding(gone)
        rows = self.table("memories", buckets)
        if not hard:
            out = rows.join(gone.withColumn("_gone", F.lit(True)), "id", "left")
            out = out.withColumn("status", F.when(F.col("_gone"), "expired").otherwise(F.col("status")))
            return self._retouched(out.withColumn("expired_at", F.when(F.col("_gone"), filters.stamp(now)).otherwise(F.col("expired_at"))), buckets)
        without = lambda df, column: df.join(gone.select(F.col("id").alias(column)), column, "left_anti")
        self._check_identity()
        hanging = self._touched("vectors", gone)
        return self.commit(
            memories=Part(without(rows, "id"), buckets),
            vectors=Part(without(self.table("vectors", hanging), "id"), hanging),
            links=without(without(self.table("links"), "source_id"), "target_id"),
            attachments=Part(without(self.table("attachments", hanging), "memory_id"), hanging),
            entities=Part(without(self.table("entities", hanging), "memory_id"), hanging),
        )

    def clear(self) -> int:
        """Forgets all records and all that hangs on them; older versions stay until they are vacuumed."""
        return self.commit(**{name: self.spark.createDataFrame([], kind) for name, kind in TABLES.items() if name != "history"})

    def restore(self, ids: DataFrame) -> int:
        """Makes records active again. Ids may repeat."""
        back = graph.cut(ids.select("id").distinct())
        buckets = self._holding(back)
        out = self.table("memories", buckets).join(back.withColumn("_back", F.lit(True)), "id", "left")
        out = out.withColumn("status", F.when(F.col("_back"), "active").otherwise(F.col("status")))
        return self._retouched(out.withColumn("expired_at", F.when(F.col("_back"), F.lit(None)).otherwise(F.col("expired_at"))).drop("_back"), buckets)

    def expire(self, now: str) -> int:
        due = filters.expire_due(self.table("memories"), now)
        return self.commit(memories=due)

    def link(self, new: DataFrame) -> int:
        return self.commit(links=graph.add_links(self.table("links"), new))

    def unlink(self, source: str, target: str, relation: str | None = None) -> int:
        return self.commit(links=graph.remove_link(self.table("links"), source, target, relation))

    def autolink(self, threshold: float = 0.75) -> DataFrame:
        """The links that title mentions, shared tags, wikilinks and similar vectors add; committed, and returned."""
        rows = self.table("memories")
        mentions, tags = graph.title_mentions(rows, generic=rules.GENERIC_TITLES), graph.shared_tags(rows, rules.GENERIC_TAGS)
        wiki = graph.wiki_edges(rows).unionByName(graph.backlinks(rows)).distinct()
        kinds = ((mentions, "mentions", 1.0), (tags, "shared_topic", 0.8), (wiki, "references", 1.0))
        found = graph.semantic(self.table("vectors"), threshold).withColumn("relation", F.lit("relates_to"))
        for edges, relation, weight in kinds:
            found = found.unionByName(edges.select("source_id", "target_id", F.lit(weight).alias("weight"), F.lit(relation).alias("relation")))
        new = graph.cut(graph.only_new(self.table("links"), found))
        self.commit(links=self.table("links").unionByName(new, allowMissingColumns=True))
        return new

    def restore_links(self, back: DataFrame) -> int:
        return self.commit(links=graph.restored(self.table("links"), self.table("memories"), back))

    def resolve_conflicts(self, now: str) -> DataFrame:
        """Merges the older record of each conflict into the newer one and retires it; returns the pairs."""
        pairs = graph.cut(conflict.resolved(self.conflicts()))
        into = graph.cut(conflict.survivors(pairs))
        records = conflict.merged_pairs(into, self.table("memories"), now)
        mapping = into.select(F.col("older_id").alias("id"), F.col("newer_id").alias("primary_id"))
        children = self._rehomed(graph.cut(mapping))
        self.commit(memories=records, vectors=self._vectors_part(self.table("memories"), records, children), **children)
        return pairs

    def merge(self, other: Vault, replace: bool = False) -> int:
        """Takes over the other vault's records (new ones only, unless replace) with all that hangs on them."""
        self._check_identity()
        self._check_identity(other.entry)
        rows, accepted = dedup.merge_vaults(self.table("memories"), other.table("memories"), replace)
        links = dedup.accepted_links(self.table("links"), other.table("links"), accepted)
        vecs = dedup.upserted(self.table("vectors"), other.table("vectors").join(accepted, "id", "left_semi"))
        owned = accepted.select(F.col("id").alias("memory_id"))
        taken = lambda name: self.table(name).join(owned, "memory_id", "left_anti").unionByName(other.table(name).join(owned, "memory_id", "left_semi"))
        return self.commit(memories=rows, links=links, vectors=vecs, attachments=taken("attachments"), entities=taken("entities"))

    # history

    def record(self, runs: DataFrame) -> int:
        """Adds runs of commands (as in the table history, without id) to the history, numbered on in order of created_at and command."""
        held = self.table("history")
        last = held.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
        return self.commit(history=held.unionByName(stats.numbered(runs, last), allowMissingColumns=True))

    def prune_history(self, keep: int) -> int:
        return self.commit(history=stats.pruned(self.table("history"), keep))

    def clear_history(self) -> int:
        return self.commit(history=self.spark.createDataFrame([], TABLES["history"]))

    # bundles

    def export_bundle(self, path: str) -> None:
        """A vault of its own under path, with all tables of this version, their manifest, and the hash of each of its files."""
        self._check_identity()
        bundle = Vault(self.spark, path, self.embedder)
        bundle.commit(**{name: self.table(name) for name in TABLES})
        bundle.manifest().write.json(f"{bundle.path}/manifest")
        bundle._hashes().write.parquet(f"{bundle.path}/hashes")

    def _hashes(self) -> DataFrame:
        """(name, sha256) of the files of this version's tables and index."""
        index = postings.Index.of(self.entry.get("index"))
        folders = [p for parts in self.entry["tables"].values() for p in parts.values()] + [x[-1] for x in index.segments + index.deleted]
        if not folders:
            return self.spark.createDataFrame([], "name string, sha256 string")
        read = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
        files = read.load([self._path(f) for f in folders])
        return files.select(F.regexp_extract("path", r"/(tables/.*)$", 1).alias("name"), F.sha2("content", 256).alias("sha256"))

    def manifest(self) -> DataFrame:
        return exporters.manifest(self.table("memories"), self.table("attachments"), self.table("links"))

    def inspect_bundle(self, path: str) -> dict:
        """What a bundle's manifest says, after its files and tables were held against it; ValueError if they differ or don't fit together.

        Every file must have its hash, and none be missing; counts, bytes and kinds must be those of the manifest, the hashes of
        attachments those of their bytes, and every link, file, entity and vector must belong to a record.
        """
        bundle = Vault(self.spark, path, self.embedder)
        told = self.spark.read.schema("name string, sha256 string").parquet(f"{bundle.path}/hashes")
        found = bundle._hashes()
        if not told.exceptAll(found).isEmpty() or not found.exceptAll(told).isEmpty():
            raise ValueError(f"files of {path} don't agree with their hashes")
        said = self.spark.read.schema(bundle.manifest().schema).json(f"{bundle.path}/manifest").first()  # one row
        if said is None or said != bundle.manifest().first():
            raise ValueError(f"the tables of {path} don't agree with its manifest")
        records, files = bundle.table("memories").select("id"), bundle.table("attachments")
        if not files.where(F.sha2("data", 256) != F.lower("sha256")).isEmpty():
            raise ValueError(f"attachments of {path} don't agree with their hashes")
        ends = (("links", "source_id"), ("links", "target_id"), ("attachments", "memory_id"), ("entities", "memory_id"), ("vectors", "id"))
        for name, column in ends:
            if not bundle.table(name).join(records.withColumnRenamed("id", column), column, "left_anti").isEmpty():
                raise ValueError(f"{name} of {path} name records that it lacks")
        return said.asDict()

    def import_bundle(self, path: str, replace: bool = False) -> int:
        """Takes over a bundle that passes inspect_bundle, as merge does; nothing is written if it doesn't pass."""
        self.inspect_bundle(path)
        return self.merge(Vault(self.spark, path, self.embedder), replace)

    def restore_bundle(self, path: str) -> int:
        """Puts a bundle that passes inspect_bundle in the place of all that the vault has, as one version.

        Files are written aside; until the version is published the vault is as it was, and roll_back brings that state back later.
        """
        self.inspect_bundle(path)
        bundle = Vault(self.spark, path, self.embedder)
        self._check_identity(bundle.entry)
        self.table("memories")  # a write under way elsewhere is in conflict with the restore
        return self.commit(**{name: bundle.table(name) for name in TABLES})

    def roll_back(self, version: int) -> int:
        """Makes the state of an older version the newest one; nothing is copied."""
        entry, newest = self.log.read(version), self.log.newest()
        entry["changed"] = sorted(TABLES)
        if newest != self.version or not self.log.publish(newest + 1, entry):
            raise ConcurrentWrite(f"the vault moved on from version {self.version}")
        self.version, self.entry, self._read = newest + 1, entry, set()
        return self.version

    def export_files(self, path: str, ids: DataFrame | None = None) -> None:
        """Writes the attachments of some or all records as files under path, which all executors reach."""
        rows = self.table("attachments")
        files.export(rows if ids is None else rows.join(ids.select(F.col("id").alias("memory_id")), "memory_id", "left_semi"), path)

    # reading

    def recall(self, query: str, limit: int = 10, expand: bool = False, **filters_) -> DataFrame:
        self._check_identity()
        request = fusion.Request(query=query, vector=[float(x) for x in self.embedder.embed_batch([query])[0]], limit=limit, **filters_)
        index = postings.Index.of(self.entry.get("index"))
        words = postings.top(self.spark, index, query, request.fetch, self._path, fusion.eligible(request))
        rows = self.table("memories")
        if self.entry["tables"].get("attachments"):
            rows = lexical.file_texts(rows, self.table("attachments"))
        hits = fusion.recall(rows, vectors.checked(self.table("vectors"), self.embedder.dims), request, words)
        return fusion.expanded(hits, self.table("memories"), self.table("links"), limit, request.category, request.as_of, request.day) if expand else hits

    def list(self, page: int = 1, size: int = 20, **filters_) -> DataFrame:
        return filters.page(filters.select(self.table("memories"), **filters_), page, size)

    def get(self, key: str) -> DataFrame:
        return filters.by_id_or_title(self.table("memories"), key)

    def get_many(self, ids: DataFrame) -> DataFrame:
        return filters.by_ids(self.table("memories"), ids)

    def for_restore(self, key: str) -> DataFrame:
        return filters.for_restore(self.table("memories"), key)

    def hydrated(self, key: str) -> DataFrame:
        return filters.hydrated(self.get(key), self.table("attachments"), self.table("entities"))

    def links_of(self, key: str) -> DataFrame:
        return graph.links_of(self.table("memories"), self.table("links"), self.get(key)).orderBy(F.col("created_at").desc())

    def neighbourhood(self, key: str, hops: int = 2) -> tuple[DataFrame, DataFrame]:
        return graph.neighbourhood(self.table("memories"), self.table("links"), self.get(key), hops)

    def peers(self, ids: DataFrame, threshold: float = 0.72) -> DataFrame:
        """(id, older_id, similarity): what records just written may contradict."""
        return conflict.peers(self.get_many(ids), self.table("memories"), threshold, self.table("vectors"))

    def conflicts(self, threshold: float = 0.78) -> DataFrame:
        return conflict.conflicts(self.table("memories").where("status = 'active'"), threshold, self.table("vectors"))

    def related(self, key: str, hops: int = 2) -> DataFrame:
        return graph.related(self.table("memories"), self.table("links"), self.get(key).select("id"), hops)

    def stats(self) -> DataFrame:
        return stats.overview(self.table("memories"), self.table("vectors"))
