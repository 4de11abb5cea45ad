"""A vault's verbs end to end."""

import hashlib
import random
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from memvault.commits import CommitLog
from memvault.operators import components, conflict
from memvault.sources import files
from memvault.streaming import ingest
from memvault.vault import Vault


@pytest.fixture
def vault(spark, tmp_path):
    v = Vault(spark, str(tmp_path / "vault"))
    rows = spark.createDataFrame([("a", "PostgreSQL runs on port 5432."), ("b", "We decided to use Redis Cache"), ("c", "See [[b]] for the cache")], "id string, content string")
    v.remember(rows, "2024-01-01 10:00:00")
    return v


def said(spark, rows):
    """rows: (id, content) or (id, category, content)."""
    if rows and len(rows[0]) == 2:
        return spark.createDataFrame(rows, "id string, content string")
    return spark.createDataFrame(rows, "id string, category string, content string")


def ids_are_unique(vault, by_content=True):
    for name in ("memories", "vectors"):
        ids = [r["id"] for r in vault.table(name).select("id").collect()]
        assert len(ids) == len(set(ids)), name
    active = vault.table("memories").where("status = 'active'")
    assert not by_content or active.groupBy("category", F.trim("content")).count().where("count > 1").isEmpty()
    assert {r["id"] for r in active.collect()} == {r["id"] for r in vault.table("vectors").collect()}


def test_remember_recall_and_merge(spark, vault):
    assert vault.stats().first().asDict() == {"total": 3, "active": 3, "expired": 0, "vectors": 3}
    vault.remember(spark.createDataFrame([("z", " PostgreSQL runs on port 5432.", 0.99)], "id string, content string, confidence double"), "2024-01-02 10:00:00")
    rows = {r["id"]: r for r in vault.table("memories").collect()}
    assert set(rows) == {"a", "b", "c"} and rows["a"]["confidence"] == 0.99 and rows["b"]["category"] == "decision"
    assert vault.recall("port 5432").first()["id"] == "a"


def test_forget_restore_and_links(spark, vault):
    new = vault.autolink()
    assert ("c", "b") in {(r["source_id"], r["target_id"]) for r in new.collect()}
    assert vault.autolink().count() == 0
    ids = spark.createDataFrame([("b",)], "id string")
    vault.forget(ids, "2024-01-03")
    assert vault.table("memories").where("id = 'b'").first()["status"] == "expired"
    vault.restore(ids)
    assert vault.stats().first()["active"] == 3
    vault.forget(ids, "2024-01-03", hard=True)
    assert vault.stats().first()["total"] == 2 and vault.table("links").where("source_id = 'b' or target_id = 'b'").count() == 0


def test_conflicts_are_resolved(spark, vault):
    vault.remember(spark.createDataFrame([("n", "PostgreSQL runs on port 6432.")], "id string, content string"), "2024-01-05")
    assert [(r["older_id"], r["newer_id"]) for r in vault.resolve_conflicts("2024-01-06").collect()] == [("a", "n")]
    assert vault.table("memories").where("id = 'a'").first()["status"] == "expired"


def test_one_content_in_two_categories_is_two_records(spark, tmp_path):
    vault = Vault(spark, str(tmp_path / "v"))
    rows = spark.createDataFrame([("Same words", "fact"), ("Same words", "goal"), (" Same words", "goal")], "content string, category string")
    vault.remember(rows, "2024-01-01")
    assert vault.table("memories").count() == 2
    ids_are_unique(vault)


def test_repeated_ids_forget_and_restore_once(spark, vault):
    twice = said(spark, [("a", ""), ("a", ""), ("b", "")])
    vault.forget(twice, "2024-01-02")
    assert vault.stats().first()["expired"] == 2
    ids_are_unique(vault)
    vault.restore(twice)
    assert vault.stats().first()["active"] == 3
    ids_are_unique(vault)


def test_an_expired_id_that_comes_in_again_is_one_record(spark, vault):
    vault.forget(said(spark, [("a", "")]), "2024-01-02")
    vault.remember(said(spark, [("a", "Something else altogether"), ("a", "And then this")]), "2024-01-03")
    (row,) = vault.table("memories").where("id = 'a'").collect()
    assert (row["content"], row["status"], row["expired_at"]) == ("And then this", "active", None)
    ids_are_unique(vault)


def test_files_are_part_of_the_key(spark, vault):
    def file(of, data):
        row = spark.createDataFrame([(of, f"{of}.txt", bytearray(data))], "memory_id string, filename string, data binary")
        return row.withColumn("sha256", F.sha2("data", 256)).withColumn("size_bytes", F.octet_length("data").cast("long"))

    port = "PostgreSQL runs on port 5432."
    vault.remember(said(spark, [("p", port)]), "2024-01-02", attached=file("p", b"1"))
    assert vault.table("memories").count() == 4  # not the one without a file
    vault.remember(said(spark, [("q", port)]), "2024-01-03", attached=file("q", b"1"))
    assert vault.table("memories").count() == 4 and [r["memory_id"] for r in vault.table("attachments").collect()] == ["p"]
    vault.remember(said(spark, [("r", port)]), "2024-01-04", attached=file("r", b"2"))
    assert vault.table("memories").count() == 5 and vault.table("attachments").count() == 2
    ids_are_unique(vault, by_content=False)


def one_by_one(held, incoming, now):
    """The records after incoming ones were written one after another: {id: (category, content, status, tags, confidence)}."""
    out = dict(held)
    last = {r["id"]: r for r in incoming}
    incoming = [r for r in incoming if last[r["id"]] is r]
    known = set(out)
    # records that come in under another key go first
    for r in incoming:
        old = out.get(r["id"])
        if old and (old["status"] != "active" or (old["category"], old["content"].strip()) != (r["category"], r["content"].strip())):
            del out[r["id"]]
    for r in incoming:
        twins = sorted((x for x in out.values() if x["status"] == "active" and (x["category"], x["content"].strip()) == (r["category"], r["content"].strip())), key=lambda x: (x["made"], x["id"]))
        new = dict(r, status="active", made=now)
        if r["id"] not in known and twins:
            new["id"] = twins[0]["id"]
        for x in twins:
            new["tags"] = new["tags"] + [t for t in x["tags"] if t.lower() not in [y.lower() for y in new["tags"]]]
            new["confidence"] = max(new["confidence"], x["confidence"])
            new["made"] = min(new["made"], x["made"])
            del out[x["id"]]
        out[new["id"]] = new
    return {(i, r["category"], r["content"].strip(), r["status"], tuple(r["tags"]), r["confidence"]) for i, r in out.items()}


@pytest.mark.parametrize("seed", range(2))
def test_batches_are_written_as_if_one_by_one(spark, tmp_path, seed):
    rng = random.Random(seed)

    def some(n, ids):
        return [{"id": rng.choice(ids), "category": rng.choice(["fact", "goal"]), "content": rng.choice(["x y", " x y", "z", "w v"]), "tags": rng.sample(["A", "a", "b"], 2), "confidence": rng.randint(1, 99) / 100} for _ in range(n)]

    def frame(rows):
        kind = "id string, category string, content string, tags array<string>, confidence double"
        return spark.createDataFrame([tuple(r[c.split()[0]] for c in kind.split(", ")) for r in rows], kind).coalesce(1)

    vault = Vault(spark, str(tmp_path / "v"), buckets=3)
    names = [f"n{i}" for i in range(8)]
    vault.remember(frame(some(5, names)), "2024-01-01")
    vault.forget(said(spark, [(names[0], ""), (names[1], "")]), "2024-01-02")
    held = {r["id"]: {**r.asDict(), "made": str(r["created_at"])} for r in vault.table("memories").collect()}
    new = some(9, names + ["m1", "m2"])
    vault.remember(frame(new), "2024-02-01")
    got = {(r["id"], r["category"], r["content"].strip(), r["status"], tuple(r["tags"]), r["confidence"]) for r in vault.table("memories").collect()}
    assert got == one_by_one(held, new, "2024-02-01 00:00:00")
    ids_are_unique(vault)


def test_a_write_replaces_only_its_buckets(spark, tmp_path):
    vault = Vault(spark, str(tmp_path / "v"), buckets=8)
    vault.remember(said(spark, [(f"n{i}", f"word{i} stands alone") for i in range(40)]), "2024-01-01")
    before = vault.entry["tables"]["memories"]
    vault.remember(said(spark, [("m", "one more")]), "2024-01-02")
    after = vault.entry["tables"]["memories"]
    assert sum(before.get(b) != after[b] for b in after) == 1 and vault.table("memories").count() == 41


def test_peers_are_reported_and_superseded(spark, vault):
    done = vault.remember(said(spark, [("n", "PostgreSQL runs on port 6432.")]), "2024-01-05")
    assert [(r["id"], r["older_id"]) for r in done.peers.collect()] == [("n", "a")]
    vault.remember(said(spark, [("o", "PostgreSQL runs on port 7432.")]), "2024-01-06", supersede=True)
    assert {r["id"] for r in vault.table("memories").where("status = 'active'").collect()} & {"a", "n", "o"} in ({"o"}, {"a", "o"}, {"n", "o"})
    assert vault.table("memories").where("id = 'o'").first()["status"] == "active"


def test_stale_writer_fails(spark, vault):
    other = Vault(spark, vault.path)
    other.expire("2024-01-01")
    with pytest.raises(RuntimeError, match="memories"):
        vault.expire("2024-01-01")


def test_writers_of_different_tables_go_on_from_each_other(spark, vault):
    other = Vault(spark, vault.path)
    other.link(spark.createDataFrame([("a", "b", "uses", 1.0)], "source_id string, target_id string, relation string, weight double"))
    runs = spark.createDataFrame([("recall", "x", "success", 5, "2024-01-01 00:00:01"), ("recall", "y", "error", 7, "2024-01-01 00:00:00")], "command string, subcommand string, status string, duration_ms long, created_at string")
    vault.record(runs.withColumn("created_at", F.col("created_at").cast("timestamp_ntz")))
    fresh = Vault(spark, vault.path)
    assert fresh.version == other.version + 1 and fresh.table("links").count() == 1
    assert [r["subcommand"] for r in fresh.table("history").orderBy("id").collect()] == ["y", "x"]
    fresh.clear_history()
    fresh.clear()
    assert fresh.table("history").isEmpty() and fresh.table("memories").isEmpty()
    assert Vault(spark, vault.path, version=vault.version).table("memories").count() == 3


def test_raced_writers_leave_one_winner_each(spark, tmp_path):
    logs = [CommitLog(spark, str(tmp_path)) for _ in range(4)]
    with ThreadPoolExecutor(4) as pool:
        for version in range(1, 101):
            won = list(pool.map(lambda k, v=version: logs[k].publish(v, {"by": k, "tables": {}, "changed": []}), range(4)))
            assert sum(won) == 1 and logs[0].read(version)["by"] == won.index(True)
    assert logs[0].versions() == list(range(1, 101)) and not list(tmp_path.glob("log/*.tmp"))


def test_unpublished_entries_are_not_seen(spark, vault):
    (Path(vault.path) / "log" / "entry-x.tmp").write_text('{"tab')
    assert Vault(spark, vault.path).version == vault.version


def test_vacuum_keeps_what_newer_versions_name(spark, vault):
    for day in range(2, 6):
        vault.expire(f"2024-01-0{day}")
    stray = Path(vault.path) / "tables" / "memories-stray"
    stray.mkdir()
    before = {v: Vault(spark, vault.path, version=v).table("memories").count() for v in vault.log.versions()[-2:]}
    assert vault.vacuum(keep=2) > 0 and stray.exists()
    assert vault.log.versions() == sorted(before)
    assert {v: Vault(spark, vault.path, version=v).table("memories").count() for v in before} == before
    assert vault.vacuum(keep=2, unused_before_ms=2**62) == 1 and not stray.exists()
    assert vault.table("memories").count() == 3


def test_markdown_is_read_back(spark, vault, tmp_path):
    vault.link(spark.createDataFrame([("a", "b", "uses", 2.0)], "source_id string, target_id string, relation string, weight double"))
    vault.export_markdown(str(tmp_path / "out"))
    fresh = Vault(spark, str(tmp_path / "fresh"))
    fresh.import_files(str(tmp_path / "out"), "2024-05-01")
    fields = ["id", "category", "title", "content", "tags", "confidence", "provenance", "created_at"]
    rows = lambda v: sorted(map(str, v.table("memories").select(*fields).collect()))
    assert rows(fresh) == rows(vault) and fresh.version == 1
    assert [(r["source_id"], r["target_id"], r["relation"], r["weight"]) for r in fresh.table("links").collect()] == [("a", "b", "uses", 2.0)]


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("s1", "Learned that streams end"), ("s2", "Deadline is Friday")], "id string, content string")
    rows.write.json(str(tmp_path / "in"))
    vault = Vault(spark, str(tmp_path / "v"))
    stream = spark.readStream.schema("id string, content string").json(str(tmp_path / "in"))
    ingest.remember_stream(stream, vault, str(tmp_path / "cp"), lambda batch: f"2024-01-0{batch + 1} 10:00:00").awaitTermination()
    assert {str(r["created_at"]) for r in vault.table("memories").collect()} == {"2024-01-01 10:00:00"}
    assert {r["category"] for r in vault.table("memories").select(F.col("category")).collect()} == {"learning", "commitment"}


def test_vectors_of_another_embedder_are_refused_until_reindexed(spark, vault):
    class Flat:
        identity, dims = "card-v1:flat", 2

        def embed_batch(self, texts):
            return np.ones((len(texts), 2), dtype=np.float32)

    other = Vault(spark, vault.path, Flat())
    row = spark.createDataFrame([("d", "Quartz")], "id string, content string")
    for use in (lambda: other.recall("port"), lambda: other.remember(row, "2024-01-02"), lambda: vault.merge(Vault(spark, vault.path + "-none")) and other.merge(vault)):
        with pytest.raises(ValueError, match="reindex"):
            use()
    other = Vault(spark, vault.path, Flat())
    other.reindex()
    assert {len(r["embedding"]) for r in other.table("vectors").collect()} == {2}
    with pytest.raises(ValueError, match="reindex"):
        Vault(spark, vault.path).recall("port")


def test_bundles_are_verified_before_they_are_taken_over(spark, vault, tmp_path):
    file = spark.createDataFrame([("a", "n.txt", bytearray(b"hello"))], "memory_id string, filename string, data binary")
    file = file.withColumn("sha256", F.sha2("data", 256)).withColumn("size_bytes", F.octet_length("data").cast("long")).withColumn("media_kind", F.lit("document"))
    vault.commit(attachments=file)
    vault.autolink()
    vault.export_bundle(str(tmp_path / "good"))
    fresh = Vault(spark, str(tmp_path / "fresh"))
    said = fresh.inspect_bundle(str(tmp_path / "good"))
    assert (said["records"], said["files"], said["bytes"]) == (3, 1, 5)
    fresh.import_bundle(str(tmp_path / "good"))
    for name in ("memories", "vectors", "attachments"):
        assert sorted(map(str, fresh.table(name).collect())) == sorted(map(str, vault.table(name).collect()))
    assert fresh.table("links").count() == vault.table("links").count() > 0

    changes = {
        "attachments": {"attachments": file.withColumn("sha256", F.lit("00"))},
        "lacks": {"vectors": vault.table("vectors").withColumn("id", F.lit("none"))},
        "manifest": {"memories": vault.table("memories").limit(2)},
    }
    version = fresh.version
    for k, (message, change) in enumerate(changes.items()):
        bad = Vault(spark, str(tmp_path / f"bad{k}"))
        bad.commit(**{name: vault.table(name) for name in vault.entry["tables"]})
        vault.manifest().write.json(f"{bad.path}/manifest")
        bad.commit(**change)
        bad._hashes().write.parquet(f"{bad.path}/hashes")
        with pytest.raises(ValueError, match=message):
            fresh.import_bundle(bad.path)
    assert Vault(spark, fresh.path).version == version


@pytest.mark.parametrize("table", ["memories", "postings"])
def test_a_flipped_byte_is_refused_and_restores_are_whole(spark, vault, tmp_path, table):
    path = tmp_path / "bundle"
    vault.export_bundle(str(path))
    other = Vault(spark, str(tmp_path / "other"))
    other.remember(said(spark, [("x", "Held before")]), "2024-01-01")
    file = next(f for f in sorted(path.glob(f"tables/{table}-*/**/*.parquet")))
    whole = file.read_bytes()
    for checksum in file.parent.glob(f".{file.name}.crc"):
        checksum.unlink()
    file.write_bytes(whole[: len(whole) // 2] + bytes([whole[len(whole) // 2] ^ 1]) + whole[len(whole) // 2 + 1 :])
    with pytest.raises(ValueError, match="files"):
        other.restore_bundle(str(path))
    assert Vault(spark, other.path).version == 1 and [r["id"] for r in other.table("memories").collect()] == ["x"]
    file.write_bytes(whole)
    other.restore_bundle(str(path))
    assert {r["id"] for r in Vault(spark, other.path).table("memories").collect()} == {"a", "b", "c"}
    assert other.recall("port 5432").first()["id"] == "a"
    other.roll_back(1)
    assert [r["id"] for r in Vault(spark, other.path).table("memories").collect()] == ["x"] and other.recall("held").first()["id"] == "x"


def test_attachments_become_files(spark, tmp_path):
    rows = [("a", "n.txt", b"one"), ("b", "n.txt", b"two"), ("c", "n.txt", b"one"), ("d", "noext", b""), ("e", "n.tar.gz", bytes(range(256)))]
    df = spark.createDataFrame([(*r[:2], bytearray(r[2])) for r in rows], "memory_id string, filename string, data binary").withColumn("sha256", F.sha2("data", 256))
    out = tmp_path / "out"
    for _ in range(2):  # the second time all is there already
        files.export(df.repartition(3), f"file://{out}")
        found = {p.name: p.read_bytes() for p in out.iterdir()}
        assert {k: v for k, v in found.items() if not k.startswith("n_")} == {"n.txt": b"one", "noext": b"", "n.tar.gz": bytes(range(256))}
        (other,) = (k for k in found if k.startswith("n_"))
        assert other.endswith(f"_{hashlib.sha256(b'two').hexdigest()[:8]}.txt") and found[other] == b"two"
    with pytest.raises(Exception, match="hash"):
        files.export(df.withColumn("sha256", F.lit("00")), f"file://{tmp_path}/bad")
    assert not list((tmp_path / "bad").iterdir())


def test_long_chains_of_conflicts_are_settled_in_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(components, "cut", lambda df, real=components.cut: rounds.append(1) or real(df))
    n = 10_000
    pairs = spark.range(n).select(F.format_string("n%06d", "id").alias("older_id"), F.format_string("n%06d", F.col("id") + 1).alias("newer_id"), (1 - F.col("id") / n).alias("similarity"), F.lit(1.0).alias("overlap_ratio"))
    assert conflict.resolved(pairs).count() == n  # each pair's newer record is retired only after it
    assert len(rounds) <= 2 + 2 * 20
    back = pairs.withColumn("similarity", 1 - F.col("similarity"))
    assert conflict.resolved(back).count() == n // 2
    few = pairs.where("older_id < 'n000030'")
    one, two = conflict.resolved(few), conflict.resolved(few, scanned=3)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_backups_carry_all_tables(spark, vault, tmp_path):
    file = spark.createDataFrame([("a", "n.txt", bytearray(b"hello"), 5)], "memory_id string, filename string, data binary, size_bytes long").withColumn("sha256", F.sha2("data", 256))
    slots = spark.createDataFrame([("b", "cache", "Redis")], "memory_id string, entity_name string, entity_val string")
    vault.commit(attachments=file, entities=slots, links=spark.createDataFrame([("a", "b", "uses", 2.0)], "source_id string, target_id string, relation string, weight double"))
    vault.export_backup(str(tmp_path / "backup"))
    fresh = Vault(spark, str(tmp_path / "fresh"))
    for _ in range(2):  # again: nothing doubles
        fresh.import_backup(str(tmp_path / "backup"))
        for name in ("memories", "attachments", "entities", "links"):
            assert sorted(map(str, fresh.table(name).collect())) == sorted(map(str, vault.table(name).collect())), name
    ids_are_unique(fresh)
