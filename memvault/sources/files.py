"""Attachments as files: a sink that writes each file under a name of its own in a folder that all executors reach."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Where files lie until they are whole.
_STAGING = "_staging-"


def named(attachments: DataFrame) -> DataFrame:
    """(name, sha256, data): a file for each file name and content.

    Of several contents under one name that of the least memory_id keeps it; the others get a number and the beginning of their
    hash. Numbers rise in the order of names and owners and may leave some out, so that a name that most files have is no group of its own.
    """
    one = attachments.groupBy("filename", "sha256").agg(F.min("memory_id").alias("owner"))
    first = one.groupBy("filename").agg(F.min(F.struct("owner", "sha256")).alias("first"))
    order = ["filename", "owner", "sha256"]
    placed = one.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("n", F.monotonically_increasing_id() + 1)
    stem, extension = F.regexp_extract("filename", r"^(.+?)(\.[^.]*)?$", 1), F.regexp_extract("filename", r"^.+?(\.[^.]*)?$", 1)
    other = F.concat(stem, F.lit("_"), F.col("n").cast("string"), F.lit("_"), F.substring("sha256", 1, 8), extension)
    names = placed.join(first, "filename").select("filename", "sha256", "owner", F.when(F.struct("owner", "sha256") == F.col("first"), F.col("filename")).otherwise(other).alias("name"))
    data = attachments.select("filename", "sha256", F.col("memory_id").alias("owner"), "data")
    return names.join(data, ["filename", "sha256", "owner"]).dropDuplicates(["name"]).select("name", "sha256", "data")


def export(attachments: DataFrame, path: str) -> None:
    """Writes attachments, whose bytes must agree with their hashes, as files under a path or URI; the same file there already stays as it is."""
    attachments.sparkSession.dataSource.register(FileSink)
    named(attachments).write.format(FileSink.name()).mode("append").option("path", path).option("job", uuid.uuid4().hex).save()


@dataclass
class Saved(WriterCommitMessage):
    files: int


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vault_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FileWriter(self.options["path"], self.options["job"])


class FileWriter(DataSourceWriter):
    """A file is written aside, then moved to its name, so nobody sees half of it; what is left aside goes when the job ends, well or not."""

    def __init__(self, path: str, job: str):
        self.path, self.job = path, job

    def _root(self) -> tuple[fs.FileSystem, str]:
        system, root = fs.FileSystem.from_uri(self.path)
        return system, root.rstrip("/")

    def write(self, rows: Iterator[Row]) -> Saved:
        system, root = self._root()
        aside = f"{root}/{_STAGING}{self.job}"
        system.create_dir(aside)
        attempt, n = TaskContext.get().taskAttemptId(), 0
        for name, sha256, data in rows:
            data = bytes(data)
            if hashlib.sha256(data).hexdigest() != sha256:
                raise ValueError(f"the bytes of {name} don't agree with their hash")
            target = f"{root}/{name}"
            there = system.get_file_info(target)
            n += 1
            if there.type == fs.FileType.File:
                if there.size == len(data) and system.open_input_file(target).readall() == data:
                    continue
                raise FileExistsError(f"another file is at {target}")
            part = f"{aside}/{attempt}-{n}"
            with system.open_output_stream(part) as out:
                out.write(data)
            system.move(part, target)
        return Saved(n)

    def _clean(self) -> None:
        system, root = self._root()
        aside = f"{root}/{_STAGING}{self.job}"
        if system.get_file_info(aside).type == fs.FileType.Directory:
            system.delete_dir(aside)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clean()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clean()
