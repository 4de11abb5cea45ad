"""SentencePiece encoding and decoding of documents of any size.

The model at hand merges pairs by rank (BPE), so its pieces are not a best path and
a max-plus scan over piece scores gives other pieces than the library; see the
README for the figures. What holds for it instead: no piece of the vocabulary has the
space mark after another character, so pieces never reach across a single space
between two other characters. Giant documents are cut there into chunks of about
``CHUNK`` characters, which are dealt out, encoded and decoded independently, and
joined in order. A chunk's first space is the one that the library puts before a text.
A run without such a place stays in one chunk.

Defined cases: a null or empty text has no pieces and decodes to the empty text.
Repeated rows and rows without a doc_id are kept. Other columns are not carried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memvault.llm.common import written

CHUNK = 32_768
#: Chunks that are encoded or decoded at a time.
SLICE = 64
_MARK = "▁"
_CUT = re.compile(rf"(?<=[^\s{_MARK}]) (?=[^\s{_MARK}])")


@cache
def load(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@cache
def may_cut(path: str) -> bool:
    """Whether no piece has the space mark after another character."""
    model = load(path)
    return not any(_MARK in model.id_to_piece(i).lstrip(_MARK) for i in range(model.get_piece_size()))


def chunks(text: str, size: int = CHUNK) -> Iterator[str]:
    """text without the spaces at which it is cut."""
    start = 0
    while len(text) - start > size and (cut := _CUT.search(text, start + size)):
        yield text[start : cut.start()]
        start = cut.end()
    yield text[start:]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of SLICE rows: Python lists of ids take many times the memory of the texts."""
    for batch in batches:
        for start in range(0, len(batch), SLICE):
            yield batch.slice(start, SLICE)


def encode(documents: DataFrame, model: str, *, text: str = "text", size: int = CHUNK) -> DataFrame:
    """Written: (row, doc_id, chunk, chunks, ids): each chunk's ids as little-endian unsigned 32-bit numbers."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            rows = []
            for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = list(chunks(body or "", size)) if may_cut(model) else [body or ""]
                rows += [(number, doc_id, k, len(parts), part) for k, part in enumerate(parts)]
                number += 1
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["row", "doc_id", "chunk", "chunks", "part"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = load(model)
        for batch in _slices(batches):
            found = sp.encode(batch.column(4).to_pylist(), num_threads=1)
            ids = pa.array([np.array(x, dtype="<u4").tobytes() for x in found], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], ids], names=["row", "doc_id", "chunk", "chunks", "ids"])

    ddl = "row long, doc_id long, chunk int, chunks int"
    parts = documents.select("doc_id", F.col(f"`{text}`")).mapInArrow(cut, ddl + ", part string")
    return written(parts.mapInArrow(pieces, ddl + ", ids binary"), "pieces")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """encoded with part, each chunk's text."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = load(model)
        for batch in _slices(batches):
            ids = [np.frombuffer(x.as_buffer(), dtype="<u4").tolist() for x in batch.column(4)]
            parts = pa.array(sp.decode(ids) if ids else [], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, parts], names=["row", "doc_id", "chunk", "chunks", "ids", "part"])

    columns = encoded.select("row", "doc_id", "chunk", "chunks", "ids")
    return columns.mapInArrow(texts, "row long, doc_id long, chunk int, chunks int, ids binary, part string")


def joined(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids, text) per document of encode()'s chunks, each decoded once; only documents of several chunks are shuffled."""
    one = decode(encoded.where("chunks = 1"), model).select("doc_id", "ids", F.col("part").alias("text"))
    many = (
        decode(encoded.where("chunks > 1"), model)
        .groupBy("row", "doc_id")
        .agg(F.array_sort(F.collect_list(F.struct("chunk", "ids", "part"))).alias("p"))
        .select(
            "doc_id",
            F.expr("aggregate(p, cast('' as binary), (a, x) -> a || x.ids)").alias("ids"),
            F.array_join("p.part", " ").alias("text"),
        )
    )
    return one.unionByName(many)
