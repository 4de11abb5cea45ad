"""Packing token streams into fixed windows: concatenate and cut.

All documents' ids, each followed by an end id, make one stream in the order of
the input partitions. Pass 1 tokenizes and writes each document's ids with its
offset inside its partition; partition totals summed up in order give every
partition's base, so pass 2 knows each document's place in the stream and cuts it
at multiples of ``length`` without moving any ids. A document that crosses a
window's end leaves a boundary record on both sides. Only the very last window is
not full.

Defined cases: a null or empty text is its end id alone. Rows without a doc_id
and repeated rows are packed like any other. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memvault.llm import tokens
from memvault.llm.common import written

#: Ids that a batch of pass 1 gathers before it is handed on.
BATCH_IDS = 4_000_000
_ENCODED = "part int, part_offset long, doc_id long, n long, ids binary"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encoded(documents: DataFrame, tokenizer: str, *, text: str = "text", end_id: int = 0) -> DataFrame:
    """Pass 1, written: each document's ids with the end id, and its offset among its partition's ids."""
    schema = pa.schema([("part", pa.int32()), ("part_offset", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
    end = np.array([end_id], dtype="<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, offset, rows, held = TaskContext.get().partitionId(), 0, [], 0
        known = tokens.part_ids(tokenizer)

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for given in batches:
            ids = given.column(0).to_pylist()
            for doc_id, body in zip(ids, given.column(1), strict=True):
                data = (known.text_ids(body.as_py()) if body.is_valid and len(body.as_py()) else b"") + end
                rows.append((part, offset, doc_id, len(data) // 4, data))
                offset += len(data) // 4
                held += len(data) // 4
                if held >= BATCH_IDS:
                    yield batch()
                    rows, held = [], 0
        yield batch()

    rows = documents.select("doc_id", F.col(f"`{text}`"))
    return written(rows.mapInArrow(encode, _ENCODED), "token-ids")


def pack(
    documents: DataFrame, tokenizer: str, *, text: str = "text", length: int = 1024, end_id: int = 0, with_ids: bool = False
) -> DataFrame:
    """One row per piece: a document's ids inside one window (with_ids: and the ids as binary)."""
    ids = encoded(documents, tokenizer, text=text, end_id=end_id)
    # one row per input partition: the sums pass through one task, and are broadcast
    totals = ids.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    placed = ids.join(F.broadcast(base), "part").select("doc_id", "n", "ids", (F.col("base") + F.col("part_offset")).alias("at"))
    fields = _PIECES + (", ids binary" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, n, at, body in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), batch.column(2), strict=True):
                data = memoryview(body.as_buffer())
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, length)
                    size = min(n - start, length - offset)
                    piece = data[4 * start : 4 * (start + size)]
                    row = (doc_id, start, size, zlib.crc32(piece), n, sequence, offset)
                    rows.append((*row, bytes(piece)) if with_ids else row)
                    start += size
            columns = list(zip(*rows, strict=True)) or [[]] * (7 + with_ids)
            names = [f.split()[0] for f in fields.split(", ")]
            kinds = [pa.int64()] * 7 + [pa.binary()] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return placed.mapInArrow(cut, fields)


def sequences(pieces: DataFrame, length: int = 1024, pad_id: int = 0) -> DataFrame:
    """(sequence_id, n_ids, ids): the windows themselves from pieces with ids, at most length ids each.

    The last window is padded with pad_id unless its size is a power of two.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.expr("aggregate(_p, cast('' as binary), (a, x) -> a || x.ids)")
    n = F.octet_length("_b") / 4
    pad = F.expr(f"unhex(repeat('{pad_id.to_bytes(4, 'little').hex()}', {length} - cast(octet_length(_b) / 4 as int)))")
    whole = F.bit_count(n.cast("long")) == 1
    return (
        pieces.groupBy("sequence_id")
        .agg(parts.alias("_p"))
        .select("sequence_id", joined.alias("_b"))
        .select("sequence_id", n.cast("long").alias("n_ids"), F.when(whole, F.col("_b")).otherwise(F.concat("_b", pad)).alias("ids"))
    )
