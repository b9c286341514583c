"""Token sequences of one length by concatenate and cut.

All documents, in the order in which they are read, make one stream of ids.
A first pass encodes them, notes how many ids of its own partition stand before
each document, and writes this. Prefix sums over the partitions' totals, a row a
partition, then give every document its place in the whole stream. A second pass
cuts documents where a window of the stream ends, without moving any row. Only
the last window can be short. A window's pieces are its boundary records: which
document, from where in it, at which offset of the window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm import bpe
from tabwright.llm.common import materialize, partition_offsets

BATCH_BYTES = 8_000_000


def _encode_partition(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(path)
        kind = "<u2" if coder.size <= 1 << 16 else "<u4"
        before = 0
        for batch in batches:
            rows, size = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*coder.encode(text.as_py() or ""), end_id], dtype=kind)
                rows.append((doc_id, ids.tobytes(), len(ids), before, ids.itemsize))
                before += len(ids)
                size += ids.nbytes
                if size >= BATCH_BYTES:
                    yield _batch(rows, batch.column(0).type)
                    rows, size = [], 0
            yield _batch(rows, batch.column(0).type)

    def _batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 5
        types = [id_type, pa.binary(), pa.int64(), pa.int64(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "ids", "doc_tokens", "before", "width"])

    return run


def _cut_partition(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id_type = batch.column(0).type
            rows, size = [], 0
            for doc_id, raw, tokens, place, width in zip(batch.column(0).to_pylist(), batch.column(1), *(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                ids = np.frombuffer(raw.as_buffer(), dtype=f"<u{width}").astype("<u4")
                at = 0
                while at < tokens:
                    sequence, offset = divmod(place + at, window)
                    length = min(window - offset, tokens - at)
                    rows.append((doc_id, at, length, tokens, sequence, offset, ids[at : at + length].tobytes()))
                    at += length
                    size += 4 * length
                    if size >= BATCH_BYTES:
                        yield _pieces(rows, id_type)
                        rows, size = [], 0
            yield _pieces(rows, id_type)

    def _pieces(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 7
        types = [id_type, *[pa.int64()] * 5, pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    return run


def pack(docs: DataFrame, window: int = 2048, text_col: str = "text", id_col: str = "doc_id", tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    """Pieces of documents in sequences of ``window`` ids.

    (doc_id, start, length, doc_tokens, sequence_id, offset, ids): start counts
    the document's ids before the piece, doc_tokens all its ids with end_id,
    offset the sequence's ids before the piece; ids are little-endian unsigned
    32-bit integers. Every id is in one piece and every sequence but the last is
    full, so at most window - 1 ids of padding are needed in all. A null or empty
    text is end_id alone. Repeated rows, and rows of a null id, are documents
    each. An empty table gives no pieces; other columns are passed over. A text
    is held whole by one task, never more than a batch of texts.
    """
    path = tokenizer or bpe.default_tokenizer_path()
    id_type = docs.schema[id_col].dataType.simpleString()
    coded = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _encode_partition(path, end_id), f"doc_id {id_type}, ids binary, doc_tokens long, before long, width int"
    )
    coded = materialize(coded.withColumn("part", F.spark_partition_id()), "packing", compression="zstd")
    offsets = partition_offsets(coded, F.col("doc_tokens"), part=F.col("part")).withColumnRenamed("before", "base")
    placed = coded.join(F.broadcast(offsets), "part")  # a row a partition
    return placed.select("doc_id", "ids", "doc_tokens", (F.col("base") + F.col("before")).alias("place"), "width").mapInArrow(
        _cut_partition(window), f"doc_id {id_type}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    )
