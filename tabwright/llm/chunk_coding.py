"""BPE encoding that reuses the chunks that documents share, and decoding.

Texts are cut by content: a chunk ends where a rolling hash of the last 32 bytes
has its low bits zero, so that equal passages are cut alike wherever they stand.
Chunks that come more than once are found by counting their hashes, gathered by
hash and encoded once; the rest is encoded where it lies.

Ids of a chunk alone needn't be its ids in a text, as tokens at its edges depend
on what is beside it. But between a printable ASCII character, one space and a
further printable ASCII character the encoder always splits, before the space and
whatever the context, so there both encodings agree. A shared chunk's ids are kept
between its first and last such cut. Each join is repaired by encoding anew, from
the last cut on its left to the first on its right, and on through chunks that
have no two cuts, until it reaches a place of agreement on both sides.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm import bpe
from tabwright.llm.common import materialize

#: Bytes of a chunk: the least, the most, and how many on average past the least.
LEAST, MOST, MEAN = 512, 16_384, 1024
#: Bits of the filter of shared hashes that workers hold: 4 MB whatever the input.
FILTER_BITS = 25
BATCH_BYTES = 8_000_000
#: Bytes that are hashed at once; texts are hashed together until they have so many.
BLOCK = 1 << 16
SAFE_CUT = re.compile(rb"(?<=[!-~]) (?=[!-~])")
_GEAR = np.random.default_rng(20240501).integers(0, 1 << 32, 256, dtype=np.uint32)


def _rolling(raw: np.ndarray) -> np.ndarray:
    """Gear hash of the 32 bytes up to each byte, by doubling."""
    h = _GEAR.take(raw)
    for step in (1, 2, 4, 8, 16):
        h[step:] += h[:-step] << np.uint32(step)
    return h


def _marks(raw: bytes) -> list[int]:
    """Ends of all bytes at which a chunk may end."""
    codes, found = np.frombuffer(raw, dtype=np.uint8), []
    for at in range(0, len(codes), BLOCK):
        before = min(at, 31)  # what the first hashes look back on
        h = _rolling(codes[at - before : at + BLOCK])[before:]
        # High bits, as these depend on all 32 bytes.
        found += (np.flatnonzero(h >> np.uint32(32 - MEAN.bit_length() + 1) == 0) + (at + 1)).tolist()
    return found


def chunk_ends(raw: bytes, marks: list[int] | None = None, base: int = 0) -> list[int]:
    """Ends of the chunks of UTF-8 bytes, none inside a character; [] for none.

    marks: those of bytes that hold raw from base on. What lies before it has no
    say, as a chunk's first LEAST bytes exceed what a hash looks back on.
    """
    size = len(raw)
    if size <= LEAST:
        return [size] if size else []
    if marks is None:
        marks = _marks(raw)
    ends, at = [], 0
    while size - at > LEAST:
        k = bisect_left(marks, base + at + LEAST)
        end = min(marks[k] - base if k < len(marks) else size, at + MOST, size)
        while end < size and raw[end] & 0xC0 == 0x80:
            end += 1
        ends.append(end)
        at = end
    if at < size:
        ends.append(size)
    return ends


def chunks(raw: bytes, ends: list[int]) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, 128-bit hash) of each chunk."""
    at = 0
    for end in ends:
        yield at, end, xxhash.xxh3_128_digest(raw[at:end])
        at = end


def core(chunk: bytes) -> tuple[int, int] | None:
    """First and last place where a chunk's encoding agrees with any text's around it, if these are two."""
    first = SAFE_CUT.search(chunk)
    if not first:
        return None
    at = len(chunk)
    while (at := chunk.rfind(b" ", 0, at)) > first.start():
        if SAFE_CUT.match(chunk, at):
            return first.start(), at
    return None


def _slot(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big") >> (64 - FILTER_BITS)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in record batches of bounded bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) if isinstance(x, (bytes, str)) else 8 for x in row)
        if size >= BATCH_BYTES:
            yield _batch(held, schema)
            held, size = [], 0
    yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes, list[int]]]:
    """(doc_id, UTF-8, ends of its chunks) of each row, a null text as none."""

    def cut(rows: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes, list[int]]]:
        marks, base = _marks(b"".join(raw for _, raw in rows)), 0
        for doc_id, raw in rows:
            yield doc_id, raw, chunk_ends(raw, marks, base)
            base += len(raw)

    for batch in batches:
        held, size = [], 0
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary()), strict=True):
            held.append((doc_id, text.as_py() or b""))
            size += len(held[-1][1])
            if size >= BLOCK:
                yield from cut(held)
                held, size = [], 0
        yield from cut(held)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each distinct chunk of a text, and how often it has it."""
    schema = pa.schema([("hash", pa.binary()), ("times", pa.int64())])

    def rows() -> Iterator[tuple]:
        for _, raw, ends in _texts(batches):
            found: dict[bytes, int] = {}
            for _, _, digest in chunks(raw, ends):
                found[digest] = found.get(digest, 0) + 1
            yield from found.items()

    return _batches(rows(), schema)


def _parts(raw: bytes, ends: list[int], shared: np.ndarray) -> Iterator[tuple[bytes | None, int, int]]:
    """A text's parts in order: (hash, start, end) of the cores of chunks in the filter, (None, start, end) of what is between."""
    at = 0
    for start, end, digest in chunks(raw, ends):
        slot = _slot(digest)
        if shared[slot >> 3] >> (slot & 7) & 1 and (kept := core(raw[start:end])):
            if start + kept[0] > at:
                yield None, at, start + kept[0]
            yield digest, start + kept[0], start + kept[1]
            at = start + kept[1]
    if at < len(raw):
        yield None, at, len(raw)


def _dictionary_texts(shared):
    """Each task's shared cores, each once in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()

        def rows() -> Iterator[tuple]:
            for _, raw, ends in _texts(batches):
                for digest, a, b in _parts(raw, ends, shared.value):
                    if digest is not None and digest not in seen:
                        seen.add(digest)
                        yield digest, raw[a:b]

        return _batches(rows(), pa.schema([("hash", pa.binary()), ("core", pa.binary())]))

    return run


def _ids(coder: bpe.ByteBpe, raw: bytes) -> bytes:
    return np.array(coder.encode(raw.decode()), dtype="<u4").tobytes()


def _encode_dictionary(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(path)
        rows = ((digest.as_py(), _ids(coder, text.as_py())) for batch in batches for digest, text in zip(batch.column(0), batch.column(1), strict=True))
        return _batches(rows, pa.schema([("hash", pa.binary()), ("ids", pa.binary())]))

    return run


def _encode_alone(path: str, shared, decoded: bool):
    """Ids of the texts without shared cores, and the text that these ids decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(path)
        for batch in batches:

            def rows() -> Iterator[tuple]:
                for doc_id, raw, ends in _texts([batch]):
                    if all(digest is None for digest, _, _ in _parts(raw, ends, shared.value)):
                        ids = coder.encode(raw.decode())
                        yield doc_id, np.array(ids, dtype="<u4").tobytes(), *([coder.decode(ids)] if decoded else [])

            kinds = [("ids", pa.binary()), *([("decoded", pa.string())] if decoded else [])]
            yield from _batches(rows(), pa.schema([("doc_id", batch.schema.field("doc_id").type), *kinds]))

    return run


def _encode_parts(path: str, shared):
    """Parts of the texts with shared cores: hashes of these, ids of what is between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(path)
        for batch in batches:

            def rows() -> Iterator[tuple]:
                for key, (doc_id, raw, ends) in zip(batch.column("key").to_pylist(), _texts([batch]), strict=True):
                    parts = list(_parts(raw, ends, shared.value))
                    if any(digest is not None for digest, _, _ in parts):
                        for place, (digest, a, b) in enumerate(parts):
                            yield doc_id, key, place, digest, None if digest is not None else _ids(coder, raw[a:b])

            kinds = [("key", pa.int64()), ("place", pa.int64()), ("hash", pa.binary()), ("own", pa.binary())]
            yield from _batches(rows(), pa.schema([("doc_id", batch.schema.field("doc_id").type), *kinds]))

    return run


def shared_filter(texts: DataFrame) -> np.ndarray:
    """Bits of the hash prefixes of chunks that come twice or more, as bytes.

    Its size is fixed, and so is what reaches the driver: at most as many rows as
    it has 64-bit words, however many chunks there are. A chunk that only shares
    its prefix with a shared one is taken for shared, which costs its way through
    the dictionary and changes no result.
    """
    counts = texts.mapInArrow(_hashes, "hash binary, times long").groupBy("hash").agg(F.sum("times").alias("times")).filter("times > 1")
    prefix = F.conv(F.hex(F.substring("hash", 1, 4)), 16, 10).cast("long")
    at = F.shiftright(prefix, 32 - FILTER_BITS)
    words = counts.select(at.alias("at")).select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at % 64 AS int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(1 << (FILTER_BITS - 6), dtype="<i8")
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return table.view(np.uint8)


def encode(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", tokenizer: str | None = None, decoded: bool = False) -> DataFrame:
    """(doc_id, ids), a row for each row of docs; ids are little-endian unsigned 32-bit integers.

    decoded: also the text that the ids decode to, which spares handing the ids to
    a further Python worker.

    The ids are those of the tokenizers library for the whole text without added
    special tokens. A null or empty text has no ids. Repeated rows and null ids
    keep their rows; an empty table gives none; other columns are passed over.
    A task holds one text, or one text's parts, at a time and a batch of them.
    """
    path = tokenizer or bpe.default_tokenizer_path()
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("key"))
    texts = keyed.select("doc_id", "text")
    id_field = f"doc_id {docs.schema[id_col].dataType.simpleString()}"
    shared = docs.sparkSession.sparkContext.broadcast(shared_filter(texts))
    cores = texts.mapInArrow(_dictionary_texts(shared), "hash binary, core binary").groupBy("hash").agg(F.min("core").alias("core"))
    dictionary = materialize(cores.mapInArrow(_encode_dictionary(path), "hash binary, ids binary"), "bpe-dictionary", compression="zstd")
    alone = texts.mapInArrow(_encode_alone(path, shared, decoded), f"{id_field}, ids binary" + ", decoded string" * decoded)
    parts = keyed.mapInArrow(_encode_parts(path, shared), f"{id_field}, key long, place long, hash binary, own binary")
    parts = materialize(parts, "bpe-parts", compression="zstd")
    # Only references meet the dictionary; a text's own parts go around the join.
    own = parts.filter("hash IS NULL").select("key", "doc_id", "place", F.col("own").alias("ids"))
    references = parts.filter("hash IS NOT NULL").join(dictionary, "hash").select("key", "doc_id", "place", "ids")
    whole = (
        own.unionAll(references)
        .groupBy("key")
        .agg(F.min("doc_id").alias("doc_id"), F.collect_list(F.struct("place", "ids")).alias("parts"))  # of one document
    )
    joined = F.unhex(F.array_join(F.transform(F.sort_array("parts"), lambda part: F.hex(part["ids"])), ""))
    found = whole.select("doc_id", joined.alias("ids"))
    return alone.unionAll(found.withColumn("decoded", decode(F.col("ids"), path)) if decoded else found)


def decode(ids: Column, tokenizer: str | None = None) -> Column:
    """Text of a binary column of ids, special tokens kept; null for null."""
    path = tokenizer or bpe.default_tokenizer_path()

    @F.pandas_udf("string")
    def run(coded: pd.Series) -> pd.Series:
        coder = bpe.load(path)
        return pd.Series([None if raw is None else coder.decode(np.frombuffer(raw, dtype="<u4").tolist()) for raw in coded], dtype="object")

    return run(ids)
