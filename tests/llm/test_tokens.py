"""Packing and chunk-reusing BPE against the tokenizers library."""

import os

import numpy as np
import pytest

from tabwright.llm import bpe, chunk_coding, packing, queries
from tests.llm import brute
from tests.llm.conftest import EDGE_ROWS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return brute.library(bpe.default_tokenizer_path())


@pytest.fixture(scope="module")
def coder():
    return bpe.load(bpe.default_tokenizer_path())


def test_engine_equals_the_library(library, coder):
    texts = [t or "" for _, t, _ in EDGE_ROWS]
    # Every character that takes the fast way, among letters, digits, marks and spaces.
    for c in range(0x240):
        texts += [f"a{chr(c)}b", f" {chr(c)} {chr(c)}{chr(c)}1", f"x{chr(c)}'s{chr(c)}  \n{chr(c)}"]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert coder.encode(text) == ids
        assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_decoding_of_broken_characters(library, coder):
    for ids in ([222], [50256, 34], [173, 188, 255], [47249, 236]):
        assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_chunks_cover_the_text_and_repeat():
    rng = np.random.default_rng(5)
    words = [bytes(rng.integers(97, 123, rng.integers(2, 9), dtype=np.uint8)) for _ in range(20_000)]
    shared = b" ".join(words[:4000])
    a, b = b" ".join(words[4000:6000]) + b" " + shared, "é".encode() * 999 + b" " + shared
    for raw in (a, b, b"", b"x", "é".encode() * 20_000):
        ends = chunk_coding.chunk_ends(raw)
        assert ends == sorted(set(ends)) and (ends[-1:] == [len(raw)] if raw else ends == [])
        assert all(len(raw) == e or raw[e] & 0xC0 != 0x80 for e in ends)
        assert all(y - x <= chunk_coding.MOST + 3 for x, y in zip([0, *ends], ends, strict=False))
    found = [{h for _, _, h in chunk_coding.chunks(raw, chunk_coding.chunk_ends(raw))} for raw in (a, b)]
    assert len(found[0] & found[1]) >= 0.7 * len(chunk_coding.chunk_ends(shared))


def test_texts_cut_together_are_cut_as_alone():
    """By the rule itself: a hash of the 32 bytes up to an end, byte by byte."""
    rng = np.random.default_rng(8)
    sizes = [0, 1, chunk_coding.LEAST, chunk_coding.LEAST + 1, 3000, 700, 20_000, 0, 900, chunk_coding.BLOCK + 5000, 5000]
    texts = [bytes(rng.integers(97, 123, n, dtype=np.uint8)) for n in sizes]
    texts += ["é😀".encode() * 4000, b"x" * 40_000]

    def ends_of(raw):
        marks, h, gear = set(), 0, chunk_coding._GEAR.tolist()
        for i, byte in enumerate(raw):
            h = (h << 1) + gear[byte] & 0xFFFFFFFF
            if h >> 22 == 0:
                marks.add(i + 1)
        ends, at = [], 0
        while len(raw) - at > chunk_coding.LEAST:
            last = min(at + chunk_coding.MOST, len(raw))
            at = next((e for e in range(at + chunk_coding.LEAST, last) if e in marks), last)
            while at < len(raw) and raw[at] & 0xC0 == 0x80:
                at += 1
            ends.append(at)
        return ends + [len(raw)] * (at < len(raw))

    marks, base = chunk_coding._marks(b"".join(texts)), 0
    for raw in texts:
        assert chunk_coding.chunk_ends(raw, marks, base) == chunk_coding.chunk_ends(raw) == ends_of(raw)
        base += len(raw)


@pytest.mark.parametrize("raw", [b"a b c d", b"x  y z", b" a b", b"a b ", b"nospace", "é é a b é".encode()])
def test_core_is_between_agreeing_cuts(raw, coder):
    kept = chunk_coding.core(raw)
    if kept:
        first, last = kept
        for before, after in ((b"", b""), (b"zz", b"zz"), (b" ", b" "), (b"'", b"s")):
            whole = before + raw + after
            parts = [whole[: len(before) + first], raw[first:last], raw[last:] + after]
            assert coder.encode(whole.decode()) == [i for p in parts for i in coder.encode(p.decode())]


def test_encode_equals_the_library(spark, edge, nothing, library):
    found = sorted((str(r["doc_id"]), r["ids"].hex()) for r in chunk_coding.encode(edge).collect())
    want = sorted((str(i), np.array(library.encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes().hex()) for i, t, _ in EDGE_ROWS)
    assert found == want
    assert chunk_coding.encode(nothing).count() == 0


def test_shared_chunks_are_used(spark, library):
    """Long texts that share most of their chunks take the dictionary's ids."""
    rng = np.random.default_rng(3)
    words = [bytes(rng.integers(97, 123, rng.integers(2, 9), dtype=np.uint8)).decode() for _ in range(6000)]
    texts = [" ".join([*words[i * 7 : i * 7 + 5], *words[: 3000 + i]]) for i in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bits = chunk_coding.shared_filter(docs.select("doc_id", "text"))
    assert 5 < np.unpackbits(bits).sum() < 200
    found = {r["doc_id"]: np.frombuffer(r["ids"], dtype="<u4").tolist() for r in chunk_coding.encode(docs).collect()}
    assert found == {i: library.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}


def test_op6_equals_brute_force(spark, small, library):
    want = brute.op6(small, library)
    assert {r[0]: tuple(r)[1:4] for r in queries.op6_bpe(spark, SF).collect()} == want


def check_pieces(rows, want, window=2048):
    """rows: (doc_id, start, length, crc, doc_tokens, sequence, offset) of documents with unique ids."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r[0], []).append(r)
        by_sequence.setdefault(r[5], []).append(r)
    assert by_doc.keys() == want.keys()
    for i, pieces in by_doc.items():
        at = 0
        for _, start, length, crc, tokens, _, _ in sorted(pieces, key=lambda r: r[1]):
            assert start == at and tokens == len(want[i]) and crc == brute.crc_of_ids(want[i][start : start + length])
            at += length
        assert at == len(want[i])
    for s, pieces in by_sequence.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r[6]):
            assert r[6] == at
            at += r[2]
        assert at == window or s == max(by_sequence)
    assert sorted(by_sequence) == list(range(len(by_sequence)))


def test_op4_equals_brute_force(spark, small, library):
    check_pieces([tuple(r) for r in queries.op4_packing(spark, SF).collect()], brute.op4(small, library))


def test_packing_of_edge_rows(spark, edge, nothing, library):
    pieces = packing.pack(edge, window=100).collect()
    total = sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in EDGE_ROWS)
    assert sum(r["length"] for r in pieces) == total
    joined = sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"]))
    assert [r["sequence_id"] * 100 + r["offset"] for r in joined] == np.cumsum([0, *[r["length"] for r in joined]])[:-1].tolist()
    stream = b"".join(r["ids"] for r in joined)
    docs = [np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes() for _, t, _ in EDGE_ROWS]
    at = 0
    rest = sorted(docs)
    while rest:  # every document once, one after another
        doc = next(d for d in sorted(rest, key=len, reverse=True) if stream.startswith(d, at))
        rest.remove(doc)
        at += len(doc)
    assert at == len(stream)
    assert packing.pack(nothing).count() == 0


def test_no_tokenizer_in_the_repository():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert not [f for _, _, names in os.walk(root) for f in names if f.endswith((".tiktoken", ".model"))]
