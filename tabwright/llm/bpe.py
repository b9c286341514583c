"""Byte-level BPE from a tokenizer file, as the tokenizers library encodes and decodes.

The file's own library is the measure. Most text takes a second engine over the
same vocabulary that gives the same ids faster: text whose characters are below
U+0240, where both engines' character classes agree, and without very long runs
between spaces. Everything else goes through the tokenizers library itself.
"""

from __future__ import annotations

import functools
import json
import os

import numpy as np

#: How byte-level BPE splits text before merging; a fixed value of the format.
PRETOKEN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Above this byte, UTF-8 holds characters from U+0240 on.
LAST_PLAIN_BYTE = 0xC8
LONGEST_RUN = 2000


def default_tokenizer_path() -> str:
    """Where the installed public tokenizers keep the byte-level vocabulary of 50,257 ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 bytes stand for themselves, the rest take the characters
    from U+0100 on, in order.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """One tokenizer file, loaded once in a worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        alphabet = byte_alphabet()
        ids = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.size = max([*ids.values(), *self.added.values()]) + 1
        self.pieces = [b""] * self.size
        for piece, i in ids.items():
            self.pieces[i] = piece
        for content, i in self.added.items():
            self.pieces[i] = content.encode()
        self._fast = self._fast_engine(spec, ids)

    def _fast_engine(self, spec: dict, ids: dict[bytes, int]):
        """The second engine, where the file describes plain byte-level BPE; its ids must be the merges' order."""
        pre = spec.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer") and not spec.get("post_processor")
        simple = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in spec.get("added_tokens", []))
        merges = spec["model"].get("merges", [])
        alphabet = byte_alphabet()
        spelled = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in merges]
        in_order = all(ids.get(bytes(alphabet[c] for c in s)) == 256 + i for i, s in enumerate(spelled))
        if not (plain and simple and in_order):
            return None
        import tiktoken

        return tiktoken.Encoding("byte-level", pat_str=PRETOKEN_PATTERN, mergeable_ranks=ids, special_tokens={})

    @functools.cached_property
    def library(self):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return tokenizer

    def _is_plain(self, raw: bytes) -> bool:
        codes = np.frombuffer(raw, dtype=np.uint8)
        if codes.max() > LAST_PLAIN_BYTE:
            return False
        if len(codes) <= LONGEST_RUN:
            return True
        spaces = np.flatnonzero(codes == 32)
        return bool(np.diff(spaces, prepend=-1, append=len(codes)).max() <= LONGEST_RUN)

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, as the library gives them without adding special tokens."""
        if not text:
            return []
        if self._fast is None or any(content in text for content in self.added) or not self._is_plain(text.encode()):
            return self.library.encode(text, add_special_tokens=False).ids
        return self._fast.encode_ordinary(text)

    def decode(self, ids: list[int]) -> str:
        """Text of ids, special tokens kept; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)
