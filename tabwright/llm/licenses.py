"""License scans by template markup, compiled to automata over words.

A template is a sequence of words, of regions that may be left out and of
variables that stand for a bounded number of any words. It compiles to an
automaton whose states are places in the template. Reading a text's words, the
automaton holds the set of places that it can be at; it accepts when a place has
only optional regions left, and so only if all mandatory words stood there exactly
and in order. To spare most of the reading, an automaton starts only in texts that
hold the template's longest run of mandatory words, and only at its first words.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.license_templates import TEMPLATES

#: Phrases and their labels, found wherever their words stand one after another. Fixed values.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
MARKUP = re.compile(r"<<(beginOptional|endOptional|var)(;[^>]*)?>>")
#: Lower-cases A-Z, keeps digits, a-z and all bytes from 0x80, and makes the rest spaces.
_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))
BATCH_ROWS = 4096


def words_of(text: str | None) -> list[bytes]:
    """Words: runs of digits, letters a-z after lowering A-Z, and characters beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_BYTES).split()


@dataclass(frozen=True)
class Step:
    """One place of a template: a word to read or, without one, up to ``most`` of any words, ``least`` at least."""

    word: bytes | None
    least: int = 1
    most: int = 1


class Automaton:
    """A compiled template.

    moves[i] are the places that can follow place i at once, by leaving out
    regions; place len(steps) accepts.
    """

    def __init__(self, label: str, template: str):
        self.label = label
        self.steps: list[Step] = []
        skips: dict[int, list[int]] = {}  # start of a region -> ends
        opened: list[int] = []
        required: list[bool] = []
        at = 0
        for mark in [*MARKUP.finditer(template), None]:
            for word in words_of(template[at : mark.start() if mark else len(template)]):
                self.steps.append(Step(word))
                required.append(not opened)
            if mark is None:
                break
            at = mark.end()
            if mark[1] == "beginOptional":
                opened.append(len(self.steps))
            elif mark[1] == "endOptional":
                skips.setdefault(opened.pop(), []).append(len(self.steps))
            else:
                given = dict(x.split("=") for x in (mark[2] or "").strip(";").split(";") if "=" in x)
                least, most = int(given.get("min", 0)), int(given.get("max", 20))
                # A variable of up to so many words is so many places, of which the last can be left out.
                for k in range(most):
                    self.steps.append(Step(None))
                    required.append(False)
                first = len(self.steps) - most
                for k in range(least, most):
                    skips.setdefault(first + k, []).append(len(self.steps))
        if opened:
            raise ValueError(f"template {label} doesn't end an optional region")
        self.mandatory = sum(required)
        self.skips = skips
        self.start = self._closure({0})
        self.first = {self.steps[i].word for i in self.start if i < len(self.steps)}
        self.anchor = self._longest_run(required)

    def _closure(self, places: set[int]) -> frozenset[int]:
        found, todo = set(places), list(places)
        while todo:
            for end in self.skips.get(todo.pop(), ()):
                if end not in found:
                    found.add(end)
                    todo.append(end)
        return frozenset(found)

    def _longest_run(self, required: list[bool]) -> bytes:
        runs: list[list[bytes]] = [[]]
        for step, needed in zip(self.steps, required, strict=True):
            if needed and step.word is not None:
                runs[-1].append(step.word)
            else:
                runs.append([])
        longest = max(runs, key=lambda run: len(b" ".join(run)))
        return b" " + b" ".join(longest) + b" "

    @functools.lru_cache(maxsize=65_536)
    def _next(self, places: frozenset[int], word: bytes) -> frozenset[int]:
        end = len(self.steps)
        return self._closure({i + 1 for i in places if i < end and self.steps[i].word in (None, word)})

    def accept(self, words: list[bytes], start: int) -> int | None:
        """End of the longest match from a word on, if there is one."""
        places, found = self.start, None
        end = len(self.steps)
        for at in range(start, len(words)):
            places = self._next(places, words[at])
            if not places:
                break
            if end in places:
                found = at + 1
        return found

    def search(self, words: list[bytes], joined: bytes) -> Iterator[tuple[int, int]]:
        """(start, end) in words of the template's matches, which don't overlap."""
        if self.anchor not in joined:
            return
        free = 0
        for start, word in enumerate(words):
            if start >= free and (word in self.first or None in self.first):
                end = self.accept(words, start)
                if end is not None:
                    yield start, end
                    free = end


@functools.lru_cache(maxsize=8)
def compiled(templates: tuple[tuple[str, str], ...]) -> tuple[Automaton, ...]:
    return tuple(Automaton(label, template) for label, template in templates)


def phrase_places(joined: bytes, phrase: str) -> list[int]:
    """Number of the first word of each place where the phrase's words stand together; places may overlap."""
    wanted, found, at, word, counted = b" " + phrase.encode() + b" ", [], 0, 0, 0
    while (at := joined.find(wanted, at)) >= 0:
        word += joined.count(b" ", counted, at)
        counted = at
        found.append(word)
        at += 1
    return found


def scan(text: str | None, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> tuple:
    """(n_words, n_base, first_word, last_word, base labels, labels, score, matches) of a whole text.

    matches are (label, start, end) in words, phrases included. score is 1 with a
    whole template, 0.5 with a phrase alone, else 0.
    """
    words = words_of(text)
    joined = b" " + b" ".join(words) + b" "
    places = [(label, at, at + len(phrase.split())) for phrase, label in PHRASES for at in phrase_places(joined, phrase)]
    matches = [(a.label, *span) for a in compiled(templates) for span in a.search(words, joined)]
    starts = [p[1] for p in places]
    base = sorted({p[0] for p in places})
    labels = sorted({*base, *(m[0] for m in matches)})
    score = 1.0 if matches else 0.5 if places else 0.0
    return len(words), len(places), min(starts, default=None), max(starts, default=None), base, labels, score, places + matches


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, matches array<struct<label:string,start:long,end:long>>"
_ARROW = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))]


def scan_licenses(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches), a row for each row of docs.

    The base fields count the places of PHRASES; matches adds those of templates,
    as (label, start, end) in words from 0. A null or empty text has no words and
    no labels, null places and score 0. score is 1 for a text with a whole
    template, 0.5 for one with a phrase alone, else 0. Repeated rows and null ids
    keep their rows; an empty table gives none; other columns are passed over.
    Nothing is shuffled; a task holds a batch of texts.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, max(batch.num_rows, 1), BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                rows = [scan(t.as_py(), templates) for t in part.column(1)]
                columns = list(zip(*rows, strict=True)) or [()] * len(_ARROW)
                columns[-1] = [[{"label": m[0], "start": m[1], "end": m[2]} for m in found] for found in columns[-1]]
                names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(columns, _ARROW, strict=True))], names=names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {id_type}, {SCHEMA}")
