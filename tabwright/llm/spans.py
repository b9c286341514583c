"""Places of regular-expression matches, in DataFrame functions only.

Spark returns the strings that match, not where. Splitting a text by the pattern
gives what lies between the matches, and running sums of both lengths give the
places, in code points. Lookbehinds and possessive quantifiers in the callers'
patterns keep the leftmost non-overlapping matches and only spare attempts that
must fail, so that long runs of a text cost linear time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Running sums go block by block, so that a text of very many matches costs their number times this.
BLOCK = 128


@dataclass(frozen=True)
class Pattern:
    """A Java regular expression that matches no empty string.

    needs: text without a match of this is passed over; cheaper than the pattern.
    context: keep so many code points of what is before each match, back to the
    match before, and of what is after it, up to the next match.
    """

    regex: str
    needs: str | None = None
    context: int = 0


def _grow(sums: Column, x: Column) -> Column:
    return F.concat(sums, F.array(F.element_at(sums, -1) + x))


def _block(array: Column, b: Column) -> Column:
    return F.slice(array, b * BLOCK + 1, BLOCK)


def find_spans(rows: DataFrame, text: Column, patterns: dict[str, Pattern]) -> DataFrame:
    """Add a column for each pattern: array of (start, end, value, before, after), in order.

    start and end are code points of the whole text, end exclusive; value is the
    match, before and after are the text beside it (see ``Pattern.context``). Null
    and empty texts have empty arrays. Names must be new to rows.
    """
    whole = F.coalesce(text, F.lit(""))
    names = list(patterns)

    def of(name: str, what: str) -> str:
        return f"__{what}_{name}"

    def when_needed(p: Pattern, found: Column, empty: str) -> Column:
        return found if p.needs is None else F.when(F.regexp_like(whole, F.lit(p.needs)), found).otherwise(F.array().cast(empty))

    def between(p: Pattern) -> Column:
        def gap(x: Column) -> Column:
            none = F.lit(None).cast("string")
            head, tail = (F.substring(x, 1, p.context), F.substring(x, -p.context, p.context)) if p.context else (none, none)
            return F.struct(F.length(x).alias("n"), head.alias("head"), tail.alias("tail"))

        return F.transform(F.split(whole, p.regex), gap)

    stage = rows.withColumns({of(n, "gaps"): when_needed(p, between(p), "array<struct<n:int,head:string,tail:string>>") for n, p in patterns.items()})
    stage = stage.withColumns({
        of(n, "hits"): F.when(F.size(of(n, "gaps")) > 1, F.regexp_extract_all(whole, F.lit(p.regex), F.lit(0))).otherwise(F.array().cast("array<string>"))
        for n, p in patterns.items()
    })

    def lengths(n: str) -> Column:
        gaps = F.col(of(n, "gaps"))
        return F.transform(of(n, "hits"), lambda m, i: F.get(gaps, i)["n"] + F.length(m))

    stage = stage.withColumns({of(n, "lengths"): lengths(n) for n in names})

    def blocks(n: str) -> Column:
        return F.sequence(F.lit(0), F.expr(f"cast(greatest(size({of(n, 'lengths')}) - 1, 0) div {BLOCK} AS int)"))

    def block_sums(n: str) -> Column:
        lengths = F.col(of(n, "lengths"))
        return F.transform(blocks(n), lambda b: F.aggregate(_block(lengths, b), F.lit(0), lambda a, x: a + x))

    stage = stage.withColumns({of(n, "starts"): F.aggregate(block_sums(n), F.array(F.lit(0)), _grow) for n in names})

    def sums(n: str) -> Column:
        lengths, starts = F.col(of(n, "lengths")), F.col(of(n, "starts"))
        return F.flatten(F.transform(blocks(n), lambda b: F.slice(F.aggregate(_block(lengths, b), F.array(F.get(starts, b)), _grow), 1, BLOCK)))

    stage = stage.withColumns({of(n, "sums"): sums(n) for n in names})

    def spans(n: str) -> Column:
        gaps, before = F.col(of(n, "gaps")), F.col(of(n, "sums"))

        def span(m: Column, i: Column) -> Column:
            start = F.get(before, i) + F.get(gaps, i)["n"]
            return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("value"), F.get(gaps, i)["tail"].alias("before"), F.get(gaps, i + 1)["head"].alias("after"))

        return F.transform(F.col(of(n, "hits")), span)

    stage = stage.withColumns({n: spans(n) for n in names})
    return stage.drop(*[of(n, w) for n in names for w in ("gaps", "hits", "lengths", "starts", "sums")])


def digest_of(spans: Column) -> Column:
    """kind:start:end of an array of (kind, start, end), comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
