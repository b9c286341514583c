"""Personal data by rules and by contexts bootstrapped from them, in DataFrame functions only.

Fixed patterns with checks find e-mail addresses, IPv4 addresses, payment cards
and phone numbers; these are the seeds. Every seed, every other token that holds a
digit or an @ and every row of digit groups with spaces between is an instance.
Its lexical patterns are the one or two words before it, the label with its marks
right before it (``card:``), the word after it, and the words on both sides.
Patterns and instances make a weighted graph over the whole corpus. Round by round each
pattern is scored, for each kind, by the instances that it introduces, and each
instance by the patterns that introduce it. Instances of the shape of a kind, in
contexts that nearly always introduce that kind, are reported as well: numbers
whose check digit is wrong, phone numbers without a country code, addresses
without a dotted domain.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import discard, materialize
from tabwright.llm.spans import Pattern, digest_of, find_spans

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": Pattern(r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", needs="@"),
    "ip": Pattern(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+", needs="[0-9]"),
    "card": Pattern(r"[0-9](?:[\x20-]?[0-9])++", needs="[0-9]"),
    "phone": Pattern(r"\+[0-9][\x20().0-9-]+[0-9]", needs=r"\+"),
    # Any token of a digit or an @, with the words before it.
    "token": Pattern(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+", needs="[0-9@]", context=80),
    # Digit groups, such as (017) 555-7713, with single spaces between them.
    "group": Pattern(r"""(?<![^\s"'\[<{])[+(]?[0-9(][0-9().-]*+(?:\x20(?=[0-9(][0-9().-]*+(?![^\s,;:!?"'\]}>]))[0-9(][0-9().-]*+)++""", needs=r"[0-9().-]\x20[0-9(]", context=80),
}
#: What a discovered token must look like, marks around it taken off.
SHAPES = {
    "email": r"^[^\s@]+@[^\s@]+$",
    "ip": r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$",
    "card": r"^[0-9]([\x20-]?[0-9]){12,18}$",
    "phone": r"^(\+?[0-9().-]{7,18}|(?=([^0-9]*[0-9]){7,15}[^0-9]*$)\+?[0-9(][0-9().-]*(\x20[0-9(][0-9().-]*)+)$",
}


@dataclass(frozen=True)
class Bootstrap:
    """rounds of scoring; a pattern counts from min_instances distinct known instances of a kind on and from a
    confidence of min_confidence on, the known share of its distinct instances after adding one unknown."""

    rounds: int = 3
    min_instances: int = 5
    min_confidence: float = 0.8


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _passes(kind: str, value: Column) -> Column:
    count = F.length(_digits(value))
    if kind == "ip":
        return F.regexp_like(value, F.lit(r"^(0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.|$)){4}$"))
    if kind == "card":
        # The check only sees numbers short enough to be cards.
        return F.when(count.between(13, 19), F.call_function("luhn_check", _digits(value))).otherwise(False)
    if kind == "phone":
        return count.between(9, 15)
    return F.lit(True)


def _tagged(kind: str, number: int, spans: Column) -> Column:
    """Spans as (rank of the kind, start, end, kind, value), those that fail the kind's check left out."""
    kept = F.filter(spans, lambda s: _passes(kind, s["value"]))
    return F.transform(kept, lambda s: F.struct(F.lit(number).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value")))


def _trimmed(value: Column) -> Column:
    return F.regexp_replace(value, r"^[^\p{L}0-9+@]+|[^\p{L}0-9]+$", "")


def base_spans(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, email, ip, card, phone, token, group): arrays of checked spans of each kind, and of tokens and digit groups with what is before them."""
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))
    found = find_spans(picked, F.col("__text"), PATTERNS).drop("__text")
    return found.withColumns({kind: _tagged(kind, i, F.col(kind)) for i, kind in enumerate(KINDS)})


def occurrences(found: DataFrame) -> DataFrame:
    """A row for each token and each row of digit groups of each document: (key, start, end, instance, kind, patterns).

    kind is that of the base span that starts there, if any, which is then the
    instance as a whole; patterns are in lower case, those to the left marked < and
    those to the right >. Groups count if they hold as many digits as a phone or a card and no
    dotted address; tokens that start in them don't.
    """
    base = F.concat(*[F.col(k) for k in KINDS])
    groups = F.filter("group", lambda g: F.length(_digits(g["value"])).between(7, 19) & ~F.regexp_like(g["value"], F.lit(r"[0-9](\.[0-9]+){3}")))
    rows = found.filter("size(token) > 0").select("key", base.alias("base"), "token", groups.alias("groups"))
    single = F.filter("token", lambda t: ~F.exists("groups", lambda g: (g["start"] <= t["end"] - 1) & (t["start"] < g["end"])))
    both = F.concat(F.transform(single, lambda t: F.struct(t.alias("t"), F.lit(False).alias("group"))), F.transform("groups", lambda g: F.struct(g.alias("t"), F.lit(True).alias("group"))))
    tokens = rows.select("key", "base", F.explode(both).alias("e")).select("key", "base", "e.t", "e.group")
    plain = lambda c: F.split(F.trim(F.lower(F.regexp_replace(c, r"[\s\p{Punct}]+", " "))), " ")
    words, after = plain(F.col("t.before")), plain(F.coalesce("t.after", F.lit("")))
    known = F.get(F.filter("base", lambda b: (b["start"] >= F.col("t.start")) & (b["start"] < F.col("t.end"))), F.lit(0))
    some = lambda c: F.when(c != "", c)
    last, two = some(F.element_at(words, -1)), F.when(F.size(words) > 1, F.concat_ws(" ", F.try_element_at(words, F.lit(-2)), F.element_at(words, -1)))
    label = F.lower(F.regexp_extract("t.before", r"(\S*\p{Punct})\s*$", 1))
    # What follows a token needn't follow the base span that starts in it.
    following = F.when(F.coalesce(F.get(F.filter("base", lambda b: (b["start"] >= F.col("t.start")) & (b["start"] < F.col("t.end"))), F.lit(0))["end"], F.col("t.end")) <= F.col("t.end"), some(F.get(after, F.lit(0))))
    given = F.array(F.concat(F.lit("<"), last), F.concat(F.lit("<"), two), F.concat(F.lit("<"), some(label)), F.concat(F.lit(">"), following), F.concat(F.lit("<"), last, F.lit(" >"), following))
    patterns = F.array_distinct(F.filter(given, lambda p: p.isNotNull()))
    # A group keeps its opening bracket.
    lead = F.when(F.col("group"), F.lit(0)).otherwise(F.length(F.regexp_extract("t.value", r"^[^\p{L}0-9+@]+", 0)))
    own = F.when(F.col("group"), F.regexp_replace("t.value", "[^0-9]+$", "")).otherwise(_trimmed(F.col("t.value")))
    tokens = tokens.withColumns({"known": known, "own": own, "at": F.col("t.start") + lead})
    return tokens.select(
        "key",
        F.coalesce("known.start", "at").alias("start"),
        F.coalesce("known.end", F.col("at") + F.length("own")).alias("end"),
        F.coalesce("known.value", "own").alias("instance"),
        F.col("known.kind").alias("kind"),
        patterns.alias("patterns"),
    ).filter("instance <> ''")


def confident_patterns(found: DataFrame, how: Bootstrap, label: str = "pii") -> DataFrame:
    """(pattern, kind, confidence) of the patterns that the bootstrap trusts.

    found: occurrences. Edges of the graph are distinct pairs of pattern and
    instance, so copies of a text add nothing. All sums are pre-aggregated where
    the edges lie.
    """
    edges = materialize(
        found.select(F.explode("patterns").alias("pattern"), "instance", "kind").groupBy("pattern", "instance").agg(F.min("kind").alias("kind")), f"{label}-edges"
    )
    totals = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    known = edges.filter("kind IS NOT NULL").groupBy("instance", "kind").agg(F.lit(1.0).alias("score"))
    trusted = None
    for number in range(how.rounds):
        known = materialize(known, f"{label}-known-{number}")
        support = edges.select("pattern", "instance").join(known, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("s"), F.count(F.lit(1)).alias("seen"))
        scored = support.filter(F.col("seen") >= how.min_instances).join(totals, "pattern").withColumn("confidence", F.col("s") / (F.col("n") + 1))
        before, trusted = trusted, materialize(scored.filter(F.col("confidence") >= how.min_confidence).select("pattern", "kind", "confidence"), f"{label}-trusted-{number}")
        discard(known)
        if before is not None:
            discard(before)
        # An instance is as likely of a kind as not all of its trusted patterns err.
        heard = edges.filter("kind IS NULL").select("pattern", "instance").join(trusted, "pattern")
        shaped = heard.filter(shape_fits(F.col("instance"), F.col("kind")))
        new = shaped.groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.999)))))).alias("score"))
        known = edges.filter("kind IS NOT NULL").groupBy("instance", "kind").agg(F.lit(1.0).alias("score")).unionAll(new)
    discard(edges)
    return trusted


def shape_fits(instance: Column, kind: Column) -> Column:
    fits = F.lit(False)
    for name, shape in SHAPES.items():
        fits = fits | ((kind == name) & F.regexp_like(instance, F.lit(shape)))
    return fits


def personal_data(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", how: Bootstrap = Bootstrap(), label: str = "pii") -> DataFrame:
    """Spans of personal data, a row for each row of docs.

    (doc_id, base, spans): arrays of (rank, start, end, kind, value) by kind as
    in KINDS, then start; base by the fixed patterns alone, spans with those that
    contexts add. Places are code points of the whole text. A null or empty text
    has empty arrays; repeated rows each have theirs; an empty table gives none;
    other columns are passed over. Texts are searched once and what they hold is
    written; later steps read that alone.
    """
    found = materialize(base_spans(docs, text_col, id_col).withColumn("key", F.monotonically_increasing_id()), label)
    seen = occurrences(found)
    trusted = confident_patterns(seen, how, label)
    # Documents' tokens in trusted contexts; few, as patterns are.
    candidates = seen.filter("kind IS NULL").select("key", "start", "end", "instance", F.explode("patterns").alias("pattern"))
    ranks = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    added = (
        candidates.join(trusted, "pattern")
        .filter(shape_fits(F.col("instance"), F.col("kind")))
        .select("key", F.struct(ranks.alias("rank"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "kind", F.col("instance").alias("value")).alias("span"))
        .groupBy("key")
        .agg(F.collect_set("span").alias("added"))  # of one document
    )
    base = F.concat(*[F.col(k) for k in KINDS])
    joined = found.join(added, "key", "left").withColumn("base", base)
    alone = F.filter(F.coalesce("added", F.expr("slice(base, 1, 0)")), lambda a: ~F.exists("base", lambda b: (b["start"] < a["end"]) & (a["start"] < b["end"]) & (b["kind"] == a["kind"])))
    return joined.withColumn("spans", F.sort_array(F.concat("base", alone))).select("doc_id", "base", "spans")


__all__ = ["Bootstrap", "KINDS", "base_spans", "confident_patterns", "digest_of", "occurrences", "personal_data"]
