"""Secrets by rules and by tests of randomness, in DataFrame functions only.

Fixed patterns find assignments to secret names, access keys and long hex runs.
Other runs of letters and digits are held against the hypothesis that they were
drawn at random from their alphabet, which is inferred: hex in either case, base
32, letters and digits of one case, of both, or base 64. Three tests are made: a
chi-squared test of the characters' counts, a test of the number of runs above
and below the alphabet's middle, and one of the correlation of neighbours. Their
p-values are combined by Fisher's method: the greater p, the more random a run looks.

How random ordinary text looks is learnt from decoys: every text, without its long
runs and without what separates words, is cut into pieces of a length, and those
that hold a digit and a letter, as runs must, take the same tests. A run's own
p-value under the hypothesis that it is ordinary text is the share of decoys of its
band of lengths that look as random. Benjamini and Hochberg's procedure on these,
band by band as short runs make weak tests, bounds the share of ordinary text
among what is reported as ``random``. A band without enough decoys reports nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabwright.llm.common import bit_filter, discard, keyed, materialize, with_hit
from tabwright.llm.spans import Pattern, find_spans

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = {
    "assign": Pattern(ASSIGN),
    "access": Pattern(r"AKIA[A-Z0-9]++", needs="AKIA"),
    "hex": Pattern(r"(?<![0-9a-f])[0-9a-f]{24,}+", needs="[0-9a-f]{24}"),
    # Runs of a token's characters that hold a digit and a letter and are long enough to test.
    "random": Pattern(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{20,}+", needs="[0-9]"),
}
#: Inferred encodings, the narrowest first: name, what all characters must be, the characters in order.
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", "0123456789abcdef"),
    ("HEX", "^[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", "^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("lower", "^[a-z0-9]+$", "abcdefghijklmnopqrstuvwxyz0123456789"),
    ("upper", "^[A-Z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"),
    ("base62", "^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "^[A-Za-z0-9+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "^[A-Za-z0-9_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
#: Least lengths of the bands, and the length of decoys in each.
BANDS = (20, 28, 40, 64)
DECOYS = (24, 34, 52, 80)
_BINS = 400


@dataclass(frozen=True)
class Battery:
    """false_discovery: share of ordinary text among the runs reported, in each band; min_p: runs that are so
    unlikely to be random are never reported; min_bits: least length times the bits of a character of the alphabet."""

    false_discovery: float = 0.05
    min_p: float = 0.01
    min_bits: float = 80.0


def _normal_tail(z: Column) -> Column:
    """Two-sided p-value of a standard normal, by a fixed rational approximation (Abramowitz and Stegun 26.2.17)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.greatest(F.least(2 * poly * F.exp(-x * x / 2) / 2.5066282746310002, F.lit(1.0)), F.lit(1e-300))


def test_runs(tokens: DataFrame, value: str) -> DataFrame:
    """Add encoding, bits and p (of the three tests together) for a string column; p is null without an encoding."""
    which = F.coalesce(*[F.when(F.regexp_like(value, F.lit(rule)), F.lit(i)) for i, (_, rule, _) in enumerate(ENCODINGS)])
    stage = tokens.withColumn("__which", which).withColumns({
        "encoding": F.get(F.array(*[F.lit(name) for name, _, _ in ENCODINGS]), F.col("__which")),
        "__alphabet": F.get(F.array(*[F.lit(a) for _, _, a in ENCODINGS]), F.col("__which")),
    })
    stage = stage.withColumn("__codes", F.expr(f"transform(split({value}, ''), c -> locate(c, __alphabet) - 1)"))
    stage = stage.withColumns({"__n": F.size("__codes").cast("double"), "__a": F.length("__alphabet").cast("double")})
    counts = F.transform(F.array_distinct("__codes"), lambda d: F.size(F.filter("__codes", lambda c: c == d)).cast("double"))
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x)
    codes = F.col("__codes")
    high = F.transform(codes, lambda c: (2 * c >= F.col("__a")).cast("int"))
    stage = stage.withColumns({"__squares": total, "__high": high, "__mean": F.aggregate(codes, F.lit(0.0), lambda s, x: s + x) / F.col("__n")})
    ups, halves = F.aggregate("__high", F.lit(0), lambda s, x: s + x).cast("double"), F.col("__high")
    turns = F.size(F.filter(halves, lambda x, i: F.get(halves, i - 1) != x)).cast("double")
    mean = F.col("__mean")
    spread = F.aggregate(codes, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean))
    together = F.aggregate(F.transform(codes, lambda x, i: F.coalesce((x - mean) * (F.get(codes, i - 1) - mean), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    stage = stage.withColumns({"__ups": ups, "__turns": turns, "__spread": spread, "__together": together})
    n, a = F.col("__n"), F.col("__a")
    # Wilson and Hilferty: the cube root of chi-squared over its degrees is near normal. Only unevenness counts.
    chi = a / n * F.col("__squares") - n
    z_chi = (F.cbrt(chi / (a - 1)) - (1 - 2 / (9 * (a - 1)))) / F.sqrt(2 / (9 * (a - 1)))
    p_chi = F.when(z_chi > 0, _normal_tail(z_chi) / 2).otherwise(1 - _normal_tail(z_chi) / 2)
    n1, n0 = F.col("__ups"), n - F.col("__ups")
    expected = 2 * n1 * n0 / n + 1
    variance = (expected - 1) * (expected - 2) / (n - 1)
    p_runs = F.when((n1 > 0) & (n0 > 0) & (variance > 0), _normal_tail((F.col("__turns") + 1 - expected) / F.sqrt(F.greatest(variance, F.lit(1e-9))))).otherwise(F.lit(1e-12))
    p_serial = F.when(F.col("__spread") > 0, _normal_tail((F.col("__together") / F.greatest("__spread", F.lit(1e-9)) + 1 / n) * F.sqrt(n))).otherwise(F.lit(1e-12))
    half = -(F.log(p_chi) + F.log(p_runs) + F.log(p_serial))
    x = F.col("__half")
    p = F.when(F.col("encoding").isNotNull(), F.exp(-x) * (1 + x + x * x / 2))
    return stage.withColumn("__half", half).withColumns({"bits": n * F.log2(a), "p": p}).drop(
        "__which", "__alphabet", "__codes", "__n", "__a", "__squares", "__high", "__mean", "__ups", "__turns", "__spread", "__together", "__half"
    )


def band_of(length: Column) -> Column:
    return F.size(F.filter(F.array(*[F.lit(b) for b in BANDS]), lambda b: b <= length))


def step_of(p: Column) -> Column:
    """Step k holds p in (10^((k-1)/20 - 20), 10^(k/20 - 20)]."""
    return F.least(F.greatest(F.ceil((F.log10(F.greatest(p, F.lit(1e-20))) + 20) * 20), F.lit(0)), F.lit(_BINS)).cast("int")


def report_levels(tested: DataFrame, decoys: DataFrame, how: Battery) -> DataFrame:
    """(band, level): runs of a band whose step of p is level or more are discoveries.

    Both tables have band and step. Under the hypothesis of ordinary text, a run's
    p-value is (1 + decoys of its step or more) / (1 + decoys), and Benjamini and
    Hochberg's procedure takes all runs of the band. Counts of a band and step are
    summed where the rows lie, and the ranks run over these sums alone.
    """
    counts = tested.select("band", "step", F.lit(1).alias("run")).unionAll(decoys.select("band", "step", F.lit(0).alias("run")))
    counts = counts.filter("step IS NOT NULL").groupBy("band", "step").agg(F.sum("run").alias("runs"), F.sum(1 - F.col("run")).alias("decoys"))
    by_band = Window.partitionBy("band")
    above = by_band.orderBy(F.desc("step"))
    ranked = counts.select(
        "band", "step", F.sum("runs").over(above).alias("n"), F.sum("decoys").over(above).alias("d"), F.sum("runs").over(by_band).alias("all"), F.sum("decoys").over(by_band).alias("all_d")
    )
    passed = (1 + F.col("d")) / (1 + F.col("all_d")) * F.col("all") <= how.false_discovery * F.col("n")
    return ranked.filter(passed).groupBy("band").agg(F.min("step").alias("level"))


def decoys_of(text: Column) -> Column:
    """Pieces of ordinary text as long as runs, an array of strings; their length is picked by the text's hash.

    Long runs are taken out first, so that no secret is a decoy.
    """
    squeezed = F.regexp_replace(F.regexp_replace(text, "[A-Za-z0-9+/_-]{20,}", " "), "[^A-Za-z0-9+/_-]+", "")
    pick = F.pmod(F.xxhash64(text), F.lit(len(DECOYS)))
    pieces = F.coalesce(*[F.when(pick == i, F.regexp_extract_all(squeezed, F.lit(rf"[\s\S]{{{n}}}"), F.lit(0))) for i, n in enumerate(DECOYS)])
    kept = F.filter(pieces, lambda x: F.regexp_like(x, F.lit("[0-9]")) & F.regexp_like(x, F.lit("[A-Za-z]")))
    return F.when(F.regexp_like(text, F.lit("[0-9]")), kept)


def secret_spans(docs: DataFrame, text: Column) -> DataFrame:
    """Add the arrays assign, access, hex and random of (start, end, value, ...) to docs, without the fixed patterns' failures, and decoys."""
    found = find_spans(docs, text, PATTERNS)
    return found.withColumns({
        "decoys": decoys_of(text),
        "assign": F.filter("assign", lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 1)) >= 6),
        "access": F.filter("access", lambda s: F.length(s["value"]) >= 20),
    })


def _ordered(kind: str, spans: Column) -> Column:
    number = KINDS.index(kind)
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value")))


def find_secrets(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", how: Battery = Battery(), label: str = "secrets") -> DataFrame:
    """Spans of secrets, a row for each row of docs.

    (doc_id, base, spans): arrays of (start, rank, end, kind, value) by start and
    kind as in KINDS; base by the fixed patterns alone, spans with the runs that
    the battery finds random. Places are code points of the whole text. A null or
    empty text has empty arrays; repeated rows count each, also in the levels; an
    empty table gives none; other columns are passed over.
    """
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))
    found = materialize(secret_spans(picked, F.col("__text")).drop("__text").withColumn("key", F.monotonically_increasing_id()), label)
    return add_random(found, random_runs(found, how, label)).select("doc_id", "base", "spans")


def tested_runs(runs: DataFrame) -> DataFrame:
    """Add encoding, bits, p, band and step to rows with a string column ``value``."""
    return test_runs(runs, "value").withColumns({"band": band_of(F.length("value")), "step": step_of(F.col("p"))})


def random_runs(found: DataFrame, how: Battery, label: str) -> DataFrame:
    """(key, kept): the runs that the battery reports of rows of ``secret_spans`` with a unique ``key``, where there are any."""
    runs = found.filter(F.size("random") > 0).select("key", F.explode("random").alias("run"))
    tested = materialize(tested_runs(runs.select("key", "run", F.col("run.value").alias("value"))), f"{label}-tested")
    decoys = tested_runs(found.filter(F.size("decoys") > 0).select(F.explode("decoys").alias("value")))
    levels = materialize(report_levels(tested, decoys, how), f"{label}-levels")
    reported = tested.filter((F.col("bits") >= how.min_bits) & (F.col("p") >= how.min_p)).join(F.broadcast(levels), "band")  # a row for each of the bands
    kept = reported.filter(F.col("step") >= F.col("level")).groupBy("key").agg(F.collect_list("run").alias("kept"))  # of one document
    kept = materialize(kept, f"{label}-kept")
    discard(tested)
    discard(levels)
    return kept


def add_random(found: DataFrame, kept: DataFrame) -> DataFrame:
    """Add base and spans to rows of ``secret_spans``."""
    joined = found.drop("decoys").join(kept, "key", "left").withColumn("random", F.coalesce("kept", F.expr("slice(random, 1, 0)"))).drop("kept")
    fixed = F.sort_array(F.concat(*[_ordered(k, F.col(k)) for k in KINDS[:3]]))
    # A run that a fixed pattern's span holds is known already.
    new = F.filter("random", lambda r: ~F.exists("base", lambda b: (b["start"] <= r["start"]) & (r["end"] <= b["end"])))
    return joined.withColumn("base", fixed).withColumn("spans", F.sort_array(F.concat("base", _ordered("random", new))))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with its spans, merged where they overlap, each replaced by a mark. spans are in order of start."""

    def merge(found: Column, s: Column) -> Column:
        inside = (F.size(found) > 0) & (s["start"] <= F.try_element_at(found, F.lit(-1))["end"])
        joined = F.struct(F.try_element_at(found, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(found, F.lit(-1))["end"], s["end"]).alias("end"))
        return F.when(inside, F.concat(F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0))), F.array(joined))).otherwise(
            F.concat(found, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))
        )

    merged = F.aggregate(spans, F.array().cast("array<struct<start:int,end:int>>"), merge)

    def piece(iv: Column, i: Column) -> Column:
        begin = F.coalesce(F.get(merged, i - 1)["end"], F.lit(0))
        return F.concat(F.substring(text, begin + 1, iv["start"] - begin), F.lit(mark))

    rest = F.coalesce(F.try_element_at(merged, F.lit(-1))["end"], F.lit(0))
    return F.concat(F.array_join(F.transform(merged, piece), ""), F.substring(text, rest + 1, F.length(text)))


def remove_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", how: Battery = Battery(), label: str = "redact") -> DataFrame:
    """docs with every secret of their texts replaced by a mark, all other text and all columns kept.

    length_col, where docs have it, gets the length of a changed text. A null text
    stays null. Texts aren't copied: rows are known by their places, what is found
    in them is written, and only rows that may hold a secret are joined with it.
    Other cases are as in ``find_secrets``.
    """
    whole = keyed(docs, f"{label}-docs")
    found = secret_spans(whole.select(F.col("__key").alias("key"), F.col(f"__row.`{text_col}`").alias("__text")), F.col("__text")).drop("__text")
    found = materialize(found, label, compression="zstd")
    kept = random_runs(found, how, label)
    some = F.size("assign") > 0
    for kind in KINDS[1:]:
        some = some | (F.size(kind) > 0)
    spans = add_random(found.filter(some), kept).filter(F.size("spans") > 0)
    spans = materialize(spans.select(F.col("key").alias("__key"), F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("__spans")), f"{label}-spans")
    discard(found)
    discard(kept)
    marked = with_hit(whole, "__key", materialize(bit_filter(spans, "__key"), f"{label}-filter"), "__hit")
    clear = marked.filter(~F.col("__hit")).select("__row.*")
    text = F.col(f"__row.`{text_col}`")
    joined = marked.filter("__hit").join(spans, "__key", "left").withColumn("__text", F.when(F.col("__spans").isNotNull(), redact(text, F.col("__spans"))).otherwise(text))

    def column(name: str) -> Column:
        own = F.col(f"__row.`{name}`")
        if name == text_col:
            return F.col("__text").alias(name)
        if name == length_col:
            return F.when(F.col("__spans").isNotNull(), F.length("__text").cast(docs.schema[name].dataType)).otherwise(own).alias(name)
        return own.alias(name)

    return clear.unionAll(joined.select(*[column(name) for name in docs.columns]))
