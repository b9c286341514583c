"""Quality rules with host verdicts, in DataFrame functions only.

Each text is measured and held against hard rules, which reject it, and soft
rules, which alone don't. Failures are counted by host. A host's failure rate is
shrunk towards the rate of all hosts by a beta prior that the method of moments
fits to the hosts' own rates, so that a host of few documents isn't condemned by
few. A host is condemned where its posterior lies clearly above the prior's mean.
Documents of a condemned host go if they fail a soft rule themselves; clean
documents stay wherever they come from.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import materialize

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 5


@dataclass(frozen=True)
class QualityRules:
    """Limits of the rules.

    Hard: fewer words than min_words; repeated words above max_repeat_percent of
    all. Soft: more symbols than max_symbols_per_word a word; duplicate lines
    above max_dup_line_percent of the lines with a word; a mean word length
    outside mean_word_chars. A host is condemned when the shrunk rate of its
    documents that fail any rule lies above the mean of all hosts by more than
    host_deviations of the posterior's standard deviation (0.84: in four of five
    cases it is a worse host than most). One failure is left out of the count, so
    that no document is condemned by itself.
    """

    min_words: int = 10
    max_repeat_percent: int = 20
    max_symbols_per_word: float = 0.5
    max_dup_line_percent: int = 30
    mean_word_chars: tuple[float, float] = (2.0, 20.0)
    host_deviations: float = 0.84


def _windows(hashes: Column) -> Column:
    """Hash of each run of five words, from the words' hashes."""
    last = F.size(hashes) - WINDOW
    runs = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))
    return F.when(last >= 0, runs).otherwise(F.array().cast("array<bigint>"))


def measure(docs: DataFrame, text: Column) -> DataFrame:
    """Add the struct ``__m`` of measures of whole texts to docs.

    n_words and word_chars (code points in words); n_symbols; n_lines with a word
    and n_dup_lines of them that equal an earlier one; n_repeat_words, the words
    in windows of five that stand in the text twice or more. All are 0 for a null,
    empty or blank text. Windows are compared by 64-bit hashes of 64-bit word
    hashes, and found again by sorting, so very long texts cost n log n.
    """
    whole = F.coalesce(text, F.lit(""))
    stage = docs.withColumns({
        "__words": F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)),
        "__lines": F.filter(F.split(whole, "\n"), lambda line: F.regexp_like(line, F.lit(WORD))),
        "__n_symbols": F.regexp_count(whole, F.lit(SYMBOL)).cast("long"),
    })
    stage = stage.withColumn("__hashes", F.transform("__words", lambda w: F.xxhash64(w)))
    stage = stage.withColumn("__windows", _windows(F.col("__hashes")))
    found = F.transform("__windows", lambda h, p: F.struct(h.alias("h"), p.alias("p")))
    stage = stage.withColumn("__found", F.when(F.size(F.array_distinct("__windows")) < F.size("__windows"), F.sort_array(found)))
    pairs = F.col("__found")
    twice = F.filter(pairs, lambda x, i: F.equal_null(F.get(pairs, i - 1)["h"], x["h"]) | F.equal_null(F.get(pairs, i + 1)["h"], x["h"]))
    stage = stage.withColumn("__places", F.sort_array(F.transform(twice, lambda x: x["p"])))
    places = F.col("__places")
    # Each place adds the words of its window that the place before didn't cover.
    covered = F.aggregate(
        F.transform(places, lambda p, i: F.coalesce(F.least(F.lit(WINDOW), p - F.get(places, i - 1)), F.lit(WINDOW))), F.lit(0), lambda total, x: total + x
    )
    measures = F.struct(
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.col("__n_symbols").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    return stage.withColumn("__m", measures).drop("__words", "__lines", "__n_symbols", "__hashes", "__windows", "__found", "__places")


def hard_failed(m: Column, rules: QualityRules) -> Column:
    return (m["n_words"] < rules.min_words) | (100 * m["n_repeat_words"] > rules.max_repeat_percent * m["n_words"])


def soft_failed(m: Column, rules: QualityRules) -> Column:
    low, high = rules.mean_word_chars
    return (
        (m["n_symbols"] > rules.max_symbols_per_word * m["n_words"])
        | (100 * m["n_dup_lines"] > rules.max_dup_line_percent * m["n_lines"])
        | (m["word_chars"] < low * m["n_words"])
        | (m["word_chars"] > high * m["n_words"])
    )


def host_rates(flagged: DataFrame, host: str) -> DataFrame:
    """(host, n_docs, n_failed, rate, deviations): each host's failure rate without one failure, shrunk by an empirical beta prior.

    flagged: a host column and booleans hard and soft. Counts are summed where
    the rows lie, so a hot host costs no more than another. The prior's mean and
    weight come from the mean and variance of the hosts' rates: weight =
    mean * (1 - mean) / variance - 1. deviations tells by how many standard
    deviations of the posterior, a beta distribution of weight and documents, the
    rate lies above the prior's mean; 0 where all hosts have one rate, as then
    the variance says nothing. A null host is a host.
    """
    counts = flagged.groupBy(host).agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("hard") | F.col("soft")).alias("n_failed"))
    raw = F.col("n_failed") / F.col("n_docs")
    prior = counts.agg(F.avg(raw).alias("mean"), F.var_pop(raw).alias("variance")).first()  # two numbers
    mean, variance = prior["mean"] or 0.0, prior["variance"] or 0.0
    weight = max(0.0, mean * (1 - mean) / variance - 1) if variance > 1e-12 else 0.0
    others, failed = F.col("n_docs") - 1, F.greatest(F.col("n_failed") - 1, F.lit(0))
    rate = F.when(others + weight > 0, (failed + mean * weight) / (others + weight)).otherwise(mean)
    spread = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n_docs") + weight))
    above = F.when(F.col("rate") >= 1, F.lit(float("inf"))).when(spread > 0, (F.col("rate") - mean) / spread).otherwise(0.0)
    found = counts.withColumn("rate", rate)
    return found.select(host, "n_docs", "n_failed", "rate", (above if variance > 1e-12 else F.lit(0.0)).alias("deviations"))


def judge(flagged: DataFrame, host: str, rules: QualityRules, label: str = "quality") -> DataFrame:
    """Add boolean ``kept`` to flagged rows (see ``host_rates``), by the verdicts on their hosts.

    Only rows that fail a soft rule alone are joined with the condemned hosts, which
    are written first, so that the rows of a hot host are split.
    """
    rates = host_rates(flagged, host)
    condemned = materialize(rates.filter(F.col("deviations") > rules.host_deviations).select(F.col(host).alias("__host"), F.lit(True).alias("__bad")), f"{label}-hosts")
    doubtful = ~F.col("hard") & F.col("soft")
    joined = flagged.filter(doubtful).join(condemned, F.equal_null(F.col(host), F.col("__host")), "left")
    judged = joined.withColumn("kept", F.col("__bad").isNull()).drop("__host", "__bad")
    return flagged.filter(~doubtful).withColumn("kept", ~F.col("hard")).unionByName(judged)


def quality_report(docs: DataFrame, text_col: str = "text", host_col: str = "source", id_col: str = "doc_id", rules: QualityRules = QualityRules()) -> DataFrame:
    """Measures and verdicts, a row for each row of docs.

    (doc_id, measures..., base_failed, soft_failed, host, kept). Texts are
    measured once, and the measures written, as the verdicts need all hosts
    first. A null, empty or blank text has no words and fails; a null host is a
    host; repeated rows count each; an empty table gives no rows; other columns
    are passed over.
    """
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.col(text_col).alias("__text"))
    measured = measure(picked, F.col("__text")).drop("__text")
    m = F.col("__m")
    flagged = materialize(measured.select("doc_id", "host", "__m.*", hard_failed(m, rules).alias("hard"), soft_failed(m, rules).alias("soft")), "quality")
    return judge(flagged, "host", rules).withColumnsRenamed({"hard": "base_failed", "soft": "soft_failed"})


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source", rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows of docs that the rules keep, with all columns of docs and no others.

    Rows are carried whole in one struct, so their own columns can have any
    names. Cases are as in ``quality_report``.
    """
    carried = docs.select(F.struct("*").alias("__row"))
    measured = measure(carried, F.col(f"__row.{text_col}"))
    m = F.col("__m")
    flagged = measured.select("__row", F.col(f"__row.{host_col}").alias("host"), hard_failed(m, rules).alias("hard"), soft_failed(m, rules).alias("soft"))
    flagged = materialize(flagged, "quality-rows", compression="zstd")
    return judge(flagged, "host", rules, "quality").filter("kept").select("__row.*")
