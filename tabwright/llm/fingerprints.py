"""Merkle fingerprints of documents, in DataFrame functions only.

Sections end after an empty line and paragraphs after a line break. A paragraph is
cut into leaves by its content: a leaf ends after white space that follows an e, an
s or a mark that ends a sentence, or after 32 code points, so an edit changes the
leaves about it and no others. The rule is one for the whole text, and no
character is lost in cutting. A paragraph's hash is of its text, a section's of its
paragraphs' hashes, and the root is of the sections', so equal roots mean equal
texts, and where roots differ the branches that differ lead to the edits. The
fingerprint spells the tree:

    root:paragraph.leaf,leaf;paragraph.leaf|...

with sections between |, paragraphs between ; (the first 8 hex digits of their
hashes) and 32-bit hashes of leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SECTION_END = r"(?<=\n\n)"
PARAGRAPH_END = r"(?<=\n)"
#: The least text up to a mark and white space, within 32 code points, or 32 of them, or the rest.
LEAF = r"[\s\S]{0,30}?[es.!?]\s|[\s\S]{1,32}"
#: Text bytes of a range of neighbours, and the most ranges (this bounds what is broadcast).
RANGE_BYTES, MOST_RANGES = 4_000_000, 1 << 18
_CUTS = 64


def add_tree(rows: DataFrame, text: Column, name: str) -> DataFrame:
    """Add a text's tree to rows: struct of root, leaves (distinct, array of int) and fingerprint. A null text is empty."""
    whole = F.coalesce(text, F.lit(""))

    def paragraph(p: Column) -> Column:
        return F.struct(F.md5(p.cast("binary")).alias("hash"), F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), lambda x: F.hash(x)).alias("leaves"))

    def spell(p: Column) -> Column:
        return F.concat(F.substring(p["hash"], 1, 8), F.lit("."), F.array_join(F.transform(p["leaves"], lambda x: F.lower(F.hex(x.cast("long").bitwiseAND(0xFFFFFFFF)))), ","))

    stage = rows.withColumn("__sections", F.transform(F.split(whole, SECTION_END), lambda s: F.transform(F.split(s, PARAGRAPH_END), paragraph)))
    section_hashes = F.transform("__sections", lambda s: F.md5(F.array_join(F.transform(s, lambda p: p["hash"]), ",").cast("binary")))
    stage = stage.withColumns({
        "__root": F.sha2(F.array_join(section_hashes, ",").cast("binary"), 256),
        "__body": F.array_join(F.transform("__sections", lambda s: F.array_join(F.transform(s, spell), ";")), "|"),
        "__leaves": F.array_distinct(F.flatten(F.transform("__sections", lambda s: F.flatten(F.transform(s, lambda p: p["leaves"]))))),
    })
    tree = F.struct(F.col("__root").alias("root"), F.col("__leaves").alias("leaves"), F.concat_ws(":", "__root", "__body").alias("fingerprint"))
    return stage.withColumn(name, tree).drop("__sections", "__root", "__body", "__leaves")


def likeness(a: Column, b: Column) -> Column:
    """Twice the distinct leaves that both trees have, over the sum of each one's; 1 for equal roots."""
    shared = F.size(F.array_intersect(a["leaves"], b["leaves"]))
    every = F.size(a["leaves"]) + F.size(b["leaves"])
    return F.when(a["root"] == b["root"], F.lit(1.0)).otherwise(2.0 * shared / F.greatest(every, F.lit(1)))


def differing_branches(a: Column, b: Column) -> Column:
    """(section, paragraph) of each paragraph of fingerprint a that b doesn't have in its place, from 0."""

    def body(f: Column) -> Column:
        return F.split(F.substring_index(f, ":", -1), r"\|")

    other = body(b)

    def in_section(section: Column, s: Column) -> Column:
        theirs = F.split(F.coalesce(F.get(other, s), F.lit("")), ";")
        found = F.transform(F.split(section, ";"), lambda p, i: F.when(~F.equal_null(F.get(theirs, i), p), F.struct(s.alias("section"), i.alias("paragraph"))))
        return F.when(F.equal_null(F.get(other, s), section), F.array().cast("array<struct<section:int,paragraph:int>>")).otherwise(F.filter(found, lambda x: x.isNotNull()))

    return F.flatten(F.transform(body(a), in_section))


def _ranges(keys: DataFrame, size: Column) -> Column | None:
    """A number that grows with ``__key`` and then ``__tie``, the same for so many neighbours as hold RANGE_BYTES; None without rows.

    Quantiles of the keys, 64 at most, come to the driver. A key that is several
    of them is hot: its rows are dealt out evenly by their tie, which is a hash.
    Between two quantiles keys are dealt out evenly.
    """
    steps = [i / _CUTS for i in range(_CUTS + 1)]
    found = keys.agg(F.percentile_approx("__key", steps, 10_000).alias("cuts"), F.sum(size).alias("size"), F.min("__key").alias("low"), F.max("__key").alias("high")).first()
    if found["low"] is None:
        return None
    cuts = sorted({found["low"], *found["cuts"]})
    wanted = min(MOST_RANGES, max(1, found["size"] // RANGE_BYTES))
    if wanted == 1:
        return F.lit(0)
    each = -(-wanted // len(cuts))
    # Ranges of a hot key's own rows.
    own = [-(-wanted * found["cuts"].count(c) // _CUTS) if found["cuts"].count(c) > 1 else 1 for c in cuts]
    step = max(own) + each
    key = F.col("__key")
    marks = F.array(*[F.lit(c).cast("long") for c in [*cuts, found["high"]]])
    at = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c <= key))
    low, high = F.get(marks, at - 1).cast("double"), F.get(marks, at).cast("double")
    share = F.when(high > low, F.least(F.floor((key.cast("double") - low) / (high - low) * each), F.lit(each - 1))).otherwise(0)
    # Ties as fractions from 0 to 1.
    fraction = F.shiftrightunsigned("__tie", 11).cast("double") / float(1 << 53)
    of_tie = F.floor(F.least(fraction, F.lit(1 - 1e-9)) * F.get(F.array(*map(F.lit, own)), at - 1))
    return (at.cast("long") * step + F.when(key == F.get(marks, at - 1), of_tie).otherwise(max(own) + share)).cast("long")


def with_next(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(doc_id, text, tree, next_text, next_tree): each row with its neighbour in descending ids, the first after the last.

    Rows are dealt out once, by ranges of ids; each range also gets the first row
    of the range after it. Null ids come last; rows of one id follow by a hash of
    their text, descending, and its text. Ids are integers.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumns({"__key": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "__tie": F.xxhash64("text")})
    number = _ranges(rows, F.octet_length("text") + 8)
    rows = rows.withColumn("__range", F.lit(0).cast("long") if number is None else number.cast("long"))
    # Ties are ordered as unsigned numbers, as the ranges are.
    rows = rows.withColumn("__tie", F.col("__tie").bitwiseXOR(F.lit(-(1 << 63))))
    # The first row of a range, in descending order, has its greatest key; it also ends the range of greater keys.
    heads = rows.groupBy("__range").agg(F.max(F.struct("__key", "__tie")).alias("h"))
    above = F.coalesce(F.lead("__range").over(Window.orderBy("__range")), F.first("__range").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = heads.select(F.col("h.__key").alias("__head"), F.col("h.__tie").alias("__head_tie"), above.alias("__above"))
    placed = rows.join(F.broadcast(heads), (F.col("__key") == F.col("__head")) & (F.col("__tie") == F.col("__head_tie")), "left")  # twice MOST_RANGES rows at most
    homes = F.when(F.col("__above").isNull(), F.array(F.struct(F.col("__range").alias("range"), F.lit(0).alias("guest")))).otherwise(
        F.array(F.struct(F.col("__range").alias("range"), F.lit(0).alias("guest")), F.struct(F.col("__above").alias("range"), F.lit(1).alias("guest")))
    )
    own = ["doc_id", "text", "__key", "__tie"]
    dealt = placed.select(*own, F.explode(homes).alias("__home")).select(*own, "__home.range", "__home.guest").repartition("range")
    treed = add_tree(dealt, F.col("text"), "tree")
    order = Window.partitionBy("range").orderBy("guest", F.desc("__key"), F.desc("__tie"), "text")
    following = F.lead(F.struct("text", "tree")).over(order)
    return treed.withColumn("next", following).filter("guest = 0").select("doc_id", "text", "tree", F.col("next.text").alias("next_text"), F.col("next.tree").alias("next_tree"))


def edited_text(text: Column, next_text: Column) -> Column:
    """The text with the last half of its code points, rounded down, replaced by as many of the next text's first (or all)."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(next_text, F.lit(1), half))


def fingerprint_edits(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Fingerprints of every text and of its edit with the next document's, and their likeness.

    (doc_id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited,
    near_next, edits): edits lists the (section, paragraph) of the text that its
    edit doesn't have. A null or empty text is an empty section of an empty
    paragraph, with the same fingerprint; likeness is 1 between equal texts and 0
    between texts without a common leaf. A table of one row is its own next;
    repeated rows follow each other; an empty table gives none; other columns are
    passed over. A task holds a range of texts (RANGE_BYTES, or the copies of one
    text under one id), which the window's sort spills where it must.
    """
    pairs = with_next(docs, text_col, id_col).withColumn("edited", edited_text(F.col("text"), F.col("next_text")))
    trees = add_tree(pairs.drop("next_text"), F.col("edited"), "edited_tree")
    return trees.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.col("edited").alias("edited_text"),
        F.col("tree.fingerprint").alias("fingerprint"),
        F.col("edited_tree.fingerprint").alias("edited_fingerprint"),
        likeness(F.col("tree"), F.col("edited_tree")).alias("near_edited"),
        likeness(F.col("tree"), F.col("next_tree")).alias("near_next"),
        differing_branches(F.col("tree.fingerprint"), F.col("edited_tree.fingerprint")).alias("edits"),
    )
