r"""Document fingerprints: a Merkle tree over paragraphs and sections, as SQL functions only.

Paragraphs end with a line break or with a sentence's full stop, question or exclamation mark and the
space after it; nothing is dropped, so the paragraphs joined are the text. A leaf is a paragraph's MD5. A
section ends after a leaf whose MD5 starts with the digit 0 (one in SECTION) or with the text: cuts follow from
the paragraphs, not from their places, so paragraphs put in or taken out change the sections they are in, and later ones
stay as they are. A section is the SHA-256 of its leaves in order, the root the SHA-256 of the sections. Equal texts have equal roots;
where roots differ, only the sections that the other tree lacks need to be looked into.

Likeness of two fingerprints is the Dice coefficient of their sets of leaves: 1 for equal texts, 0 if
no paragraph is shared. Null and empty texts have one empty paragraph.

The next document: ids are cut into ranges at approximate quantiles, each range gets the first row of
the next one as well, and a window per range looks one row ahead. So texts are shuffled once and no
range depends on how many rows share a source. Ties on the id follow the text's hash; null ids come
last. A table of one row follows itself. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Paragraphs in a section on average (as many as there are hexadecimal digits), and most ranges of ids (a bound for the broadcast of their first rows).
SECTION, RANGES = 16, 4096
_LAST = (1 << 63) - 1


def paragraphs(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), r"(?<=\n)(?!\z)|(?<=[.!?] )(?!\z)", -1)


def leaves(text: Column) -> Column:
    return F.transform(paragraphs(text), lambda p: F.md5(F.encode(p, "UTF-8")))


def sections(leaf: Column) -> Column:
    ends = F.filter(F.transform(leaf, lambda p, k: F.when(p.startswith("0") | (k + 1 == F.size(leaf)), k + 1)), lambda k: k.isNotNull())
    starts = F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.size(ends) - 1))
    return F.zip_with(starts, ends, lambda a, b: F.sha2(F.encode(F.array_join(F.slice(leaf, a + 1, b - a), ""), "UTF-8"), 256))


def root(section: Column) -> Column:
    return F.sha2(F.encode(F.array_join(section, ""), "UTF-8"), 256)


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of two sets of leaves (arrays without repeats)."""
    return 2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))


def differing_sections(a: Column, b: Column) -> Column:
    """Positions (from 0) of a's sections that b has nowhere: where a was edited."""
    # What b lacks is bound once, as the only element of an array; a lambda would compute it anew for every section.
    own = F.array(F.array_except(a, b))
    return F.transform(own, lambda other: F.filter(F.transform(a, lambda s, k: F.when(F.array_contains(other, s), k)), lambda k: k.isNotNull()))[0]


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text and next_text, the text of the next row in order of id (after the last: the first)."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce(F.col("id").cast("long"), F.lit(_LAST)))
    n = min(RANGES, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = rows.agg(F.percentile_approx("key", [k / n for k in range(1, n)], 10 * n).alias("at")).first().at or []
    cuts = sorted(set(found))
    steps = [1 << k for k in range(len(cuts).bit_length() - 1, -1, -1)]
    at = F.array(*(F.lit(c) for c in cuts)) if cuts else F.array().cast("array<bigint>")
    place = F.aggregate(
        F.array(*(F.lit(s) for s in steps)) if cuts else F.array().cast("array<int>"),
        F.lit(0),
        lambda got, s: F.when((got + s <= len(cuts)) & (F.get(at, got + s - 1) <= F.col("key")), got + s).otherwise(got),
    )
    rows = rows.withColumn("range", place)
    firsts = rows.groupBy("range").agg(F.min("key").alias("key"))
    order = Window.orderBy("range")
    ends = F.max("range").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    firsts = firsts.select("key", F.coalesce(F.lag("range").over(order), ends).alias("to"))
    more = rows.join(F.broadcast(firsts), "key").select("id", "text", "key", F.col("to").alias("range"), F.lit(1).alias("extra"))
    both = rows.select("id", "text", "key", "range", F.lit(0).alias("extra")).unionByName(more)
    ahead = F.lead("text").over(Window.partitionBy("range").orderBy("extra", "key", F.xxhash64("text")))
    return both.withColumn("next_text", ahead).where("extra = 0").select(F.col("id").alias(id_col), "text", "next_text")


def edited(text: Column, following: Column) -> Column:
    """The last floor(n / 2) code points replaced by the first as many (or all) of the following text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.left(text, F.length(text) - half), F.left(following, half))


def trees(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, edited text, and the sections and leaf sets of the text, the edited text and the next text."""
    out = with_next(df, id_col, text_col).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    for name in ("text", "edited", "next_text"):
        out = out.withColumn(f"{name}_leaves", leaves(F.col(name)))
    return out.select(
        id_col, "text", "edited",
        sections(F.col("text_leaves")).alias("sections"), sections(F.col("edited_leaves")).alias("edited_sections"),
        *(F.array_distinct(f"{n}_leaves").alias(f"{n}_set") for n in ("text", "edited", "next_text")),
    )


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next, changed_sections (of the text) and edited_sections (of the edited text)."""
    t = trees(df, id_col, text_col)
    return t.select(
        id_col, F.length("text").cast("long").alias("n_chars"), F.col("edited").alias("edited_text"),
        root(F.col("sections")).alias("fingerprint"), root(F.col("edited_sections")).alias("edited_fingerprint"),
        likeness(F.col("text_set"), F.col("edited_set")).alias("near_edited"), likeness(F.col("text_set"), F.col("next_text_set")).alias("near_next"),
        differing_sections(F.col("sections"), F.col("edited_sections")).alias("changed_sections"),
        differing_sections(F.col("edited_sections"), F.col("sections")).alias("edited_sections"),
    )
