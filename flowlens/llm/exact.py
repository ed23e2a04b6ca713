"""Exact deduplication by distributed MSD radix partitioning.

A document's radix string is its byte length followed by its bytes. Round by
round the next digit (a run of successive bytes, wider every round) splits the
groups of rows that agree so far. A row whose group has no other row is done;
so is a group whose texts have ended, since the length led the string: its
rows are equal byte by byte. No digest decides anything.

One round is one aggregate over (group, digit) -- combined before the shuffle,
so a group with a third of all rows costs each task one row -- and one join of
the rows with the digits that occur more than once, whose hot keys Spark
splits. The rows that must go on are written with their next group number, so
a round reads only them. Digit widths grow eightfold: documents of 128 kB need
five rounds.

Defined cases: a null text counts as empty, and empty texts equal each other.
Of equal texts the row with the largest id stays; null ids sort below all
others. Where the largest id occurs on several equal rows, one of them stays.
An empty table gives an empty result. Input columns of any name pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.runtime import Scratch

FIRST_DIGIT = 64
DIGIT_GROWTH = 8
WIDEST_DIGIT = 1 << 20


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 first_digit: int = FIRST_DIGIT, growth: int = DIGIT_GROWTH) -> DataFrame:
    """``row`` (the input columns as a struct), ``keep_id``, ``group_size`` and
    ``kept`` for every input row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    text = F.coalesce(F.col("row")[text_col].cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.lit(0).cast("long").alias("grp"))
    offset, width, done, round_ = 0, first_digit, [], 0
    while True:
        size = F.octet_length(text).cast("long")
        part = F.substring(text, offset + 1, width)
        # The length is the leading digit: texts of other lengths part in round 0.
        keyed = rows.select("row", "grp", (size if round_ == 0 else F.lit(0).cast("long")).alias("len"),
                            part.alias("digit"), (size <= offset + width).alias("ended"))
        many = (keyed.groupBy("grp", "len", "digit", "ended")
                .agg(F.count(F.lit(1)).alias("n"), F.max(F.col("row")[id_col]).alias("keep_id"))
                .filter("n > 1").withColumn("next", F.monotonically_increasing_id()))
        many = scratch.keep(many, f"many{round_}")  # written once, so the group numbers are settled
        hit = many.select(*[F.col(c).alias(f"m_{c}") for c in many.columns])
        on = [F.col(c) == F.col(f"m_{c}") for c in ("grp", "len", "digit", "ended")]
        # A merge join at every size: the rows are dealt by key once, and hot keys are split.
        out = (keyed.join(hit.hint("merge"), on, "left")
               .select("row", F.coalesce("m_next", F.lit(-1)).alias("grp"), F.coalesce("m_n", F.lit(1)).alias("group_size"),
                       F.when(F.col("m_n").isNull(), F.col("row")[id_col]).otherwise(F.col("m_keep_id")).alias("keep_id"),
                       F.coalesce(F.col("m_ended"), F.lit(True)).alias("done")))
        out = scratch.keep(out, f"round{round_}", partition_by="done")
        done.append(out.filter("done"))
        rows = out.filter("NOT done").select("row", "grp")
        if many.filter("NOT ended").limit(1).count() == 0:
            break
        offset, width, round_ = offset + width, min(width * growth, WIDEST_DIGIT), round_ + 1
    parts = [_with_kept(spark, p, r, id_col) for r, p in enumerate(done)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _with_kept(spark, part: DataFrame, number: int, id_col: str) -> DataFrame:
    """``kept``: the row with the largest id. Where that id stands on several
    rows of a group, the first by file and row of the written round stays."""
    largest = F.col("row")[id_col].eqNullSafe(F.col("keep_id"))
    ties = (part.filter((F.col("group_size") > 1) & largest).groupBy("grp").count().filter("count > 1"))
    if ties.limit(1).count() == 0:
        return part.select("row", "keep_id", "group_size", largest.alias("kept"))
    place = F.struct(F.col("_metadata.file_name"), F.col("_metadata.row_index"))
    placed = part.select("row", "keep_id", "group_size", "grp", largest.alias("largest"), place.alias("place"))
    first = (placed.filter((F.col("group_size") > 1) & F.col("largest")).groupBy("grp").agg(F.min("place").alias("first"))
             .withColumnRenamed("grp", "f_grp"))
    return (placed.join(first, F.col("grp") == F.col("f_grp"), "left")
            .select("row", "keep_id", "group_size",
                    (F.col("largest") & ((F.col("group_size") == 1) | F.col("place").eqNullSafe(F.col("first")))).alias("kept")))


def drop_exact_duplicates(docs: DataFrame, **names) -> DataFrame:
    """The input's rows and columns, one row of every group of equal texts."""
    kept = exact_groups(docs, **names).filter("kept")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
