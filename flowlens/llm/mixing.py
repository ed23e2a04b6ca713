"""Mixing sources to target weights by a time-varying curriculum.

Every source has a weight and a schedule: how strongly it is wanted at each
moment of training time 0..1 (a piecewise linear curve). The integral of the
schedule, scaled to the source's target, is its cumulative word demand; its
inverse tells when the k-th word of the source is due. The documents of a
source form a stream in a fixed pseudo-random order (MD5 of the id), repeated
while the target exceeds the source; a copy's training position is the time at
which the demand reaches the copy's middle word. Sorting by position (range
partitioning) gives the training order.

Targets: sources share the total size by weight, no target above
``max_repeat`` times its source; what a capped source leaves is shared again
by weight among the others until none is above its cap.

Running sums over a source never put the source into one task: the stream is
cut into blocks by the leading digits of the MD5, block sums give each block's
start, and only the rows of one (source, block) are ordered together.

Defined cases: a null text has size 0; null sources form one source, ordered
last; a document of size 0 is never taken; rows with equal ids and sizes are
interchangeable; an empty table gives an empty result. Input columns of any
name pass through untouched.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlens.llm.runtime import Scratch

WORDS = r"[^\x20\x09-\x0D]+"
GAPS = r"[\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
# Relative weight over training time, by position in WEIGHTS: heavy sources
# early, light ones late.
SCHEDULES = ((1.6, 1.0, 0.4), (1.0, 1.0, 1.0), (0.4, 1.0, 1.6))
BLOCK_DIGITS = 3  # 16^3 blocks per source


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def _source_key(source: Column) -> Column:
    """A non-null key: joins treat null sources as one source."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def source_targets(spark: SparkSession, sizes: DataFrame, weights=WEIGHTS, max_repeat: float = 3.0,
                   scratch: Scratch | None = None) -> DataFrame:
    """From (source, size) rows: source_key, source, source_size, tier, weight, target.

    Only scalars reach the driver (one aggregate per round of re-sharing, and
    one count per partition for the ranks)."""
    scratch = scratch or Scratch(spark, "mix")
    per = (sizes.groupBy(F.col("source")).agg(F.sum("size").alias("source_size"))
           .repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
           .withColumn("place", F.monotonically_increasing_id()))
    per = scratch.keep(per, "sources")
    part = F.shiftright("place", 33)
    before, start = {}, 0
    for r in per.groupBy(part.alias("p")).count().orderBy("p").collect():  # one row per partition
        before[r.p], start = start, start + r["count"]
    offset = F.element_at(F.create_map(*[F.lit(int(x)) for kv in before.items() for x in kv]), part.cast("int")) \
        if before else F.lit(0)
    tier = ((F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + offset) % len(weights)).cast("int")
    per = per.withColumn("tier", tier).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("tier") + 1))
    cap = F.col("source_size") * F.lit(max_repeat)
    level, total = 0.0, None
    while True:
        capped = cap < F.col("weight") * F.lit(level)
        if total is None:
            total = per.agg(F.sum("source_size")).first()[0] or 0
        r = per.agg(F.sum(F.when(capped, cap).otherwise(0.0)).alias("c"),
                    F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))).alias("w")).first()
        new = (total - r.c) / r.w if r.w else 0.0
        if new <= level:
            break
        level = new
    return per.select(_source_key(F.col("source")).alias("source_key"), "source_size", "tier",
                      F.least(cap, F.col("weight") * F.lit(level)).alias("target"))


def due_time(share: Column, tier: Column, schedules=SCHEDULES) -> Column:
    """The training time by which ``share`` (0..1) of a source's demand is due:
    the inverse of the integrated schedule, one quadratic per linear piece."""
    out = None
    for t, knots in enumerate(schedules):
        h = 1.0 / (len(knots) - 1)
        areas = [(a + b) / 2 * h for a, b in zip(knots, knots[1:])]
        total, when, done = sum(areas), None, 0.0
        for k, (a, b, area) in enumerate(zip(knots, knots[1:], areas)):
            left = F.greatest(share * F.lit(total) - F.lit(done), F.lit(0.0))  # a*d + (b-a)*d*d/(2h) = left
            root = F.sqrt(F.greatest(F.lit(a * a) + F.lit(2.0 * (b - a) / h) * left, F.lit(0.0)))
            d = F.coalesce(F.try_divide(F.lit(2.0) * left, F.lit(a) + root), F.lit(0.0))
            at = F.lit(k * h) + F.least(d, F.lit(h))
            done += area
            when = at if when is None else F.when(share * F.lit(total) > F.lit(done - area), at).otherwise(when)
        out = when if out is None else F.when(tier == t, when).otherwise(out)
    return F.greatest(F.least(out, F.lit(1.0)), F.lit(0.0))


def plan_mix(docs: DataFrame, weights=WEIGHTS, max_repeat: float = 3.0, id_col: str = "doc_id",
             source_col: str = "source", size: Column | None = None) -> DataFrame:
    """One row per input row: ``row`` (the input columns as a struct) and
    ``mix`` (size, source_size, target, taken, before, whole, tier).

    ``whole`` is the target in whole words; the copies of the source's stream
    are cut off there, so the words taken add up to it exactly."""
    spark = docs.sparkSession
    size = word_count(F.col("text").cast("string")) if size is None else size
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), size.alias("size"),
                       F.col(source_col).cast("string").alias("source"), F.col(id_col).alias("id"), key.alias("order"))
    rows = rows.select("row", "size", "id", "order", "source", _source_key(F.col("source")).alias("source_key"),
                       F.substring("order", 1, BLOCK_DIGITS).alias("block"))
    scratch = Scratch(spark, "mix")
    blocks = scratch.keep(rows.groupBy("source", "source_key", "block").agg(F.sum("size").alias("size")), "blocks")
    targets = source_targets(spark, blocks.select("source", "size"), weights, max_repeat, scratch)
    w = Window.partitionBy("source_key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (blocks.select("source_key", "block", F.coalesce(F.sum("size").over(w), F.lit(0)).alias("block_start"))
              .join(targets, "source_key"))
    starts = scratch.keep(starts, "starts")
    w = Window.partitionBy("source_key", "block").orderBy("order", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = (rows.select("row", "size", "source_key", "block", "order", "id",
                       F.coalesce(F.sum("size").over(w), F.lit(0)).alias("in_block"))
           .join(starts, ["source_key", "block"]))
    before = F.col("block_start") + F.col("in_block")
    whole = F.floor("target").cast("long")
    rounds = F.coalesce(F.try_divide(whole, F.col("source_size")).cast("long"), F.lit(0))
    rest = whole - rounds * F.col("source_size")
    taken = rounds * F.col("size") + F.greatest(F.least(rest - before, F.col("size")), F.lit(0))
    return out.select("row", F.struct("size", "source_size", "target", taken.cast("long").alias("taken"),
                                      before.alias("before"), whole.alias("whole"), "tier").alias("mix"))


def deal(planned: DataFrame, schedules=SCHEDULES) -> DataFrame:
    """``row``, ``mix`` and ``copies``: the copies that the mix takes of the row
    (empty if none), each with ``copy`` (0, 1, ...), ``words`` (of this copy) and
    ``position`` (training time 0..1)."""
    m = F.col("mix")
    n = F.ceil(F.try_divide(m.taken, m["size"])).cast("int")

    def one(copy: Column) -> Column:
        offset = m.before + copy * m.source_size
        words = F.least(m["size"], m.whole - offset)
        share = (offset + words / 2) / m.whole
        return F.struct(copy.alias("copy"), words.alias("words"), due_time(share, m.tier, schedules).alias("position"))

    numbers = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return planned.select("row", "mix", F.transform(numbers, one).alias("copies"))


def copies(planned: DataFrame, schedules=SCHEDULES) -> DataFrame:
    """One row per copy that the mix takes: ``row``, ``mix``, ``copy``, ``words``
    and ``position`` of :func:`deal`."""
    return deal(planned, schedules).select("row", "mix", F.inline("copies"))


def in_training_order(planned: DataFrame, schedules=SCHEDULES) -> DataFrame:
    """The rows of :func:`deal`, range-sorted by the position of the first copy;
    rows that the mix leaves out come last."""
    first = F.try_element_at("copies", F.lit(1))["position"]
    return deal(planned, schedules).orderBy(first.asc_nulls_last(), "mix.before", F.col("mix.tier"))


def _plain_scan(docs: DataFrame) -> bool:
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation"


def _numbered(docs: DataFrame, number: str) -> DataFrame:
    """``docs`` with a column that tells its rows apart and is the same on every
    read: file and row number of a table read from Parquet files as it is, else
    numbers written with the rows once."""
    if _plain_scan(docs):
        try:
            return docs.select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias(number))
        except AnalysisException:  # no Parquet files
            pass
    return Scratch(docs.sparkSession, "mixed").keep(docs.withColumn(number, F.monotonically_increasing_id()), "rows")


def mix_documents(docs: DataFrame, weights=WEIGHTS, max_repeat: float = 3.0, schedules=SCHEDULES,
                  text_col: str = "text", whole_copies: bool = False) -> DataFrame:
    """The mixed corpus in training order, with the input's columns. A copy at
    the end of a source's demand is cut to the words still wanted (its
    ``n_chars``, where there is such a column, follows); with ``whole_copies``
    it is taken whole, so a source exceeds its target by less than one document."""
    number, place = "number", "place"
    while {number, place} & set(docs.columns):
        number, place = number + "_", place + "_"
    # Rows have numbers, so that plan and order are made of numbers, sources and sizes; texts join at the end.
    rows = _numbered(docs, number)
    slim = rows.select(F.col(number), F.col("doc_id"), F.col("source"), word_count(F.col(text_col).cast("string")).alias("n_words"))
    planned = copies(plan_mix(slim, weights, max_repeat, size=F.col("n_words")), schedules)
    order = planned.select(F.struct(F.col("row")[number].alias("of"), "position", "copy", "mix.before", "words", F.col("mix.size").alias("size")).alias(place))
    c = rows.join(order.hint("merge"), F.col(number) == F.col(f"{place}.of"))
    text, mix = F.col(f"`{text_col}`"), F.col(place)
    cut = F.lit(False) if whole_copies else mix.words < mix["size"]
    first = F.array_join(F.slice(F.split(F.regexp_replace(text, "^" + GAPS, ""), GAPS), 1, mix.words.cast("int")), " ")
    taken = F.when(cut, first).otherwise(text)
    cols = []
    for name in docs.columns:
        v = F.col(f"`{name}`")
        if name == text_col:
            v = taken
        elif name == "n_chars":
            v = F.when(cut, F.length(taken).cast(docs.schema[name].dataType)).otherwise(v)
        cols.append(v.alias(name))
    return c.orderBy(mix.position, mix.before, mix["copy"]).select(*cols)
