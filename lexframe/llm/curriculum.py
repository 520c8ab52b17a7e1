"""Mixing sources to target weights by a time-varying curriculum.

Every source has a weight schedule over training time 0..1, given as (time, weight) knots joined
by straight lines. The integral of the schedule is the source's weight in the mix. Targets share a
token budget by weight, stop at a multiple of the source's size, and the excess is shared again
among the others until none is above. Inside a source, documents follow one another in a fixed
hash order, pass after pass, until the target is used up; only whole documents are taken, the last one if
at least half of it fits, so a source misses its target by at most half a document. A document's training position is found by inverting the source's cumulative token
demand at its first token, and the mix is range-sorted by position.

The running totals never gather a source: rows are cut by hash order into buckets, a bucket's
total is a partial aggregate, and only rows of one (source, bucket) are sorted together. A source
with a third of all rows is spread over all its buckets.

Defined cases: sizes of null texts are 0, and such rows are taken 0 times; the null source comes
last; a null id sorts as the empty string; repeated rows and rows of one id are taken one after
the other (equal rows are interchangeable); extra columns are carried; an empty table gives an
empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lexframe.llm.common import materialise, n_words, partitions
from lexframe.operators.conversations import positional_rank
from lexframe.session import cut_lineage

Schedule = list[tuple[float, float]]
#: Schedules given to the sources in turn; their integrals are 3, 1 and 2.
SCHEDULES: list[Schedule] = [[(0.0, 4.0), (1.0, 2.0)], [(0.0, 1.0), (1.0, 1.0)], [(0.0, 1.0), (0.5, 2.0), (1.0, 3.0)]]
#: Words to take, as a share of all words, and the most often that one document is taken.
BUDGET, MAX_PASSES = 1.5, 2


def integral(schedule: Schedule) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]))


def demand_inverse(share: Column, schedule: Schedule) -> Column:
    """Time at which the schedule's integral reaches ``share`` (0..1) of its whole."""
    total, before, out = integral(schedule), 0.0, None
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        area = (t1 - t0) * (w0 + w1) / 2
        if area <= 0:
            continue
        left = share * F.lit(total) - F.lit(before)
        # w0 * x + slope / 2 * x**2 = left, solved in the form that also holds for slope 0.
        slope = (w1 - w0) / (t1 - t0)
        root = F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + F.lit(2 * slope) * left))
        x = F.when(left <= 0, F.lit(0.0)).otherwise(F.lit(2.0) * left / (F.lit(w0) + root))
        time = F.lit(t0) + F.least(F.lit(t1 - t0), x)
        out = time if out is None else F.when(left <= 0, out).otherwise(time)
        before += area
    return out


def source_targets(sources: DataFrame, schedules: list[Schedule] = SCHEDULES, budget: float = BUDGET,
                   max_passes: int = MAX_PASSES) -> DataFrame:
    """``sources`` (source, source_size) with ``turn`` (which schedule) and ``target`` (double).

    The level at which targets are proportional to weights rises each time a source is capped;
    each round is one aggregate over the sources whose totals (scalars) come to the driver."""
    weights = [integral(s) for s in schedules]
    ranked = positional_rank(sources.withColumn("_all", F.lit(0)), "_all", [F.col("source").asc_nulls_last()], name="_rank")
    turn = ((F.col("_rank") - 1) % len(schedules)).cast("int")
    weight = F.element_at(F.array(*map(F.lit, weights)), turn + 1)
    cap = (max_passes * F.col("source_size")).cast("double")
    table = cut_lineage(ranked.select("source", "source_size", turn.alias("turn"), weight.alias("_weight"), cap.alias("_cap")))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        free = F.lit(True) if capped < 0 else F.col("_cap") >= F.col("_weight") * F.lit(level)
        n, caps, w = table.agg(F.count(F.when(~free, 1)), F.sum(F.when(~free, F.col("_cap")).otherwise(0.0)),
                               F.sum(F.when(free, F.col("_weight")).otherwise(0.0))).first()
        if n == capped or not w:
            break
        capped, level = n, (budget * total - caps) / w
    return table.select("source", "source_size", "turn",
                        F.least(F.col("_cap"), F.col("_weight") * F.lit(level)).alias("target"))


def plan(docs: DataFrame, size: Column, source_col: str = "source", id_col: str = "doc_id",
         schedules: list[Schedule] = SCHEDULES, budget: float = BUDGET, max_passes: int = MAX_PASSES) -> DataFrame:
    """One row per input row: ``row`` (the input columns as a struct), size, source_size, turn,
    target, ``start`` (words of the source before it in a pass) and ``taken`` (words the mix takes)."""
    n_buckets = 2 * partitions(docs)
    order = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    part = F.floor(F.conv(F.substring("_order", 1, 8), 16, 10).cast("double") / float(1 << 32) * n_buckets).cast("int")
    rows = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("row"), F.col(source_col).alias("source"),
                       size.alias("size"), order.alias("_order")).withColumn("_part", part)
    pieces = cut_lineage(rows.groupBy("source", "_part").agg(F.sum("size").alias("_sum")))
    sources = source_targets(pieces.groupBy("source").agg(F.sum("_sum").alias("source_size")), schedules, budget, max_passes)
    before = F.sum("_sum").over(Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.withColumn("_before", F.coalesce(before, F.lit(0)))  # at most n_buckets rows a source
    side = pieces.join(sources.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).select(
        F.col("source").alias("_source"), F.col("_part").alias("_piece"), "_before", "source_size", "turn", "target")
    inside = F.sum("size").over(Window.partitionBy("source", "_part").orderBy("_order", "size", F.xxhash64("row"))
                                .rowsBetween(Window.unboundedPreceding, 0))
    out = (rows.withColumn("_inside", inside)
           .join(side, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_part") == F.col("_piece"))))
    start = F.col("_before") + F.col("_inside") - F.col("size")
    words = F.floor(F.col("target") + 0.5).cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long")
    rest = words - passes * F.col("source_size")
    taken = (passes + F.when((F.col("size") > 0) & (2 * (rest - start) >= F.col("size")), 1).otherwise(0)) * F.col("size")
    return out.select("row", "size", "source_size", "turn", "target", start.cast("long").alias("start"),
                      taken.cast("long").alias("taken"))


def copies(planned: DataFrame, schedules: list[Schedule] = SCHEDULES) -> DataFrame:
    """One row per copy that the mix takes: the plan's columns, ``copy`` (0, 1, ...) and ``position``
    (0..1), range-sorted by position."""
    n = (F.col("taken") / F.col("size")).cast("int")
    rows = planned.where("taken > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), n - 1)))
    rows = rows.withColumn("position", position(F.col("copy"), schedules))
    return rows.repartitionByRange(partitions(rows), "position").sortWithinPartitions("position")


def position(copy: Column, schedules: list[Schedule] = SCHEDULES) -> Column:
    """Training position of a copy's first word."""
    share = (copy * F.col("source_size") + F.col("start")).cast("double") / F.greatest(F.lit(1.0), F.col("target"))
    out = demand_inverse(share, schedules[0])
    for k, schedule in enumerate(schedules[1:], 1):
        out = F.when(F.col("turn") == k, demand_inverse(share, schedule)).otherwise(out)
    return out


def mix_documents(docs: DataFrame, text_col: str = "text", **params) -> DataFrame:
    """The mixed documents in training order: a row per copy, with the input's columns and whole texts."""
    got = copies(plan(docs, n_words(F.col(text_col)), **params))
    return got.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def taken_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per document: size, source_size, target, taken, and the position of its first copy (null if
    none is taken), range-sorted by position, then id."""
    sized = materialise(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                                    n_words(F.col(text_col)).alias("size")), "sizes")
    out = plan(sized, F.col("size")).select(F.col("row")["doc_id"].alias(id_col), "size", "source_size", "target", "taken",
                             F.when(F.col("taken") > 0, position(F.lit(0))).alias("position"))
    return out.repartitionByRange(partitions(out), "position", id_col).sortWithinPartitions("position", id_col)
