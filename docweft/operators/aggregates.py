"""Grouped aggregates of documents and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unanimous(value: Column) -> Column:
    """The value if a group has exactly one that isn't null."""
    return F.when(F.count_distinct(value) == 1, F.max(value))


def first_distinct(value: Column, order: Column) -> Column:
    """Distinct values of a group that aren't null, by their first occurrence."""
    rows = F.filter(F.sort_array(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"].isNotNull())
    return F.array_distinct(F.transform(rows, lambda x: x["v"]))


def bbox_union(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(F.min(x1).alias("x1"), F.min(y1).alias("y1"), F.max(x2).alias("x2"), F.max(y2).alias("y2"))


def weighted_vote(rows: DataFrame, group: str, choice: str, weight: str) -> DataFrame:
    """The choice of the largest summed weight per group; weights of 0 or less don't count; ties: the larger choice."""
    real = rows.where((F.col(weight) > 0) & ~F.isnan(weight) & (F.col(weight) < float("inf")))
    sums = real.groupBy(group, choice).agg(F.sum(weight).alias("__w"))
    return sums.groupBy(group).agg(F.max_by(choice, F.struct("__w", choice)).alias(choice))


def ctc_collapse(rows: DataFrame, group: str, order: str, token: str, blank: str, score: str) -> DataFrame:
    """Tokens of a group that differ from the one before and aren't the blank: text, their number and mean score (0 if none)."""
    before = Window.partitionBy(group).orderBy(order)
    kept = rows.withColumn("__before", F.lag(token).over(before)).withColumn("__kept", ~F.col(token).eqNullSafe(F.col("__before")) & (F.col(token) != blank))
    texts = F.transform(F.sort_array(F.collect_list(F.when(F.col("__kept"), F.struct(F.col(order).alias("o"), F.col(token).alias("t"))))), lambda x: x["t"])
    return kept.groupBy(group).agg(F.array_join(texts, "").alias("text"), F.count_if("__kept").alias("tokens"), F.coalesce(F.avg(F.when(F.col("__kept"), F.col(score))), F.lit(0.0)).alias("confidence"))


def window_starts(n: Column, size: int, overlap: int) -> Column:
    """First positions (from 0) of windows of ``size`` that overlap and cover n items; one if n is small."""
    step = size - overlap
    last = F.when(n > size, F.ceil((n - size) / F.lit(step)).cast("int")).otherwise(0)
    return F.transform(F.sequence(F.lit(0), last), lambda i: i * step)


def spans(rows: DataFrame, group: str, index: str, start: str, end: str, least: float = 0.5, reach: int = 32, top: int = 8, chars: tuple[str, str] | None = None) -> DataFrame:
    """Pairs of start and end positions of a group, at most ``reach`` apart, the ``top`` most likely of each.

    The range join is an equi-join on blocks of ``reach`` positions: an end lies
    in its start's block or in the next one. ``chars`` names the columns of the
    first character of a start and of the one behind an end: only pairs that hold
    characters count, and they are returned as start_char and end_char.
    """
    first, last = ([F.col(chars[0]).alias("start_char")], [F.col(chars[1]).alias("end_char")]) if chars else ([], [])
    begins = rows.where(F.col(start) >= least).select(group, F.col(index).alias("start_index"), F.col(start).alias("__s"), F.floor(F.col(index) / reach).alias("__b"), *first)
    near = begins.withColumn("__b", F.explode(F.array(F.col("__b"), F.col("__b") + 1)))
    ends = rows.where(F.col(end) >= least).select(group, F.col(index).alias("end_index"), F.col(end).alias("__e"), F.floor(F.col(index) / reach).alias("__b"), *last)
    pairs = near.join(ends, [group, "__b"]).where(F.col("end_index").between(F.col("start_index"), F.col("start_index") + reach))
    if chars:
        pairs = pairs.where(F.col("end_char") > F.col("start_char"))
    own = ("start_char", "end_char") if chars else ()
    scored = pairs.select(group, "start_index", "end_index", *own, F.sqrt(F.col("__s") * F.col("__e")).alias("confidence"))
    order = Window.partitionBy(group).orderBy(F.desc("confidence"), "start_index", "end_index")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def rotation_vote(rows: DataFrame, group: str, rotation: str, weight: str) -> DataFrame:
    """The rotation of a group's patches that weighs most, in whole degrees from 0 to 359; ties: the larger one."""
    whole = F.pmod(F.round(F.col(rotation)).cast("int"), F.lit(360))
    return weighted_vote(rows.withColumn(rotation, whole), group, rotation, weight)
