"""Exact quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written

#: Values of a group that an aggregate may hold; greater groups are selected from by rank.
HELD = 1_000_000


def _name(p: float) -> str:
    return f"q{p:g}".replace(".", "_")


def held_quantiles(df: DataFrame, keys: list[str], value: str, ps: tuple[float, ...]) -> DataFrame:
    """keys and a column for each p (q0_5 of 0.5), by an aggregate that holds the distinct values of a group."""
    return df.groupBy(*keys).agg(*(F.percentile(value, p).alias(_name(p)) for p in ps))


def ranked_quantiles(df: DataFrame, keys: list[str], value: str, ps: tuple[float, ...]) -> DataFrame:
    """The same, where no task holds a group: distinct values are counted, sorted into ranges, and ranked by the counts before them; of each group only the values at the ranks asked for are kept."""
    c = F.col
    cells = df.where(c(value).isNotNull()).select(*keys, c(value).cast("double").alias("_v")).groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
    ranges = written(written(cells, "cells").repartitionByRange(*keys, "_v").withColumn("_range", F.spark_partition_id()), "ranges")
    # what a group has in the ranges before, and in all
    per = ranges.groupBy(*keys, "_range").agg(F.sum("_n").alias("_m"))
    group = W.partitionBy(*keys)
    upto = per.select(*(c(k).alias(f"_k{i}") for i, k in enumerate(keys)), c("_range").alias("_r"), F.coalesce(F.sum("_m").over(group.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_m").over(group).alias("_all"))
    same = c("_range") == c("_r")
    for i, k in enumerate(keys):
        same = same & c(k).eqNullSafe(c(f"_k{i}"))
    inside = F.coalesce(F.sum("_n").over(W.partitionBy("_range", *keys).orderBy("_v").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = ranges.withColumn("_inside", inside).join(F.broadcast(upto), same).withColumn("_from", c("_before") + c("_inside"))

    def at(rank: Column) -> Column:
        return F.max(F.when((c("_from") <= rank) & (rank < c("_from") + c("_n")), c("_v")))

    position = lambda p: (c("_all") - 1) * F.lit(float(p))
    picked = placed.groupBy(*keys).agg(F.max("_all").alias("_all"), *(x.alias(f"{_name(p)}{s}") for p in ps for s, x in (("l", at(F.floor(position(p)))), ("h", at(F.ceil(position(p)))))))
    low, high = (lambda p: c(f"{_name(p)}l")), (lambda p: c(f"{_name(p)}h"))
    between = lambda p: (F.ceil(position(p)) - position(p)) * low(p) + (position(p) - F.floor(position(p))) * high(p)
    return picked.select(*keys, *(F.when(low(p) == high(p), low(p)).otherwise(between(p)).alias(_name(p)) for p in ps))


def quantiles(df: DataFrame, keys: list[str], value: str, ps: tuple[float, ...], held: int = HELD, sizes: DataFrame | None = None) -> DataFrame:
    """keys and a column for each p (q0_5 of 0.5): the value at (n - 1) * p in order, between two by linear interpolation; null for a group without values. Groups of up to `held` values by an aggregate, others by ranks, with the same result. sizes: keys and n of each group, if they are known."""
    sizes = sizes if sizes is not None else df.groupBy(*keys).agg(F.count(value).alias("n"))
    big = written(sizes.where(F.col("n") > held).select(*keys), "large-groups")
    if not big.head(1):
        return held_quantiles(df, keys, value, ps)
    marks = big.select(*(F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_g{i}"))
    # so many large groups as there are, each has more than `held` rows: few beside the rows
    return held_quantiles(df.join(marks, same, "left_anti"), keys, value, ps).unionByName(ranked_quantiles(df.join(marks, same, "left_semi"), keys, value, ps))
