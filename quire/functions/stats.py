"""Aggregates with the tie rules that layout needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upper_median(c: Column) -> Column:
    """The upper middle of the sorted values, 0 for none."""
    values = F.sort_array(F.collect_list(c))
    return F.coalesce(F.get(values, F.floor(F.size(values) / 2).cast("int")), F.lit(0.0))


def counted_middle(counts: Column, total: Column) -> Column:
    """The upper middle of values given by their counts, an array of struct(v, n) in order of
    v: the first value with more than half of all (rounded down) up to it."""
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("v"))

    def step(acc: Column, x: Column) -> Column:
        seen = acc["seen"] + x["n"]
        return F.struct(seen.alias("seen"), F.coalesce(acc["v"], F.when(seen > F.floor(total / 2), x["v"])).alias("v"))

    return F.aggregate(counts, start, step)["v"]


def upper_median_over(df: DataFrame, value: Column, keys: list[str], name: str) -> DataFrame:
    """Adds ``name``, the ``upper_median`` of a group, to each of its rows. The lower one of
    the negated values is what Spark's own discrete percentile gives."""
    lower = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY _negated)").over(Window.partitionBy(*keys))
    return df.withColumn("_negated", F.negative(value)).withColumn(name, F.coalesce(F.negative(lower), F.lit(0.0))).drop("_negated")


def modal_first_over(value: str, keys: list[str], order: list[str], rows: DataFrame, name: str) -> DataFrame:
    """``modal_first`` as a column of every row; one partitioning by ``keys`` serves it all."""
    reach, place = Window.partitionBy(*keys, value).orderBy(*order), Window.partitionBy(*keys).orderBy(*order)
    seen = rows.withColumn("_at", F.row_number().over(place)).withColumn("_n", F.row_number().over(reach))
    best = F.max_by(value, F.struct("_n", F.negative("_at"))).over(Window.partitionBy(*keys))
    return seen.withColumn(name, best).drop("_at", "_n")


def modal_first(df: DataFrame, keys: list[str], value: str, order: list[str], name: str) -> DataFrame:
    """For each group the value that first reaches the greatest count, in ``order``."""
    reach = Window.partitionBy(*keys, value).orderBy(*order)
    place = Window.partitionBy(*keys).orderBy(*order)
    seen = df.select(*keys, value, F.row_number().over(place).alias("_at"), F.row_number().over(reach).alias("_n"))
    return seen.groupBy(*keys).agg(F.max_by(value, F.struct("_n", F.negative("_at"))).alias(name))
