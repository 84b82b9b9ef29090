"""Running values, numbers and exact medians of groups of any size: no task holds or walks a whole group.

A group is cut along its order into buckets (a coarse column that the order begins with).  A bucket is one task's window; what lies
before it comes from one total a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, group: list[str], coarse: list[Column], fine: list[Column], value: Column, name: str, most: bool = False) -> DataFrame:
    """Adds the sum (with ``most`` the maximum) of ``value`` over the rows before each row of its group; 0 (null) where there are none.

    The order is ``coarse`` and then ``fine``, and is total.  ``df`` is read twice, so one that is dear to make should be written first.
    Groups, and coarse values, may be null.
    """
    how = F.max if most else F.sum
    held = df.withColumns({"_v": value, "_g": F.struct(*group), "_c": F.struct(*(c.alias(f"c{i}") for i, c in enumerate(coarse)))})
    totals = held.groupBy("_g", "_c").agg(how("_v").alias("_t"))
    before = totals.select(F.struct("_g", "_c").alias("_k"), how("_t").over(Window.partitionBy("_g").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    own = held.withColumn("_k", F.struct("_g", "_c"))
    inside = how("_v").over(Window.partitionBy("_k").orderBy(*fine).rowsBetween(Window.unboundedPreceding, -1))
    both = own.withColumn("_inside", inside).join(before, "_k")
    out = F.greatest("_inside", "_before") if most else F.coalesce("_inside", F.lit(0)) + F.coalesce("_before", F.lit(0))
    return both.withColumn(name, out).drop("_v", "_g", "_c", "_k", "_inside", "_before")


def numbered(df: DataFrame, group: list[str], coarse: list[Column], fine: list[Column], name: str) -> DataFrame:
    """Adds the number from 1 of each row in its group's order."""
    return running(df, group, coarse, fine, F.lit(1), name).withColumn(name, (F.col(name) + 1).cast("int"))


def exact_medians(df: DataFrame, group: list[str], value: str, name: str = "median", accuracy: int = 10_000) -> DataFrame:
    """(group, ``name``): the exact median of the values that aren't null, as the mean of the middle two; null for a group without any.

    A mergeable sketch, whose ranks are at most 1 / ``accuracy`` off, gives two values around the middle.  The values between
    them, 4 / ``accuracy`` of a group and the sketch's error, are counted one by one, and those below only altogether.  ``df`` is
    read twice.
    """
    eps = 2 / accuracy
    keys = [F.col(g).alias(f"_g{i}") for i, g in enumerate(group)] or [F.lit(0).alias("_g0")]
    key = F.struct(*keys)
    own = df.select(key.alias("_k"), F.col(value).alias("_v"))
    bounds = own.groupBy("_k").agg(F.percentile_approx("_v", [0.5 - eps, 0.5 + eps], accuracy).alias("_b"), F.count("_v").alias("_n"))
    near = own.join(bounds, "_k").filter(F.col("_v").isNotNull() & (F.col("_v") <= F.col("_b")[1]))
    # below the lower bound all values are one row
    counts = near.groupBy("_k", "_n", F.when(F.col("_v") >= F.col("_b")[0], F.col("_v")).alias("_v")).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy("_k").orderBy(F.col("_v").asc_nulls_first()))
    placed = counts.withColumn("_upto", upto)
    at = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col("_v")))
    middle = placed.groupBy("_k", "_n").agg(((at(F.floor((F.col("_n") - 1) / 2)) + at(F.floor(F.col("_n") / 2))) / 2).alias(name))
    out = bounds.select("_k").join(middle.select("_k", name), "_k", "left")
    return out.select(*(F.col(f"_k._g{i}").alias(g) for i, g in enumerate(group)), name)
