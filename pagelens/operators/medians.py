"""Exact medians of groups of any size.

F.median holds all values of a group in one buffer. Here equal values are counted first,
combined before the shuffle and dealt by (group, value), so a group that holds most rows
is spread over all tasks. A group with few distinct values finds its median in a running
sum; for the others a histogram between least and greatest value gives the bin that holds
the middle, whose own least and greatest value bound the next round's histogram.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_folder

#: Distinct values that one task puts in order.
ENOUGH = 4096
BINS = 1024


def medians(rows: DataFrame, group: list[str], value: str, enough: int = ENOUGH, bins: int = BINS) -> DataFrame:
    """group, n (finite values), median (double): a row for each group that has a finite value."""
    spark = rows.sparkSession
    at = shared_folder(spark)
    turn = 0

    def put(df: DataFrame) -> DataFrame:
        nonlocal turn
        turn += 1
        df.write.parquet(f"{at}/medians-{turn}")
        return spark.read.parquet(f"{at}/medians-{turn}")

    counted = put(rows.where(F.abs(F.col(value).cast("double")) < F.lit(float("inf"))).groupBy(F.struct(*group).alias("g"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n")))
    whole = counted.groupBy("g").agg(F.sum("n").alias("total"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("values"))
    # The two middle values, which are one where the number is odd: ``rank`` values of the range lie before it.
    middle = F.explode(F.array_distinct(F.array(F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)))).alias("rank")
    state = put(whole.select("g", "total", "lo", "hi", "values", middle).withColumn("target", F.col("rank")))
    closed = []
    while True:
        wide = (F.col("values") > enough) & (F.col("lo") < F.col("hi"))
        closed.append(state.where(~wide))
        state = state.where(wide)
        if state.isEmpty():
            break
        inside = _inside(counted, state)
        bin_ = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
        counts = inside.withColumn("bin", bin_).groupBy("g", "total", "target", "bin").agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("values"), F.min("rank").alias("rank"))
        before = F.sum("n").over(Window.partitionBy("g", "target").orderBy("bin")) - F.col("n")
        held = counts.withColumn("before", before).where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n")))
        state = put(held.select("g", "total", "lo", "hi", "values", (F.col("rank") - F.col("before")).alias("rank"), "target"))
    return _finish(counted, closed, group)


def _inside(counted: DataFrame, state: DataFrame) -> DataFrame:
    """The values of each group that are still in its range, once for each middle value that is looked for."""
    ranges = state.select(F.col("g").alias("_g"), "total", "lo", "hi", "rank", "target")
    return counted.join(ranges, F.col("g") == F.col("_g")).where(F.col("v").between(F.col("lo"), F.col("hi"))).drop("_g")


def _finish(counted: DataFrame, closed: list[DataFrame], group: list[str]) -> DataFrame:
    out = None
    for state in closed:
        inside = _inside(counted, state)
        before = F.sum("n").over(Window.partitionBy("g", "target").orderBy("v")) - F.col("n")
        held = inside.withColumn("before", before).where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n"))).select("g", "total", "v")
        out = held if out is None else out.unionByName(held)
    return out.groupBy("g").agg(F.max("total").alias("n"), F.avg("v").alias("median")).select(*(F.col(f"g.{c}").alias(c) for c in group), "n", "median")
