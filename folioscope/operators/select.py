"""Exact medians of groups of any size, by nested histograms.

Each group's two middle ranks are narrowed down: values between the bounds known so far are counted by bucket, with each bucket's least and greatest value; the bucket that
holds the rank gives the next bounds. Only counts leave a task. Once few enough values are left between the bounds, they are ranked; none of that needs a group in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.work import settled

#: Buckets of a histogram; values of a group that may be ranked in one task; groups whose bounds are sent to every task.
BUCKETS, FEW, SENT = 1024, 10_000, 100_000


def _bucket(x: Column, lo: Column, hi: Column) -> Column:
    """The bucket of a value between the bounds; it never falls as the value rises. Bounds far apart are cut by the logarithm."""
    share = F.when((lo > 0) & (hi > BUCKETS * lo), (F.log(x) - F.log(lo)) / (F.log(hi) - F.log(lo))).otherwise((x / 2 - lo / 2) / (hi / 2 - lo / 2))
    return F.when(lo == hi, 0).otherwise(F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)))


def medians(rows: DataFrame, group: str, value: str, few: int = FEW) -> DataFrame:
    """(group, median): the middle value of each group, or the mean of the two middle ones; nulls don't count. A group without values isn't there; groups may be null."""
    x = rows.select(F.col(group).alias("g"), F.col(value).cast("double").alias("x")).filter("x IS NOT NULL")
    ends = x.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    # nth: which value of the group, from 0; before: how many values are under the bounds; n: how many between them
    state = ends.select("g", F.explode(F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)))).alias("nth"), F.lit(0).cast("long").alias("before"), "n", "lo", "hi")
    state = settled(state)
    small = state.count() <= SENT

    def between(state: DataFrame) -> DataFrame:
        of = state.withColumnRenamed("g", "of")
        on = x["g"].eqNullSafe(of["of"]) & (x["x"] >= of["lo"]) & (x["x"] <= of["hi"])
        return x.join(F.broadcast(of) if small else of, on).drop("of")

    while not (wide := state.filter((F.col("n") > few) & (F.col("lo") < F.col("hi")))).isEmpty():
        counted = between(wide).groupBy("g", "nth", "before", _bucket(F.col("x"), F.col("lo"), F.col("hi")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        below = F.sum("n").over(Window.partitionBy("g", "nth").orderBy("bucket")) - F.col("n")  # at most BUCKETS rows each
        found = counted.withColumn("below", F.col("before") + below).filter("nth >= below AND nth < below + n")
        state = settled(found.select("g", "nth", F.col("below").alias("before"), "n", "lo", "hi").unionByName(state.filter((F.col("n") <= few) | (F.col("lo") == F.col("hi")))))
    one = state.filter("lo = hi").select("g", "nth", F.col("lo").alias("x"))
    rank = F.row_number().over(Window.partitionBy("g", "nth").orderBy("x")) - 1 + F.col("before")
    rest = between(state.filter("lo < hi")).withColumn("rank", rank).filter("rank = nth").select("g", "nth", "x")
    return one.unionByName(rest).groupBy("g").agg(F.avg("x").alias("median")).withColumnRenamed("g", group)
