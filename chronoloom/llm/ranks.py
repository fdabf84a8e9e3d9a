"""Dense ranks and running sums over large groups, without bringing a group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, group: list[str], order: str, size: str | None, out: str, buckets: int) -> DataFrame:
    """df with `out`: how much comes before the row in its group, in rows or in the sum of `size`.

    A group is cut into `buckets` hash buckets of `order`, a unique id; the order is by bucket, then by id. Only the
    totals of a bucket, one row each, are summed over the group; rows are sorted within their bucket alone.
    """
    b = df.withColumn("_b", F.pmod(F.xxhash64(order), F.lit(buckets)).cast("int"))
    what = F.col(size) if size else F.lit(1)
    totals = b.groupBy(*group, "_b").agg(F.sum(what).alias("_n"))
    ahead = totals.select(*group, "_b", (F.sum("_n").over(Window.partitionBy(*group).orderBy("_b")) - F.col("_n")).alias("_ahead"))
    within = Window.partitionBy(*group, "_b").orderBy(order)
    here = b.withColumn("_here", F.sum(what).over(within.rowsBetween(Window.unboundedPreceding, 0)) - what)
    return here.join(ahead, [*group, "_b"]).withColumn(out, (F.col("_ahead") + F.col("_here")).cast("long")).drop("_b", "_here", "_ahead")
