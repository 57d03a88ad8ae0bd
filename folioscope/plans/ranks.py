"""Ranks over a whole table without a window over all of it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

PARTS = 256


def value_ranks(df: DataFrame, column: str, group: str | None = None) -> DataFrame:
    """(group, value, n, below, total): each distinct value's rows, the rows with smaller values, and all rows.

    Values fall into at most ``PARTS`` ranges by approximate quantiles of the whole
    table; a small table of range totals carries the counts from range to range, so a
    task sorts the distinct values of one range (and group) only. Exact whatever the
    quantiles. Null values are left out.
    """
    keys = [group] if group else []
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    bounds = counts.agg(F.percentile_approx("value", [k / PARTS for k in range(1, PARTS)], 10_000).alias("_bounds"))
    counts = counts.join(F.broadcast(bounds), F.lit(True)).withColumn("_part", F.size(F.filter("_bounds", lambda b: b < F.col("value")))).drop("_bounds")  # one row
    totals = counts.groupBy(*keys, "_part").agg(F.sum("n").alias("_m"))
    one = W.partitionBy(*keys)
    totals = totals.withColumns({"_before": F.coalesce(F.sum("_m").over(one.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "total": F.sum("_m").over(one)}).drop("_m")
    if keys:
        totals = totals.withColumnsRenamed({group: "_group", "_part": "_p"})
        ranked = counts.join(totals, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_group"))).drop("_group", "_p")
    else:
        ranked = counts.join(F.broadcast(totals), "_part")  # PARTS rows
    inner = W.partitionBy(*keys, "_part").orderBy("value").rowsBetween(W.unboundedPreceding, -1)
    return ranked.withColumn("below", F.col("_before") + F.coalesce(F.sum("n").over(inner), F.lit(0))).drop("_part", "_before")
