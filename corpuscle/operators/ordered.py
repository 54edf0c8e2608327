"""Running totals and ordinals within groups of any size: no group has to fit into one task.

Rows are divided by ranges of (group, order), each range is summed up, and what stands before a range is added to the
totals inside it. A group that holds a third of all rows is spread over as many tasks as its share asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise


def before(df: DataFrame, by: list[str], order: list[str], value: Column | None = None, name: str = "before") -> DataFrame:
    """Adds the sum of ``value`` (the number of rows by default) over the rows of the same group that stand before a row.

    ``order`` should be total within a group; rows that are equal in it may swap places. Null counts as nothing.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = F.lit(1).cast("bigint") if value is None else F.coalesce(value.cast("bigint"), F.lit(0).cast("bigint"))
    ranged = df.withColumn("_v", one).repartitionByRange(n, *by, *order).withColumn("_r", F.spark_partition_id())
    ranged = materialise(ranged, "ranges")  # the ranges are drawn once, so both readings agree on them
    upto = Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = ranged.groupBy(*by, "_r").agg(F.sum("_v").alias("_s")).withColumn("_o", F.coalesce(F.sum("_s").over(upto), F.lit(0).cast("bigint"))).drop("_s")
    inside = Window.partitionBy(*by, "_r").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("_i", F.coalesce(F.sum("_v").over(inside), F.lit(0).cast("bigint")))
    same = [summed[c].eqNullSafe(offsets[c]) for c in [*by, "_r"]]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return summed.join(offsets, cond).select(*[summed[c] for c in df.columns], (F.col("_i") + F.col("_o")).alias(name))
