"""Numbers for rows within groups, without a task that sees a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagework.session import materialize


def numbered(rows: DataFrame, by: list[str], order: list[str], number: str = "i", size: str = "size") -> DataFrame:
    """`rows` with their number from 0 in the order of `order` within `by`, and the size of their group.

    Rows are spread by ranges of (by, order), so that a group which holds a
    third of them lies in many parts, numbered within each part, and moved on by the sizes
    of the parts before: one row a group and part. Rows equal in `by` and
    `order` are numbered in no particular order; nulls come first. The new
    columns must not bear names of `rows`.
    """
    apart = rows.repartitionByRange(*[F.col(c) for c in (*by, *order)])
    held = materialize(apart.withColumn("__part", F.spark_partition_id()), "numbered")
    counts = held.groupBy(*by, "__part").agg(F.count(F.lit(1)).alias("__n"))
    groups = Window.partitionBy(*by)
    before = F.coalesce(F.sum("__n").over(groups.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*[F.col(c).alias(f"__{k}") for k, c in enumerate(by)], F.col("__part").alias("__at"), before.alias("__before"), F.sum("__n").over(groups).alias(size))
    same = F.col("__part") == F.col("__at")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__{k}"))
    local = F.row_number().over(Window.partitionBy(*by, "__part").orderBy(*order)) - 1
    placed = held.withColumn("__local", local).join(starts, same)
    return placed.select(*rows.columns, (F.col("__before") + F.col("__local")).alias(number), size)
