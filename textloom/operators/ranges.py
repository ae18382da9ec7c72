"""Running sums and last values of groups of any size, by a sort by range.

A window over a group is one task's, however large the group. Here rows are sorted by range; windows run inside a range, and a group that lies
over several ranges needs one row for each of them to go on from one to the next.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.runtime import materialize


def running(df: DataFrame, group: list[str], order: list[str | Column], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None) -> DataFrame:
    """``df`` plus, for each row, sums and last values that aren't null of the rows before it in its group (0 and null before the first).

    ``order`` should be total; rows that it doesn't tell apart come in any order. Null groups are groups.
    """
    sums, lasts = sums or {}, lasts or {}
    columns = df.columns
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    rows = df.select("*", *(F.coalesce(v, F.lit(0)).cast("long").alias(f"_v_{n}") for n, v in sums.items()), *(v.alias(f"_v_{n}") for n, v in lasts.items()))
    rows = materialize(rows.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()), "running")
    inside = Window.partitionBy("_range", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.select(
        *columns, "_range", *(F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)).alias(f"_in_{n}") for n in sums),
        *(F.last(f"_v_{n}", ignorenulls=True).over(inside).alias(f"_in_{n}") for n in lasts),
    )
    ends = rows.withColumn("_at", F.row_number().over(Window.partitionBy("_range", *group).orderBy(*order))) if lasts else rows
    runs = ends.groupBy(*group, "_range").agg(*(F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums), *(F.max(F.when(F.col(f"_v_{n}").isNotNull(), F.struct("_at", f"_v_{n}")))[f"_v_{n}"].alias(f"_t_{n}") for n in lasts), F.count(F.lit(1)).alias("_n"))
    over = Window.partitionBy(*group)
    cut = runs.withColumn("_ranges", F.count(F.lit(1)).over(over)).filter("_ranges > 1")  # at most two groups for each range
    before = over.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = cut.select(
        *(F.col(c).alias(f"_g_{c}") for c in group), F.col("_range").alias("_r"), *(F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums),
        *(F.last(f"_t_{n}", ignorenulls=True).over(before).alias(f"_b_{n}") for n in lasts),
    )
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in group))
    j = placed.join(F.broadcast(carried), same & (F.col("_range") == F.col("_r")), "left")
    return j.select(*columns, *((F.col(f"_in_{n}") + F.coalesce(f"_b_{n}", F.lit(0))).alias(n) for n in sums), *(F.coalesce(f"_in_{n}", f"_b_{n}").alias(n) for n in lasts))


def numbered(df: DataFrame, group: list[str], order: list[str | Column], name: str = "ordinal") -> DataFrame:
    """``df`` with each row's number in its group, from 0."""
    return running(df, group, order, sums={name: F.lit(1)})
