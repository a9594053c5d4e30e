"""Sums, numbers and ranks along an order, within groups of any size: no task holds a whole group."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.operators.storage import cut


def running(rows: DataFrame, order: Sequence[str | Column], name: str, size: Column, within: Sequence[str] = ()) -> DataFrame:
    """``name``: the sum of ``size`` over the rows that come before a row in its group; 0 for the first.

    The order is parted into ranges that are summed apart, and a range adds what its groups have in the ranges before. The
    sorted ranges are written to the checkpoint folder, so that sums and rows come from the same ones, whatever is lost.
    """
    placed = cut(rows.withColumn("_size", size).orderBy(*within, *order)).withColumn("_at", F.monotonically_increasing_id())
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    inside = Window.partitionBy("_part", *within).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    run = placed.withColumn("_run", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    out = _with_offsets(run, placed.groupBy("_part", *within).agg(F.sum("_size").alias("_sum")), within)
    return out.withColumn(name, F.col("_run") + F.col("_offset")).drop("_size", "_at", "_part", "_run", "_offset")


def numbered(rows: DataFrame, order: Sequence[str | Column], name: str, within: Sequence[str] = ()) -> DataFrame:
    """All rows in order, numbered from 1, anew in each group of ``within``. ``order`` must tell the rows of a group apart.

    A row's number is its place among its group's rows in its range, and how many rows the group has in the ranges before.
    Ranges are written as in :func:`running`.
    """
    placed = cut(rows.orderBy(*within, *order)).withColumn("_at", F.monotonically_increasing_id())
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    out = _with_offsets(placed, placed.groupBy("_part", *within).agg(F.count("*").alias("_sum"), F.min("_at").alias("_first")), within)
    return out.withColumn(name, F.col("_at") - F.col("_first") + F.col("_offset") + 1).drop("_at", "_part", "_first", "_offset")


def _with_offsets(rows: DataFrame, sums: DataFrame, within: Sequence[str]) -> DataFrame:
    """Rows with what their group has in the ranges before; ``sums`` has a row for each group of a range. Without groups
    that is a row for each range, which is broadcast."""
    before = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    if not within:
        return rows.join(F.broadcast(sums), "_part")
    return same_groups(rows, sums, ["_part", *within])


def same_groups(rows: DataFrame, per_group: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Rows with the other columns of their group; null is a group too."""
    other = per_group
    same = F.lit(True)
    for i, g in enumerate(groups):
        other = other.withColumnRenamed(g, f"_group{i}")
        same = same & F.col(g).eqNullSafe(F.col(f"_group{i}"))
    return rows.join(other, same).drop(*[f"_group{i}" for i in range(len(groups))])


def at_ranks(rows: DataFrame, groups: Sequence[str], value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(groups, a column for each rank): the values at places of each group's sorted values. A rank gives the place, from
    1, for the number of values; nulls are none. Equal values are counted first, so that ranges are of different ones."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("_n"))
    totals = counts.groupBy(*groups).agg(F.sum("_n").alias("_total"))
    run = same_groups(running(counts, [value], "_before", F.col("_n"), groups), totals, groups)

    def there(place: Column) -> Column:
        return F.max(F.when((F.col("_before") < place) & (place <= F.col("_before") + F.col("_n")), F.col(value)))

    return run.groupBy(*groups).agg(*[there(r(F.col("_total"))).alias(name) for name, r in ranks.items()])


def nearest_rank(share: str) -> Callable[[Column], Column]:
    """The place ``ceil(share * n)``; ``share`` as decimal text, so that no product is rounded."""
    return lambda n: F.ceil(F.lit(share).cast("decimal(10,6)") * n)


def floor_rank(share: str) -> Callable[[Column], Column]:
    """The place after ``floor(share * n)``, another definition."""
    return lambda n: F.least(n, F.floor(F.lit(share).cast("decimal(10,6)") * n) + 1)
