"""Reproducible sampling: seeded hash orders, splits, quotas. Set-based, so no visit order matters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions.text import hash_bucket


def seeded(seed: str, *keys: str) -> Column:
    """A hash by which rows are shuffled the same way each time: any prefix of the order is a random sample."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.col(k).cast("string") for k in keys]))


def split_of(key: Column, share: int) -> Column:
    """``dev`` for one unit in ``share``, else ``train``."""
    return F.when(hash_bucket(key, share) == 0, "dev").otherwise("train")


def per_stratum(rows: DataFrame, strata: Sequence[str], n: int, seed: str, *keys: str) -> DataFrame:
    """``n`` rows of each stratum, the first in seeded order."""
    w = Window.partitionBy(*strata).orderBy(seeded(seed, *keys), *keys)
    return rows.withColumn("_turn", F.row_number().over(w)).where(F.col("_turn") <= n).drop("_turn")


def sample(rows: DataFrame, n: int, seed: str, *keys: str) -> DataFrame:
    """``n`` rows in seeded order; each task sends its first ``n`` at most."""
    return rows.orderBy(seeded(seed, *keys), *keys).limit(n)


def first_of_each(rows: DataFrame, key: str, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows of each key."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_turn", F.row_number().over(w)).where(F.col("_turn") <= n).drop("_turn")


def quota(rows: DataFrame, content: str, taken: DataFrame, strata: Sequence[str], n: int, seed: str, *keys: str) -> DataFrame:
    """Rows whose content is neither taken nor a repeat, up to a quota for each stratum: rejected ones use none of it."""
    fresh = rows.join(taken.select(content).distinct(), content, "left_anti")
    w = Window.partitionBy(content).orderBy(seeded(seed, *keys), *keys)
    once = fresh.withColumn("_turn", F.row_number().over(w)).where("_turn = 1").drop("_turn")
    return per_stratum(once, strata, n, seed, *keys)


def bounded(rows: DataFrame, first: int, last: int, order: Sequence[str]) -> DataFrame:
    """Rows number ``first`` to ``last`` (from 1) of an order: the first ``last`` are taken, then numbered."""
    top = rows.orderBy(*order).limit(last)
    return top.withColumn("_turn", F.row_number().over(Window.orderBy(*order))).where(F.col("_turn") >= first).drop("_turn")


def shuffled(rows: DataFrame, seed: str, keys: Sequence[str], name: str) -> DataFrame:
    """All rows with their number, from 1, in seeded order. Hashes are spread evenly, so their leading digits part the
    order into even ranges: only the keys are read to count these, and the rows are shuffled once."""
    parts = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.withColumn("_hash", seeded(seed, *keys))
    keyed = keyed.withColumn("_part", F.shiftright(F.conv(F.substring("_hash", 1, 8), 16, 10).cast("long") * parts, 32))
    sizes = keyed.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    placed = keyed.withColumn("_turn", F.row_number().over(Window.partitionBy("_part").orderBy("_hash", *keys)))
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_turn") + F.col("_offset")).drop("_hash", "_part", "_turn", "_offset")
