"""Overlap with held-out texts: exact, window and neighbouring-run membership, exclusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def members(rows: DataFrame, pieces: Column, probe: DataFrame, probe_col: str, key: str) -> DataFrame:
    """Keys of rows of which a piece is in the probe. Pieces are exploded and met by an equality join; whether the probe
    is broadcast is left to its size."""
    return rows.select(key, F.explode(pieces).alias("_piece")).join(probe.select(F.col(probe_col).alias("_piece")).distinct(), "_piece", "left_semi").select(key).distinct()


def clear_of(rows: DataFrame, bad: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in ``bad``."""
    return rows.join(bad.select(key), key, "left_anti")


def with_previous(rows: DataFrame, key: str, order: str, run: str) -> DataFrame:
    """Each run with the one before it in its document."""
    return rows.withColumn("previous", F.lag(run).over(Window.partitionBy(key).orderBy(order)))


def seen_in(hits: DataFrame, key: str, corpus: str) -> DataFrame:
    """(key, seen_in): names of the corpora that hold it, sorted and joined by commas."""
    return hits.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set(corpus)), ",").alias("seen_in"))


def unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``left`` that ``right`` lacks; an integrity check holds when there are none."""
    return left.join(right.select(*keys).distinct(), keys, "left_anti")
