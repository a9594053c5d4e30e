"""What stands before a row in its group (the paragraphs before a clause, the turns before a turn), as offsets into one text.

A group's texts, joined in order, are kept once, in blocks of some characters; a row has the place where its own text
begins. So contexts take as much room as the texts do, and are cut out where they are used. Groups may be of any size: offsets are
running sums over ranges, and a group's blocks are rows of their own.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.operators.ordered import running

#: Characters of a block.
BLOCK = 4096


def offsets(rows: DataFrame, within: Sequence[str], order: Sequence[str], text: str = "text", sep: str = "\n") -> DataFrame:
    """``rows`` with ``start`` and ``end`` (code points, end exclusive) of their text in their group's joined text. A null text
    is no part of it, and begins and ends where the next one begins."""
    own = F.coalesce(F.length(text), F.lit(0))
    out = running(rows, order, "start", F.when(F.col(text).isNotNull(), own + len(sep)).otherwise(0).cast("bigint"), within)
    return out.withColumn("start", F.col("start").cast("bigint")).withColumn("end", F.col("start") + own)


def blocks(placed: DataFrame, within: Sequence[str], text: str = "text", sep: str = "\n", size: int = BLOCK) -> DataFrame:
    """(within, block, text): the joined texts of rows with :func:`offsets`, in blocks of ``size`` characters from 0 on. Before each
    text but the first stands ``sep``; so what comes before a row ends ``sep`` before its start."""
    lead = F.when(F.col("start") > 0, len(sep)).otherwise(0)
    whole = placed.where(F.col(text).isNotNull()).select(*within, (F.col("start") - lead).alias("_at"), F.concat(F.when(F.col("start") > 0, sep).otherwise(""), F.col(text)).alias("_text"))
    last = F.col("_at") + F.greatest(F.length("_text"), F.lit(1)) - 1
    some = whole.select(*within, "_at", "_text", F.explode(F.sequence(F.floor(F.col("_at") / size), F.floor(last / size))).alias("block"))
    begin = F.greatest(F.col("_at"), F.col("block") * size)
    part = F.substring(F.col("_text"), (begin - F.col("_at") + 1).cast("int"), (F.least(last + 1, (F.col("block") + 1) * size) - begin).cast("int"))
    pieces = some.select(*within, "block", F.struct(begin.alias("at"), part.alias("text")).alias("_piece"))
    return pieces.groupBy(*within, "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list("_piece")), lambda p: p["text"]), "").alias("text"))


def tails(placed: DataFrame, within: Sequence[str], keys: Sequence[str], most: int, text: str = "text", sep: str = "\n", size: int = BLOCK) -> DataFrame:
    """(within, keys, before): the last ``most`` characters of what stands before each row. ``keys`` tell a group's rows apart.

    A row asks only for the blocks that its context lies in, and takes from each what it needs."""
    ask = placed.select(*within, *keys, F.greatest(F.col("start") - len(sep), F.lit(0)).alias("_end")).withColumn("_begin", F.greatest(F.col("_end") - most, F.lit(0)))
    need = ask.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_begin") / size), F.floor(F.greatest(F.col("_end") - 1, F.col("_begin")) / size))))
    held = blocks(placed, within, text, sep, size).select(*[F.col(c).alias(f"_of_{c}") for c in within], F.col("block").alias("_own"), F.col("text").alias("_text"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in within], F.col("_block") == F.col("_own"))
    first = F.greatest(F.col("_begin"), F.col("_block") * size)
    part = F.substring(F.col("_text"), (first - F.col("_block") * size + 1).cast("int"), F.greatest(F.col("_end") - first, F.lit(0)).cast("int"))
    cut_out = need.join(held, same, "left").select(*within, *keys, F.struct(F.col("_block").alias("block"), F.coalesce(part, F.lit("")).alias("text")).alias("_part"))
    return cut_out.groupBy(*within, *keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_part")), lambda p: p["text"]), "").alias("before"))


def whole_contexts(placed: DataFrame, within: Sequence[str], keys: Sequence[str], text: str = "text", sep: str = "\n") -> DataFrame:
    """(within, keys, before): all that stands before each row. A group's text is held once, and cut for one row after the other;
    the output grows with the square of a group, so for large groups keep offsets and blocks instead."""
    row: list[str | Column] = [F.col(c) for c in keys]
    groups = placed.groupBy(*within).agg(F.array_sort(F.collect_list(F.struct("start", F.col(text).alias("_text"), *row))).alias("_rows"))
    joined = groups.select(*within, F.array_join(F.transform("_rows", lambda r: r["_text"]), sep).alias("_whole"), F.explode(F.transform("_rows", lambda r: F.struct(*[r[c].alias(c) for c in keys], r["start"].alias("_start")))).alias("_row"))
    return joined.select(*within, *[F.col(f"_row.{c}").alias(c) for c in keys], F.substring(F.col("_whole"), F.lit(1), F.greatest(F.col("_row._start") - len(sep), F.lit(0)).cast("int")).alias("before"))
