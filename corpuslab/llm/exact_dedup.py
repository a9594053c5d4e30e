"""Exact deduplication with a heavy-hitter split. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.llm.common import cut, id_and_text, unused

#: Characters that don't count when texts are compared.
BLANKS = "[\\x20\\x09-\\x0D]+"
#: A digest is heavy from this share of the rows on; at most 1 / SUPPORT digests can be.
SUPPORT = 0.001
#: Counters of a Misra-Gries summary; its error is below SUPPORT / 2 of the rows.
TRACKED = 6000
#: Summaries merged in the first of two rounds.
FAN_IN = 64


def frequent_digests(keyed: DataFrame) -> DataFrame:
    """Every digest that holds more than ``SUPPORT`` of the rows, and perhaps some that hold less.

    Misra-Gries summaries of a fixed size, made map-side, merged in two rounds so that no task reads more than
    its share of them. One row with at most ``TRACKED`` items leaves the last round. It is grouped by a constant: without
    a group, partitions that got no summary would give an empty one, which can't be merged.
    """
    parts = keyed.groupBy((F.spark_partition_id() % FAN_IN).alias("part")).agg(F.expr(f"approx_top_k_accumulate(text_sha256, {TRACKED})").alias("s"))
    whole = parts.groupBy((F.col("part") % 1).alias("all")).agg(F.expr(f"approx_top_k_combine(s, {TRACKED})").alias("s"))
    items = whole.select(F.explode(F.expr(f"approx_top_k_estimate(s, {round(1 / SUPPORT)})")).alias("x"))
    return items.select(F.col("x.item").alias("text_sha256")).where("text_sha256 is not null")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without blanks. Of equal texts, the row with the most code points
    stays, then the smallest id; a null id comes last; of wholly equal rows one stays. A null text is an empty
    one, and all empty or blank texts are equal. An empty table gives no rows. Texts may be of any length; columns other than
    id and text (``kept``, say) are left out.

    Digests and lengths are computed once and cut to a narrow table. Frequent digests go the map-side way: their
    exact sizes and winners (at most ``1 / SUPPORT`` rows, whatever the input) are broadcast to all rows. All
    other digests are shuffled: minima and counts, map-side first, then a join of rows with them, which adaptive execution
    splits where a group that is below ``SUPPORT`` of very many rows is still large.
    """
    rows = id_and_text(df, id_col, text_col)
    keyed = cut(
        rows.select(
            "doc_id",
            F.length("text").alias("n_cp"),
            F.sha2(F.regexp_replace("text", BLANKS, "").cast("binary"), 256).alias("text_sha256"),
            F.monotonically_increasing_id().alias("row_id"),
        )
    )
    frequent = cut(frequent_digests(keyed))
    rank = F.struct((-F.col("n_cp")).alias("n"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"), F.col("row_id").alias("r"))
    winners = (
        keyed.join(F.broadcast(frequent), "text_sha256", "left_semi")
        .groupBy("text_sha256").agg(F.min(rank).alias("w"), F.count("*").alias("group_size"))
        .select("text_sha256", F.col("w.d").alias("keep_id"), F.col("w.r").alias("keep_row"), "group_size")
    )
    winners = cut(winners)
    heavy = keyed.join(F.broadcast(winners), "text_sha256").select("doc_id", "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"), "text_sha256")
    rest = keyed.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    first = rest.groupBy("text_sha256").agg(F.min(rank).alias("w"), F.count("*").alias("group_size"))
    light = rest.join(first, "text_sha256").select("doc_id", F.col("w.d").alias("keep_id"), "group_size", (F.col("row_id") == F.col("w.r")).alias("kept"), "text_sha256")
    return heavy.unionByName(light)


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that :func:`exact_dedup` keeps, with all their columns. Of wholly equal rows one stays.

    Decisions are cut to a narrow table; the texts are shuffled once, by id, to meet them.
    """
    decided = cut(exact_dedup(df, id_col, text_col))
    text = F.coalesce(df[text_col], F.lit(""))
    sha, length, turn, own_id, own_sha = (unused(df, n) for n in ("_sha", "_len", "_turn", "_id", "_kept"))
    numbered = df.withColumn(sha, F.sha2(F.regexp_replace(text, BLANKS, "").cast("binary"), 256)).withColumn(length, F.length(text))
    stay = decided.where("kept").select(F.col("doc_id").alias(own_id), F.col("text_sha256").alias(own_sha))
    kept = numbered.join(stay, numbered[id_col].eqNullSafe(stay[own_id]) & (F.col(sha) == F.col(own_sha)), "left_semi")
    if decided.groupBy("doc_id", "text_sha256").count().where("count > 1").limit(1).count():
        of = Window.partitionBy(kept[id_col], F.col(sha)).orderBy(F.desc(length))
        kept = kept.withColumn(turn, F.row_number().over(of)).where(F.col(turn) == 1).drop(turn)
    return kept.drop(sha, length)
