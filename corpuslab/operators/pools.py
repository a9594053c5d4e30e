"""Candidate pools: gating, comparable candidates, picks, hybrid weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions import presets as P
from corpuslab.functions.stats import mcnemar


def with_facts(c: Column, leader: Column) -> Column:
    """Facts of a candidate (text, source, answers_key, trusted): a null one falls back on the leader's length and on
    whether the source is a dictionary."""
    return F.struct(
        c["text"].alias("text"),
        c["source"].alias("source"),
        F.coalesce(c["answers_key"], F.length(c["text"]) == F.length(leader["text"])).alias("answers"),
        F.coalesce(c["trusted_dictionary_hit"], c["source"].isin(*P.DICTIONARY_SOURCES)).alias("trusted"),
    )


def comparable(candidates: Column, most: int = P.COMPARED) -> Column:
    """The first ``most`` candidates that answer the typed key, or none where the gate declines: the leader is a
    trusted dictionary hit, or doesn't answer, or fewer than two compare."""
    leader = F.get(candidates, F.lit(0))
    facts = F.transform(candidates, lambda c: with_facts(c, leader))
    same = F.slice(F.filter(facts, lambda c: c["answers"]), 1, most)
    first = F.get(facts, F.lit(0))
    open_ = ~first["trusted"] & first["answers"] & (F.size(same) >= 2)
    return F.when(open_, same).otherwise(F.slice(same, 1, 0))


def best_first(rows: DataFrame, key: Sequence[str], score: str, index: str) -> DataFrame:
    """The row with the highest score of each key; of equal ones the earliest."""
    w = Window.partitionBy(*key).orderBy(F.desc(score), index)
    return rows.withColumn("_turn", F.row_number().over(w)).where("_turn = 1").drop("_turn")


def pick_of(scores: Column) -> Column:
    """Index from 0 of the highest score, the first of equal ones; null without scores."""
    return F.when(F.size(scores) > 0, F.array_position(scores, F.array_max(scores)).cast("int") - 1)


def promote(items: Column, chosen: Column) -> Column:
    """The chosen item (index from 0) in front, the others in their order."""
    rest = F.filter(items, lambda _, i: i != chosen)
    return F.concat(F.slice(items, chosen + 1, 1), rest)


def rank_of(items: Column, gold: Column, most: int = 32) -> Column:
    """Index from 0 of the gold among the first ``most``, -1 if it isn't there."""
    return F.array_position(F.slice(items, 1, most), gold).cast("int") - 1


def hybrid_grid(rows: DataFrame, rank_weights: Sequence[float], dict_weights: Sequence[float], key: str, score: str, index: str, is_dict: str, gold: str) -> DataFrame:
    """Accuracy of ``score - r * index + d * is_dict`` for each pair of weights. The grid is an array literal that is
    exploded in place; picks are maxima by (score, -index), so nothing is sorted."""
    grid = F.array(*[F.struct(F.lit(float(r)).alias("r"), F.lit(float(d)).alias("d")) for r in rank_weights for d in dict_weights])
    flat = rows.select(key, score, index, is_dict, gold, F.explode(grid).alias("g"))
    s = F.round(F.col(score) - F.col("g.r") * F.col(index) + F.col("g.d") * F.col(is_dict).cast("int"), 9)
    best = flat.groupBy(key, "g").agg(F.max_by(gold, F.struct(s, -F.col(index))).alias("ok"))
    return best.groupBy(F.col("g.r").alias("rank_weight"), F.col("g.d").alias("dict_weight")).agg(F.count("*").alias("n"), F.count_if("ok").alias("hits"))


def against_references(hits: DataFrame, references: Sequence[str]) -> DataFrame:
    """(scorer, and for each reference r: vs_r_ref_only, vs_r_this_only, vs_r_p): in how many cases that both have (columns scorer,
    id, hit) only one of the two hits, and McNemar's p; null against itself and where they share no case. There are few
    references, so a case is met by a handful of rows."""
    refs = hits.where(F.col("scorer").isin(*references)).select("id", F.col("scorer").alias("_ref"), F.col("hit").alias("_hit"))
    both = hits.select("id", "scorer", "hit").join(refs, "id").where("scorer <> _ref")
    counts = both.groupBy("scorer").pivot("_ref", list(references)).agg(F.count_if(F.col("_hit") & ~F.col("hit")).alias("ref_only"), F.count_if(F.col("hit") & ~F.col("_hit")).alias("this_only"), F.count("hit").alias("n"))
    out = hits.select("scorer").distinct().join(counts, "scorer", "left")
    columns = []
    for r in references:
        a, b, run = F.col(f"{r}_ref_only"), F.col(f"{r}_this_only"), F.col(f"{r}_n") > 0
        columns += [F.when(run, a).alias(f"vs_{r}_ref_only"), F.when(run, b).alias(f"vs_{r}_this_only"), F.when(run, mcnemar(a, b)).alias(f"vs_{r}_p")]
    return out.select("scorer", *columns)
