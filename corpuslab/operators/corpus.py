"""Building a corpus: lines, keep-first deduplication, budgets, islands, vocabularies, n-grams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions import text as X
from corpuslab.functions.presets import CLAUSE_MAX, CLAUSE_MIN, RESERVED_IDS, Script
from corpuslab.operators.ordered import running


def lines_of(docs: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """Lines of texts with their position from 0."""
    return docs.select(*keys, F.posexplode(F.split(text, "\n")).alias("pos", "line"))


def clause_rows(docs: DataFrame, key: str, script: Script, strict: bool = False, least: int = CLAUSE_MIN, most: int = CLAUSE_MAX) -> DataFrame:
    """(key, start, clause), as :func:`corpuslab.functions.text.clauses` gives them, for texts of any length: pieces become
    rows, and starts are running sums by key, so the cost is that of a text's length and not its square."""
    edges = script.edges.replace(" ", "") if strict else script.edges
    pieces = docs.select(key, F.posexplode(F.split("text", X.class_of(edges))).alias("pos", "clause"))
    of = Window.partitionBy(key)
    before = of.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("start", F.coalesce(F.sum(F.length("clause") + 1).over(before), F.lit(0)))
    if strict:
        placed = placed.withColumn("last", F.max("pos").over(of)).where("pos > 0 and pos < last")
    return placed.where(F.rlike("clause", F.lit(f"^[{script.letters}]{{{least},{most}}}$"))).select(key, "start", "clause")


def keep_first(rows: DataFrame, content: str, order: Sequence[str]) -> DataFrame:
    """Of rows with the same content the first by ``order``, then by their other columns; null is a content too.

    Rows are read and shuffled once: each task keeps its first row of a content before, so one that very many rows share
    costs one row for each task."""
    rest = [c for c in rows.columns if c != content and c not in order]
    first = rows.groupBy(content).agg(F.min(F.struct(*order, *rest)).alias("_first"))
    return first.select(*[F.col(content) if c == content else F.col("_first")[c].alias(c) for c in rows.columns])


def survival(before: DataFrame, after: DataFrame, group: str, text: str) -> DataFrame:
    """Lines and characters of each group before and after, and the share of characters that is left."""
    a = before.groupBy(group).agg(F.count("*").alias("lines"), F.sum(F.length(text).cast("bigint")).alias("chars"))
    b = after.groupBy(group).agg(F.count("*").alias("kept_lines"), F.sum(F.length(text).cast("bigint")).alias("kept_chars"))
    return a.join(b, group, "left").select(group, "lines", "chars", F.coalesce("kept_lines", F.lit(0)).cast("bigint").alias("kept_lines"), F.coalesce("kept_chars", F.lit(0)).cast("bigint").alias("kept_chars"), F.round(F.coalesce("kept_chars", F.lit(0)) / F.col("chars"), 6).alias("survival"))


def within_budget(rows: DataFrame, size: Column, order: Sequence[str], budget: int, partition: Sequence[str] = ()) -> DataFrame:
    """Rows up to and with the one that crosses a budget of sizes summed in order, for each group of ``partition``."""
    return running(rows, order, "_before", size, partition).where(F.col("_before") < budget).drop("_before")


def islands(rows: DataFrame, keep: Column, key: str, order: str) -> DataFrame:
    """Numbers the stretches of kept rows between dropped ones; dropped rows go."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("_keep", keep).withColumn("island", F.sum(F.when(F.col("_keep"), 0).otherwise(1)).over(w)).where("_keep").drop("_keep")


def vocabulary(texts: DataFrame, text: str, size: int, token: Column | None = None) -> DataFrame:
    """(token_id, token, n): reserved ids, then the most frequent tokens (characters, if none are given; an empty one isn't
    a token), ties in code-point order."""
    # Groups are few, and each task adds up its own before any row is shuffled.
    one = token if token is not None else F.split(text, "")
    counts = texts.select(F.explode(one).alias("token")).where("token <> ''").groupBy("token").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "token").limit(size - len(RESERVED_IDS))
    ranked = top.withColumn("token_id", F.row_number().over(Window.orderBy(F.desc("n"), "token")) + len(RESERVED_IDS) - 1)
    reserved = texts.sparkSession.createDataFrame([(i, t, 0) for i, t in enumerate(RESERVED_IDS)], "token_id int, token string, n long")
    return reserved.unionByName(ranked.select("token_id", "token", "n"))


def ngrams(rows: DataFrame, tokens: Column, n: int) -> DataFrame:
    """n-grams of token arrays with their counts; a group never crosses a row."""
    grams = X.let(tokens, lambda t: X.windows(t, n, " "))
    return rows.select(F.explode(grams).alias("ngram")).groupBy("ngram").agg(F.count("*").alias("n"))


def encode(rows: DataFrame, key: Sequence[str], tokens: Column, vocab: DataFrame, unknown: int = 1) -> DataFrame:
    """(key, pos, token_id): tokens that the vocabulary lacks get the unknown id."""
    flat = rows.select(*key, F.posexplode(tokens).alias("pos", "token"))
    return flat.join(vocab.select("token", "token_id"), "token", "left").select(*key, "pos", F.coalesce("token_id", F.lit(unknown)).alias("token_id"))


def kneser_ney(bigrams: DataFrame, discount: float = 0.75) -> DataFrame:
    """(w1, w2, p): interpolated Kneser-Ney for bigram counts (columns w1, w2, n), all by grouped sums.

    p = max(n - d, 0) / n(w1) + d * types(w1) / n(w1) * types before w2 / all types.
    """
    left = bigrams.groupBy("w1").agg(F.sum("n").alias("n1"), F.count("*").alias("t1"))
    right = bigrams.groupBy("w2").agg(F.count("*").alias("t2"))
    total = bigrams.agg(F.count("*").alias("tt"))
    full = bigrams.join(left, "w1").join(right, "w2").join(F.broadcast(total), F.lit(True))  # one row
    p = F.greatest(F.col("n") - discount, F.lit(0.0)) / F.col("n1") + discount * F.col("t1") / F.col("n1") * F.col("t2") / F.col("tt")
    return full.select("w1", "w2", p.alias("p"))


def kneser_ney_trigrams(trigrams: DataFrame, discount: float = 0.75) -> DataFrame:
    """(w1, w2, w3, p): interpolated Kneser-Ney of order 3 for trigram counts (columns w1, w2, w3, n), all by grouped sums.

    The order below counts in how many different contexts a bigram comes, and is itself smoothed by :func:`kneser_ney`.
    """
    contexts = trigrams.groupBy(F.col("w2").alias("w1"), F.col("w3").alias("w2")).agg(F.count("*").alias("n"))
    lower = kneser_ney(contexts, discount).select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("p").alias("_p2"))
    left = trigrams.groupBy("w1", "w2").agg(F.sum("n").alias("_n"), F.count("*").alias("_types"))
    full = trigrams.join(left, ["w1", "w2"]).join(lower, ["w2", "w3"])
    p = F.greatest(F.col("n") - discount, F.lit(0.0)) / F.col("_n") + discount * F.col("_types") / F.col("_n") * F.col("_p2")
    return full.select("w1", "w2", "w3", p.alias("p"))
