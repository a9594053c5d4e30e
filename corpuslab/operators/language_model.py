"""Back-off n-gram models: estimation by grouped counts, ARPA files, scores of texts.

An n-gram has a probability if it was counted; one that wasn't falls back to the order below, weighted by its context:
p(w | h) = backoff(h) * p(w | h without its first word). Probabilities are modified Kneser-Ney, interpolated with the orders
below (Chen and Goodman, 1999), so what a context leaves for unseen words is just what they are given, and sums are 1.

Logarithms are to base 10 and rounded to six decimals, as ARPA files hold them. Scores add them as whole millionths, so that
equal scores are equal in any order of addition.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.operators.storage import cut

BOS, EOS, UNKNOWN = "<s>", "</s>", "<unk>"
#: Discounts of n-grams that were counted once, twice, more often, where counts of counts can't tell.
FALLBACK = (0.5, 1.0, 1.5)
#: The logarithm of what is never predicted.
NEVER = -99.0
#: N-grams and words of a model that goes along with a function (some 24 bytes each); a larger one is joined.
AT_HAND = 5_000_000
MILLION = 1_000_000


def estimate(sentences: DataFrame, tokens: Column, order: int = 3) -> DataFrame:
    """(order, ngram, n, logp, backoff) of a model of arrays of tokens, one a sentence; ``ngram`` is an array.

    The highest order and what begins a sentence count how often they come, lower orders after how many different words.
    Words are told from ``<unk>``, the share that is left for all others, and sentences begin with ``<s>``, which is never
    predicted, and end with ``</s>``. Null sentences don't count. Without sentences there are no rows. All sums are grouped
    map-side first; joins are by context and by what follows it.
    """
    if order < 2:
        raise ValueError("a back-off model has two orders at least")
    padded = sentences.where(tokens.isNotNull()).select(F.concat(F.array(F.lit(BOS)), tokens, F.array(F.lit(EOS))).alias("s"))

    def grams(k: int) -> Column:
        return F.when(F.size("s") >= k, F.transform(F.sequence(F.lit(1), F.size("s") - k + 1), lambda i: F.slice("s", i, k)))

    counts = {order: cut(padded.select(F.explode(grams(order)).alias("ngram")).groupBy("ngram").agg(F.count("*").alias("n")))}
    for k in range(order - 1, 0, -1):
        after = counts[k + 1].select(F.slice("ngram", 2, k).alias("ngram")).groupBy("ngram").agg(F.count("*").alias("n"))
        first = padded.where(F.size("s") >= k).select(F.slice("s", 1, k).alias("ngram")).groupBy("ngram").agg(F.count("*").alias("n"))
        counts[k] = cut(after.unionByName(first) if k > 1 else after)

    p = context = None
    parts = []
    for k in range(1, order + 1):
        taken = discounts(counts[k])
        own = counts[k].withColumn("d", F.when(F.col("n") == 1, taken[0]).when(F.col("n") == 2, taken[1]).otherwise(taken[2]))
        left = sum((F.count_if(c) * d for c, d in zip((F.col("n") == 1, F.col("n") == 2, F.col("n") > 2), taken, strict=True)), F.lit(0.0))
        context = own.groupBy(F.slice("ngram", 1, k - 1).alias("h")).agg(F.sum("n").alias("total"), (left / F.sum("n")).alias("gamma"), F.count("*").alias("types"))
        if parts:
            parts[-1] = parts[-1].join(context.select(F.col("h").alias("ngram"), "gamma"), "ngram", "left")
        seen = (F.col("n") - F.col("d")) / F.col("total")
        if k == 1:
            one = own.join(F.broadcast(context.drop("h")), F.lit(True))  # one row
            share = F.col("gamma") / (F.col("types") + 1)
            p = one.select("ngram", "n", (seen + share).alias("p")).unionByName(context.select(F.array(F.lit(UNKNOWN)).alias("ngram"), F.lit(0).cast("bigint").alias("n"), share.alias("p")))
        else:
            lower = p.select(F.col("ngram").alias("_rest"), F.col("p").alias("_p"))
            joined = own.join(context.select("h", "total", "gamma"), F.slice("ngram", 1, k - 1) == F.col("h")).join(lower, F.slice("ngram", 2, k - 1) == F.col("_rest"))
            p = joined.select("ngram", "n", (seen + F.col("gamma") * F.col("_p")).alias("p"))
        p = cut(p)
        with_start = p.unionByName(padded.groupBy().agg(F.count("*").alias("n")).where("n > 0").select(F.array(F.lit(BOS)).alias("ngram"), "n", F.lit(0.0).alias("p"))) if k == 1 else p
        parts.append(with_start.withColumn("order", F.lit(k)))
    parts[-1] = parts[-1].withColumn("gamma", F.lit(None).cast("double"))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    logp = F.when(F.col("p") > 0, F.round(F.log10("p"), 6)).otherwise(NEVER)
    # what leaves nothing for unseen words has the weight 0; no context means the weight 1
    backoff = F.when(F.col("gamma") > 0, F.round(F.log10("gamma"), 6)).when(F.col("gamma") == 0, NEVER).otherwise(0.0)
    return out.select("order", "ngram", "n", logp.alias("logp"), backoff.alias("backoff"))


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Discounts of n-grams counted once, twice, more often, from how many were counted one to four times."""
    one, two, three, four = counts.agg(*[F.count_if(F.col("n") == k) for k in (1, 2, 3, 4)]).first()
    if not (one and two and three and four):
        return FALLBACK
    y = one / (one + 2 * two)
    d = (1 - 2 * y * two / one, 2 - 3 * y * three / two, 3 - 4 * y * four / three)
    return d if all(0 <= x <= k for k, x in enumerate(d, 1)) else FALLBACK


def arpa_lines(model: DataFrame) -> DataFrame:
    """(place, line): the lines of an ARPA file, in order of ``place``. Tokens must have no white space.

    The order is a range partitioning, so that part files that are written from it make the file when they are put together
    by name."""
    bad = model.where(F.exists("ngram", lambda w: F.rlike(w, F.lit("\\s")) | (w == ""))).limit(1).count()
    if bad:
        raise ValueError("an ARPA file can't hold tokens that are empty or have white space")
    sizes = {r["order"]: r["n"] for r in model.groupBy("order").agg(F.count("*").alias("n")).collect()}
    top = max(sizes, default=0)
    head = [(0, k, "", line) for k, line in enumerate(["\\data\\", *[f"ngram {k}={sizes[k]}" for k in sorted(sizes)], ""])]
    head += [(2 * k - 1, 0, "", f"\\{k}-grams:") for k in sizes] + [(2 * k + 1, -1, "", "") for k in sizes] + [(2 * top + 2, 0, "", "\\end\\")]
    text = lambda x: x.cast("decimal(12,6)").cast("string")
    words = F.array_join("ngram", " ")
    line = F.concat_ws("\t", text(F.col("logp")), words, F.when(F.col("order") < top, text(F.col("backoff"))))
    rows = model.select((2 * F.col("order")).alias("section"), F.lit(0).alias("k"), words.alias("words"), line.alias("line"))
    return rows.unionByName(model.sparkSession.createDataFrame(head, "section int, k int, words string, line string")).select(F.struct("section", "k", "words").alias("place"), "line")


def write_arpa(model: DataFrame, path: str) -> None:
    """A folder of text files whose lines, files by name, are those of an ARPA file."""
    arpa_lines(model).orderBy("place").select("line").write.mode("overwrite").text(path)


def read_arpa(rows: DataFrame) -> DataFrame:
    """(order, ngram, logp, backoff) of the lines (column ``value``) of an ARPA file, in any order: an n-gram's order is its
    number of words."""
    f = F.split("value", "\t")
    words = F.split(F.get(f, F.lit(1)), " ")
    found = rows.where("value rlike '^-?[0-9.]+(e-?[0-9]+)?\t'")
    return found.select(F.size(words).alias("order"), words.alias("ngram"), F.get(f, F.lit(0)).cast("double").alias("logp"), F.coalesce(F.get(f, F.lit(2)).cast("double"), F.lit(0.0)).alias("backoff"))


@dataclass(frozen=True)
class PackedModel:
    """A model as sorted whole numbers: an n-gram is its words' numbers to the base of their count, so look-ups are binary
    searches and no two n-grams share a number. Scores are millionths; -1 stands for no word."""

    words: dict[str, int]
    keys: tuple[np.ndarray, ...]
    logp: tuple[np.ndarray, ...]
    backoff: tuple[np.ndarray, ...]

    @property
    def order(self) -> int:
        return len(self.keys)

    def ids(self, tokens: Sequence[str]) -> np.ndarray:
        """Numbers of words; 0 for unknown ones."""
        get = self.words.get
        return np.array([get(t, 0) for t in tokens], np.int64)

    def _at(self, k: int, words: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(where, found) of n-grams of ``k`` words."""
        key = np.zeros(len(words[0]), np.int64)
        for w in words:
            key = key * len(self.words) + w
        have = self.keys[k - 1]
        at = np.minimum(np.searchsorted(have, key), max(0, len(have) - 1))
        return at, (have[at] == key if len(have) else np.zeros(len(key), bool)) & np.all([w >= 0 for w in words], axis=0)

    def scores(self, context: Sequence[np.ndarray], word: np.ndarray) -> np.ndarray:
        """Millionths of log p(word | context) for many at once; ``context`` has the words before, the oldest first."""
        out = np.zeros(len(word), np.int64)
        open_ = np.ones(len(word), bool)
        for k in range(self.order, 0, -1):
            before = list(context[len(context) - k + 1 :]) if k > 1 else []
            if len(before) < k - 1:
                continue
            at, found = self._at(k, [*before, word])
            now = open_ & found
            out[now] += self.logp[k - 1][at[now]]
            open_ &= ~found
            if k > 1:
                at, found = self._at(k - 1, before)
                now = open_ & found
                out[now] += self.backoff[k - 2][at[now]]
        return out


def packed(model: DataFrame, at_hand: int = AT_HAND) -> PackedModel | None:
    """The model on the driver, to go along with functions; None if it has more n-grams than ``at_hand``."""
    sizes = {r["order"]: r["n"] for r in model.groupBy("order").agg(F.count("*").alias("n")).collect()}
    top = max(sizes, default=1)
    if sum(sizes.values()) > at_hand or (sizes.get(1, 0) + 2) ** top >= 2**63:
        return None
    t = model.select("order", "ngram", F.round(F.col("logp") * MILLION).cast("bigint").alias("logp"), F.round(F.col("backoff") * MILLION).cast("bigint").alias("backoff")).toArrow().combine_chunks()
    order, logp, backoff = (t.column(c).to_numpy() for c in ("order", "logp", "backoff"))
    grams = t.column("ngram").combine_chunks()
    flat = grams.flatten().to_pylist()
    words = {w: i for i, w in enumerate([UNKNOWN, *sorted(set(flat) - {UNKNOWN})])}
    ids = np.array([words[w] for w in flat], np.int64)
    starts = np.concatenate([[0], np.cumsum(order)])[:-1].astype(np.int64) if len(order) else np.zeros(0, np.int64)
    keys, ps, bs = [], [], []
    for k in range(1, top + 1):
        of = np.flatnonzero(order == k)
        key = np.zeros(len(of), np.int64)
        for j in range(k):
            key = key * len(words) + ids[starts[of] + j]
        by = np.argsort(key)
        keys.append(key[by])
        ps.append(logp[of][by])
        bs.append(backoff[of][by])
    return PackedModel(words, tuple(keys), tuple(ps), tuple(bs))


def with_logp(rows: DataFrame, context: Sequence[str], word: str, model: DataFrame, order: int, name: str) -> DataFrame:
    """``rows`` with the millionths of log p(word | context) by joins, for models of any size; ``context`` names the columns
    of the words before, the oldest first, null where there is none. A word that the model lacks is unknown."""
    millionths = lambda c: F.round(F.col(c) * MILLION).cast("bigint")
    known = model.where("order = 1").select(F.get("ngram", F.lit(0)).alias("_word"))
    cols = rows.columns
    for i, c in enumerate((*context, word)):
        there = known.withColumnRenamed("_word", f"_known{i}")
        rows = rows.join(there, F.col(c) == F.col(f"_known{i}"), "left").withColumn(f"_w{i}", F.when(F.col(c).isNotNull(), F.coalesce(f"_known{i}", F.lit(UNKNOWN)))).drop(f"_known{i}")
    total, open_ = F.lit(0).cast("bigint"), F.lit(True)
    for k in range(order, 0, -1):
        if len(context) < k - 1:
            continue
        at = [f"_w{i}" for i in range(len(context) - k + 1, len(context) + 1)]
        for j, (grams, what) in enumerate(((at, "logp"), (at[:-1], "backoff")) if k > 1 else ((at, "logp"),)):
            col = f"_{what}{k}"
            table = model.where(F.col("order") == k - j).select(F.col("ngram").alias(f"_g{k}{j}"), millionths(what).alias(col))
            whole = F.when(~F.exists(F.array(*grams), lambda w: w.isNull()), F.array(*grams))
            rows = rows.join(table, whole == F.col(f"_g{k}{j}"), "left").drop(f"_g{k}{j}")
        seen = F.col(f"_logp{k}").isNotNull()
        step = F.when(seen, F.col(f"_logp{k}")).otherwise(F.coalesce(f"_backoff{k}", F.lit(0)) if k > 1 else 0)
        total = total + F.when(open_, step).otherwise(0)
        open_ = open_ & ~seen
    return rows.withColumn(name, total).select(*cols, name)


def score_sentences(rows: DataFrame, keys: Sequence[str], tokens: str, model: DataFrame, bos: bool = True, eos: bool = True, at_hand: int = AT_HAND) -> DataFrame:
    """(keys, words, unknown, logp): each sentence's words, those that the model doesn't know, and the logarithm of its
    probability, unseen n-grams by back-off. Null and empty sentences have no words, and are scored by begin and end alone.

    A model of up to ``at_hand`` n-grams goes along with the function; beyond, sentences become rows of words that are joined
    with it, and ``keys`` must tell the sentences apart."""
    own = packed(model, at_hand)
    order = own.order if own else model.agg(F.max("order")).first()[0]
    rows = rows.select(*keys, F.coalesce(tokens, F.array().cast("array<string>")).alias("_tokens"))
    if own is None:
        return _scored_by_joins(rows, keys, model, order, bos, eos)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, end = own.words.get(BOS, 0), own.words.get(EOS, 0)
        for b in batches:
            arrays = b.column(len(keys))
            sizes = np.asarray(arrays.value_lengths().to_numpy(zero_copy_only=False), np.int64)
            ids = own.ids(arrays.flatten().to_pylist())
            # a row of words: the begin (or as many places without a word), the words, the end
            width = order - 1
            size = width + sizes + eos
            first = np.concatenate([[0], np.cumsum(size)])[:-1]
            line = np.full(int(size.sum()), -1, np.int64)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            line[first[owner] + width + np.arange(len(ids)) - np.repeat(np.concatenate([[0], np.cumsum(sizes)])[:-1], sizes)] = ids
            if bos and width:
                line[first + width - 1] = start
            if eos:
                line[first + size - 1] = end
            scored = np.ones(len(line), bool)
            for k in range(width):
                scored[first + k] = False
            at = np.flatnonzero(scored)
            total = own.scores([line[at - k] for k in range(width, 0, -1)], line[at]) if len(at) else np.zeros(0, np.int64)
            sums = np.zeros(len(sizes), np.int64)
            np.add.at(sums, np.searchsorted(first, at, "right") - 1, total)
            lost = np.bincount(owner, weights=ids == 0, minlength=len(sizes)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keys))), pa.array(sizes), pa.array(lost), pa.array(sums / MILLION)], names=[*keys, "words", "unknown", "logp"])

    kinds = "".join(f"{k} {rows.schema[k].dataType.simpleString()}, " for k in keys)
    return rows.mapInArrow(run, f"{kinds}words bigint, unknown bigint, logp double")


def _scored_by_joins(rows: DataFrame, keys: Sequence[str], model: DataFrame, order: int, bos: bool, eos: bool) -> DataFrame:
    before = order - 1
    front = F.array(*[F.lit(BOS if bos and i == before - 1 else None).cast("string") for i in range(before)])
    line = F.concat(front, F.col("_tokens"), F.array(F.lit(EOS)) if eos else F.array().cast("array<string>"))
    flat = rows.select(*keys, F.size("_tokens").alias("_size"), line.alias("_line")).select(*keys, "_size", "_line", F.posexplode(F.slice("_line", before + 1, F.size("_line"))).alias("_pos", "_word"))
    names = [f"_before{i}" for i in range(before)]
    flat = flat.select(*keys, "_size", "_pos", "_word", *[F.get("_line", F.col("_pos") + i).alias(n) for i, n in enumerate(names)])
    known = model.where("order = 1").select(F.get("ngram", F.lit(0)).alias("_own"))
    flat = with_logp(flat, names, "_word", model, order, "_score").join(known, F.col("_word") == F.col("_own"), "left")
    word = F.col("_pos") < F.col("_size")
    unknown = F.count_if(word & (F.col("_own").isNull() | (F.col("_word") == UNKNOWN)))
    scored = flat.groupBy(*keys).agg(F.count_if(word).alias("words"), unknown.alias("unknown"), (F.sum("_score") / MILLION).alias("logp"))
    if eos:
        return scored
    return scored.unionByName(rows.where(F.size("_tokens") == 0).select(*keys, F.lit(0).cast("bigint").alias("words"), F.lit(0).cast("bigint").alias("unknown"), F.lit(0.0).alias("logp")))
