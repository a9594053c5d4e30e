"""Evaluation statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslab.functions.presets import Z_95, Z_POWER_80


def hits(ok: Column) -> Column:
    """Aggregate: how many are true."""
    return F.count_if(ok)


def rate(ok: Column) -> Column:
    return F.count_if(ok) / F.count(F.lit(1))


def wilson(hits_: Column, n: Column, z: float = Z_95, digits: int = 4) -> tuple[Column, Column]:
    """Lower and upper end of the Wilson interval, held to 0..1 and rounded; both 0 without cases."""
    p = hits_ / n
    below = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / below
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / below
    low = F.round(F.greatest(F.lit(0.0), centre - half), digits)
    high = F.round(F.least(F.lit(1.0), centre + half), digits)
    return F.when(n == 0, 0.0).otherwise(low), F.when(n == 0, 0.0).otherwise(high)


def mcnemar(only_a: Column, only_b: Column) -> Column:
    """Exact two-sided p of a binomial test with share 1/2. Terms are added as logarithms, so no count underflows."""
    n = (only_a + only_b).cast("double")
    k = F.least(only_a, only_b).cast("int")
    zero = F.struct((-n * F.log(F.lit(2.0))).alias("term"), F.lit(0.0).alias("total"))
    step = lambda acc, i: F.struct(
        (acc["term"] + F.when(i < k, F.log((n - i) / (i + 1.0))).otherwise(F.lit(0.0))).alias("term"),
        (acc["total"] + F.exp(acc["term"])).alias("total"),
    )
    total = F.aggregate(F.sequence(F.lit(0), k), zero, step, lambda acc: acc["total"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * total))


def cases_needed(discordance: Column, net: Column) -> Column:
    """Cases that show a net difference at 5 % and power 80 %."""
    q = F.least((discordance + net) / (2 * discordance), F.lit(1 - 1e-12))
    pairs = F.pow(Z_95 / 2 + Z_POWER_80 * F.sqrt(q * (1 - q)), F.lit(2.0)) / F.pow(q - 0.5, F.lit(2.0))
    return pairs / discordance


def detectable_net(n: Column, discordance: Column, steps: int = 100) -> Column:
    """The smallest net difference that ``n`` cases show, by bisection; null where even all discordance doesn't."""
    zero = F.struct(F.lit(1e-6).alias("low"), discordance.cast("double").alias("high"))

    def step(acc: Column, _: Column) -> Column:
        middle = (acc["low"] + acc["high"]) / 2
        short = cases_needed(discordance, middle) > n
        return F.struct(F.when(short, middle).otherwise(acc["low"]).alias("low"), F.when(short, acc["high"]).otherwise(middle).alias("high"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), zero, step, lambda acc: acc["high"])
    return F.when((n > 0) & (discordance > 0) & (cases_needed(discordance, discordance * 0.999999) <= n), found)


def over_budget(value: Column, budget: float) -> Column:
    """Aggregate: share of values over a budget."""
    return F.count_if(value > budget) / F.count(value)


def learning_rate(step: Column, total: int, peak: float, warmup: int) -> Column:
    """Linear warm-up, then a cosine down to a tenth."""
    done = (step - warmup) / max(1, total - warmup)
    return F.when(step < warmup, peak * (step + 1) / warmup).otherwise(peak * (0.1 + 0.45 * (1 + F.cos(F.lit(3.141592653589793) * done))))


def transformer_parameters(vocab: Column, context: Column, layers: Column, width: Column) -> Column:
    """Parameters of a causal transformer , the tied embedding counted once."""
    block = 12 * width * width + 9 * width
    return vocab * width + context * width + layers * block + 2 * width
