"""Decoding of syllables into characters: segmentations, Viterbi over bigrams, beams."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def segmentations(keys: DataFrame, key: str, syllables: DataFrame, most: int) -> DataFrame:
    """(key, parts, n): every way to split a typed key into syllables, at most ``most`` of them. Each round extends what
    is left by an equality join on its prefixes, so no pair of a key and a syllable is tried that doesn't fit."""
    longest = syllables.agg(F.max(F.length("syllable"))).first()[0] or 0
    sizes = F.sequence(F.lit(1), F.least(F.length("rest"), F.lit(longest)))
    known = syllables.select("syllable").distinct()
    state = keys.select(key, F.col(key).alias("rest"), F.lit("").alias("parts"), F.lit(0).alias("n"))
    done = None
    for _ in range(most):
        state = (
            state.where("rest <> ''")
            .select("*", F.explode(F.transform(sizes, lambda k: F.substring("rest", F.lit(1), k))).alias("syllable"))
            .join(known, "syllable")
            .select(key, F.substring("rest", F.length("syllable") + 1, F.length("rest")).alias("rest"), F.concat("parts", F.when(F.col("n") > 0, " ").otherwise(""), "syllable").alias("parts"), (F.col("n") + 1).alias("n"))
        )
        ended = state.where("rest = ''").select(key, "parts", "n")
        done = ended if done is None else done.unionByName(ended)
    return done


def typed_slots(syllables: Sequence[str], code: str) -> list[str]:
    """How each syllable was typed: in full, as an initial (one letter, or zh ch sh), or the last one cut short; the
    fuller way wins. Empty where the code doesn't fit. A table of reachable positions, from the end."""
    n = len(syllables)
    good = [{len(code)} if i == n else set() for i in range(n + 1)]

    def ways(i: int, at: int) -> list[int]:
        s = syllables[i]
        sizes = [len(s)] + [k for k in range(len(s) - 1, 0, -1) if i == n - 1 or k == 1 or (k == 2 and s[:2] in ("zh", "ch", "sh"))]
        return [k for k in sizes if code[at : at + k] == s[:k] and at + k <= len(code)]

    for i in range(n - 1, -1, -1):
        good[i] = {at for at in range(len(code) + 1) if any(at + k in good[i + 1] for k in ways(i, at))}
    if 0 not in good[0]:
        return []
    out, at = [], 0
    for i in range(n):
        k = next(k for k in ways(i, at) if at + k in good[i + 1])
        out.append(code[at : at + k])
        at += k
    return out


def viterbi(layers: Sequence[Sequence[str]], log_p: Callable[[str | None, str], float]) -> tuple[str, float]:
    """Best path through layers of candidates under bigram log-probabilities; of equal ones the first."""
    best: dict[str, tuple[float, str]] = {}
    for i, layer in enumerate(layers):
        now: dict[str, tuple[float, str]] = {}
        for c in layer:
            if i == 0:
                now[c] = (log_p(None, c), c)
                continue
            score, path = max(((s + log_p(p, c), t) for p, (s, t) in best.items()), key=lambda x: x[0])
            now[c] = (score, path + c)
        best = now
    if not best:
        return "", 0.0
    score, path = max(best.values(), key=lambda x: x[0])
    return path, score


def viterbi_rescored(layers: Sequence[Sequence[str]], score: Callable[[str, bool], float]) -> tuple[str, float]:
    """One path for each last character, each scored as a whole with BOS; the best one's score has EOS in it, which has no part
    in the choice. Without layers ("", 0.0)."""
    if not layers:
        return "", 0.0
    paths = [""]
    for layer in layers:
        paths = [max((p + c for p in paths), key=lambda t: score(t, False)) for c in layer]
    best = max(paths, key=lambda t: score(t, False), default="")
    return best, score(best, True) if best else 0.0


def beam(layers: Sequence[Sequence[str]], next_log_p: Callable[[str], Callable[[str], float | None]], width: int = 12, each: int = 12) -> list[tuple[str, float]]:
    """The ``width`` best readings, extended layer by layer with the first ``each`` characters."""
    beams = [("", 0.0)]
    for layer in layers:
        grown = []
        for text, total in beams:
            p = next_log_p(text)
            grown += [(text + c, total + x) for c in layer[:each] if (x := p(c)) is not None]
        beams = sorted(grown, key=lambda b: -b[1])[:width]
    return beams


def decode_rows(rows: DataFrame, key: str, layers: str, one: Callable[[list[list[str]]], tuple[str, float]], *more: str) -> DataFrame:
    """(key, more columns, text, score): a decoder over each row's array of arrays."""

    def run(batches):
        for pdf in batches:
            got = [one([list(x) for x in a]) for a in pdf[layers]]
            yield pd.DataFrame({**{c: pdf[c] for c in (key, *more)}, "text": [t for t, _ in got], "score": [round(float(s), 6) if math.isfinite(s) else s for _, s in got]})

    kinds = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in (key, *more))
    return rows.select(key, *more, layers).mapInPandas(run, f"{kinds}text string, score double")
