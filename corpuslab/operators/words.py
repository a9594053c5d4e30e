"""Texts against a table of words: segmentation, readings, conversion of variants.

A table of words is a dictionary, which doesn't grow with the texts: it travels to the tasks after a check of its size
(MOST entries, else ``ValueError``), and the texts stay where they are. Null texts stay null.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from corpuslab.functions.presets import WORD_MAX, WORD_MIN

#: Entries of a table of words, at most.
MOST = 2_000_000


def entries(words: DataFrame, *columns: str) -> list[Row]:
    """The rows of a table of words; those without a word are left out."""
    rows = words.select(*columns).where(F.length(columns[0]) > 0).limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"a table of words has over {MOST} entries")
    return rows


class Finder:
    """Finds words of a table in a text from the left, of those that begin at a place the longest."""

    def __init__(self, words: Sequence[str]) -> None:
        by: dict[str, set[int]] = {}
        for w in words:
            by.setdefault(w[0], set()).add(len(w))
        self.lengths = {c: sorted(n, reverse=True) for c, n in by.items()}
        self.begin = re.compile("[" + "".join(re.escape(c) for c in by) + "]") if by else re.compile("(?!)")

    def spans(self, text: str, words: dict[str, object]) -> list[tuple[int, int]]:
        out, at = [], 0
        while m := self.begin.search(text, at):
            at = m.start()
            end = next((at + n for n in self.lengths[m[0]] if text[at : at + n] in words), 0)
            if end:
                out.append((at, end))
            at = end or at + 1
        return out


def converted(texts: DataFrame, text: str, variants: DataFrame) -> DataFrame:
    """``texts`` with the variants (variant, plain) in column ``text`` made plain, phrases before what they begin with.
    Of several plain forms of a variant the smallest holds."""
    table = variants.groupBy("variant").agg(F.min("plain").alias("plain"))
    held = texts.sparkSession.sparkContext.broadcast({r["variant"]: r["plain"] or "" for r in entries(table, "variant", "plain")})

    @F.pandas_udf("string")
    def convert(column: pd.Series) -> pd.Series:
        words = held.value
        finder = Finder(list(words))

        def one(t: str | None) -> str | None:
            if t is None:
                return None
            out, last = [], 0
            for a, b in finder.spans(t, words):
                out += [t[last:a], words[t[a:b]]]
                last = b
            return "".join(out) + t[last:]

        return column.map(one, na_action="ignore")

    return texts.withColumn(text, convert(F.col(text)))


def with_readings(texts: DataFrame, text: str, table: DataFrame, out: str = "readings") -> DataFrame:
    """``texts`` with the reading of every character of ``text``, null where the table (word, readings: one for each
    character) has none. Words decide before their characters, longer ones first, so that a character's reading may
    depend on the word around it. Entries whose readings don't fit the word are left out; of several the smallest holds."""
    fit = table.where(F.size("readings") == F.length("word")).groupBy("word").agg(F.min("readings").alias("readings"))
    held = texts.sparkSession.sparkContext.broadcast({r["word"]: list(r["readings"]) for r in entries(fit, "word", "readings")})

    @F.pandas_udf("array<string>")
    def read(column: pd.Series) -> pd.Series:
        words = held.value
        finder = Finder(list(words))

        def one(t: str | None) -> list[str | None] | None:
            if t is None:
                return None
            found: list[str | None] = [None] * len(t)
            for a, b in finder.spans(t, words):
                found[a:b] = words[t[a:b]]
            return found

        return column.map(one, na_action="ignore")

    return texts.withColumn(out, read(F.col(text)))


def cost(n: float, total: float) -> int:
    """Thousandths of the negative logarithm of a word's share, as an integer, so that ties are ties everywhere."""
    return round(1000 * math.log(total / n))


def segmented(texts: DataFrame, text: str, words: DataFrame, out: str = "pieces") -> DataFrame:
    """``texts`` with the words of ``text``, which has no spaces: the cheapest segmentation by the shares of words
    (word, n); a character that is no word costs as one seen half a time. Of equal ones that with the longer last word."""
    counts = {r["word"]: r["n"] for r in entries(words.groupBy("word").agg(F.sum("n").alias("n")).where("n > 0"), "word", "n")}
    total = max(1, sum(counts.values()))
    held = texts.sparkSession.sparkContext.broadcast(({w: cost(n, total) for w, n in counts.items()}, cost(0.5, total)))

    @F.pandas_udf("array<string>")
    def segment(column: pd.Series) -> pd.Series:
        costs, unknown = held.value
        lengths = sorted({len(w) for w in costs} | {1}, reverse=True)

        def one(t: str | None) -> list[str] | None:
            if t is None:
                return None
            best, last = [0] * (len(t) + 1), [0] * (len(t) + 1)
            for e in range(1, len(t) + 1):
                options = ((n, costs.get(t[e - n : e], unknown if n == 1 else None)) for n in lengths if n <= e)
                best[e], back = min((best[e - n] + c, -n) for n, c in options if c is not None)
                last[e] = e + back
            pieces, e = [], len(t)
            while e:
                pieces.append(t[last[e] : e])
                e = last[e]
            return pieces[::-1]

        return column.map(one, na_action="ignore")

    return texts.withColumn(out, segment(F.col(text)))


def word_windows(pieces: Column, least: int = WORD_MIN, most: int = WORD_MAX) -> Column:
    """Windows of one word or two neighbours that have ``least`` to ``most`` characters, in order."""
    both = F.flatten(F.transform(pieces, lambda p, i: F.array(p, F.concat(p, F.get(pieces, i + 1)))))
    return F.filter(both, lambda w: F.length(w).between(least, most))


def picked(items: Column, seed: Column) -> Column:
    """One of the items by a seeded hash of its place; null of none."""
    ranked = F.transform(items, lambda x, i: F.struct(F.md5(F.concat_ws(":", seed, i.cast("string"))).alias("h"), x.alias("x")))
    return F.array_min(ranked)["x"]
