"""Windows behind a filter, and keys that begin names, against plain Python."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab import registry
from corpuslab.operators import overlap_filter as OF
from corpuslab.operators import prefix_join as PJ


def plain_windows(text, kind):
    p = re.split(kind.pattern, text) if text is not None else []
    return {kind.sep.join(p[i : i + kind.width]) for i in range(len(p) - kind.width + 1)}


@pytest.mark.parametrize("kind", [OF.Windows(), OF.Windows(width=2), OF.LINES, OF.Windows("\n", 2, "\n")])
def test_hits(spark, monkeypatch, kind):
    monkeypatch.setattr(OF, "TOGETHER", 50)
    r = random.Random(3)
    word = lambda: r.choice(["a", "b", "é𠀀", "", "dd"])
    text = lambda n: "".join(word() + r.choice([" ", "\n"]) for _ in range(n))
    docs = {i: text(r.randrange(30)) for i in range(60)} | {100: None, 101: "", 102: text(3000)}
    items = {f"i{i}": text(r.randrange(12)) for i in range(8)} | {"none": None, "long": docs[102][200:260] + " x", "part": "q " + docs[5]}
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(list(items.items()), "item_id string, text string")
    want = {(i, j) for i, t in docs.items() for j, u in items.items() if plain_windows(t, kind) & plain_windows(u, kind)}
    assert {tuple(x) for x in OF.hits(d, "doc_id", b, "item_id", kind).collect()} == want and want
    assert {x["doc_id"] for x in OF.sharing(d, "doc_id", b, kind).collect()} == {i for i, _ in want}
    assert OF.hits(d, "doc_id", b.where("false"), "item_id", kind).collect() == [] == OF.sharing(d.where("false"), "doc_id", b, kind).collect()


def test_filter_lets_few_others_through(spark):
    """All windows of the set pass, and of others three in a thousand at most; a full array only lets more through."""
    own = spark.range(3000).select(F.md5(F.col("id").cast("string")).alias("text"))
    others = spark.range(20_000).select("id", F.md5(F.concat(F.lit("x"), F.col("id").cast("string"))).alias("text"))
    bits = OF.filter_of(own, "text", OF.LINES)
    assert 64 * len(bits) >= OF.BITS_EACH * 3000 and OF.possible(own.withColumn("id", F.lit(1)), "id", "text", OF.LINES, bits).count() == 3000
    assert OF.possible(others, "id", "text", OF.LINES, bits).count() <= 60
    assert OF.possible(others, "id", "text", OF.LINES, np.full(1, np.uint64(2**64 - 1))).count() == 20_000


def test_only_possible_windows_are_shuffled(spark):
    data = "/root/testdata/sf0.001"
    docs, bench = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "benchmark"))
    every = OF.possible(docs, "doc_id", "text", OF.Windows()).count()
    passed = OF.possible(docs, "doc_id", "text", OF.Windows(), OF.filter_of(bench, "text")).count()
    assert 0 < passed < 0.1 * every
    assert registry.queries()["j05_window_members"](spark, data).count() > 0


def plain_beginnings(names, keys):
    return sorted((i, t, k) for i, t in names for k in keys if k is not None and t is not None and t.startswith(k))


@pytest.mark.parametrize("ranges,end", [(1, 64), (7, 64), (40, 64), (40, 2)])
def test_beginnings(spark, monkeypatch, ranges, end):
    monkeypatch.setattr(PJ, "END", end)
    monkeypatch.setattr(PJ, "TRIED", 3)
    r = random.Random(ranges)
    text = lambda n: "".join(r.choice("ab𠀀") for _ in range(r.randrange(n)))
    names = [(i, text(9)) for i in range(400)] + [(1000 + i, "abab") for i in range(300)] + [(2000, None), (2001, ""), (2002, "a" * 5000)]
    keys = sorted({text(6) for _ in range(60)} | {"a" * 70, "abab", "ababa"}) + [None]
    n = spark.createDataFrame(names, "id long, name string").repartition(3)
    got = PJ.beginnings(n, "name", spark.createDataFrame([(k,) for k in keys], "k string"), "k", ranges)
    assert got.columns == ["id", "name", "k"] and sorted(map(tuple, got.collect())) == plain_beginnings(names, keys)
    assert PJ.beginnings(n.where("false"), "name", spark.createDataFrame([("a",)], "k string"), "k").collect() == []
    assert PJ.beginnings(n, "name", spark.createDataFrame([], "k string"), "k").collect() == []


def test_ranges_hold_what_their_names_begin_with():
    r = random.Random(1)
    text = lambda n: "".join(r.choice("ab") for _ in range(r.randrange(n)))
    for _ in range(300):
        ends = sorted(text(5) for _ in range(r.randrange(9)))
        keys, names = {text(5) for _ in range(12)}, [text(8) for _ in range(12)]
        for t in names:
            for at in PJ.ranges_of_name(ends, t):
                there = {k for k in keys if at in PJ.ranges_of_key(ends, k)}
                assert {k for k in keys if t.startswith(k)} <= there


def test_a_frequent_name_is_spread():
    """A name that a third of the rows hold has a third of the ranges."""
    names = sorted(["hot"] * 100 + [f"{i:03d}" for i in range(200)])
    ends = [names[len(names) * i // 30] for i in range(1, 30)]
    assert 9 <= len(PJ.ranges_of_name(ends, "hot")) <= 11 and len(PJ.ranges_of_name(ends, "100")) <= 1
