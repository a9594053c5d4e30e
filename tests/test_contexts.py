"""Contexts as offsets and blocks against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from corpuslab.operators import contexts as K


@pytest.mark.parametrize("size", [1, 7, 4096])
def test_contexts(spark, size):
    r = random.Random(size)
    rows = [(g, k, r.choice([None, "", "é𠀀", "abc", "x" * r.randrange(30)])) for g in (1, 2, None) for k in range(r.randrange(3, 25))] + [(9, 0, "only")]
    df = spark.createDataFrame(rows, "g long, k long, text string").repartition(3)
    placed = K.offsets(df, ["g"], ["k"]).cache()
    want, joined = {}, {}
    for g, k, t in sorted(rows, key=lambda r: (r[0] or 0, r[1])):
        before = [x for x in joined.get(g, []) if x is not None]
        want[g, k] = "\n".join(before)
        joined.setdefault(g, []).append(t)
    whole = {g: "\n".join(x for x in t if x is not None) for g, t in joined.items()}
    for x in placed.collect():
        if x["text"] is not None:
            assert whole[x["g"]][x["start"] : x["end"]] == x["text"] and whole[x["g"]][: max(x["start"] - 1, 0)] == want[x["g"], x["k"]]
    assert {(x["g"], x["k"]): x["before"] for x in K.whole_contexts(placed, ["g"], ["k"]).collect()} == want
    got = {}
    for x in K.blocks(placed, ["g"], size=size).collect():
        got.setdefault(x["g"], {})[x["block"]] = x["text"]
    for g, b in got.items():
        assert "".join(b.get(i, "") for i in range(max(b) + 1)) == whole[g] and all(len(t) <= size for t in b.values())
    for most in (0, 1, 5, 1000):
        assert {(x["g"], x["k"]): x["before"] for x in K.tails(placed, ["g"], ["k"], most, size=size).collect()} == {k: t[max(0, len(t) - most) :] for k, t in want.items()}
    none = K.offsets(df.where("false"), ["g"], ["k"])
    assert none.collect() == K.blocks(none, ["g"]).collect() == K.tails(none, ["g"], ["k"], 5).collect() == K.whole_contexts(none, ["g"], ["k"]).collect() == []


def test_a_long_conversation_takes_linear_room(spark):
    n = 100_000
    df = spark.range(n).select(F.lit(1).alias("g"), F.col("id").alias("k"), F.concat(F.lit("turn "), F.col("id").cast("string")).alias("text"))
    placed = K.offsets(df, ["g"], ["k"]).cache()
    chars = sum(len(f"turn {i}") + 1 for i in range(n)) - 1
    sizes = K.blocks(placed, ["g"]).agg(F.sum(F.length("text")).alias("all"), F.max(F.length("text")).alias("most"), F.count("*").alias("n")).first()
    assert (sizes["all"], sizes["most"], sizes["n"]) == (chars, K.BLOCK, -(-chars // K.BLOCK))
    got = K.tails(placed, ["g"], ["k"], 20).where("k = 99999").first()["before"]
    assert got == "\n".join(f"turn {i}" for i in range(n - 1))[-20:]
