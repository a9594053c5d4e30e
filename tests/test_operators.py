import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab import registry
from corpuslab.operators import corpus as C
from corpuslab.operators import decoding as D
from corpuslab.operators import ordered as O
from corpuslab.operators import pools
from corpuslab.operators import sampling as S
from corpuslab.operators.reranker import CharTransformer
from corpuslab.sources import tensors

CAND = "array<struct<text:string,source:int,answers_key:boolean,trusted_dictionary_hit:boolean>>"


def compared(spark, cands):
    return [c["text"] for c in spark.createDataFrame([(cands,)], f"c {CAND}").select(pools.comparable(F.col("c")).alias("x")).first()["x"]]


def test_gate(spark):
    assert compared(spark, []) == []
    assert compared(spark, [("ab", 8, None, None), ("cd", 8, None, None), ("e", 8, None, None)]) == ["ab", "cd"]  # widths as the leader's
    assert compared(spark, [("ab", 0, None, None), ("cd", 8, None, None)]) == []  # a dictionary leads
    assert compared(spark, [("ab", 0, None, False), ("cd", 8, None, None)]) == ["ab", "cd"]
    assert compared(spark, [("ab", 8, False, None), ("cd", 8, True, None), ("ef", 8, True, None)]) == []  # the leader doesn't answer
    assert compared(spark, [("ab", 8, True, None), ("cde", 8, True, None), ("fg", 8, False, None)]) == ["ab", "cde"]  # facts beat lengths
    assert len(compared(spark, [(f"a{i}", 8, True, None) for i in range(12)])) == 9


def test_picks(spark):
    df = spark.createDataFrame([(["a", "b", "c", "b"], [1.0, 3.0, 3.0, 2.0])], "t array<string>, s array<double>")
    got = df.select(pools.pick_of(F.col("s")), pools.promote(F.col("t"), F.lit(2)), pools.rank_of(F.col("t"), F.lit("b")), pools.rank_of(F.col("t"), F.lit("z"))).first()
    assert tuple(got) == (1, ["c", "a", "b", "b"], 1, -1)


def test_keep_first_and_budget(spark):
    rows = [(i, "line%d" % (i % 7)) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, line string").repartition(5)
    assert sorted(r["id"] for r in C.keep_first(df, "line", ["id"]).collect()) == list(range(7))
    sized = spark.createDataFrame([(i, i % 5 + 1) for i in range(200)], "id long, n long").repartition(6)
    want, total = [], 0
    for i in range(200):
        if total >= 123:
            break
        want.append(i)
        total += i % 5 + 1
    assert sorted(r["id"] for r in C.within_budget(sized, F.col("n"), ["id"], 123).collect()) == want


def test_kneser_ney_sums_to_one(spark):
    r = random.Random(1)
    b = {}
    for _ in range(500):
        k = (r.choice("abcdef"), r.choice("uvwxyz"))
        b[k] = b.get(k, 0) + 1
    p = C.kneser_ney(spark.createDataFrame([(*k, n) for k, n in b.items()], "w1 string, w2 string, n long")).collect()
    firsts = {k[0] for k in b if len([x for x in b if x[0] == k[0]]) == 6}
    for w in firsts:
        assert sum(x["p"] for x in p if x["w1"] == w) == pytest.approx(1)


def test_trigrams_sum_to_one_over_what_follows_anywhere(spark):
    """Every third letter follows each pair here, so that nothing is left for unseen ones."""
    r = random.Random(2)
    b = {k: r.randint(1, 9) for k in itertools.product("ab", "cd", "efg")}
    p = C.kneser_ney_trigrams(spark.createDataFrame([(*k, n) for k, n in b.items()], "w1 string, w2 string, w3 string, n long")).collect()
    assert len(p) == len(b)
    for w in itertools.product("ab", "cd"):
        assert sum(x["p"] for x in p if (x["w1"], x["w2"]) == w) == pytest.approx(1)


def test_samples_are_the_same_each_time(spark):
    df = spark.range(500).withColumnRenamed("id", "doc_id").withColumn("k", F.col("doc_id") % 3)
    a = sorted(r["doc_id"] for r in S.per_stratum(df, ["k"], 10, "x", "doc_id").collect())
    assert len(a) == 30 and a == sorted(r["doc_id"] for r in S.per_stratum(df.repartition(7), ["k"], 10, "x", "doc_id").collect())
    taken = spark.createDataFrame([(1,)], "k long")
    assert {r["k"] for r in S.quota(df, "k", taken, [], 10, "x", "doc_id").collect()} == {0, 2}


def test_all_rows_are_numbered_in_order(spark):
    rows = [(i, f"w{i * 7919 % 40}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, w string").repartition(7)
    got = [(r["w"], r["id"], r["k"]) for r in O.numbered(df, ["w", "id"], "k").collect()]
    assert sorted(got, key=lambda x: x[2]) == [(w, i, k) for k, (w, i) in enumerate(sorted((w, i) for i, w in rows), 1)]
    assert O.numbered(df.where("false"), ["w", "id"], "k").collect() == []


def grouped(spark, n=3000):
    """Rows of a group that holds two thirds, small ones, and a null group; values repeat."""
    rows = [(i, None if i % 11 == 0 else "hot" if i % 3 else f"g{i % 30}", float(i * 7919 % 101)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, g string, v double").repartition(7)


def test_groups_are_numbered_and_summed_in_order(spark):
    rows, df = grouped(spark)
    want, place, total = {}, Counter(), Counter()
    for i, g, v in sorted(rows):
        place[g] += 1
        want[i] = (place[g], total[g])
        total[g] += v
    assert {r["id"]: r["k"] for r in O.numbered(df, ["id"], "k", ["g"]).collect()} == {i: k for i, (k, _) in want.items()}
    assert {r["id"]: r["b"] for r in O.running(df, ["id"], "b", F.col("v"), ["g"]).collect()} == {i: b for i, (_, b) in want.items()}
    kept = C.within_budget(df, F.col("v"), ["id"], 500, ["g"]).collect()
    assert sorted(r["id"] for r in kept) == sorted(i for i, (_, b) in want.items() if b < 500)
    assert O.running(df.where("false"), ["id"], "b", F.col("v"), ["g"]).collect() == []


def test_values_at_ranks(spark):
    rows, df = grouped(spark)
    by = {}
    for _, g, v in rows:
        by.setdefault(g, []).append(v)
    got = O.at_ranks(df.union(df.limit(1).select("id", "g", F.lit(None).cast("double"))), ["g"], "v", {"near": O.nearest_rank("0.95"), "floor": O.floor_rank("0.95"), "least": lambda n: F.lit(1)})
    want = {g: (sorted(a)[math.ceil(len(a) * 95 / 100) - 1], sorted(a)[min(len(a) - 1, len(a) * 95 // 100)], min(a)) for g, a in by.items()}
    assert {r["g"]: (r["near"], r["floor"], r["least"]) for r in got.collect()} == want
    assert O.at_ranks(df.where("false"), ["g"], "v", {"near": O.nearest_rank("0.5")}).collect() == []


@pytest.mark.parametrize("name", ["t05_all_sorted_lines", "t06_shuffled_documents"])
def test_nothing_is_left_out(spark, name):
    data = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    want = docs.select(F.explode(F.split("text", "\n"))) if "lines" in name else docs
    got = registry.queries()[name](spark, data)
    assert [tuple(x) for x in got.agg(F.count("*"), F.min("k"), F.max("k"), F.countDistinct("k")).collect()] == [(n := want.count(), 1, n, n)]


def test_scan_leaves_no_document_out(spark):
    data = "/root/testdata/sf0.01"
    assert registry.queries()["src05_all_documents"](spark, data).count() == spark.read.parquet(f"{data}/documents.parquet").count()


def test_decoders():
    assert D.typed_slots(["zhong", "guo"], "zhg") == ["zh", "g"]
    assert D.typed_slots(["zhong", "guo"], "zhonggu") == ["zhong", "gu"]
    assert D.typed_slots(["zhong", "guo"], "zoguo") == []
    lp = lambda p, c: {"ab": 0.0, "ba": -1.0}.get((p or "") + c, -3.0)
    assert D.viterbi([["a", "b"], ["a", "b"]], lp) == ("ab", -3.0)
    assert D.viterbi([], lp) == ("", 0.0)
    layers = [["a", "b", "c"]] * 4
    score = lambda t, end: -sum((ord(x) * 7 + ord(y) * 3) % 11 for x, y in zip(t, t[1:]))  # noqa: E731, B905
    bigram = lambda p, c: 0.0 if p is None else -float((ord(p) * 7 + ord(c) * 3) % 11)
    import itertools

    best = max(score("".join(x), False) for x in itertools.product("abc", repeat=4))
    assert D.viterbi(layers, bigram)[1] == best
    assert D.viterbi_rescored(layers, score)[1] == best
    assert D.beam(layers, lambda t: lambda c: bigram(t[-1] if t else None, c), width=100)[0][1] == best


def test_segmentations(spark):
    keys = spark.createDataFrame([("xian",), ("zz",)], "k string")
    syl = spark.createDataFrame([("xi",), ("an",), ("xian",), ("a",), ("n",)], "syllable string")
    got = sorted((r["parts"], r["n"]) for r in D.segmentations(keys, "k", syl, 3).collect())
    assert got == [("xi a n", 3), ("xi an", 2), ("xian", 1)]


def test_transformer_scores_one_by_one():
    m = CharTransformer.random(["<pad>", "<unk>", "<bos>", *"abcdef"], context=12)
    cands = ["ab", "abc", "f", "", "zz"]
    got = m.score("fedcba", cands)
    assert got[3] == float("-inf")
    longest = 3
    prefix = [2, *m.encode("fedcba")[-(12 - 1 - longest) :]]
    for c, s in zip(cands, got):
        if c:
            p = m.log_probabilities(np.array([prefix + m.encode(c)]))[0]
            want = np.mean([p[len(prefix) - 1 + j, t] for j, t in enumerate(m.encode(c))])
            assert s == pytest.approx(want, abs=1e-9)
    assert np.exp(m.next_log_probabilities("ab")).sum() == pytest.approx(1)


def test_model_files():
    r = np.random.default_rng(0)
    w = {"tok.weight": r.normal(size=(5, 4)).astype("f4"), "pos.weight": r.normal(size=(3, 4)).astype("f4"), "b": r.normal(size=4).astype("f4")}
    data = tensors.build(w, {"license": "MIT"})
    back, meta = tensors.parse(data)
    assert meta == {"license": "MIT"} and all((back[k] == w[k]).all() for k in w)
    small, _ = tensors.parse(tensors.build(w, {}, int8=True))
    assert np.abs(small["tok.weight"] - w["tok.weight"]).max() < np.abs(w["tok.weight"]).max() / 100 and (small["pos.weight"] == w["pos.weight"]).all()
    for cut in range(len(data)):
        with pytest.raises(tensors.ModelFileError):
            tensors.parse(data[:cut])
    half = b'{"h":{"dtype":"F16","shape":[2],"data_offsets":[0,4]}}'
    assert tensors.parse(len(half).to_bytes(8, "little") + half + b"\x00\x3c\x01\x00")[0]["h"].tolist() == [1.0, 2.0**-24]


def test_words_of_a_table(spark):
    from pyspark.sql import functions as F

    from corpuslab.operators import words as W

    texts = spark.createDataFrame([(1, "还钱还是还"), (2, ""), (3, None), (4, "行x行人")], "id int, t string")
    table = spark.createDataFrame([("还", ["hai"]), ("还钱", ["huan", "qian"]), ("行", ["xing"]), ("行人", ["hang", "ren"]), ("坏", ["a", "b"]), ("", [])], "word string, readings array<string>")
    assert [r["readings"] for r in W.with_readings(texts, "t", table).orderBy("id").collect()] == [["huan", "qian", "hai", None, "hai"], [], None, ["xing", None, "hang", "ren"]]
    variants = spark.createDataFrame([("发", "發"), ("头发", "頭髮"), ("头", "頭"), ("头", "首首"), ("]", "[")], "variant string, plain string")
    plain = W.converted(spark.createDataFrame([(1, "发头发头]头头发"), (2, None), (3, "")], "id int, t string"), "t", variants)
    head = min("頭", "首首")
    assert [r["t"] for r in plain.orderBy("id").collect()] == [f"發頭髮{head}[{head}頭髮", None, ""]
    assert [r["t"] for r in W.converted(texts, "t", variants.where("false")).orderBy("id").collect()] == ["还钱还是还", "", None, "行x行人"]
    pieces = spark.createDataFrame([(["a", "bc", "defgh", "i"],), ([],)], "p array<string>").select(W.word_windows(F.col("p")).alias("w"), W.picked(W.word_windows(F.col("p")), F.lit(1)).alias("x")).collect()
    assert [r["w"] for r in pieces] == [["abc", "bc"], []] and pieces[0]["x"] in ("abc", "bc") and pieces[1]["x"] is None


def test_segmentation_is_cheapest(spark):
    import itertools

    from corpuslab.operators import words as W

    counts = {"a": 5, "ab": 4, "b": 1, "abc": 2, "ca": 3, "bca": 2}
    total = sum(counts.values())
    price = lambda p: W.cost(counts.get(p, 0.5), total)
    texts = ["".join(t) for n in range(1, 6) for t in itertools.product("abcx", repeat=n)]
    got = W.segmented(spark.createDataFrame([(t,) for t in [*texts, ""]], "t string"), "t", spark.createDataFrame(list(counts.items()), "word string, n long")).collect()

    def parts(t):
        return [[]] if not t else [[t[:n], *rest] for n in range(1, len(t) + 1) if n == 1 or t[:n] in counts for rest in parts(t[n:])]

    for r in got:
        want = min(sum(map(price, p)) for p in parts(r["t"]))
        assert "".join(r["pieces"]) == r["t"] and sum(map(price, r["pieces"])) == want


def test_candidates_longer_than_the_model(spark):
    """What lies beyond the window of the model isn't scored."""
    from corpuslab.operators.reranker import CharTransformer, score_candidates

    model = CharTransformer.random(["<pad>", "<unk>", "<bos>", *"abc"])
    long = "abc" * 20
    assert model.score("context", [long, "a"])[0] == pytest.approx(model.score("", [long[:48]])[0]) and model.score("", [long * 9]) == model.score("", [long[:48]])
    got = score_candidates(spark.createDataFrame([(1, "c", [long, "", "ab"])], "id int, c string, k array<string>"), model, "id", "c", "k").first()["scores"]
    assert len(got) == 3 and got[1] == float("-inf")
