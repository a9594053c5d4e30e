"""The n-gram join and decontamination against brute force."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.llm import decontamination, ngram_join, queries, shingles
from corpuslab.llm.components import components, star_components
from corpuslab.llm.shingles import shingle_strings


def made_texts(seed, n, vocabulary=400):
    r = random.Random(seed)
    words = ["w%d" % i for i in range(vocabulary)]
    base = [[r.choice(words) for _ in range(r.choice([0, 1, 3, 5, 6, 9, 14, 20, 40, 120, 300]))] for _ in range(n // 3)]
    passage = [r.choice(words) for _ in range(70)]
    out = []
    for i in range(n):
        t = list(r.choice(base))
        kind = r.random()
        if kind < 0.5 and t:
            for _ in range(r.randint(1, 3)):
                t[r.randrange(len(t))] = r.choice(words)
        elif kind < 0.6:
            t = t[: r.randint(0, 25)] + passage
        elif kind < 0.7:
            t = t + [r.choice(words) for _ in range(len(t) // r.randint(3, 9))]
        out.append(r.choice([" ", "\n", "\t "]).join(w.upper() if r.random() < 0.1 else w for w in t))
    return out


def brute_components(rows):
    sets = [shingle_strings(t or "") for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if inter and 100 * inter >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        k = find(i)
        if d is not None:
            least[k] = min(least.get(k, d), d)
    return sorted((-1 if d is None else d, len(s), -1 if (c := least.get(find(i))) is None else c) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def result(df):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in df.collect())


@pytest.mark.parametrize("seed,rare,hot,hand", [(1, 12, 64, 10**6), (2, 2, 3, 0), (3, 1, 2, 10**6), (4, 0, 2, 0)])
def test_components_as_brute_force(spark, monkeypatch, seed, rare, hot, hand):
    monkeypatch.setattr(ngram_join, "MEET", 3 if hand else 512)
    monkeypatch.setattr(ngram_join, "SPOKES", 2 if hand else 256)
    monkeypatch.setattr(ngram_join, "PAIRS", 7 if hand else 1000)
    monkeypatch.setattr(ngram_join, "RARE", rare)
    monkeypatch.setattr(ngram_join, "PACK", 3000 if hand else 2_000_000)
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", hand)
    monkeypatch.setattr(ngram_join, "FEW", 3 if hand else 16)
    monkeypatch.setattr(ngram_join, "HOT", hot)
    rows = [(i * 7 % 1009, t) for i, t in enumerate(made_texts(seed, 240))]
    rows += [(5000, None), (5001, ""), (5002, " \n\t"), (5003, rows[0][1]), (5003, rows[1][1]), (None, rows[2][1]), (5004, "x " * 30000), (5005, "one"), (5006, "One"), (5006, "one"), (5007, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(ngram_join.jaccard_components(df)) == brute_components(rows)


def test_a_group_of_near_copies_and_one_passage(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "RARE", 3)
    monkeypatch.setattr(ngram_join, "HOT", 4)
    monkeypatch.setattr(ngram_join, "FEW", 2)
    monkeypatch.setattr(ngram_join, "TILE", 5)
    r = random.Random(5)
    base = ["w%d" % r.randrange(500) for _ in range(200)]
    rows = []
    for i in range(120):  # a chain: far ends aren't linked, neighbours are
        t = list(base)
        for j in range(0, i, 2):
            t[j % 200] = "x%d" % j
        rows.append((i, " ".join(t)))
    passage = " ".join(base[:60])
    rows += [(1000 + i, passage + " " + " ".join("y%d" % r.randrange(10**6) for _ in range(r.randrange(5, 40)))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(ngram_join.jaccard_components(df)) == brute_components(rows)


def test_empty_table_and_clashing_names(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.jaccard_components(empty).collect() == []
    odd = spark.createDataFrame([(1, "a b c d e f", 1, 2, "x")], "doc_id long, text string, gid long, n long, fp string")
    assert result(ngram_join.jaccard_components(odd)) == [(1, 2, 1)]
    named = spark.createDataFrame([(1, "a b c d e f", 9, 9), (2, "a b c d e f", 9, 9)], "doc_id long, text string, n_shingles long, component_id long")
    assert result(ngram_join.jaccard_components(named)) == [(1, 2, 1), (2, 2, 1)]
    assert [tuple(r) for r in ngram_join.keep_smallest(named).collect()] == [(1, "a b c d e f", 9, 9)]


def test_shingle_hashes_as_tuples():
    texts = made_texts(9, 90) + ["", " ", "A b\x0bc d\x0ce  f", "é É é É é É", "a" * 5000, "a b c d e f"]
    for t, s in zip(texts, shingles.Shingler().sets(texts)):
        assert len(s) == len(shingle_strings(t)) and (np.diff(s.view(np.uint64)) > 0).all()
    one, two = shingles.Shingler().sets(["A B c D e f", "x a b C d E f"])
    assert len(np.intersect1d(one, two)) == 2


def test_bitmaps_rule_out_no_link():
    r = random.Random(4)
    texts = made_texts(4, 120) + ["q%d " % i * r.randrange(1, 9) for i in range(20)] + [" ".join("v%d" % r.randrange(3000) for _ in range(n)) for n in (900, 950, 1100, 2600)]
    texts += [t + " and a bit more" for t in texts]
    sets = [s for s in shingles.Shingler().sets(texts) if len(s)]
    ruled = linked = 0
    for a in sets:
        for b in sets:
            inter = len(np.intersect1d(a, b))
            link = 100 * inter >= 75 * (len(a) + len(b) - inter)
            may = ngram_join.may_link(len(a), len(b), ngram_join.parity(a), ngram_join.parity(b))
            assert may or not link
            ruled, linked = ruled + (not may), linked + link
    assert ruled > len(sets) ** 2 / 2 and linked > len(sets)


def test_components(spark):
    r = random.Random(3)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)] + [(7, 7)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    for f in (components, star_components):
        got = {x["node"]: x["comp"] for x in f(spark.createDataFrame(links, "a long, b long")).collect()}
        assert got == {n: find(n) for n in {x for a, b in links if a != b for x in (a, b)}}
        assert f(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_contained(docs, items):
    out = []
    for d, t in docs:
        have = shingle_strings(t or "")
        for k, x in items:
            want = shingle_strings(x or "")
            if want and len(want & have) >= 0.75 * len(want):
                out.append((d, k, len(want), len(want & have)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block,blocks", [(1_000_000, 8), (300, 10**6), (300, 0)])
def test_contained_items_as_brute_force(spark, monkeypatch, block, blocks):
    """In one block, in several, and joined."""
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", block)
    monkeypatch.setattr(decontamination, "BLOCKS", blocks)
    r = random.Random(8)
    items = [(i, t) for i, t in enumerate(made_texts(6, 30, 100000)) ] + [(100, "a b c d e"), (101, "short item"), (102, None), (103, ""), (104, "a b c d e")]
    docs = []
    for i in range(150):
        t = ["z%d" % r.randrange(10**6) for _ in range(r.choice([0, 5, 50, 3000]))]
        for _ in range(r.randrange(3)):
            x = (r.choice(items)[1] or "").split()
            if r.random() < 0.5 and len(x) > 10:
                x = x[: int(len(x) * r.choice([0.6, 0.74, 0.76, 0.9]))]
            at = r.randrange(len(t) + 1)
            t[at:at] = x
        docs.append((i, " ".join(t)))
    docs += [(200, None), (201, ""), (None, "q a b c d e f"), (202, "short item"), (202, "Short\nITEM")]
    got = decontamination.find_contained(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(((x["doc_id"], x["item_id"], x["n_item"], x["n_shared"]) for x in got.collect()), key=str) == brute_contained(docs, items)
    clean = decontamination.remove_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((x["doc_id"] for x in clean.collect()), key=str) == sorted((d for d, t in docs if not brute_contained([(d, t)], items)), key=str)


def test_empty_benchmark_or_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string")
    assert decontamination.find_contained(docs, none).collect() == []
    assert decontamination.find_contained(docs.where("false"), spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")).collect() == []


@pytest.mark.parametrize("blocks", [8, 0])
def test_string_ids_long_texts_and_clashing_names(spark, monkeypatch, blocks):
    """op3: items with ids of any type, in blocks or joined; a text of a million words; columns named like outputs."""
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 20)
    monkeypatch.setattr(decontamination, "BLOCKS", blocks)
    items = spark.createDataFrame([("x", "a b c d e f g h", 1), ("x", "a b c d e f g h", 2), (None, "q r s t u v", 3), ("y", "k l m n o p", 4)], "item_id string, text string, n_item int").repartition(2)
    long = " ".join(f"v{i}" for i in range(500_000)) + " K L m N o p " + " ".join(f"u{i}" for i in range(500_000))
    docs = spark.createDataFrame([("d", "0 a b c d e f g h 1", 7), (None, "q r s t u v", 7), ("e", long, 7), ("e", "a b", 7)], "doc_id string, text string, n_shared int").withColumn("_key", F.lit(1)).withColumn("_bad", F.lit(2))
    got = decontamination.find_contained(docs, items)
    assert got.columns == ["doc_id", "item_id", "n_item", "n_shared", "containment"]
    assert sorted(((r["doc_id"], r["item_id"], r["n_item"], r["n_shared"]) for r in got.collect()), key=str) == [("d", "x", 4, 4), ("d", "x", 4, 4), ("e", "y", 2, 2), (None, None, 2, 2)]
    kept = decontamination.remove_contaminated(docs, items)
    assert kept.columns == docs.columns and [r["text"] for r in kept.collect()] == ["a b"]
    numbers = items.selectExpr("cast(n_item as decimal(5,1)) as item_id", "text")
    assert sorted(str(r["item_id"]) for r in decontamination.find_contained(docs, numbers).collect()) == ["1.0", "2.0", "3.0", "4.0"]


def test_signatures_miss_nothing():
    """op3: of any set that holds an item's share, a signature that isn't cut has a hash; it is a quarter of the item or so."""
    r = np.random.default_rng(1)
    for n in [*range(1, 62), 100, 400, 5000]:
        item = np.sort(r.integers(0, 2**63, n).astype(np.uint64))
        sig = decontamination.signature(item)
        assert len(sig) <= max(decontamination.EXACT, min(decontamination.SIGNATURE, n // 4 + 1))
        block = decontamination.ItemBlock([0], [""], [item])
        for _ in range(40):
            held = np.sort(r.choice(item, decontamination.required(n), replace=False))
            assert block.held(held) == [0]
            assert block.held(np.sort(np.concatenate([held, r.integers(0, 2**63, 3000).astype(np.uint64)]))) == [0]
        if n > 20:
            assert block.held(np.sort(r.choice(item, decontamination.required(n) - 1, replace=False))) == []


@pytest.mark.parametrize("count", [200, 20_000])
def test_share_of_hashes_that_is_searched(count):
    """op3: what part of a document's hashes is looked up among items of the benchmark's sizes follows from the sizes, not from
    how many items there are; those without a cut are few."""
    r = np.random.default_rng(2)
    items = [np.sort(r.integers(0, 2**63, int(n)).astype(np.uint64) * np.uint64(2)) for n in r.integers(10, 56, count)]
    block = decontamination.ItemBlock(list(range(count)), [""] * count, items)
    cut = {b: float(decontamination.cut_of(b)) / 2**64 for b in (4, 5, 6)}
    assert 0.64 > cut[4] > cut[5] > cut[6] and cut[5] < 0.52 and cut[6] < 0.43
    assert {float(p.highest) / 2**64 for p in block.parts} <= {*cut.values(), 1.0}
    without = [i for i, x in enumerate(items) if not decontamination.has_cut(x)]
    assert len(without) < 0.05 * count
    for i in [*without[:20], *range(0, count, count // 40)]:
        held = np.sort(r.choice(items[i], decontamination.required(len(items[i])), replace=False))
        assert i in block.held(np.sort(np.concatenate([held, r.integers(0, 2**63, 500).astype(np.uint64)])))


@pytest.mark.parametrize("name", ["op3_decontamination", "op9_ngram_join"])
def test_query_and_sql(spark, name):
    data = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    got = queries.queries()[name](spark, data).toPandas()
    want = c.execute(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert sorted(map(tuple, got[columns].values.tolist())) == sorted(map(tuple, want[columns].values.tolist()))
