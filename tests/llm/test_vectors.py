"""Whitening and hard negatives against brute force in Python integers."""

from fractions import Fraction
from math import floor, isfinite

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuslab.llm import common, hard_negatives, queries, vectors, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, component int, n string"


def whole(rows, id_at=0, vec_at=1):
    """(row, integer vector) of rows that take part."""
    return [(r, [floor(256 * float(c)) for c in r[vec_at]]) for r in rows if r[vec_at] is not None and all(c is not None and isfinite(c) for c in r[vec_at])]


def check_whitening(got, rows):
    own = whole(rows)
    dims = max(len(x) for _, x in own)
    own = [(r, x + [0] * (dims - len(x))) for r, x in own]
    fit = sorted({tuple(x) for _, x in own})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    cov = np.array([[float(Fraction(sum(n * (n * a[i] - sums[i]) * (n * a[j] - sums[j]) for a in fit), n**4)) for j in range(dims)] for i in range(dims)])
    values, columns = np.linalg.eigh(cov)
    m = min(4, int((values > values[-1] * dims * 2**-52).sum()))
    assert len(got) == m * len(own)
    want = {}
    for r, x in own:
        want.setdefault((r[0], sum((n * a - s) ** 2 for a, s in zip(x, sums))), []).append([(a - s / n) for a, s in zip(x, sums)])
    for c in range(1, m + 1):
        u, e = columns[:, -c], values[-c]
        mine = [g for g in got if g["component"] == c]
        assert {g["n"] for g in mine} == {n} and all(abs(g["explained"] / (e / np.trace(cov)) - 1) < 1e-9 for g in mine)
        signs = set()
        for g in mine:
            near = [float(np.dot(y, u) / np.sqrt(e)) for y in want[g["vec_id"], g["deviation"]]]
            signs.add(min((min(abs(g["whitened"] - s * v) for v in near), s) for s in (1, -1))[1] if abs(near[0]) > 1e-6 else 0)
            assert min(abs(abs(g["whitened"]) - abs(v)) for v in near) < 1e-6
        assert len(signs - {0}) <= 1
    assert all(0 <= g["identity_error"] < 1e-9 for g in got)


def odd_rows(n=60, dims=6, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(v)) for v in rng.normal(size=dims) * np.arange(1, dims + 1)], int(i % 3), 1, "x") for i in range(n)]
    rows += rows[:7] + [(None, rows[9][1], 2, 1, "x"), (500, None, 1, 1, "x"), (501, [1.0, None], 1, 1, "x"), (502, [float("nan")] * dims, 1, 1, "x"), (503, [float("inf"), 1.0], 1, 1, "x")]
    rows += [(504, [1.0, -2.0], None, 1, "x"), (505, [], 1, 1, "x"), (506, [0.5] * (dims + 2), 1, 1, "x")] + [(600 + i, rows[0][1], 0, 1, "x") for i in range(40)]
    return rows


def test_whitening(spark):
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    check_whitening(whitening.whiten(df).collect(), rows)
    assert whitening.whiten(df.where("false")).collect() == []
    assert whitening.whiten(df.where("vec_id >= 500 and vec_id < 504")).collect() == []
    assert whitening.whiten(df.where("vec_id >= 600")).collect() == []  # a single vector has no direction
    two = whitening.whiten(df.where("vec_id < 2")).collect()
    assert {r["component"] for r in two} == {1} and {round(abs(r["whitened"]), 9) for r in two} == {1.0}


def test_whitening_of_the_table(spark):
    df = common.as_table(spark, "/root/testdata/sf0.01", "embeddings")
    rows = [tuple(r) for r in df.collect()]
    check_whitening(queries.op13_whitening(spark, "/root/testdata/sf0.01").collect(), rows)


def test_scatter_is_exact_beyond_doubles(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(-vectors.MOST, vectors.MOST, size=(40, 3))
    x[0] = vectors.MOST
    df = spark.createDataFrame([(b,) for b in vectors.pack(x)], "x binary").repartition(3)
    primes = whitening.primes_below(whitening.PRIMES, 2 * 40 * vectors.MOST**2 + 1)
    one = np.concatenate([np.ones((40, 1), object), x.astype(object)], axis=1)
    assert (whitening.scatter(df, 3, primes) == one.T @ one).all()
    model = whitening.fit(df)
    assert model.deviations(x) == [None] * 40
    small = whitening.Whitening(10**9, (5 * 10**9, -(10**9)), np.ones(1), np.ones((2, 1)), np.ones(1))
    assert small.deviations(np.array([[5, 1], [7, -1]])) == [4 * 10**18, 4 * 10**18] and small.deviations(np.array([[90, 1]])) == [None]
    assert whitening.whiten(spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x[:6])], "vec_id long, embedding array<double>")).count() == 18


def test_packed_vectors():
    x = np.array([[0, 0, 0], [1, 0, 0], [127, -128, 0], [128, 0, -1], [2**40, 0, 0], [-(2**31), 1, 2]])
    packed = vectors.pack(x)
    assert (vectors.unpack(packed, 3) == x).all() and vectors.pack(np.pad(x, ((0, 0), (0, 2)))) == packed
    assert [p[0] for p in packed] == [1, 1, 1, 2, 8, 4]


@pytest.mark.parametrize("entries", [1, 8, 10**6])
def test_rows_in_bounded_matrices(monkeypatch, entries):
    monkeypatch.setattr(vectors, "ENTRIES", entries)
    data = [[1.0, 2.0], None, [0.5, None], [float("nan")], [], [-0.001, 0.0, 0.0], [1e300, -1e300], [3.0, 4.0]]
    got = {int(i): x[k].tolist() for at, x in vectors.integer_rows(pa.array(data, pa.list_(pa.float64())).slice(0)) for k, i in enumerate(at)}
    assert {i: x[: len(data[i])] for i, x in got.items()} == {0: [256, 512], 4: [], 5: [-1, 0, 0], 6: [vectors.MOST, -vectors.MOST], 7: [768, 1024]}
    later = {int(i) for at, _ in vectors.integer_rows(pa.array(data, pa.list_(pa.float64())).slice(3, 3)) for i in at}
    assert later == {1, 2}


def plain_negatives(rows, is_anchor, positives=5, negatives=5):
    """op11 by loops over Python integers."""
    own = [(r[0], r[2], x) for r, x in whole(rows) if r[2] is not None]
    dot = lambda x, y: sum(a * b for a, b in zip(x, y))
    order = lambda p: (-p[0], p[1] is None, p[1] or 0)
    out = []
    for i, (a, label, x) in enumerate(own):
        if a is None or not is_anchor(a):
            continue
        scored = [(dot(x, y), b, l) for j, (b, l, y) in enumerate(own) if i != j]
        for ps, p, _ in sorted((s for s in scored if s[2] == label), key=order)[:positives]:
            fit = sorted((s for s in scored if s[2] != label and 80 * ps <= 100 * s[0] <= 100 * ps), key=order)
            out += [(a, p, k + 1, s[1], ps, s[0]) for k, s in enumerate(fit[:negatives])]
    return sorted(out, key=str)


def mined(df, **kw):
    return sorted(map(tuple, hard_negatives.mine(df, F.col("vec_id") % 10 == 0, **kw).collect()), key=str)


def near_rows(n=400, seed=1, scale=1.0):
    """Vectors around few centres, with copies, equal scores, odd ids and odd vectors."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 5))
    rows = [(i, [float(np.float32(v * scale)) for v in centres[i % 6] + rng.normal(size=5) * 0.2], int(rng.integers(4)), 1, "x") for i in range(n)]
    rows += [(1000 + i, rows[3][1], i % 3, 1, "x") for i in range(150)]  # a vector of many rows
    rows += rows[:12] + [(None, rows[3][1], 1, 1, "x"), (None, rows[3][1], 2, 1, "x"), (2000, rows[4][1], None, 1, "x"), (2010, None, 1, 1, "x"), (2020, [1.0, None], 1, 1, "x"), (2030, [float("inf")] * 5, 1, 1, "x")]
    return rows + [(2040, [1.0], 1, 1, "x"), (2050, [], 1, 1, "x"), (2060, rows[5][1] + [2.0], 1, 1, "x"), (-10, rows[6][1], -3, 1, "x"), (2070, [float(-v) for v in rows[7][1]], 2, 1, "x")]


def test_hard_negatives(spark, monkeypatch):
    rows = near_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = plain_negatives(rows, lambda i: i % 10 == 0)
    assert len(want) > 500 and mined(df) == want
    assert mined(df, positives=2, negatives=3) == plain_negatives(rows, lambda i: i % 10 == 0, 2, 3)
    for name, value in (("SHARD", 13), ("BLOCK", 7), ("CHUNK", 25), ("FIRST", 4), ("LISTS", 5)):  # many shards, blocks, chunks; first scores of a part
        monkeypatch.setattr(hard_negatives, name, value)
    assert mined(df) == want
    for none in (df.where("false"), df.where("vec_id = 1"), df.where("vec_id = 2010"), df.where("vec_id = 0"), df.where("vec_id = 2050")):
        assert mined(none) == []


@pytest.mark.parametrize("scale", [30.0, 1e4, 1e6])
def test_hard_negatives_of_long_vectors(spark, scale):
    """Inner products beyond whole numbers of floats, and of doubles."""
    rows = near_rows(120, 2, scale)
    longest = max(sum(v * v for v in x) ** 0.5 for _, x in whole(rows))
    assert (longest**2 >= 2**53) == (scale == 1e6) and longest < hard_negatives.LONGEST
    got = mined(spark.createDataFrame([*rows, (3000, [1e9, 1.0], 1, 1, "x")], SCHEMA))
    assert got == plain_negatives(rows, lambda i: i % 10 == 0) and got


def test_lists_are_skipped():
    """The search visits few lists where clusters are far apart, and finds what a full one finds."""
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(16, 8)) * 400
    x = np.floor(centres[np.arange(1600) % 16] + rng.normal(size=(1600, 8)) * 4).astype(np.int64)
    c = hard_negatives.centroids(x, 16)
    assert sorted(np.round(c).sum(axis=1)) == pytest.approx(sorted(centres.sum(axis=1)), abs=25) or len(c) == 16
    labels, none = np.arange(1600) % 3, np.zeros(1600, bool)
    shard = next(hard_negatives.shards_of(hard_negatives._shard(0, c, np.arange(1600), none, labels, none, x)))
    q = np.arange(0, 1600, 40)
    at = np.argsort(shard.ids)
    own = hard_negatives.Queries(np.zeros(len(q), np.int64), at[q], q, labels[q], x[q], np.full((len(q), 1), -(2**62)), np.full((len(q), 1), 2**62))
    search = hard_negatives.Search(own, own.low, c, 5, True, float(np.sqrt((x * x).sum(axis=1)).max()))
    visited = []
    plain = search._list
    search._list = lambda s, k, block, a, *more: (visited.append(len(a)), plain(s, k, block, a, *more))
    search.visit(shard)
    assert sum(visited) < 0.5 * len(q) * len(c)
    got = {}
    for b in search.found():
        for i, s, j in zip(b.column("query").to_pylist(), b.column("score").to_pylist(), b.column("id").to_pylist()):
            got.setdefault(i, []).append((s, j))
    for i, a in enumerate(q):
        scores = x @ x[a]
        want = sorted(((int(scores[j]), j) for j in range(1600) if labels[j] == labels[a] and j != a), key=lambda p: (-p[0], p[1]))[:5]
        assert sorted(got[i], key=lambda p: (-p[0], p[1])) == want


def test_hard_negatives_query_and_sql(spark):
    for data in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        c = duckdb.connect()
        c.execute(f"create view embeddings as select * from '{data}/embeddings.parquet'")
        want = c.execute(queries.OP11_SQL).fetchall()
        assert sorted(map(tuple, queries.op11_hard_negatives(spark, data).collect())) == sorted(want)
