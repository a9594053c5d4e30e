"""Hard negatives by an inverted file: k-means lists with radii, visited by an upper bound of what they can hold.

Rows are dealt at random into shards, and each shard is an inverted file of its own over the same centroids: its rows lie in
lists by nearest centroid, and each list has its radius, the largest distance of its rows from the centroid. For a query q
a row of a list has an inner product of at most q . centroid + |q| radius (Cauchy and Schwarz) and at least the same with a
minus. Lists are visited by falling upper bound; one that can't reach into the window of scores is skipped, and a query
stops when the bound falls strictly below its kth score, which it keeps from shard to shard. So results are exact.

Dealing at random parts large lists (a third of all rows may be one vector) and lets every task meet near rows early.
Queries go to the shards in chunks of bounded size, one pass over the index for the positives of a chunk and one for its
negatives; where there are many shards, a sample of them is searched first, and its kth scores are where the others begin.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.llm.common import batch, cut, map_batches, one_thread, release
from corpuslab.llm.vectors import integer_rows, pack, unpack

#: Rows that centroids are fitted on, at most twice as many; centroids; rounds of k-means.
SAMPLE, LISTS, ROUNDS = 16_384, 64, 8
#: Rows of a shard and queries of a chunk, at most, and entries of either's matrix.
SHARD, CHUNK, ENTRIES = 8192, 65_536, 4_000_000
#: Queries that a shard is searched for at once.
BLOCK = 4096
#: Of more shards than this, one in as many is searched first for scores to begin with.
FIRST = 32
#: Vectors as long as this take no part: inner products of shorter ones fit a long.
LONGEST = 2.0**31


def centroids(x: np.ndarray, k: int = LISTS, rounds: int = ROUNDS) -> np.ndarray:
    """k-means of the rows of ``x`` in doubles, at most k and as many as different rows; empty ones keep their place."""
    x = np.unique(x, axis=0).astype(np.float64)
    rng = np.random.default_rng(0)
    c = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))]
    for _ in range(rounds if len(x) > len(c) else 0):
        of = nearest(x, c)
        n = np.bincount(of, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, of, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    squares = (c * c).sum(axis=1)
    return np.concatenate([(squares - 2 * (x[i : i + BLOCK].astype(np.float64) @ c.T)).argmin(axis=1) for i in range(0, len(x), BLOCK)] or [np.zeros(0, np.int64)])


@dataclass
class Shard:
    """Rows by list, within a list by id (null ids last): list i holds rows starts[i] to starts[i + 1]."""

    number: int
    ids: np.ndarray
    null: np.ndarray
    labels: np.ndarray
    anchor: np.ndarray
    vectors: np.ndarray
    starts: np.ndarray
    radii: np.ndarray


SHARDS = "shard long, n int, width int, ids binary, null binary, labels binary, anchor binary, vectors binary, starts binary, radii binary"


def _shard(number: int, c: np.ndarray, ids: np.ndarray, null: np.ndarray, labels: np.ndarray, anchor: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    of = nearest(x, c)
    order = np.lexsort((ids, null, of))
    ids, null, labels, anchor, x, of = ids[order], null[order], labels[order], anchor[order], x[order], of[order]
    starts = np.searchsorted(of, np.arange(len(c) + 1))
    far = np.sqrt(((x - c[of]) ** 2).sum(axis=1))
    radii = np.array([far[a:b].max(initial=0.0) for a, b in zip(starts, starts[1:], strict=False)])
    top = int(np.abs(x).max(initial=0))
    width = next(w for w in (2, 4, 8) if top < 2 ** (8 * w - 1))
    raw = (ids.astype(np.int64), null.astype(np.int8), labels.astype(np.int64), anchor.astype(np.int8), x.astype(f"<i{width}"), starts.astype(np.int64), radii)
    named = dict(zip(("ids", "null", "labels", "anchor", "vectors", "starts", "radii"), ([r.tobytes()] for r in raw), strict=True))
    return batch(shard=([number], pa.int64()), n=([len(ids)], pa.int32()), width=([width], pa.int32()), **{k: (named[k], pa.binary()) for k in ("ids", "null", "labels", "anchor", "vectors", "starts", "radii")})


def shards_of(b: pa.RecordBatch) -> Iterator[Shard]:
    for r in range(b.num_rows):
        get = {c: b.column(c)[r].as_py() for c in b.schema.names}
        n = get["n"]
        yield Shard(
            get["shard"], np.frombuffer(get["ids"], np.int64), np.frombuffer(get["null"], np.int8) > 0, np.frombuffer(get["labels"], np.int64), np.frombuffer(get["anchor"], np.int8) > 0,
            np.frombuffer(get["vectors"], f"<i{get['width']}").reshape(n, -1), np.frombuffer(get["starts"], np.int64), np.frombuffer(get["radii"], np.float64),
        )


def index(rows: DataFrame, c: np.ndarray, dims: int, shards: int, size: int) -> DataFrame:
    """The shards of rows (id, label, anchor, x: packed vectors), one a row, in the checkpoint folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, n = (TaskContext.get().partitionId() << 24) - 1, [], 0
        for b in (*batches, None):
            for i in range(0, b.num_rows if b is not None else 0, size):
                held.append(b.slice(i, size))
                n += held[-1].num_rows
            while n >= size or (b is None and n):
                t = pa.Table.from_batches(held).combine_chunks()
                own, rest = t.slice(0, size), t.slice(size)
                held, n, number = rest.to_batches(), rest.num_rows, number + 1
                ids = own.column("id")
                x = unpack(own.column("x").to_pylist(), dims)
                yield _shard(number, c, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(), own.column("label").to_numpy(), own.column("anchor").to_numpy(), x)
        release()

    return cut(rows.repartition(shards).mapInArrow(run, SHARDS))


@dataclass(frozen=True)
class Queries:
    """A chunk of anchors: where they lie (shard, place), their ids, labels and vectors; for each the windows that are asked
    for (low, high, both inclusive; low over high: closed) and the scores to begin with."""

    shard: np.ndarray
    place: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def __len__(self) -> int:
        return len(self.ids)


class Best:
    """The best k rows of each window of a block of queries so far: by falling score, then by id, null ids last."""

    def __init__(self, floor: np.ndarray, k: int, kind: type, least: float):
        self.k, self.least, self.floor = k, least, floor
        shape = (*floor.shape, k)
        self.score = np.full(shape, least, kind)
        self.id, self.null = np.zeros(shape, np.int64), np.zeros(shape, bool)

    def kth(self, q: np.ndarray | slice) -> np.ndarray:
        return np.maximum(self.floor[q], self.score[q, :, -1])

    def add(self, q: np.ndarray, w: int, s: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        """Scores of the rows of a list (columns, in order of id) for some queries; those that don't count are ``least``."""
        k, t = self.k, np.maximum(self.floor[q, w], self.score[q, w, -1])
        over = s > t[:, None]
        many = np.flatnonzero(over.sum(axis=1) > k)
        if len(many):
            t[many] = np.partition(s[many], s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        some = np.flatnonzero((s >= np.maximum(t, self._above_least())[:, None]).any(axis=1))
        if not len(some):
            return
        s, t, q = s[some], t[some], q[some]
        same = s == t[:, None]
        keep = ((s > t[:, None]) | (same & (np.cumsum(same, axis=1) <= k))) & (s > self.least)
        a, b = np.nonzero(keep)
        old = np.nonzero(self.score[q, w] > self.least)
        a = np.concatenate([a, old[0]])
        score = np.concatenate([s[keep], self.score[q, w][old]])
        id_ = np.concatenate([ids[b], self.id[q, w][old]])
        none = np.concatenate([null[b], self.null[q, w][old]])
        order = np.lexsort((id_, none, -score, a))
        a, score, id_, none = a[order], score[order], id_[order], none[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        first = rank < k
        a, rank = a[first], rank[first]
        self.score[q, w] = self.least
        self.score[q[a], w, rank], self.id[q[a], w, rank], self.null[q[a], w, rank] = score[first], id_[first], none[first]

    def _above_least(self):
        return np.nextafter(np.float32(self.least), np.float32(0)) if np.issubdtype(self.score.dtype, np.floating) else self.least + 1


class Search:
    """The best k rows of the index for each window of a chunk of queries, of the query's label or of the others."""

    def __init__(self, queries: Queries, floor: np.ndarray, c: np.ndarray, k: int, same: bool, longest: float):
        # Inner products are below the square of the longest vector, so whole numbers of this kind hold them and all sums on the way.
        self.kind = np.float32 if longest**2 < 2**24 else np.float64 if longest**2 < 2**53 else np.int64
        self.least = -np.inf if self.kind is not np.int64 else np.iinfo(np.int64).min
        self.q, self.c, self.same, self.k = queries, c, same, k
        most = np.inf if self.kind is not np.int64 else np.iinfo(np.int64).max
        bound = 2**62

        def limit(x: np.ndarray) -> np.ndarray:
            return np.where(x >= bound, most, np.where(x <= -bound, self.least, x.astype(np.float64) if self.kind is not np.int64 else x)).astype(self.kind)

        self.low, self.high = limit(queries.low), limit(queries.high)
        self.x = queries.vectors.astype(self.kind)
        self.best = [Best(np.maximum(limit(floor)[i : i + BLOCK], self.low[i : i + BLOCK]), k, self.kind, self.least) for i in range(0, len(queries), BLOCK)]
        dots = queries.vectors.astype(np.float64) @ c.T
        length = np.sqrt((queries.vectors.astype(np.float64) ** 2).sum(axis=1))
        self.dots, self.length, self.c_length = dots, length, np.sqrt((c * c).sum(axis=1))

    def visit(self, shard: Shard) -> None:
        for i, best in enumerate(self.best):
            self._block(shard, slice(i * BLOCK, min((i + 1) * BLOCK, len(self.q))), best)

    def _block(self, shard: Shard, at: slice, best: Best) -> None:
        q = self.q
        reach = self.length[at, None] * shard.radii
        slack = 1e-9 * (self.length[at, None] * self.c_length + reach) + 1e-6
        upper, lower = self.dots[at] + reach + slack, self.dots[at] - reach - slack
        filled = np.flatnonzero(np.diff(shard.starts))
        order = filled[np.argsort(-upper[:, filled], axis=1)]
        low, high = self.low[at], self.high[at]
        here = np.flatnonzero(q.shard[at] == shard.number)
        own = dict(zip(here.tolist(), q.place[at][here].tolist(), strict=True))
        done, width = 0, 1
        while done < len(filled):
            visits = order[:, done : done + width]
            done, width = done + width, 2 * width
            kth = best.kth(slice(None))
            for c in np.unique(visits):
                a = np.flatnonzero((visits == c).any(axis=1))
                # of lists in falling order of bounds, once one is below the kth score the later ones are
                can = (upper[a, c, None] >= kth[a]) & (lower[a, c, None] <= high[a]) & (low[a] <= high[a])
                open_ = can.any(axis=1)
                a, can = a[open_], can[open_]
                if len(a):
                    self._list(shard, int(c), at, a, can, best, low, high, own)

    def _list(self, shard: Shard, c: int, at: slice, a: np.ndarray, can: np.ndarray, best: Best, low: np.ndarray, high: np.ndarray, own: dict[int, int]) -> None:
        lo, hi = int(shard.starts[c]), int(shard.starts[c + 1])
        s = self.x[at][a] @ shard.vectors[lo:hi].astype(self.kind).T
        counts = (self.q.labels[at][a][:, None] == shard.labels[lo:hi]) == self.same
        if self.same and own:
            for i in np.flatnonzero(np.isin(a, list(own))):
                if lo <= own[int(a[i])] < hi:
                    counts[i, own[int(a[i])] - lo] = False
        s = np.where(counts, s, self.kind(self.least))
        for w in range(low.shape[1]):
            r = np.flatnonzero(can[:, w])
            if len(r):
                inside = s[r]
                inside = np.where((inside >= low[a[r], w, None]) & (inside <= high[a[r], w, None]), inside, self.kind(self.least))
                best.add(a[r], w, inside, shard.ids[lo:hi], shard.null[lo:hi])

    def found(self) -> Iterator[pa.RecordBatch]:
        """(query, w, score, id): the place of the query in its chunk, its window."""
        for i, best in enumerate(self.best):
            a, w, k = np.nonzero(best.score > best.least)
            if len(a):
                yield batch(query=(a + i * BLOCK, pa.int32()), w=(w, pa.int32()), score=(best.score[a, w, k].astype(np.int64), pa.int64()), id=(pa.array(best.id[a, w, k], pa.int64(), mask=best.null[a, w, k]), None))


FOUND = "query int, w int, score long, id long"


def search(shards: DataFrame, queries: Queries, floor: np.ndarray, c: np.ndarray, k: int, same: bool, longest: float) -> DataFrame:
    """(query, w, score, id, rank): the first k rows of ``shards`` for each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = Search(queries, floor, c, k, same, longest)
        for b in batches:
            for shard in shards_of(b):
                one.visit(shard)
        yield from one.found()
        del one
        release()

    each = Window.partitionBy("query", "w").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    tasks = max(1, 2 * shards.sparkSession.sparkContext.defaultParallelism)
    return shards.coalesce(tasks).mapInArrow(run, FOUND).withColumn("rank", F.row_number().over(each)).where(F.col("rank") <= k)


def begun(shards: DataFrame, count: int, queries: Queries, c: np.ndarray, k: int, same: bool, longest: float) -> np.ndarray:
    """Scores that the kth row of each window has at least: those of a part of many shards, else none."""
    floor = np.full(queries.low.shape, -(2**62), np.int64)
    if count > FIRST:
        part = shards.where(F.pmod(F.xxhash64("shard"), F.lit(FIRST)) == 0)
        for b in search(part, queries, floor, c, k, same, longest).where(F.col("rank") == k).select("query", "w", "score").toArrow().to_batches():
            floor[b.column("query").to_numpy(), b.column("w").to_numpy()] = b.column("score").to_numpy()
    return floor


def anchors(shards: DataFrame, chunk: int, chunks: int) -> Queries:
    """The anchors of a chunk, with no window yet."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for s in shards_of(b):
            at = np.flatnonzero(s.anchor)
            if len(at):
                yield batch(shard=(np.full(len(at), s.number), pa.int64()), place=(at, pa.int32()), id=(pa.array(s.ids[at], pa.int64(), mask=s.null[at]), None), label=(s.labels[at], pa.int64()), x=(pack(s.vectors[at].astype(np.int64)), pa.binary()), dims=(np.full(len(at), s.vectors.shape[1]), pa.int32()))

    rows = map_batches(shards, "shard long, place int, id long, label long, x binary, dims int", lambda: run)
    t = rows.where(F.pmod(F.xxhash64("shard", "place"), F.lit(chunks)) == chunk).toArrow()
    x = unpack(t.column("x").to_pylist(), t.column("dims")[0].as_py() if t.num_rows else 0)
    none = np.zeros((t.num_rows, 0), np.int64)
    ids = np.array(t.column("id").to_pylist(), object)
    return Queries(t.column("shard").to_numpy(), t.column("place").to_numpy(), ids, t.column("label").to_numpy(), x, none, none)


def _chunk(shards: DataFrame, count: int, own: Queries, c: np.ndarray, positives: int, negatives: int, low: int, high: int, longest: float) -> DataFrame:
    """The result for a chunk of anchors."""
    everything = replace(own, low=np.full((len(own), 1), -(2**62), np.int64), high=np.full((len(own), 1), 2**62, np.int64))
    near = search(shards, everything, begun(shards, count, everything, c, positives, True, longest), c, positives, True, longest)
    scores, ids = np.zeros((len(own), positives), np.int64), np.full((len(own), positives), None, object)
    there = np.zeros((len(own), positives), bool)
    for b in near.select("query", "rank", "score", "id").toArrow().to_batches():
        at = b.column("query").to_numpy(), b.column("rank").to_numpy() - 1
        scores[at], ids[at], there[at] = b.column("score").to_numpy(), b.column("id").to_pylist(), True
    # shares of a score, rounded up and down; products could be beyond a long
    whole = scores.astype(object)
    windows = replace(own, low=np.where(there, -(-whole * low // 100), 2**62).astype(np.int64), high=np.where(there, whole * high // 100, -(2**62)).astype(np.int64))
    found = search(shards, windows, begun(shards, count, windows, c, negatives, False, longest), c, negatives, False, longest)

    def named(b: pa.RecordBatch) -> pa.RecordBatch:
        q, w = b.column("query").to_numpy(), b.column("w").to_numpy()
        return batch(anchor_id=(own.ids[q].tolist(), pa.int64()), positive_id=(ids[q, w].tolist(), pa.int64()), rank=(b.column("rank"), None), negative_id=(b.column("id"), None), positive_score=(scores[q, w], pa.int64()), negative_score=(b.column("score"), None))

    return map_batches(found, RESULT, lambda: named)


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


@one_thread()
def mine(df: DataFrame, anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row for which ``anchor`` holds and each
    of its ``positives`` best other rows of its label the ``negatives`` best rows of other labels whose score lies between
    ``low`` and ``high`` hundredths of the positive's.

    A row's score is its inner product with the anchor, of components times 256 rounded down; of equal scores the smaller
    id comes first, null ids last. A positive score below zero leaves no window, as 0.8 of it is the larger end.

    Rows with a null label or vector, or a null, a NaN or an infinity in it, take no part, and neither do those as long as
    2 ** 31 (8,388,608 before the factor), whose products no long holds. Shorter vectors count as filled with zeros. Repeated
    rows are rows of their own, also as anchors; what tells them apart isn't given out, so their results repeat. Ids may be null, and
    such a row is a positive or negative like others. An empty table, or one without anchors, gives no rows; columns other
    than id, vector and label are left out, whatever they are called.

    Centroids are fitted on a random sample of some 16,384 rows (twice as many at most); they decide what is skipped, not
    what is found. What the driver holds is that sample and a chunk of anchors with their positives, of bounded size; there are
    two passes over the packed index for each chunk (four, if there are many shards).
    """
    rows = df.select(df[id_col].cast("long").alias("id"), (label if label is not None else df[label_col]).cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), df[vec_col].alias("v")).where("label is not null")

    def packed(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at, x in integer_rows(b.column("v")):
            length = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
            ok = length < LONGEST
            at, x, length = pa.array(at[ok]), x[ok], length[ok]
            yield batch(id=(b.column("id").take(at), None), label=(b.column("label").take(at), None), anchor=(b.column("anchor").take(at), None), x=(pack(x), pa.binary()), dims=(np.full(len(x), x.shape[1]), pa.int32()), length=(length, pa.float64()))

    schema = "id long, label long, anchor boolean, x binary, dims int, length double"
    taking = map_batches(rows, schema, lambda: packed)
    seen = taking.agg(F.count("*").alias("n"), F.count_if("anchor").alias("anchors"), F.max("dims").alias("dims"), F.max("length").alias("longest")).first()
    spark, n = df.sparkSession, seen["n"]
    if not seen["anchors"]:
        return spark.createDataFrame([], RESULT)
    dims = max(1, seen["dims"])
    wanted = max(1, min(SAMPLE, ENTRIES // dims))
    sample = map_batches(rows.sample(fraction=min(1.0, wanted / n), seed=1), schema, lambda: packed).select("x").limit(2 * wanted).toArrow()
    fitted = centroids(unpack(sample.column("x").to_pylist(), dims)) if sample.num_rows else np.zeros((1, dims))
    size = max(1, min(SHARD, ENTRIES // dims))
    count = -(-n // size)
    shards = index(taking.drop("dims", "length"), fitted, dims, count, size)
    chunks = -(-seen["anchors"] // max(1, min(CHUNK, ENTRIES // dims)))
    longest = seen["longest"] * (1 + 1e-9) + 1

    def one(k: int) -> DataFrame:
        return _chunk(shards, count, anchors(shards, k, chunks), fitted, positives, negatives, low, high, longest)

    return one(0) if chunks == 1 else reduce(DataFrame.unionByName, [cut(one(k)) for k in range(chunks)])
