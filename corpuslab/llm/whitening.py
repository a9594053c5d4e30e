"""Whitening of embeddings: an exact scatter matrix by residues of several primes, then eigenvectors in doubles.

The scatter of integer vectors is the sum of their outer products. Modulo a prime below 2**22 a block of 1024 rows is one
matrix product in doubles without rounding, and sums of residues stay small, so each task gives one matrix of residues for
each prime. The matrices are summed by Spark; Chinese remaindering gives the integers, however large they are, and the
covariance is rounded once, when it becomes doubles.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import batch, cut, map_batches, one_thread, release
from corpuslab.llm.vectors import integer_rows, pack, unpack

#: Primes are below this; sums of BLOCK products of residues between -PRIMES / 2 and PRIMES / 2 are exact in doubles.
PRIMES, BLOCK = 2**22, 1024
#: Rows of a matrix of residues that travel as one.
STRIPE = 64
LONG = 2**63


def primes_below(limit: int, product: int) -> list[int]:
    """The largest primes below ``limit``, two at least, whose product is over ``product``."""
    out: list[int] = []
    whole, p = 1, limit - 1
    while len(out) < 2 or whole <= product:
        if all(p % k for k in range(2, int(p**0.5) + 1)):
            out.append(p)
            whole *= p
        p -= 1
    return out


def from_residues(residues: Sequence[np.ndarray], primes: Sequence[int]) -> np.ndarray:
    """The integers between -product / 2 and product / 2 with these residues, as Python integers."""
    whole = int(np.prod(np.array(primes, object)))
    total = sum(r.astype(object) * ((whole // p) * pow(whole // p, -1, p)) for r, p in zip(residues, primes, strict=True)) % whole
    return np.where(total > whole // 2, total - whole, total)


def _residues(packed: Iterator[pa.RecordBatch], dims: int, primes: Sequence[int]) -> list[np.ndarray]:
    """For each prime the residues of the scatter of (1, vector)."""
    sums = [np.zeros((dims + 1, dims + 1), np.int64) for _ in primes]
    for b in packed:
        for i in range(0, b.num_rows, BLOCK):
            x = unpack(b.column("x").slice(i, BLOCK).to_pylist(), dims)
            x = np.concatenate([np.ones((len(x), 1), np.int64), x], axis=1)
            for k, p in enumerate(primes):
                r = x % p
                r = np.where(r > p // 2, r - p, r).astype(np.float64)
                sums[k] = (sums[k] + (r.T @ r).astype(np.int64)) % p
    return sums


def scatter(vectors: DataFrame, dims: int, primes: Sequence[int]) -> np.ndarray:
    """The exact scatter of (1, vector) over the packed vectors of column x, as Python integers: the number of vectors, their
    sums, and their products. A task gives a stripe of residues at a time, and a stripe is summed where its key is dealt to."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, m in enumerate(_residues(batches, dims, primes)):
            for s in range(0, dims + 1, STRIPE):
                yield batch(prime=([k], pa.int32()), stripe=([s], pa.int32()), residues=([m[s : s + STRIPE].tobytes()], pa.binary()))
        release()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for k, s, r in zip(*(b.column(c).to_pylist() for c in ("prime", "stripe", "residues")), strict=True):
                sums[k, s] = (sums.get((k, s), 0) + np.frombuffer(r, np.int64)) % primes[k]
        for (k, s), r in sums.items():
            yield batch(prime=([k], pa.int32()), stripe=([s], pa.int32()), residues=([r.tobytes()], pa.binary()))

    schema = "prime int, stripe int, residues binary"
    stripes = len(primes) * (dims // STRIPE + 1)
    rows = vectors.select("x").mapInArrow(parts, schema).repartition(min(stripes, 256), "prime", "stripe").mapInArrow(summed, schema).collect()
    out = [np.zeros((dims + 1, dims + 1), np.int64) for _ in primes]
    for r in rows:
        m = np.frombuffer(bytes(r["residues"]), np.int64).reshape(-1, dims + 1)
        out[r["prime"]][r["stripe"] : r["stripe"] + len(m)] = m
    return from_residues(out, primes)


@dataclass(frozen=True)
class Whitening:
    """What the fit list gives: its size and sums as integers, eigenvalues in falling order and their vectors as columns."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray

    @property
    def dims(self) -> int:
        return len(self.sums)

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Rows of integer vectors, whitened."""
        mean = np.array([s / self.n for s in self.sums])
        return (x - mean) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """For each row the sum over dimensions of (n * x - sum) ** 2, exact; None beyond a long."""
        n, s = self.n, np.array(self.sums, object)
        top = max(int(np.abs(x).max(initial=0)), 1)
        widest = max([abs(v) for v in self.sums], default=0)
        if (n * top + widest) ** 2 * max(1, x.shape[1]) < LONG:
            d = n * x - s.astype(np.int64)
            return (d * d).sum(axis=1).tolist()
        own = x if top * max(top, widest) * max(1, x.shape[1]) < LONG else x.astype(object)
        squares, products = (own * own).sum(axis=1).tolist(), (own @ (s.astype(np.int64) if own is x else s)).tolist()
        whole = int((s * s).sum())
        return [v if v < LONG else None for v in (n * n * a - 2 * n * b + whole for a, b in zip(squares, products, strict=True))]


@one_thread()
def fit(vectors: DataFrame, components: int = 4) -> Whitening | None:
    """The whitening of the packed, distinct vectors of column x; None without vectors. Components whose eigenvalue is zero,
    up to the rounding of doubles, have no direction and are left out."""

    def extents(b: pa.RecordBatch) -> pa.RecordBatch:
        packed = b.column("x").to_pylist()
        dims = max((len(p) - 1) // p[0] for p in packed)
        tops = [int(np.abs(unpack(packed[i : i + BLOCK], dims)).max(initial=0)) for i in range(0, len(packed), BLOCK)]
        return batch(n=([b.num_rows], pa.int64()), dims=([dims], pa.int32()), top=([max(tops)], pa.int64()))

    found = map_batches(vectors, "n long, dims int, top long", lambda: extents).agg(F.sum("n").alias("n"), F.max("dims").alias("dims"), F.max("top").alias("top")).first()
    if not found["n"]:
        return None
    n, dims = found["n"], found["dims"]
    primes = primes_below(PRIMES, 2 * n * max(1, found["top"]) ** 2 + 1)
    whole = scatter(vectors, dims, primes)
    sums = tuple(int(v) for v in whole[0, 1:])
    if not dims or whole[0, 0] != n:
        return Whitening(n, sums, np.zeros(0), np.zeros((dims, 0)), np.zeros(0))
    s = whole[0, 1:]
    centred = n * whole[1:, 1:] - np.multiply.outer(s, s)
    covariance = (centred / (n * n)).astype(np.float64)
    values, columns = np.linalg.eigh(covariance)
    values, columns = values[::-1], columns[:, ::-1]
    keep = min(components, int((values > max(values[0], 0.0) * dims * np.finfo(float).eps).sum()))
    columns = columns[:, :keep] * np.sign(columns[np.abs(columns[:, :keep]).argmax(axis=0), np.arange(keep)])
    trace = sum(int(centred[i, i]) for i in range(dims)) / (n * n)
    return Whitening(n, sums, values[:keep], columns, values[:keep] / trace if trace else np.zeros(0))


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity, from the whitened doubles."""
    m = len(model.values)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((m + 1, m + 1))
        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                w = model.apply(unpack(b.column("x").slice(i, BLOCK).to_pylist(), model.dims))
                w = np.concatenate([np.ones((len(w), 1)), w], axis=1)
                total += w.T @ w
        yield batch(k=(np.arange((m + 1) ** 2), pa.int32()), v=(total.ravel(), pa.float64()))

    sums = {r["k"]: r["v"] for r in vectors.select("x").mapInArrow(moments, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()}
    total = np.array([sums[k] for k in range((m + 1) ** 2)]).reshape(m + 1, m + 1) / model.n
    mean = total[0, 1:]
    return float(np.abs(total[1:, 1:] - np.outer(mean, mean) - np.eye(m)).max(initial=0.0))


def packed_vectors(df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """(x): the packed vector of each row that takes part."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for _, x in integer_rows(b.column(0)):
            yield batch(x=(pack(x), pa.binary()))

    return map_batches(df.select(df[vec_col].alias("v")), "x binary", lambda: run)


def whiten(df: DataFrame, components: int = 4, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """For each row that takes part and each component: vec_id, component (from 1), n, deviation, whitened, explained,
    identity_error.

    Rows whose vector is null or holds a null, a NaN or an infinity are left out. Components are multiplied by 256 and
    rounded down (beyond a long they count as its ends). The fit list holds each vector once, however many rows have it;
    all rows are whitened, repeated ones and those with null or repeated ids too. A shorter vector counts as filled with
    zeros. There are as many components as the covariance has directions, ``components`` at most: none for an empty table,
    a single vector or empty vectors, and then no rows. ``deviation`` is exact, and null where a long can't hold it.
    Columns other than id and vector are left out.

    Vectors are grouped in a packed form of one to two bytes a dimension for usual embeddings, pre-aggregated map-side, so that
    a vector of very many rows is one row of each task. What is sent to the driver grows with the square of the dimensions
    only. The fit list is written to the checkpoint folder, for it is read three times.
    """
    rows = df.select(df[id_col].alias("vec_id"), df[vec_col].alias("v"))
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    vectors = cut(packed_vectors(df, vec_col).distinct())
    model = fit(vectors, components)
    if model is None or not len(model.values):
        return df.sparkSession.createDataFrame([], schema)
    error, m = identity_error(vectors, model), len(model.values)

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at, x in integer_rows(b.column("v")):
            for i in range(0, len(at), BLOCK):
                own = np.zeros((len(x[i : i + BLOCK]), model.dims), np.int64)
                width = min(model.dims, x.shape[1])
                own[:, :width] = x[i : i + BLOCK, :width]  # what lies beyond the longest vector of the fit list is zero
                n = len(own)
                yield batch(
                    vec_id=(b.column("vec_id").take(pa.array(np.repeat(at[i : i + BLOCK], m))), None), component=(np.tile(np.arange(1, m + 1), n), pa.int32()),
                    n=(np.full(n * m, model.n), pa.int64()), deviation=([v for v in model.deviations(own) for _ in range(m)], pa.int64()),
                    whitened=(model.apply(own).ravel(), pa.float64()), explained=(np.tile(model.explained, n), pa.float64()), identity_error=(np.full(n * m, error), pa.float64()),
                )

    return map_batches(rows, schema, lambda: run)
