"""Vectors as integers: which rows of a column of arrays take part, their components times 256, and a packed form."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A component is this many times the given one, rounded down; beyond +-MOST it counts as +-MOST.
TIMES = 256
MOST = 2**63 - 1024
#: Entries of a matrix that is made of rows at once; a single longer row makes one alone.
ENTRIES = 4_000_000


def integer_rows(vectors: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices, matrix) of the rows that take part, in order: those that aren't null and hold only finite numbers.
    Shorter rows of a matrix are filled with zeros."""
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    good = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False) & (bad[ends] == bad[ends - sizes]))
    at = 0
    while at < len(good):
        widest = np.maximum.accumulate(sizes[good[at:]])
        n = max(1, int((widest * np.arange(1, len(widest) + 1) <= ENTRIES).sum()))
        rows = good[at : at + n]
        width = int(sizes[rows].max())
        out = np.zeros((len(rows), width))
        there = np.arange(width) < sizes[rows][:, None]
        together = there.all() and len(rows) == rows[-1] - rows[0] + 1
        out[there] = flat[ends[rows[0]] - width : ends[rows[-1]]] if together else np.concatenate([flat[ends[r] - sizes[r] : ends[r]] for r in rows])
        with np.errstate(over="ignore"):
            out = np.floor(out * TIMES)
        yield rows, np.clip(out, -MOST, MOST).astype(np.int64)
        at += n


def pack(x: np.ndarray) -> list[bytes]:
    """A form that is the same for equal vectors, and for those that differ in zeros at the end: the bytes of a number
    (1, 2, 4 or 8), then the components without those zeros in so many bytes each."""
    size = np.full(len(x), 1, np.int64)
    if x.shape[1]:
        low, high = x.min(axis=1), x.max(axis=1)
        for w in (1, 2, 4):
            size[(low < -(2 ** (8 * w - 1))) | (high >= 2 ** (8 * w - 1))] = 2 * w
    length = (x.shape[1] - np.argmax(x[:, ::-1] != 0, axis=1)) * (x != 0).any(axis=1) if x.shape[1] else np.zeros(len(x), np.int64)
    out: list[bytes] = [b""] * len(x)
    for w in np.unique(size):
        of = np.flatnonzero(size == w)
        raw, row, head = x[of].astype(f"<i{w}").tobytes(), int(w) * x.shape[1], bytes([w])
        for k, i in enumerate(of):
            out[i] = head + raw[k * row : k * row + int(length[i]) * int(w)]
    return out


def unpack(packed: Sequence[bytes], dims: int) -> np.ndarray:
    """The vectors of :func:`pack`, filled with zeros up to ``dims``."""
    out = np.zeros((len(packed), dims), np.int64)
    kinds: dict[tuple[int, int], list[int]] = {}
    for i, b in enumerate(packed):
        kinds.setdefault((b[0], len(b)), []).append(i)
    for (w, size), of in kinds.items():
        n = (size - 1) // w
        if n:
            out[of, :n] = np.frombuffer(b"".join(packed[i][1:] for i in of), f"<i{w}").reshape(len(of), n)
    return out
