"""Which windows of texts may be among those of a smaller set, told by a Bloom filter while the texts are read.

The set's windows set bits of one array, which tasks make in parts that are joined by a bitwise or. It goes along with the
function that reads the texts: windows are hashed in numpy, and only those whose bits are all set leave it, as text, for
an exact join. A miss is never a member, so nothing is lost however full the array is; it only lets more through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each window, how many of them a window sets, and the largest array (64 MB).
BITS_EACH, HASHES, MOST_BITS = 16, 4, 1 << 29
#: Words that are hashed together; a longer text is hashed alone.
TOGETHER = 500_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Windows:
    """Runs of ``width`` pieces of a text that is split at ``pattern``, joined by ``sep``."""

    pattern: str = "[ \n]"
    width: int = 8
    sep: str = " "

    def pieces(self, text: str) -> list[str]:
        return re.split(self.pattern, text)


LINES = Windows("\n", 1, "\n")


def window_hashes(pieces: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` pieces."""
    own = pd.util.hash_array(pieces, categorize=True)
    n = max(0, len(own) - width + 1)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out = out * _STEP + own[j : j + n]
    return out ^ (out >> np.uint64(29))


def _bits(hashes: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Places of the bits of hashes in an array of ``size`` bits, a power of two."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    for k in range(HASHES):
        yield ((hashes + np.uint64(k) * step) * _STEP >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)


def _hashed(texts: list[str | None], kind: Windows) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(pieces, text of each window, where it begins, hash) of some texts at a time; no window crosses a text."""
    at = 0
    while at < len(texts):
        parts: list[list[str]] = []
        n = 0
        while at < len(texts) and (not parts or n < TOGETHER):
            parts.append(kind.pieces(texts[at]) if texts[at] is not None else [])
            n += len(parts[-1])
            at += 1
        sizes = np.array([len(p) for p in parts], np.int64)
        pieces = np.array([x for p in parts for x in p], object)
        if len(pieces) < kind.width:
            continue
        hashes = window_hashes(pieces, kind.width)
        owner = np.repeat(np.arange(len(parts)), sizes)
        begin = np.arange(len(hashes))
        whole = owner[begin] == owner[begin + kind.width - 1]
        yield pieces, owner[begin[whole]] + at - len(parts), begin[whole], hashes[whole]


def bit_array(hashes: DataFrame, name: str = "h") -> np.ndarray:
    """The bit array (64 bits a word) of a column of 64-bit hashes; its size follows their number up to ``MOST_BITS``."""
    n = hashes.count()
    size = 64
    while size < min(MOST_BITS, BITS_EACH * n):
        size *= 2

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(size // 64, np.uint64)
        for b in batches:
            for bit in _bits(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), size):
                np.bitwise_or.at(own, bit >> 6, np.uint64(1) << (bit & 63).astype(np.uint64))
        at = np.flatnonzero(own)
        for i in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 100_000]), pa.array(own[at[i : i + 100_000]].view(np.int64))], names=["word", "bits"])

    out = np.zeros(size // 64, np.uint64)
    for b in hashes.select(name).mapInArrow(made, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow().to_batches():
        out[b.column("word").to_numpy()] = b.column("bits").to_numpy().view(np.uint64)
    return out


def passes(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which hashes may be in a set, by its bit array."""
    out = np.ones(len(hashes), bool)
    for bit in _bits(hashes, 64 * len(bits)):
        out &= (bits[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) > 0
    return out


def filter_of(texts: DataFrame, text: str, kind: Windows = Windows()) -> np.ndarray:
    """The bit array of the windows of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for *_, hashes in _hashed(b.column(0).to_pylist(), kind):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(hashes).view(np.int64))], names=["h"])

    return bit_array(texts.select(text).mapInArrow(run, "h long"))


def possible(rows: DataFrame, key: str, text: str, kind: Windows, bits: np.ndarray | None = None) -> DataFrame:
    """(key, window): the windows of each row's text, of a filter's set only those that may be in it. Null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pieces, owner, begin, hashes in _hashed(b.column(1).to_pylist(), kind):
                if bits is not None:
                    hit = passes(hashes, bits)
                    owner, begin = owner[hit], begin[hit]
                for i in range(0, len(begin), 10_000):
                    some = [kind.sep.join(pieces[k : k + kind.width]) for k in begin[i : i + 10_000].tolist()]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner[i : i + 10_000])), pa.array(some, pa.string())], names=[key, "window"])

    return rows.select(key, text).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, window string")


def hits(rows: DataFrame, key: str, probe: DataFrame, probe_key: str, kind: Windows = Windows(), text: str = "text") -> DataFrame:
    """(key, probe_key): which rows' texts share a window with which probe's, each pair once. Only windows that pass the
    probes' filter are shuffled; a window that very many rows hold is one row of each task before."""
    bits = filter_of(probe, text, kind)
    some = possible(rows, key, text, kind, bits).distinct()
    return some.join(possible(probe, probe_key, text, kind).distinct(), "window").select(key, probe_key).distinct()


def sharing(rows: DataFrame, key: str, probe: DataFrame, kind: Windows = Windows(), text: str = "text") -> DataFrame:
    """(key): the rows whose text shares a window with any probe's."""
    bits = filter_of(probe, text, kind)
    own = possible(probe.withColumn("_probe", F.lit(0)), "_probe", text, kind).select("window").distinct()
    return possible(rows, key, text, kind, bits).join(own, "window", "left_semi").select(key).distinct()
