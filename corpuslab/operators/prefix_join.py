"""Names and the keys that they begin with, by ranges of the order of texts.

Whatever lies between a key and a name that begins with it in the order of texts begins with the key too. So of the keys up to a
name the last is met by binary search, and those that the name begins with are that key, if it is one, and the keys that it
begins with in turn: each key knows the longest other one that it begins with. The order is parted into ranges, and a range
needs, beside its own keys, only those that its lower end begins with. Texts are compared by code points.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names in a range, about; names that ends of ranges are chosen from, for each range; characters of an end.
RANGE, TRIED, END = 100_000, 40, 64


def longest_inner(keys: list[str]) -> list[int]:
    """For each of the sorted keys the place of the longest other key that it begins with, or -1."""
    out, open_ = [], []
    for i, k in enumerate(keys):
        while open_ and not k.startswith(keys[open_[-1]]):
            open_.pop()
        out.append(open_[-1] if open_ else -1)
        open_.append(i)
    return out


def ends_of(names: DataFrame, name: str, ranges: int, n: int) -> list[str]:
    """Where ranges begin, but for the first, from a sample of the ``n`` names; a name of very many rows is several ends."""
    tried = ranges * TRIED
    some = names.sample(fraction=min(1.0, 1.2 * tried / max(n, 1)), seed=1).select(F.substring(name, 1, END).alias("e")).limit(2 * tried)
    found = sorted(r["e"] for r in some.collect())
    return [found[len(found) * i // ranges] for i in range(1, ranges)] if found else []


def ranges_of_name(ends: list[str], name: str) -> range:
    """The ranges that may hold a name: one, or those that begin with an end that its first characters are."""
    first, last = bisect_left(ends, name[:END]), bisect_right(ends, name[:END])
    return range(first + 1, last + 1) if last > first else range(last, last + 1)


def ranges_of_key(ends: list[str], key: str) -> list[int]:
    """The ranges that need a key: those that may hold it as a name, and those whose lower end begins with it."""
    out = set(ranges_of_name(ends, key))
    at = bisect_left(ends, key)
    while at < len(ends) and ends[at].startswith(key):
        out.add(at + 1)
        at += 1
    return sorted(out | {bisect_right(ends, key)})


def beginnings(names: DataFrame, name: str, keys: DataFrame, key: str, ranges: int | None = None) -> DataFrame:
    """``names`` with each of the ``keys`` (a column of that name, every key once) that the name begins with, a row for each.

    Null names and keys begin nothing; the empty key begins every name. Names travel once, and a key to its range and to those
    whose lower end begins with it; a name that is several ends is dealt to all of their ranges, and its keys go to each.
    A range holds about ``RANGE`` names."""
    rows = names.where(F.col(name).isNotNull())
    n = rows.count()
    ranges = ranges or max(1, -(-n // RANGE))
    ends = ends_of(rows, name, ranges, n)
    fields = list(rows.schema.fields)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for b in batches:
            at = []
            for t in b.column(b.schema.get_field_index(name)).to_pylist():
                own = ranges_of_name(ends, t)
                at.append(own[turn % len(own)])
                turn += 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32())], names=[*b.schema.names, "_range"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [ranges_of_key(ends, k) for k in b.column(0).to_pylist()]
            of = [i for i, own in enumerate(at) for _ in own]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int64())), pa.array([r for own in at for r in own], pa.int32())], names=["_key", "_range"])

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        own = sorted(right.column("_key").to_pylist())
        inner = longest_inner(own)
        row, found = [], []
        for i, t in enumerate(left.column(name).to_pylist()):
            at = bisect_right(own, t) - 1
            while at >= 0 and not t.startswith(own[at]):
                at = inner[at]
            while at >= 0:
                row.append(i)
                found.append(own[at])
                at = inner[at]
        out = left.drop_columns(["_range"]).take(pa.array(row, pa.int64()))
        return out.append_column(key, pa.array(found, pa.string()))

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    names_dealt = rows.mapInArrow(dealt, f"{columns}, _range int")
    keys_spread = keys.select(F.col(key).alias("_key")).where("_key is not null").distinct().mapInArrow(spread, "_key string, _range int")
    return names_dealt.groupBy("_range").cogroup(keys_spread.groupBy("_range")).applyInArrow(met, f"{columns}, `{key}` string")
