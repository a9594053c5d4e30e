"""Connected components: by union and find where the links are few, else by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import cut


#: Links that one task can hold (some 100 bytes each); beyond, no task holds them all.
AT_HAND = 500_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while (up := root.setdefault(i, i)) != i:
            root[i] = root[up]
            i = root[i]
        return i

    for b in batches:
        for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(n) for n in nodes], pa.int64())], ["node", "comp"])


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``links`` (columns a, b): comp is the smallest node that can be reached. Up to
    AT_HAND links go to one task; more are handled by :func:`star_components`."""
    links = links.select("a", "b").where("a <> b")
    if links.limit(AT_HAND + 1).count() <= AT_HAND:
        return links.coalesce(1).mapInArrow(_joined, "node long, comp long")
    return star_components(links)


def star_components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``links`` (columns a, b): comp is the smallest node that can be reached.

    Each round turns every node's neighbours towards its smallest one; the number of rounds grows with the logarithm of
    the longest path. Only minima are grouped, map-side first; a node with very many links is split by adaptive joins.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if now == state or not now["n"]:
            break
        state = now
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = cut(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).distinct())
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("comp"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(roots)
