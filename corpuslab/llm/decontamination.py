"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

An item's signature are the smallest hashes of its shingles (a bottom sketch). A document that holds an item's share
lacks at most ``n - ceil(0.75 n)`` of its shingles, so of the smallest one more than that it has at least one: with such
a signature nothing is missed. It is cut at SIGNATURE hashes, which only items of over 60 shingles reach; there all 16
would have to lie in the quarter that is missing, for which the chance is below 0.25 ** 16.

Items are partitioned by size. How far down the range of hashes signatures of a size reach follows from the size alone, up to
chance: a partition has a cut that some 97 of 100 signatures lie below, however many items there are, and only
documents that are large enough are searched for them, each by its hashes below the cut. The few items whose signature ends
above it, and those of up to EXACT shingles, which have too few hashes to choose from, are one more partition without a
cut: a small table in which all hashes of a document are looked up.

A benchmark of up to BLOCKS blocks of words goes along with the documents, block by block. Of a larger one the signatures make a
Bloom filter, by which one pass tells the documents' hashes that may be theirs; these are joined with the signatures,
and only texts of candidates travel to be verified.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from corpuslab.llm.common import batch, cut, id_and_text, keep_rows, map_batches, unused
from corpuslab.llm.shingles import Shingler, shingle_strings
from corpuslab.operators.overlap_filter import bit_array, passes

#: Share of an item's shingles that a document must hold.
THRESHOLD = 0.75
#: Hashes of a signature, at most.
SIGNATURE = 16
#: Items of so many shingles are searched by all of them.
EXACT = 4
#: Benchmark words that one pass over the documents looks for, and passes; a larger benchmark is joined.
BLOCK_WORDS, BLOCKS = 1_000_000, 8


def required(n: int) -> int:
    """Shingles of an item of ``n`` that a document must hold."""
    return max(1, int(np.ceil(THRESHOLD * n)))


def signature(item: np.ndarray) -> np.ndarray:
    """The smallest of an item's ascending hashes, so many that a document with its share has one of them."""
    n = len(item)
    return item if n <= EXACT else item[: min(SIGNATURE, n - required(n) + 1)]


@lru_cache
def cut_of(bits: int) -> np.uint64:
    """What signatures of items of so many bits in their size rarely end above: for each size the mean of the last hash and
    two standard deviations, the most of the partition's sizes. Beyond 64 shingles a signature has 16 hashes, and the smallest size decides."""
    n = np.arange(2 ** (bits - 1), min(2**bits, 2 ** (bits - 1) + 64))
    last = np.array([min(SIGNATURE, int(k) - required(int(k)) + 1) for k in n]) / (n + 1)
    top = float((last + 2 * np.sqrt(last * (1 - last) / (n + 2))).max())
    return np.uint64(min(2**64 - 1, int(top * 2.0**64)))


def has_cut(item: np.ndarray) -> bool:
    """Whether an item (ascending hashes) is in a partition with a cut."""
    return len(item) > EXACT and signature(item)[-1] <= cut_of(len(item).bit_length())


@dataclass
class SizePartition:
    """Items with the same number of bits in their size, or those without a cut: ascending hashes of signatures, the item of
    each, and what a document must have to hold any: ``least`` shingles, some of them up to ``highest``."""

    hashes: np.ndarray
    items: np.ndarray
    least: int
    highest: np.uint64

    def candidates(self, doc: np.ndarray) -> np.ndarray:
        """Items of which a document (its ascending hashes) has a hash of the signature, perhaps more than once."""
        if len(doc) < self.least:
            return self.items[:0]
        low = doc[: np.searchsorted(doc, self.highest, side="right")]
        if not len(low):
            return self.items[:0]
        if len(low) < len(self.hashes):
            first, last = np.searchsorted(self.hashes, low), np.searchsorted(self.hashes, low, side="right")
            hit = np.flatnonzero(last > first)
            return np.concatenate([self.items[a:b] for a, b in zip(first[hit], last[hit], strict=True)]) if len(hit) else self.items[:0]
        at = np.minimum(np.searchsorted(low, self.hashes), len(low) - 1)
        return self.items[low[at] == self.hashes]


@dataclass
class ItemBlock:
    """Items of one block: ids, texts and shingle sets, with an index for each partition of sizes."""

    ids: list[object]
    texts: list[str]
    sets: list[np.ndarray]
    parts: list[SizePartition] = field(default_factory=list)

    def __post_init__(self) -> None:
        by_size: dict[int, list[int]] = {}
        for i, s in enumerate(self.sets):
            if len(s):
                by_size.setdefault(len(s).bit_length() if has_cut(s) else 0, []).append(i)
        for bits, members in by_size.items():
            values = [signature(self.sets[i]) for i in members]
            flat = np.concatenate(values)
            order = np.argsort(flat, kind="stable")
            items = np.repeat(np.array(members), [len(v) for v in values])[order]
            self.parts.append(SizePartition(flat[order], items, min(required(len(self.sets[i])) for i in members), cut_of(bits) if bits else np.uint64(2**64 - 1)))

    def held(self, doc: np.ndarray) -> list[int]:
        """Items of which a document has the share, by hashes."""
        near = [p.candidates(doc) for p in self.parts]
        out = []
        for c in np.unique(np.concatenate(near)).tolist() if near else []:
            s = self.sets[c]
            at = np.minimum(np.searchsorted(doc, s), len(doc) - 1)
            if np.count_nonzero(doc[at] == s) >= THRESHOLD * len(s):
                out.append(c)
        return out


def find_contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs (doc_id, item_id, n_item, n_shared, containment) where a document holds THRESHOLD of an item's shingles.

    Shingles are runs of five words, A-Z as a-z; an item with fewer words is one shingle of all of them, which only a
    text of just these words holds. Null and empty texts hold nothing and are held by nothing. Ids of either table may be of
    any type, null or repeat: each pair of rows counts. Either table may be empty. Texts may be of any length. Columns other
    than ids and texts (``n_item``, say) are left out.

    The benchmark goes along with the function in blocks of BLOCK_WORDS words (a single longer item is a block), each of
    which takes one pass over the documents; the driver holds one block at a time. There is no shuffle of documents, and
    the size of a document's text or the number of its copies leads to no larger task. A benchmark of more than BLOCKS blocks
    is joined (:func:`contained_texts`), with the same result. Candidates are verified word by word.
    """
    kind = items.schema[item_id].dataType
    if words_of(items, item_id, item_text) > BLOCKS * BLOCK_WORDS:
        named = cut(id_and_text(items, item_id, item_text).withColumn("_item", F.monotonically_increasing_id()))
        rows = id_and_text(docs, id_col, text_col)
        held = contained_texts(rows, named)
        own = _possible_texts(rows, held.select("key").distinct()).select("doc_id", "key")
        pairs = own.join(held, "key").join(named.select("_item", F.col("doc_id").alias("item_id")), "_item")
        return pairs.select("doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))
    out, blocks = None, item_blocks(items, item_id, item_text)
    for block, last in blocks:
        found = _search(docs, block, id_col, text_col, kind)
        if not last or out is not None:
            found = cut(found)  # the block is dropped before the next comes
        out = found if out is None else out.unionByName(found)
    return out


BLANKS = "[\\x20\\x09-\\x0D]+"


def words_of(items: DataFrame, item_id: str, item_text: str) -> int:
    """About how many words the benchmark has."""
    return id_and_text(items, item_id, item_text).agg(F.sum(F.size(F.split("text", BLANKS)).cast("long"))).first()[0] or 0


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with ``key``, a digest of their text: equal texts are searched and verified once."""
    return rows.withColumn("key", F.unhex(F.sha2("text", 256)))


def _possible_texts(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc_id, text, key): the rows whose key may be among ``keys``, told by a Bloom filter while they are read."""
    first = F.xxhash64("key")
    bits = bit_array(keys.select(first.alias("h")))
    keyed = _keyed(rows).withColumn("_h", first)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ok = passes(b.column("_h").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), bits)
        return b.select(["doc_id", "text", "key"]).filter(pa.array(ok))

    return map_batches(keyed, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string, key binary", lambda: run)


def contained_texts(rows: DataFrame, items: DataFrame) -> DataFrame:
    """(key, _item, n_item, n_shared): the texts (by key) that hold an item; rows have doc_id and text, items _item and text.

    For benchmarks of any size: the signatures' hashes make a Bloom filter, the hashes of documents that pass are joined with
    the signatures, and the texts of candidates alone travel, each once but for joins with its items."""

    def signed(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = Shingler().sets(b.column("text").to_pylist())
        parts = [signature(s) if len(s) else s for s in sets]
        sizes = np.array([len(x) for x in parts], np.int64)
        return batch(h=(np.concatenate(parts).view(np.int64) if parts else [], pa.int64()), _item=(np.repeat(b.column("_item").to_numpy(), sizes), pa.int64()), least=(np.repeat([required(len(s)) if len(s) else 0 for s in sets], sizes), pa.int64()))

    signatures = cut(map_batches(items, "h long, _item long, least long", lambda: signed))
    bits = bit_array(signatures)

    def make():
        shingler = Shingler()

        def hits(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            texts = b.column("text").to_pylist()
            for i in range(0, len(texts), 512):
                sets = shingler.sets(texts[i : i + 512])
                found = [s[passes(s, bits)] for s in sets]
                sizes = np.array([len(x) for x in found], np.int64)
                yield batch(key=(b.column("key").slice(i, 512).take(pa.array(np.repeat(np.arange(len(sets)), sizes))), None), h=(np.concatenate(found).view(np.int64), pa.int64()), n=(np.repeat([len(s) for s in sets], sizes), pa.int64()))

        return hits

    seen = map_batches(_keyed(rows).select("key", "text"), "key binary, h long, n long", make).distinct()
    near = cut(seen.join(signatures, "h").where(F.col("n") >= F.col("least")).select("key", "_item").distinct())
    texts = _possible_texts(rows, near.select("key").distinct()).groupBy("key").agg(F.max("text").alias("text"))
    pairs = near.join(items.select("_item", F.col("text").alias("item")), "_item").join(texts, "key")

    def verify():
        last: list[object] = [None, set()]

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            n, shared = [], []
            for key, item, text in zip(*(b.column(c).to_pylist() for c in ("key", "item", "text")), strict=True):
                if last[0] != key:  # a text's pairs lie together
                    last[:] = key, shingle_strings(text)
                own = shingle_strings(item)
                n.append(len(own))
                shared.append(len(own & last[1]))
            ok = [s >= THRESHOLD * k for s, k in zip(shared, n, strict=True)]
            return batch(key=(b.column("key"), None), _item=(b.column("_item"), None), n_item=(n, pa.int64()), n_shared=(shared, pa.int64())).filter(pa.array(ok, pa.bool_()))

        return run

    return cut(map_batches(pairs, "key binary, _item long, n_item long, n_shared long", verify))


def item_blocks(items: DataFrame, item_id: str, item_text: str) -> Iterator[tuple[ItemBlock, bool]]:
    """The benchmark, read block by block, and whether a block is the last; an empty one is one block without items.

    Blocks are ranges of a running sum of words over the rows as they lie, so ids don't matter.
    """
    rows = id_and_text(items, item_id, item_text)
    sizes = rows.withColumn("_n", F.size(F.split("text", BLANKS)).cast("long"))
    if words_of(items, item_id, item_text) <= BLOCK_WORDS:
        yield _block_of(rows), True
        return
    placed = cut(sizes.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sums = placed.groupBy(part.alias("_part")).agg(F.sum("_n").alias("_sum"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_part", F.coalesce(F.sum("_sum").over(before.orderBy("_part")), F.lit(0)).alias("_offset"))
    run = F.coalesce(F.sum("_n").over(before.partitionBy("_part").orderBy("_at")), F.lit(0))
    numbered = placed.withColumn("_part", part).withColumn("_run", run).join(offsets, "_part")
    numbered = cut(numbered.select("doc_id", "text", F.floor((F.col("_run") + F.col("_offset")) / BLOCK_WORDS).alias("_block")))
    names = sorted(r[0] for r in numbered.select("_block").distinct().collect())
    for name in names:
        yield _block_of(numbered.where(F.col("_block") == name)), name == names[-1]


def _block_of(rows: DataFrame) -> ItemBlock:
    got = [(r["doc_id"], r["text"]) for r in rows.collect()]
    return ItemBlock([i for i, _ in got], [t for _, t in got], Shingler().sets([t for _, t in got]))


def _searcher(block: ItemBlock) -> Callable[[list[str]], list[list[tuple[int, int, int]]]]:
    """A function from texts to (number of the item, its shingles, those found) of the items that each holds."""
    shingler = Shingler()

    def search(texts: list[str]) -> list[list[tuple[int, int, int]]]:
        out: list[list[tuple[int, int, int]]] = []
        for text, doc in zip(texts, shingler.sets(texts), strict=True):
            near = block.held(doc) if len(doc) else []
            own = shingle_strings(text) if near else set()
            words = [(c, shingle_strings(block.texts[c])) for c in near]
            held = [(c, len(w), len(w & own)) for c, w in words]
            out.append([x for x in held if x[2] >= THRESHOLD * x[1]])
        return out

    return search


def _search(docs: DataFrame, block: ItemBlock, id_col: str, text_col: str, item_type: DataType) -> DataFrame:
    rows = id_and_text(docs, id_col, text_col)

    def make():
        search = _searcher(block)

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = b.column("text").to_pylist()
            found = [(i + k, *x) for i in range(0, len(texts), 512) for k, held in enumerate(search(texts[i : i + 512])) for x in held]
            return batch(
                doc_id=(b.column("doc_id").take(pa.array([x[0] for x in found], pa.int64())), None),
                item_id=([block.ids[x[1]] for x in found], to_arrow_type(item_type)),
                n_item=([x[2] for x in found], pa.int64()),
                n_shared=([x[3] for x in found], pa.int64()),
                containment=([x[3] / x[2] for x in found], pa.float64()),
            )

        return run

    return map_batches(rows, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id {item_type.simpleString()}, n_item long, n_shared long, containment double", make)


def remove_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item. There is no shuffle; between the blocks of a benchmark of more
    than one, what is kept is written, so that the driver holds one block at a time. With more than BLOCKS, only rows whose
    text may hold an item, by a Bloom filter, meet the texts that do."""
    if words_of(items, item_id, item_text) > BLOCKS * BLOCK_WORDS:
        named = cut(id_and_text(items, item_id, item_text).withColumn("_item", F.monotonically_increasing_id()))
        texts = docs.select(F.lit(0).alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
        bad = contained_texts(texts, named).select("key").distinct()
        bits, key, h, other = bit_array(bad.select(F.xxhash64("key").alias("h"))), unused(docs, "_key"), unused(docs, "_hash"), unused(docs, "_bad")
        keyed = docs.withColumn(key, F.unhex(F.sha2(F.coalesce(docs[text_col], F.lit("")), 256))).withColumn(h, F.xxhash64(key))

        def split(may: bool):
            def run(b: pa.RecordBatch) -> pa.RecordBatch:
                return b.filter(pa.array(passes(b.column(b.schema.get_field_index(h)).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), bits) == may))

            return map_batches(keyed, keyed.schema, lambda: run)

        kept = split(True).join(bad.withColumnRenamed("key", other), F.col(key) == F.col(other), "left_anti")
        return split(False).unionByName(kept).drop(key, h)
    for block, last in item_blocks(items, item_id, item_text):

        def make(block: ItemBlock = block):
            search = _searcher(block)
            return lambda texts: [not held for held in search(texts)]

        docs = keep_rows(docs, text_col, make)
        docs = docs if last else cut(docs)
    return docs
