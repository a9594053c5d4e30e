"""Jaccard self-join of documents on word 5-grams by token-combination prefixes.

Shingles ("tokens") are put into one global order: those of one document first, then rare ones by hash, then frequent
ones by how frequent they are. A document that loses at most ``slack = n - ceil(0.75 n)`` tokens to a partner indexes a
prefix of its tokens. Rare tokens are indexed alone; those of one document needn't be. Frequent ones belong to one of ``g`` classes and are indexed as pairs within a class,
so a common passage gives no posting that all its documents share unless they share two of its tokens there; the
prefix is extended until its rare tokens, and its frequent ones less one for each class met, are ``slack + 1``.

Why no link is lost: of the two prefixes let P end first in the order. At least ``|P| - slack`` of its tokens are in the
partner, and so in the partner's prefix. They are more than the classes met in P, so they hold a rare token or, by the
pigeonhole principle, two frequent ones of one class: a signature that both index. Classes depend on the size by levels
a factor of 4/3 apart; linked sizes differ by that at most, and each document indexes for its own level and the next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import cut, id_and_text, map_batches, release, unused
from corpuslab.llm.components import components
from corpuslab.llm.shingles import Shingler, mix

#: Documents link when PERCENT of their union is shared.
PERCENT = 75
#: A token is frequent in more documents than this.
RARE = 12
#: Documents of fewer tokens than this index single tokens only.
SHORT = 16
#: Postings of one signature that a map task sends on as they are; of more it sends one, and links the others to it.
HOT = 64
#: In postings, numbers of documents have above this bit what share of its tokens a document has alone (127: all), and
#: below it the number: sorted, what stands for others comes first, and that is a document that has least alone.
OWN = 54
PLAIN = (1 << OWN) - 1
#: Tokens that one range of hashes holds, about, and those that a map task packs together.
RANGE, PACK = 1_000_000, 1_000_000
#: Members of components that are joined to documents as rows; of more, so many by so many at a time are compared.
FEW, TILE = 16, 2048
#: Tasks to which a list is dealt, and documents of a list and a level of size that meet its components in one tile.
SALTS, MEET = 16, 128
#: Of a document's lists so many, those of the smallest names, are at hand to tell where a pair has met already.
SKETCH = 8
#: Pairs of one document that are verified together, and pairs of a bucket, about.
SPOKES, PAIRS = 32, 50
#: Documents whose ids are broadcast to fetch their texts, at most; more are joined by shuffle.
BROADCAST_IDS = 400_000


def slack(n: int) -> int:
    """Tokens of a document of ``n`` that a linked one may lack."""
    return n - -(-PERCENT * n // 100)


@lru_cache(1)
def _levels() -> np.ndarray:
    """Smallest size of each level: powers of 4/3, rounded up exactly."""
    return np.array([-(-(4**k) // 3**k) for k in range(120)], np.int64)


def pack(a: np.ndarray) -> bytes:
    """Integers as bytes by significance, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes())


def unpack(b: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).reshape(-1)


def pack_sorted(a: np.ndarray) -> bytes:
    return pack(np.diff(a, prepend=a.dtype.type(0)))


def unpack_sorted(b: bytes, kind: str) -> np.ndarray:
    return np.cumsum(unpack(b, kind), dtype=kind)


def parity(tokens: np.ndarray) -> bytes:
    """A bitmap with, for each residue of the hashes, whether an odd number of tokens has it; a bit a token or more."""
    bits = max(256, 1 << max(0, len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_link(na: int, nb: int, a: bytes, b: bytes) -> bool:
    """False where bitmaps rule a link out: each bit that differs is a token that only one of the two has."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) > len(y):
        x, y = y, x
    if len(x) < len(y):  # a larger bitmap folds into a smaller one
        y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), 0)
    apart = int(np.bitwise_count(x ^ y).sum())
    shared = (na + nb - apart) // 2
    return 100 * shared >= PERCENT * (na + nb - shared)


def _texts(z) -> list[str]:
    d = zstandard.ZstdDecompressor()
    return [d.decompress(x).decode() for x in z.to_pylist()]


def fingerprints(rows: DataFrame) -> DataFrame:
    """(doc_id, th, n, fp, bits): a hash of the text, the size of its set, a digest of the set (null where it is empty),
    its parity bitmap."""

    def make():
        shingler = Shingler()

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            texts, n, fp, bits = b.column("text").to_pylist(), [], [], []
            for i in range(0, len(texts), 512):
                for s in shingler.sets(texts[i : i + 512]):
                    n.append(len(s))
                    fp.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    bits.append(parity(s) if len(s) else None)
            return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(bits, pa.binary())], ["doc_id", "th", "n", "fp", "bits"])

        return run

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, f"doc_id {kind}, th long, n long, fp binary, bits binary", make)


def compressed(rows: DataFrame) -> DataFrame:
    """(doc_id, th, z): texts compressed before they travel."""

    def make():
        c = zstandard.ZstdCompressor(level=1)

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array([c.compress(t.encode()) for t in b.column("text").to_pylist()], pa.binary())], ["_id", "_th", "z"])

        return run

    return map_batches(rows, f"_id {rows.schema['doc_id'].dataType.simpleString()}, _th long, z binary", make)


def distinct_sets(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """(gid, chunk, n, fp, bits, z): one document for each different set; ``gid >> 33`` names the part it lies in, and
    ``chunk`` numbers the stretches of a part that hold PACK tokens or so, in the order in which it is written and read."""
    first = seen.where("fp is not null").groupBy("fp").agg(F.min(F.struct("doc_id", "th")).alias("d"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    first = first.select("fp", "n", "bits", F.col("d.doc_id").alias("doc_id"), F.col("d.th").alias("th")).hint("shuffle_hash")
    z = compressed(rows)
    met = z.join(first, z["_id"].eqNullSafe(first["doc_id"]) & (z["_th"] == first["th"])).select("n", "fp", "bits", "z")
    most = PACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = 0, 0
        for b in batches:
            chunks = []
            for n in b.column("n").to_pylist():
                if held >= most:
                    chunk, held = chunk + 1, 0
                chunks.append(chunk)
                held += n
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int32()), *b.columns], ["chunk", *b.schema.names])
        release()

    numbered = met.mapInArrow(run, "chunk int, n long, fp binary, bits binary, z binary")
    return cut(numbered.select(F.monotonically_increasing_id().alias("gid"), "*"))


# --- how frequent tokens are ------------------------------------------------------------------------------------


def _ranges(a: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds of the ranges in ascending hashes, and the 32 bits that tell apart those of a range (up to chance)."""
    r = (a >> np.uint64(64 - bits)).astype(np.int64)
    v = ((a >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    bounds = np.searchsorted(r, np.arange((1 << bits) + 1))
    return r, v, bounds


def token_codes(sets: DataFrame, bits: int) -> DataFrame:
    """(part, chunk, r, codes): for the ascending tokens of each chunk in each range how many documents have them, packed:
    0 for one, 1 for up to RARE, else the logarithm. All tokens are counted. A map task counts a chunk of its own first;
    a range of hashes then holds RANGE tokens or so, whatever their number in all. What comes back is a bit or two a
    token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()

        def packed(part: int, chunk: int, held: list[np.ndarray]) -> pa.RecordBatch:
            a, counts = np.unique(np.concatenate(held), return_counts=True)
            _, v, bounds = _ranges(a, bits)
            some = np.flatnonzero(np.diff(bounds)).tolist()
            vs = [pack_sorted(v[bounds[r] : bounds[r + 1]]) for r in some]
            ns = [pack(counts[bounds[r] : bounds[r + 1]].astype(np.uint32)) for r in some]
            k = len(some)
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([part] * k, pa.int64()), pa.array([chunk] * k, pa.int32()), pa.array(vs, pa.binary()), pa.array(ns, pa.binary())], ["r", "part", "chunk", "v", "n"])

        place, held = (0, 0), []
        for b in batches:
            places, z = list(zip(b.column("part").to_pylist(), b.column("chunk").to_pylist(), strict=True)), b.column("z")
            for i in range(0, len(places), 256):
                for now, s in zip(places[i : i + 256], shingler.sets(_texts(z.slice(i, 256))), strict=True):
                    if held and now != place:
                        yield packed(*place, held)
                        held = []
                    place = now
                    held.append(s)
        if held:
            yield packed(*place, held)
        del held
        release()

    def total(t: pa.Table) -> pa.Table:
        values = [unpack_sorted(x, "<u4") for x in t.column("v").to_pylist()]
        counts = [unpack(x, "<u4") for x in t.column("n").to_pylist()]
        flat, n = np.concatenate(values), np.concatenate(counts)
        order = np.argsort(flat, kind="stable")
        start = np.flatnonzero(np.concatenate([[True], np.diff(flat[order]) != 0]))
        sums = np.add.reduceat(n[order].astype(np.int64), start)
        code = np.where(sums == 1, 0, np.where(sums <= RARE, 1, np.maximum(2, np.log2(sums)))).astype(np.uint8)
        back = np.empty(len(flat), np.uint8)
        back[order] = np.repeat(code, np.diff(np.append(start, len(flat))))
        ends = np.cumsum([len(v) for v in values])
        codes = [pack(back[e - len(v) : e]) for v, e in zip(values, ends, strict=True)]
        del values, counts, flat, n, order, start, sums, code, back
        release()
        return pa.table({"part": t.column("part"), "chunk": t.column("chunk"), "r": t.column("r"), "codes": pa.array(codes, pa.binary())})

    counted = sets.select("part", "chunk", "z").mapInArrow(run, "r int, part long, chunk int, v binary, n binary")
    return counted.groupBy("r").applyInArrow(total, "part long, chunk int, r int, codes binary")


# --- signatures -------------------------------------------------------------------------------------------------


def signatures(tokens: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Signatures of a document: ascending token hashes with their codes. Tokens that no other document has come first in
    the order and are part of the prefix, but need no index."""
    n = len(tokens)
    need = slack(n) + 1 - int((codes == 0).sum())
    if need <= 0:
        return np.zeros(0, np.uint64)
    rare = tokens[codes == 1]
    if len(rare) >= need:
        return rare[:need]
    often = np.flatnonzero(codes > 1)
    often = tokens[often[np.argsort(codes[often], kind="stable")]]
    levels = _levels()
    level = int(np.searchsorted(levels, n, side="right")) - 1
    out = [rare]
    for at in (level, level + 1):
        least = int(levels[at])
        if least < SHORT:
            out.append(often[: need - len(rare)])
            continue
        cls = mix(often + np.uint64(at)) % np.uint64(max(1, least // 4))
        new = np.zeros(len(often), bool)
        new[np.unique(cls, return_index=True)[1]] = True
        end = int(np.searchsorted(len(rare) + np.cumsum(~new), need)) + 1
        order = np.argsort(cls[:end], kind="stable")
        c, t = cls[:end][order], often[:end][order]
        for gap in range(1, len(c)):
            same = np.flatnonzero(c[gap:] == c[:-gap])
            if not len(same):
                break
            one, two = t[same], t[same + gap]
            out.append(mix(mix(np.minimum(one, two) + np.uint64(at)) ^ np.maximum(one, two)))
    return np.unique(np.concatenate(out))


_POSTINGS = "r int, v binary, docs binary, members binary, edges binary"


class Poster:
    """Packs the signatures of a part's documents by ranges of hashes."""

    def __init__(self, bits: int, hot: int, most: int) -> None:
        self.bits, self.hot, self.most = bits, hot, most
        self.rows: list[tuple] = []
        self.sigs: list[np.ndarray] = []
        self.ids: list[np.ndarray] = []
        self.size = 0

    def add(self, gid: int, tokens: np.ndarray, codes: np.ndarray) -> None:
        s = signatures(tokens, codes)
        own = 127 * int((codes == 0).sum()) // max(1, len(tokens))
        self.sigs.append(s)
        self.ids.append(np.full(len(s), own << OWN | gid, np.int64))
        self.size += len(s)
        if self.size > self.most:
            self.flush()

    def flush(self) -> None:
        if not self.size:
            return
        bits, s, d = self.bits, np.concatenate(self.sigs), np.concatenate(self.ids)
        self.sigs, self.ids, self.size = [], [], 0
        s = s >> np.uint64(32 - bits)
        order = np.lexsort((d, s))
        s, d = s[order], d[order]
        start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        of = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(s))))
        hot = np.diff(np.append(start, len(s)))[of] > self.hot
        first = np.zeros(len(s), bool)
        first[start] = True
        part, pick = (int(d[0]) & PLAIN) >> 33, np.flatnonzero(hot)
        for q in range(0, len(pick), self.most // 8):
            p = pick[q : q + self.most // 8]
            self.rows.append(((part * 31 + q) % (1 << bits), None, None, pack(np.concatenate([s[p].view(np.int64), d[p]])), pack(np.concatenate([d[start[of[p]]], d[p]]) & PLAIN)))
        keep = ~hot | first
        s, d, hot = s[keep], d[keep], hot[keep]
        bounds = np.searchsorted((s >> np.uint64(32)).astype(np.int64), np.arange((1 << bits) + 1))
        v = (s & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        d = d * 2 + hot  # the lowest bit: stands for others
        for k in np.flatnonzero(np.diff(bounds)).tolist():
            one = slice(bounds[k], bounds[k + 1])
            self.rows.append((k, pack_sorted(v[one]), pack(d[one]), None, None))

    def table(self) -> pa.Table:
        self.flush()
        r, v, d, m, e = zip(*self.rows, strict=True) if self.rows else ((),) * 5
        return pa.table({"r": pa.array(r, pa.int32()), "v": pa.array(v, pa.binary()), "docs": pa.array(d, pa.binary()), "members": pa.array(m, pa.binary()), "edges": pa.array(e, pa.binary())})


def postings(sets: DataFrame, codes: DataFrame, bits: int) -> DataFrame:
    """(r, v, docs, members, edges): packed signatures of a range and their documents. Of signatures that more than HOT
    documents of a part share, ``members`` and ``edges`` hold signature, document and the document that stands for them,
    dealt to other ranges than their own, so that no range gathers them. A task holds one chunk of PACK tokens or so, and the
    codes of these."""

    hot, most = HOT, PACK

    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        poster = Poster(bits, hot, most)
        if docs.num_rows:
            shingler, z = Shingler(), docs.column("z")
            tokens = [s for i in range(0, len(z), 256) for s in shingler.sets(_texts(z.slice(i, 256)))]
            every = np.unique(np.concatenate(tokens))
            code = np.concatenate([unpack(x, "<u1") for _, x in sorted(zip(known.column("r").to_pylist(), known.column("codes").to_pylist(), strict=True))])
            for gid, t in zip(docs.column("gid").to_pylist(), tokens, strict=True):
                poster.add(gid, t, code[np.searchsorted(every, t)])
            del tokens, every, code
        out = poster.table()
        release()
        return out

    return sets.select("part", "chunk", "gid", "z").groupBy("part", "chunk").cogroup(codes.groupBy("part", "chunk")).applyInArrow(run, _POSTINGS)


def candidates(packed: DataFrame) -> DataFrame:
    """(list, a, b): pairs to verify with a null list, and members a of lists with a null b (members with their share).

    The documents of a signature make a star around the one with the least of its own: pairs (a, b). Where they are three or more, or
    one stands for others, they are also a list, of which what the stars leave unlinked is looked at again. Lists of
    one range that hold the same documents are one.
    """

    def run(t: pa.Table) -> pa.Table:
        edges, members = [], []
        rows = [(unpack_sorted(v, "<u4"), unpack(d, "<i8")) for v, d in zip(t.column("v").to_pylist(), t.column("docs").to_pylist(), strict=True) if v is not None]
        r = t.column("r")[0].as_py()
        for m, e in zip(t.column("members").to_pylist(), t.column("edges").to_pylist(), strict=True):
            if m is not None:
                members.append(unpack(m, "<i8").reshape(2, -1).T)
                edges.append(unpack(e, "<i8").reshape(2, -1).T)
        if rows:
            v, d = np.concatenate([x for x, _ in rows]), np.concatenate([x for _, x in rows])
            order = np.lexsort((d, v))
            v, d = v[order], d[order]
            start = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
            length = np.diff(np.append(start, len(v)))
            hot, d = (d & 1).astype(bool), d >> 1
            of = np.repeat(np.arange(len(start)), length)
            many = length[of] > 1
            pivot = d[start][of]
            edges.append(np.unique(np.column_stack([pivot[many], d[many]]) & PLAIN, axis=0))
            stands = np.add.reduceat(hot, start) > 0 if len(start) else np.zeros(0, bool)
            # a list is named by the sum of its members' hashes, one with hot members by its signature
            name = np.add.reduceat(mix(d.astype(np.uint64)), start).view(np.int64) if len(start) else np.zeros(0, np.int64)
            sig = (np.int64(r) << np.int64(32)) + v[start].astype(np.int64)
            whole = (length > 2) & ~stands
            chosen = np.zeros(len(start), bool)
            chosen[np.flatnonzero(whole)[np.unique(name[whole], return_index=True)[1]]] = True
            chosen |= stands
            name = np.where(stands, sig, name)
            pick = chosen[of]
            members.append(np.column_stack([name[of][pick], d[pick]]))
        e = np.concatenate(edges) if edges else np.zeros((0, 2), np.int64)
        e = np.sort(e[e[:, 0] != e[:, 1]], axis=1)
        m = np.concatenate(members) if members else np.zeros((0, 2), np.int64)
        null = lambda n: pa.nulls(n, pa.int64())
        return pa.table({"list": pa.concat_arrays([null(len(e)), pa.array(m[:, 0])]), "a": pa.concat_arrays([pa.array(e[:, 0]), pa.array(m[:, 1])]), "b": pa.concat_arrays([pa.array(e[:, 1]), null(len(m))])})

    return packed.groupBy("r").applyInArrow(run, "list long, a long, b long").distinct()


def sifted(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that sizes and bitmaps don't rule out; most chance candidates go here, before any text moves."""
    one = sets.select(F.col("gid").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba"))
    two = sets.select(F.col("gid").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb"))
    size = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * PERCENT

    def make():
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            ok = [may_link(*x) for x in zip(*(b.column(c).to_pylist() for c in ("na", "nb", "ba", "bb")), strict=True)]
            return b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

        return run

    return map_batches(pairs.join(one, "a").join(two, "b").where(size), "a long, b long", make)


def level_of(n: Column) -> Column:
    """The level of a size, as in :func:`_levels`: sizes that can link are at most one apart."""
    return F.size(F.filter(F.array(*(F.lit(int(x)) for x in _levels())), lambda x: x <= n)) - 1


def _folded(m: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps (rows) of ``size`` bytes from larger ones."""
    return m if m.shape[1] == size else np.bitwise_xor.reduce(m.reshape(len(m), -1, size), 1)


def across(meet: DataFrame, comps: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) that sizes and bitmaps don't rule out, for documents and components that met (x, c), each document with the
    members of a size that can link. Small components are joined; larger ones are held against their documents in blocks
    of TILE by TILE of neighbouring levels of size, in numpy, so that what is ruled out never becomes a row."""
    salts = lambda: F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salt = lambda k: F.pmod(F.xxhash64(k), F.lit(SALTS)).cast("int")
    # Which components are large, and which small ones many documents meet, is told to salted rows: no task gathers them.
    large = cut(comps.groupBy("comp").count().where(F.col("count") > FEW).select(F.col("comp").alias("large"), salts().alias("kl")))
    met = meet.withColumn("salt", salt("x")).join(large, (F.col("c") == F.col("large")) & (F.col("salt") == F.col("kl")), "left")
    held = comps.withColumn("salt", salt("node")).join(large, (F.col("comp") == F.col("large")) & (F.col("salt") == F.col("kl")), "left")
    small, members = met.where("large is null").select("x", "c", "salt"), held.where("large is null").select("comp", "node")
    crowd = cut(small.groupBy("c").count().where(F.col("count") > MEET).select(F.col("c").alias("crowd"), salts().alias("kc")))
    small = small.join(crowd, (F.col("c") == F.col("crowd")) & (F.col("salt") == F.col("kc")), "left").select("x", "c", F.coalesce("kc", F.lit(0)).alias("deal"))
    members = members.join(crowd, F.col("comp") == F.col("crowd"), "left").select("comp", "node", F.coalesce("kc", F.lit(0)).alias("dealt"))
    few = small.join(members, (F.col("c") == F.col("comp")) & (F.col("deal") == F.col("dealt")), "left").select("x", F.coalesce("node", "c").alias("y"))
    few = sifted(few.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), sets)
    many = met.where("large is not null").select("x", "c")
    wanted = many.select("c").distinct().select(F.col("c").alias("wanted"), salts().alias("kw"))
    tiles = lambda: F.ceil(F.count("*") / TILE).cast("int")
    dealt = lambda k, n: F.pmod(F.xxhash64(k), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # Documents meet members of their own level of size and of the two beside it.
    one = sets.select(F.col("gid").alias("x"), F.col("n").alias("nx"), F.col("bits").alias("bx"))
    two = sets.select(F.col("gid").alias("y"), F.col("n").alias("ny"), F.col("bits").alias("by"), level_of(F.col("n")).alias("rv"))
    left = many.join(one, "x")
    left = left.select("*", F.explode(F.array(*(level_of(F.col("nx")) + k for k in (-1, 0, 1)))).alias("v"))
    right = held.where("large is not null").join(wanted, (F.col("comp") == F.col("wanted")) & (F.col("salt") == F.col("kw")), "left_semi").select(F.col("comp").alias("rc"), F.col("node").alias("y")).join(two, "y")
    grid = cut(left.groupBy("c", "v").agg(tiles().alias("tx")).join(right.groupBy(F.col("rc").alias("c"), F.col("rv").alias("v")).agg(tiles().alias("ty")), ["c", "v"]))
    grid = grid.select("*", salts().alias("salt"))
    left = left.withColumn("salt", salt("x")).join(grid, ["c", "v", "salt"]).select("c", "v", dealt("x", "tx").alias("i"), all_of("ty").alias("j"), "x", "nx", "bx")
    right = right.withColumn("salt", salt("y")).join(grid.select(F.col("c").alias("rc"), F.col("v").alias("rv"), "salt", "tx", "ty"), ["rc", "rv", "salt"]).select("rc", "rv", all_of("tx").alias("ri"), dealt("y", "ty").alias("rj"), "y", "ny", "by")

    def block(xs: pa.Table, ys: pa.Table) -> pa.Table:
        gy, ny, by = ys.column("y").to_numpy(), ys.column("ny").to_numpy(), ys.column("by").to_pylist()
        lengths = np.array([len(b) for b in by])
        of = {k: np.flatnonzero(lengths == k) for k in set(lengths.tolist())}
        maps = {k: np.frombuffer(b"".join([by[i] for i in at]), np.uint8).reshape(-1, k) for k, at in of.items()}
        folds: dict[tuple[int, int], np.ndarray] = {}
        a, b = [], []
        for x, nx, bx in zip(*(xs.column(k).to_pylist() for k in ("x", "nx", "bx")), strict=True):
            mine = np.frombuffer(bx, np.uint8)[None]
            for k, at in of.items():
                size = min(k, len(bx))
                if (k, size) not in folds:
                    folds[k, size] = _folded(maps[k], size)
                apart = np.bitwise_count(folds[k, size] ^ _folded(mine, size)).sum(1, dtype=np.int64)
                n = ny[at]
                shared = (nx + n - apart) // 2
                ok = (100 * shared >= PERCENT * (nx + n - shared)) & (np.minimum(n, nx) * 100 >= PERCENT * np.maximum(n, nx))
                hit = gy[at[ok]]
                a.append(np.minimum(hit, x))
                b.append(np.maximum(hit, x))
        join = lambda v: pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64())
        release()
        return pa.table({"a": join(a), "b": join(b)})

    return few.unionByName(left.groupBy("c", "v", "i", "j").cogroup(right.groupBy("rc", "rv", "ri", "rj")).applyInArrow(block, "a long, b long")).where("a <> b").distinct()


def unlinked_lists(member: DataFrame, comps: DataFrame, sets: DataFrame) -> DataFrame:
    """(list, a, comp, alone, major, n, s) of lists whose documents are in several components: ``alone`` says that a
    document has no link, ``major`` is the component with most of the list, ``s`` bounds what a document can share.

    What is known of a list is sent to its members by list and salt, so that a long list is dealt to SALTS tasks."""
    member = member.join(comps.select(F.col("node").alias("a"), "comp"), "a", "left")
    member = member.withColumn("alone", F.col("comp").isNull()).withColumn("comp", F.coalesce("comp", "a"))
    sizes = member.groupBy("list", "comp").count()
    mixed = sizes.groupBy("list").agg(F.count("*").alias("k"), F.max_by("comp", "count").alias("major")).where("k > 1")
    mixed = mixed.select("list", "major", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    member = member.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int")).join(mixed, ["list", "salt"]).join(sets.select(F.col("gid").alias("a"), "n"), "a")
    return member.select("list", "a", "comp", "alone", "major", "n", (F.col("n") - F.ceil(F.col("own") * F.col("n") / 127)).alias("s"))


def meetings(member: DataFrame) -> DataFrame:
    """(x, c): documents and components to be held against each other, for two components of a list once: a document
    outside of the list's major component with that, or with one of a smaller number. Left out is what can't link by
    sizes and by what documents have alone; two lone documents meet in the first only of the lists that their sketches
    have in common, however many they share.

    They meet by list and level of size, components at each level at which a member could link, and where a list has many
    documents of a level, these are dealt to tiles of MEET, each of which meets all components."""
    sketch = member.where("alone").groupBy("a").agg(F.slice(F.array_sort(F.collect_set("list")), 1, SKETCH).alias("sketch"))
    member = member.join(sketch, "a", "left")
    x = member.where("comp <> major").select("list", F.col("a").alias("x"), F.col("comp").alias("cx"), F.col("n").alias("nx"), F.col("s").alias("sx"), F.col("sketch").alias("kx"), level_of(F.col("n")).alias("v"))
    c = member.groupBy("list", F.col("comp").alias("c"), (F.col("comp") == F.col("major")).alias("main")).agg(F.min("n").alias("nc"), F.max("n").alias("xc"), F.max("s").alias("sc"), F.first("sketch").alias("kc"))
    c = c.select("*", F.explode(F.sequence(level_of(F.col("nc")) - 1, level_of(F.col("xc")) + 1)).alias("v"))
    tiles = cut(x.groupBy("list", "v").agg(F.ceil(F.count("*") / MEET).cast("int").alias("tiles")).where("tiles > 1"))
    tiles = tiles.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = lambda k: F.pmod(F.xxhash64(k), F.lit(SALTS)).cast("int")
    few = F.coalesce("tiles", F.lit(1))
    # How many tiles a list has at a level is told to salted rows.
    x = x.withColumn("salt", salt("x")).join(tiles, ["list", "v", "salt"], "left").withColumn("tile", F.pmod(F.xxhash64("x"), few).cast("int")).drop("tiles", "salt")
    c = c.withColumn("salt", salt("c")).join(tiles, ["list", "v", "salt"], "left").withColumn("tile", F.explode(F.sequence(F.lit(0), few - 1))).drop("tiles", "salt")
    one = F.col("main") | (F.col("cx") > F.col("c"))
    fits = (F.col("nx") * 100 >= F.col("nc") * PERCENT) & (F.col("xc") * 100 >= F.col("nx") * PERCENT) & (F.least("sx", "sc") * (100 + PERCENT) >= (F.col("nx") + F.col("nc")) * PERCENT)
    before = F.arrays_overlap(F.filter("kx", lambda k: k < F.col("list")), F.col("kc"))
    # What is main in one list may be left to the other document's turn in another, so only lists without main count.
    first = F.col("main") | ~F.coalesce(before & F.col("kx").isNotNull() & F.col("kc").isNotNull(), F.lit(False))
    return x.join(c, ["list", "v", "tile"]).where((F.col("cx") != F.col("c")) & one & fits & first).select("x", "c").distinct()


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of sifted ones that link, by their whole sets. Only texts of documents in pairs leave their place.

    Of a pair the document with more pairs is the centre. The pairs of a centre are dealt to tiles of SPOKES, and tiles to
    buckets of PAIRS pairs or so; the centre's text goes to each of its tiles once, the other's to each of its pairs."""
    pairs = cut(pairs)
    ends = pairs.select(F.col("a").alias("gid")).unionAll(pairs.select("b")).groupBy("gid").agg(F.count("*").alias("k"))
    ends = cut(ends)
    need = ends.select("gid")
    total = pairs.count()
    if ends.count() <= BROADCAST_IDS:
        need = F.broadcast(need)
    held = cut(sets.select("gid", "z").join(need, "gid", "left_semi"))
    spokes, buckets = SPOKES, max(1, -(-total // PAIRS))
    counted = pairs.join(ends.select(F.col("gid").alias("a"), F.col("k").alias("ka")), "a").join(ends.select(F.col("gid").alias("b"), F.col("k").alias("kb")), "b")
    swap = F.col("kb") > F.col("ka")
    star = counted.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("c"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("s"), F.ceil(F.greatest("ka", "kb") / spokes).alias("tiles"))
    star = star.withColumn("bucket", F.pmod(F.xxhash64("c", F.pmod(F.xxhash64("s"), F.col("tiles"))), F.lit(buckets)).cast("int")).select("c", "s", "bucket")
    other = star.join(held.select(F.col("gid").alias("s"), "z"), "s").select("bucket", "c", "s", "z")
    centre = star.select(F.col("bucket").alias("rb"), F.col("c").alias("gid")).distinct().join(held.select("gid", F.col("z").alias("zc")), "gid")

    def block(p: pa.Table, t: pa.Table) -> pa.Table:
        shingler, d = Shingler(), zstandard.ZstdDecompressor()
        texts = dict(zip(t.column("gid").to_pylist(), t.column("zc").to_pylist(), strict=True))
        p = p.sort_by("c")
        c, s, z = (p.column(k).to_pylist() for k in ("c", "s", "z"))
        kept: tuple[int, np.ndarray] = (-1, np.zeros(0, np.uint64))
        a, b = [], []
        for i in range(0, len(c), 128):
            for x, y, other in zip(c[i : i + 128], s[i : i + 128], shingler.sets([d.decompress(k).decode() for k in z[i : i + 128]]), strict=True):
                if kept[0] != x:
                    kept = (x, shingler.sets([d.decompress(texts[x]).decode()])[0])
                shared = len(np.intersect1d(kept[1], other, assume_unique=True))
                if 100 * shared >= PERCENT * (len(kept[1]) + len(other) - shared):
                    a.append(min(x, y))
                    b.append(max(x, y))
        release()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return other.groupBy("bucket").cogroup(centre.groupBy("rb")).applyInArrow(block, "a long, b long")


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: doc_id, n_shingles, component_id, the smallest id reachable by links.

    A null, empty or blank text has no shingle and no link, so its own id. Rows of equal sets are one node. A null id
    is never the smallest unless all are null; repeated ids count as separate rows. An empty table gives no rows, and columns
    other than id and text (``n_shingles``, say) are left out. Texts may be of any length. No
    link is lost or guessed: the prefix index gives candidates, whole sets decide. Pairs that stay unlinked are looked
    for again only between different components of a list, so a group of near copies costs its size, not its square.
    """
    rows = id_and_text(df, id_col, text_col).withColumn("th", F.xxhash64("text"))
    seen = cut(fingerprints(rows))
    sets = distinct_sets(rows, seen).withColumn("part", F.shiftright("gid", 33))
    tokens = sets.agg(F.sum("n")).first()[0] or 0
    bits = max(2, int(max(1, tokens // RANGE)).bit_length())
    found = cut(candidates(postings(sets, token_codes(sets, bits), bits)))
    stars = found.where("list is null").select("a", "b")
    tested = cut(sifted(stars, sets))
    links = cut(verified(tested, sets))
    comps = cut(components(links))
    member = cut(unlinked_lists(found.where("list is not null").select("list", F.col("a").bitwiseAND(PLAIN).alias("a"), F.shiftright("a", OWN).alias("own")), comps, sets))
    meet = cut(meetings(member))
    more = cut(verified(across(meet, comps, sets).join(tested, ["a", "b"], "left_anti"), sets))
    if more.limit(1).count():
        comps = cut(components(links.union(more)))
    smallest = seen.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    named = smallest.join(sets.select("fp", "gid"), "fp", "left").join(comps.withColumnRenamed("node", "gid"), "gid", "left")
    of_comp = named.where("comp is not null").groupBy("comp").agg(F.min("least").alias("lowest"))
    named = named.join(of_comp, "comp", "left").where("comp is not null or copies > 1").groupBy("fp").agg(F.min(F.coalesce("lowest", "least")).alias("component_id"))
    return seen.join(named, "fp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_smallest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, whose id is the smallest of their component; rows that share an id stand or fall
    together. Decisions are cut to a narrow table, which the texts meet by id."""
    own = unused(df, "_id")
    first = cut(jaccard_components(df, id_col, text_col).where("doc_id <=> component_id").select(F.col("doc_id").alias(own)).distinct())
    return df.join(first, df[id_col].eqNullSafe(first[own]), "left_semi")
