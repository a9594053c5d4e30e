"""BPE encoding and decoding by an index from pairs to their positions."""

from __future__ import annotations

import gc
import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from corpuslab.llm.common import batch, id_and_text, map_batches, release, tokenizer_path

VOCABULARY = "word_bpe_49k.json"
#: Chunks and words of which a Python worker remembers ids: so many that it met lately, and as many from before.
REMEMBERED = 200_000
#: Characters of a chunk or word that is remembered beyond its texts, at most.
LONGEST = 64
SHIFT = 32
#: Texts encoded together, by count and by characters.
TEXTS, CHARS = 1024, 4_000_000

WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


class Recent(dict):
    """A memory of a bounded size: what was met in the present or the last stretch of ``most`` entries stays."""

    def __init__(self, most: int) -> None:
        super().__init__()
        self.old: dict = {}
        self.most = most

    def lacking(self, keys: set[str]) -> list[str]:
        """Brings back what is remembered of ``keys`` and gives the others."""
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
        old, fresh = self.old, []
        for k in keys.difference(self):
            if k in old:
                self[k] = old[k]
            else:
                fresh.append(k)
        return fresh


def byte_letters() -> list[str]:
    """The printable character for each byte: itself where it prints, else the next from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in prints else next(rest)) for b in range(256)]


class PairIndexBPE:
    """Encodes words of a vocabulary file of the tokenizers library (BPE, byte letters, word ends).

    ``encode_words`` works on all its words at once. Their symbols lie in one array with links to the neighbours in
    the same word; an index maps each pair that has a rank (by that rank) to all its positions. Active ranks are taken in ascending
    order; each is merged at all its positions from left to right, and only the pairs beside them change lists. A merge
    makes pairs of higher ranks only (checked when the file is read), so this order gives each word what merging its
    lowest pair first gives.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = dict(model["vocab"])
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        if any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"]):
            raise ValueError("added tokens with options aren't supported")
        self.tokens = {i: t for t, i in (self.ids | self.special).items()}
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        made: dict[int, int] = {}
        rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(pairs):
            left, right, both = self.ids[a], self.ids[b], self.ids[a + b]
            if made.get(left, -1) >= r or made.get(right, -1) >= r:
                raise ValueError("a merge makes a pair of a lower rank")
            made[both] = r
            rank.setdefault((left, right), (r, both))
        for (left, right), (r, _) in rank.items():
            if max(made.get(left, -1), made.get(right, -1)) >= r:
                raise ValueError("a merge makes a pair of a lower rank")
        # A pair is left << SHIFT | right. Ranks and what they make by pair, and pairs by rank.
        self.rank = {left << SHIFT | right: r for (left, right), (r, _) in rank.items()}
        self.by_rank = {r: (left, right, both) for (left, right), (r, both) in rank.items()}
        self.pairs = np.array(sorted(self.rank), np.int64)
        self.ranks = np.array([self.rank[p] for p in self.pairs.tolist()], np.int64)
        pattern = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.words = regex.compile(pattern.replace("\\s", WHITE) if "[^\\s" in pattern else pattern, regex.V0)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.blank = regex.compile(f"[{WHITE}]+")
        self.odd = regex.compile("[\x1c-\x1fΣ]")
        letters = byte_letters()
        self.first = np.array([self.ids[c] for c in letters], np.int64)
        self.last = np.array([self.ids[c + self.suffix] for c in letters], np.int64)
        self.ids_of, self.said_of, self.word_ids, self.word_said = (Recent(remembered) for _ in range(4))

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word (a match of the pattern), all words together."""
        if not words:
            return []
        raw = [w.encode() for w in words]
        ends = np.cumsum([len(r) for r in raw])
        flat = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.first[flat]
        symbols[ends - 1] = self.last[flat[ends - 1]]
        n = len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[np.concatenate([[0], ends[:-1]])] = -1
        # The index: for each active rank all positions of its pair.
        left = np.flatnonzero(after >= 0)
        pair = symbols[left] << SHIFT | symbols[left + 1]
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        left, at = left[self.pairs[at] == pair], at[self.pairs[at] == pair]
        met = self.ranks[at]
        order = np.argsort(met, kind="stable")
        met, left = met[order], left[order]
        starts = np.flatnonzero(np.concatenate([[True], met[1:] != met[:-1]])) if len(met) else np.zeros(0, np.int64)
        index = {r: p.tolist() for r, p in zip(met[starts].tolist(), np.split(left, starts[1:]), strict=True)} if len(met) else {}
        sym, after, before = symbols.tolist(), after.tolist(), before.tolist()
        rank, by_rank = self.rank.get, self.by_rank
        active = list(index)
        heapify(active)
        while active:
            r = heappop(active)
            a, b, both = by_rank[r]
            positions = index.pop(r)
            positions.sort()
            front = both << SHIFT
            for i in positions:
                j = after[i]
                if j < 0 or sym[i] != a or sym[j] != b:
                    continue  # one of the two has gone into another merge
                k = after[j]
                sym[i], sym[j], after[i], after[j] = both, -1, k, -1
                if k >= 0:
                    before[k] = i
                    new = rank(front | sym[k])
                    if new is not None:
                        if new in index:
                            index[new].append(i)
                        else:
                            index[new] = [i]
                            heappush(active, new)
                h = before[i]
                if h >= 0:
                    new = rank(sym[h] << SHIFT | both)
                    if new is not None:
                        if new in index:
                            index[new].append(h)
                        else:
                            index[new] = [h]
                            heappush(active, new)
        out, start = [], 0
        for e in ends.tolist():
            out.append([s for s in sym[start:e] if s >= 0])
            start = e
        return out

    def plain(self, text: str) -> str:
        """A text without special strings, normalised: NFC, lower case; white space stays, as it only parts words."""
        if self.odd.search(text):
            text = self.blank.sub(" ", text).replace("Σ", "σ")
        return (text if text.isascii() else unicodedata.normalize("NFC", text)).lower()

    def chunks(self, text: str) -> list[str]:
        """What stands between white space."""
        return [x for x in self.blank.split(text) if x] if self.odd.search(text) else text.split()

    def learn(self, chunks: list[str]) -> None:
        """Remembers ids and tokens of chunks, which are made of those of their words."""
        parts = [[c] if c.isalpha() else [c[:-1], c[-1]] if c[-1] in ".,;" and c[:-1].isalpha() else self.words.findall(c) for c in chunks]
        words = set().union(*parts)
        fresh = self.word_ids.lacking(words)
        self.word_said.lacking(words)
        ids_of, said_of, tokens = self.word_ids, self.word_said, self.tokens
        for w, ids in zip(fresh, self.encode_words(fresh), strict=True):
            ids_of[w] = array("I", ids).tobytes()
            said_of[w] = tokens[ids[0]] if len(ids) == 1 else " ".join([tokens[i] for i in ids])
        get_ids, get_said = ids_of.__getitem__, said_of.__getitem__
        for c, ws in zip(chunks, parts, strict=True):
            if len(ws) == 1:
                self.ids_of[c], self.said_of[c] = ids_of[c], said_of[c]
            else:
                self.ids_of[c], self.said_of[c] = b"".join(map(get_ids, ws)), " ".join(map(get_said, ws))
        for w in fresh:
            if len(w) > LONGEST:
                del ids_of[w], said_of[w]

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """For each text its ids as little-endian unsigned 32-bit integers, and what they decode to."""
        split: list[list[list[str] | str]] = []
        for t in texts:
            parts = self.cut.split(t) if self.cut and any(x in t for x in self.special) else [t]
            split.append([x if x in self.special else self.chunks(self.plain(x)) for x in parts])
        met = set().union(*(p for parts in split for p in parts if type(p) is list))
        fresh = self.ids_of.lacking(met)
        self.said_of.lacking(met)
        if fresh:
            self.learn(fresh)
        get_ids, get_said = self.ids_of.__getitem__, self.said_of.__getitem__
        out = []
        for parts in split:
            if len(parts) == 1 and type(parts[0]) is list:
                ids, said = b"".join(map(get_ids, parts[0])), " ".join(map(get_said, parts[0]))
            else:
                ids = b"".join(b"".join(map(get_ids, p)) if type(p) is list else array("I", [self.special[p]]).tobytes() for p in parts)
                said = " ".join(x for p in parts for x in (map(get_said, p) if type(p) is list else [p]))
            out.append((ids, said))
        for c in fresh:
            if len(c) > LONGEST:
                del self.ids_of[c], self.said_of[c]
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids: the file has no decoder, so tokens are joined by spaces, special ones included."""
        return " ".join([self.tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


@lru_cache(1)
def _bpe(path: str, remembered: int) -> PairIndexBPE:
    return PairIndexBPE(path, remembered)


def _groups(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Bounds of groups of at most TEXTS texts and, but for a single longer one, ``most`` characters."""
    i = 0
    while i < len(lengths):
        j, chars = i, 0
        while j < len(lengths) and j - i < TEXTS and (j == i or chars + lengths[j] <= most):
            chars += lengths[j]
            j += 1
        yield i, j
        i = j


def encode_decode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, keep: Sequence[str] = (), remembered: int = REMEMBERED, chars: int = CHARS, lasting: bool = True) -> DataFrame:
    """One row for each row of ``df``: doc_id, n_tokens, ids_sha256, decoded_sha256; also what ``keep`` names of
    ids and decoded.

    Special strings inside texts become their ids, as is the library's default. A null or empty text has no ids and
    decodes to an empty text. Ids of rows may be null or repeat, and each row is encoded; an empty table gives no rows; texts
    may be of any length; columns other than id and text (``ids``, say) are left out. There is no shuffle.

    Texts are encoded together up to ``chars`` characters. A Python worker keeps what it ``remembered`` for its next tasks; with ``lasting`` off it is dropped with each task,
    for jobs whose workers do other things besides.
    """

    def make():
        path = tokenizer_path(VOCABULARY, folder)
        bpe = _bpe(path, remembered) if lasting else PairIndexBPE(path, remembered)
        release()

        def encoded(b: pa.RecordBatch) -> pa.RecordBatch:
            gc.disable()  # nothing here makes cycles, and the memories are costly to walk
            try:
                pairs = bpe.encode(b.column("text").to_pylist())
            finally:
                gc.enable()
            more = {}
            if "ids" in keep:
                ids = pa.array(np.frombuffer(b"".join([x for x, _ in pairs]), "<i4"), pa.int32())
                more["ids"] = (pa.ListArray.from_arrays(np.cumsum([0, *(len(x) // 4 for x, _ in pairs)], dtype="i4"), ids), None)
            if "decoded" in keep:
                more["decoded"] = ([x for _, x in pairs], pa.string())
            return batch(
                doc_id=(b.column("doc_id"), None),
                n_tokens=([len(x) // 4 for x, _ in pairs], pa.int64()),
                ids_sha256=([hashlib.sha256(x).hexdigest() for x, _ in pairs], pa.string()),
                decoded_sha256=([hashlib.sha256(x.encode()).hexdigest() for _, x in pairs], pa.string()),
                **more,
            )

        def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            lengths = pc.fill_null(pc.utf8_length(b.column("text")), 0).to_pylist()
            for i, j in _groups(lengths, chars):
                yield encoded(b.slice(i, j - i))

        return run

    rows = id_and_text(df, id_col, text_col)
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_batches(rows, schema + ", ids array<int>" * ("ids" in keep) + ", decoded string" * ("decoded" in keep), make)
