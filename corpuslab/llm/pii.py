"""Personal data: patterns, and spans that a linear-chain conditional random field over word shapes adds."""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Callable
from functools import lru_cache
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import batch, id_and_text, map_batches

KINDS = ("email", "ip", "card", "phone")

# Base kinds, as the contract of the query gives them.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")  # begins where a run of digits does, so in linear time
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

TOKEN = re.compile(r"\S+")
TRIGGER = re.compile(r"[0-9@]")
#: Words on either side of a word with a digit or @ that the field sees with it.
AROUND = 3
#: Sequences longer than this are decoded one by one, so that padding stays bounded.
LONG = 256


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def is_ip(s: str) -> bool:
    parts = s.split(".")
    return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in parts)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(number of the kind, start, end) in code points, by kind, then start."""
    found = []
    at, done = text.find("@"), 0
    while at >= 0:  # the pattern, from each @: the longest local part that nothing found before holds
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", max(done, at + 1))
    if TRIGGER.search(text):
        found += [(1, *m.span()) for m in IP.finditer(text) if is_ip(m[0])]
        found += [(2, *m.span()) for m in CARD.finditer(text) if 16 <= len(n := digits(m[0])) <= 19 and luhn(n)]
        if "+" in text:
            found += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]
    return found


# --- the field -------------------------------------------------------------------------------------------------

LABELS = ("O", *KINDS)
SHAPES = 1 << 10


def shape(word: str) -> str:
    """A for capitals, a for other letters, 9 for digits, other signs as they are; runs once, with their length class."""
    out: list[str] = []
    run = 0
    for c in word:
        k = "9" if "0" <= c <= "9" else "A" if c.isupper() else "a" if c.isalpha() else c
        if out and out[-1] == k:
            run += 1
            continue
        if out and run:
            out[-1] += str(min(run, 9) // 2 + 1)
        out.append(k)
        run = 1
    if out:
        out[-1] += str(min(run, 9) // 2 + 1)
    return "".join(out)


def word_features(word: str) -> tuple[int, ...]:
    """Hashed features of a word's shape: the whole, its signs, its digits, what it begins and ends with. Those of words of
    a usual length are remembered."""
    return _remembered(word) if len(word) < 100 else _features(word)


def _features(word: str) -> tuple[int, ...]:
    core = word.strip(".,;:!?\"'()[]{}<>#$%&*|")
    s = shape(core)
    n = len(digits(core))
    named = ("w" + s, "n" + str(min(n, 20)), "c" + "".join(sorted(set(core) & set("@.+-()"))), "d" + str(core.count(".")), "b" + s[:2], "e" + s[-2:], "t" + (core.lower() if core.isalpha() and len(core) < 8 else ""))
    return tuple(crc32(x.encode()) % SHAPES for x in named)


_remembered = lru_cache(100_000)(_features)


def numbered_card(r: random.Random, n: int = 16) -> str:
    """Digits that pass :func:`luhn`."""
    head = "".join(r.choice("0123456789") for _ in range(n - 1))
    return next(head + c for c in "0123456789" if luhn(head + c))


def labelled_table(seed: int = 7, rows: int = 400) -> list[tuple[list[str], list[int]]]:
    """The small labelled table: sentences from templates, digits drawn with a fixed seed. Its items have the forms of the base
    patterns and others that those miss: telephone numbers without a plus, cards parted by dots, several blanks or into groups of
    three, addresses with letters beyond ASCII."""
    r = random.Random(seed)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def card(sep: str, sizes: tuple[int, ...]) -> str:
        n, at, out = numbered_card(r, sum(sizes)), 0, []
        for k in sizes:
            out.append(n[at : at + k])
            at += k
        return sep.join(out)

    words = "the call of and write me under mail is at number from see order page year total on for reach us today room line item".split()
    filler = lambda: [(r.choice(words) if r.random() < 0.7 else "".join(r.choice("aehinorst") for _ in range(r.randint(2, 9)))) + r.choice(["", "", "", ",", "."]) for _ in range(r.randint(1, 4))]
    made = {
        "email": [lambda: [f"{r.choice(['ann', 'j.doe', 'info', 'x' + d(2)])}@{r.choice(['mail', 'post' + d(1), 'web'])}.{r.choice(['example.com', 'org', 'net'])}"], lambda: [f"<{r.choice(['kim', 'o.li'])}{d(2)}@host{d(1)}.example.org>"], lambda: [f"{r.choice(['jörg', 'zoé', 'françois', 'ñandú'])}{d(1)}@{r.choice(['bücher', 'café', 'web'])}.{r.choice(['example.de', 'org'])}"]],
        "ip": [lambda: [".".join(str(r.randint(0, 255)) for _ in range(4))], lambda: [".".join(str(r.randint(0, 255)) for _ in range(4)) + ","]],
        "card": [lambda: [d(16)], lambda: [d(4), d(4), d(4), d(4)], lambda: ["-".join([d(4), d(4), d(4), d(4)])], lambda: [card(".", (4, 4, 4, 4))], lambda: card(" ", (4, 6, 5)).split(), lambda: [card("", (15,))], lambda: card(" ", (4, 4, 4, 4)).split()],
        "phone": [lambda: ["+" + d(2), d(3), d(7)], lambda: ["+" + d(11)], lambda: [f"({d(3)})", f"{d(3)}-{d(4)}"], lambda: [f"{d(3)}-{d(3)}-{d(4)}"], lambda: [f"+{d(1)}-{d(3)}-{d(3)}-{d(4)}"], lambda: [f"{d(3)}.{d(3)}.{d(4)}"], lambda: [d(3), d(3), d(4)], lambda: ["00" + d(2), d(2), d(7)], lambda: ["0" + d(3) + "-" + d(7)]],
        "O": [lambda: [d(r.randint(1, 5))], lambda: [f"{d(2)}.{d(2)}"], lambda: [f"20{d(2)}-0{d(1)}-1{d(1)}"], lambda: [f"{d(2)}:{d(2)}"], lambda: [f"v{d(1)}.{d(1)}.{d(2)}"], lambda: [f"${d(3)}.{d(2)}"], lambda: [f"@{r.choice(['ann', 'team'])}"], lambda: [f"{d(6)}a{d(5)}f{d(8)}"], lambda: [f"id-{d(5)}"], lambda: [d(r.randint(8, 13))]],
    }
    table = []
    for _ in range(rows):
        tokens, tags = [], []
        for kind in r.choices(list(made), k=r.randint(1, 2)):
            f = filler()
            one = r.choice(made[kind])()
            tokens += f + one
            tags += [0] * len(f) + [LABELS.index(kind)] * len(one)
        f = filler()
        table.append((tokens + f, tags + [0] * len(f)))
    return table


class ShapeCRF:
    """Weights of features by label and of label pairs."""

    def __init__(self, emit: np.ndarray, move: np.ndarray) -> None:
        self.emit, self.move = emit, move

    @staticmethod
    def indices(tokens: list[str]) -> np.ndarray:
        """Features of each word and of its neighbours (the neighbours' apart from its own); an empty word is the edge."""
        own = [word_features(w) for w in tokens]
        none = word_features("")
        return np.array([a + tuple(SHAPES + x for x in p) + tuple(2 * SHAPES + x for x in n) for a, p, n in zip(own, [none, *own[:-1]], [*own[1:], none], strict=True)])

    def viterbi(self, sequences: list[list[str]]) -> list[np.ndarray]:
        """The best labels of each sequence; sequences of like lengths are padded and decoded in one batch."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(sequences)
        order = sorted((i for i, s in enumerate(sequences) if s), key=lambda i: len(sequences[i]))
        k = len(self.move)
        while order:
            longest = len(sequences[order[0]]) * 5 // 4 + 2
            group = [i for i in order[:4096] if len(sequences[i]) <= longest] if longest <= LONG else order[:1]
            order = order[len(group) :]
            lengths = np.array([len(sequences[i]) for i in group])
            t = int(lengths.max())
            e = np.zeros((len(group), t, k))
            flat = self.emit[self.indices([w for i in group for w in [*sequences[i], ""]])].sum(1)  # an empty word parts sequences
            at = 0
            for row, n in enumerate(lengths):
                e[row, :n] = flat[at : at + n]
                at += n + 1
            back = np.zeros((len(group), t, k), np.int8)
            best = e[:, 0]
            for j in range(1, t):
                step = best[:, :, None] + self.move[None]
                back[:, j] = step.argmax(1)
                inside = (j < lengths)[:, None]
                back[:, j] = np.where(inside, back[:, j], np.arange(k))
                best = np.where(inside, step.max(1) + e[:, j], best)
            tag = best.argmax(1)
            path = np.zeros((len(group), t), np.int64)
            for j in range(t - 1, -1, -1):
                path[:, j] = tag
                tag = np.take_along_axis(back[:, j], tag[:, None], 1)[:, 0]
            for row, i in enumerate(group):
                out[i] = path[row, : lengths[row]]
        return out


def train_crf(table: list[tuple[list[str], list[int]]], rounds: int = 150, rate: float = 2.0, penalty: float = 1e-3) -> ShapeCRF:
    """Gradient ascent on the conditional likelihood, all rows at once; no randomness."""
    k, b = len(LABELS), len(table)
    lengths = np.array([len(t) for t, _ in table])
    t = int(lengths.max())
    emit, move = np.zeros((3 * SHAPES, k)), np.zeros((k, k))
    x = [ShapeCRF.indices(tokens) for tokens, _ in table]
    rows = np.concatenate([np.full(n, i) for i, n in enumerate(lengths)])
    cols = np.concatenate([np.arange(n) for n in lengths])
    feats = np.concatenate(x)
    tags = np.concatenate([np.array(y) for _, y in table])
    gold_move = np.zeros((k, k))
    for _, y in table:
        np.add.at(gold_move, (y[:-1], y[1:]), 1)
    inside = np.arange(t)[None] < lengths[:, None]
    lse = lambda a, axis: (m := a.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis))
    for _ in range(rounds):
        e = np.zeros((b, t, k))
        e[rows, cols] = emit[feats].sum(1)
        fwd, bwd = np.zeros((b, t, k)), np.zeros((b, t, k))
        fwd[:, 0] = e[:, 0]
        for j in range(1, t):
            fwd[:, j] = np.where(inside[:, j, None], lse(fwd[:, j - 1, :, None] + move, 1) + e[:, j], fwd[:, j - 1])
        for j in range(t - 2, -1, -1):
            bwd[:, j] = np.where(inside[:, j + 1, None], lse(move + (e[:, j + 1] + bwd[:, j + 1])[:, None], 2), 0)
        z = lse(fwd[np.arange(b), lengths - 1], 1)
        p = np.exp(fwd + bwd - z[:, None, None])
        want = np.zeros((len(rows), k))
        want[np.arange(len(rows)), tags] = 1
        diff = want - p[rows, cols]
        g_emit = np.zeros_like(emit)
        for f in feats.T:
            np.add.at(g_emit, f, diff)
        g_move = gold_move.copy()
        for j in range(1, t):
            q = np.exp(fwd[:, j - 1, :, None] + move + (e[:, j] + bwd[:, j])[:, None] - z[:, None, None])
            g_move -= q[inside[:, j]].sum(0)
        emit += rate * (g_emit / b - penalty * emit)
        move += rate * (g_move / b - penalty * move)
    return ShapeCRF(emit, move)


def windows(text: str) -> list[list[tuple[int, int]]]:
    """Runs of words (start, end): each word with a digit or @ and AROUND words on either side, runs that meet joined."""
    words = [m.span() for m in TOKEN.finditer(text)]
    marks = np.zeros(len(words) + 1, np.int64)
    hits = sorted({*np.searchsorted([e for _, e in words], [m.start() for m in TRIGGER.finditer(text)], side="right").tolist()})
    for i in hits:
        marks[max(0, i - AROUND)] += 1
        marks[min(len(words), i + AROUND + 1)] -= 1
    covered = np.cumsum(marks)[:-1] > 0
    runs: list[list[tuple[int, int]]] = []
    for i in np.flatnonzero(covered):
        if i and covered[i - 1]:
            runs[-1].append(words[i])
        else:
            runs.append([words[i]])
    return runs


EDGES = ".,;:!?\"'[]{}<>#$%&*|="


def checked(kind: int, text: str, start: int, end: int) -> tuple[int, int, int] | None:
    """A span that the field proposes, without signs at its edges, if it is what its kind asks for."""
    while start < end and text[start] in EDGES:
        start += 1
    while end > start and text[end - 1] in EDGES:
        end -= 1
    s = text[start:end]
    n = len(digits(s))
    if kind == 0:
        good = re.fullmatch(r"[^\s@]+@[^\s@.]+(\.[^\s@.]+)+", s)
    elif kind == 1:
        good = is_ip(s)
    elif kind == 2:
        good = re.fullmatch(r"[0-9][0-9\s.-]*[0-9]", s) and 13 <= n <= 19 and luhn(digits(s))
    else:
        good = re.fullmatch(r"\(?\+?[0-9][0-9\s().-]*[0-9]", s) and 9 <= n <= 15 and re.search(r"[\s()+-]", s)
    return (kind, start, end) if good else None


def parts_of(kind: int, text: str, words: list[tuple[int, int]], free: Callable[[tuple[int, int, int]], bool]) -> list[tuple[int, int, int]]:
    """Spans within a run of words that as a whole is no span: of all ways to part it into spans that pass
    :func:`checked` and are ``free``, one that holds most words, of equal ones with fewest spans. A word that passes
    alone stands alone. A span has at most 19 digits and begins and ends in a word with a digit, so the ways from a word
    are few."""
    good = lambda i, k: (x := checked(kind, text, words[i][0], words[k][1])) is not None and free(x) and x
    sizes = [len(digits(text[a:b])) for a, b in words]
    alone = [good(i, i) for i in range(len(words))]
    best: list[tuple[int, int]] = [(0, 0)] * (len(words) + 1)
    pick: list[tuple[int, tuple[int, int, int]] | None] = [None] * len(words)
    for i in range(len(words) - 1, -1, -1):
        best[i] = best[i + 1]
        ways = [(i, alone[i])] if alone[i] else []
        n, k = sizes[i], i + 1
        while kind >= 2 and not alone[i] and 0 < sizes[i] and k < len(words) and not alone[k] and (n := n + sizes[k]) <= 19:
            if sizes[k] and (x := good(i, k)):
                ways.append((k, x))
            k += 1
        for k, x in ways:
            value = (best[k + 1][0] + k + 1 - i, best[k + 1][1] - 1)
            if value > best[i]:
                best[i], pick[i] = value, (k, x)
    out, i = [], 0
    while i < len(words):
        if pick[i] is None:
            i += 1
            continue
        k, x = pick[i]
        out.append(x)
        i = k + 1
    return out


def untouched(spans: list[tuple[int, int, int]]) -> Callable[[tuple[int, int, int]], bool]:
    """A function that says whether a span touches none of ``spans``, by a search in their order."""
    order = sorted((s, e) for _, s, e in spans)
    starts, ends = [s for s, _ in order], list(accumulate((e for _, e in order), max))

    def free(x: tuple[int, int, int]) -> bool:
        before = bisect_left(starts, x[2])  # these begin before x ends
        return not before or ends[before - 1] <= x[1]

    return free


def added_spans(texts: list[str], base: list[list[tuple[int, int, int]]], crf: ShapeCRF) -> list[list[tuple[int, int, int]]]:
    """For each text the field's spans that pass :func:`checked` and touch no base span, by kind, then start.

    Labels don't tell where an item begins, so neighbours of a kind are one run; a run that doesn't pass is parted."""
    where = [(i, run) for i, t in enumerate(texts) if TRIGGER.search(t) for run in windows(t)]
    paths = crf.viterbi([[texts[i][s:e] for s, e in run] for i, run in where])
    frees = {i: untouched(base[i]) for i, _ in where}
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (i, run), path in zip(where, paths, strict=True):
        free, j = frees[i], 0
        while j < len(run):
            k = j
            while k + 1 < len(run) and path[k + 1] == path[j]:
                k += 1
            if path[j]:
                kind = int(path[j]) - 1
                span = checked(kind, texts[i], run[j][0], run[k][1])
                out[i] += [span] if span and free(span) else parts_of(kind, texts[i], run[j : k + 1], free)
            j = k + 1
    return [sorted(x) for x in out]


@lru_cache(1)
def _crf() -> ShapeCRF:
    return train_crf(labelled_table())


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", crf: ShapeCRF | None = None) -> DataFrame:
    """One row for each row of ``df``: doc_id, and arrays kinds, starts, ends, is_base of all spans, by kind, then start.

    Offsets are code points, ends exclusive. The field is trained from :func:`labelled_table` if none is given; it
    reads every stretch of a text that holds a digit or an @, for no kind does without. A null text is an empty one and
    has no spans. Ids may be null or repeat, and repeated rows each get their spans; an empty table gives no rows; columns
    other than id and text (``kinds``, say) are left out. Whole texts and words of any length are read, in time in proportion
    to their length. Of labels that are equally good for a word the first of LABELS is taken. There is no shuffle.
    """
    crf = crf or _crf()

    def make():
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = b.column("text").to_pylist()
            kinds, starts, ends, own = [], [], [], []
            for i in range(0, len(texts), 512):
                part = texts[i : i + 512]
                base = [base_spans(t) for t in part]
                for one, two in zip(base, added_spans(part, base, crf), strict=True):
                    spans = sorted([(*s, True) for s in one] + [(*s, False) for s in two])
                    kinds.append([KINDS[s[0]] for s in spans])
                    starts.append([s[1] for s in spans])
                    ends.append([s[2] for s in spans])
                    own.append([s[3] for s in spans])
            return batch(doc_id=(b.column("doc_id"), None), kinds=(kinds, pa.list_(pa.string())), starts=(starts, pa.list_(pa.int32())), ends=(ends, pa.list_(pa.int32())), is_base=(own, pa.list_(pa.bool_())))

        return run

    rows = id_and_text(df, id_col, text_col)
    return map_batches(rows, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, kinds array<string>, starts array<int>, ends array<int>, is_base array<boolean>", make)


def digest_columns(found: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    spans = F.transform(F.arrays_zip("kinds", "starts", "ends", "is_base"), lambda x: F.struct(x["kinds"].alias("kind"), x["is_base"].alias("base"), F.concat_ws(":", x["kinds"], x["starts"].cast("string"), x["ends"].cast("string")).alias("s")))
    base = F.filter(spans, lambda x: x["base"])
    joined = lambda a: F.array_join(F.transform(a, lambda x: x["s"]), ",")
    count = lambda k: F.size(F.filter(base, lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(spans).alias("spans"))
