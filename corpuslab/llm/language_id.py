"""Language identification by error-correcting output codes."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.llm.common import batch, cut, held_out, id_and_text, keep_rows, map_batches, one_thread

#: Buckets of hashed byte n-grams, n = 1, 2, 3, as bits.
BITS_OF_BUCKETS = 12
BUCKETS = 1 << BITS_OF_BUCKETS
#: Labelled texts that train the classifiers: so many for each language at most, of many languages fewer of each, so that
#: there are no more than TEXTS in all; one of each at least. Every language is learnt.
TEXTS_EACH, TEXTS = 400, 25_600
#: Languages whose shares are broadcast to the texts, at most.
BROADCAST_LANGS = 10_000
#: Bits of a codeword for more than six languages, at least; ten times the logarithm of their number if that is more.
BITS = 31
#: Codes of which the one with the largest distances is taken, and up to how many languages they are compared.
DRAWN, COMPARED = 200, 512
#: Ridge penalty, and the steepness that turns losses into scores.
PENALTY, STEEPNESS = 0.3, 6.0
#: A text is ambiguous where the best codeword's score is below this.
AMBIGUOUS = 0.5

LETTER = regex.compile(r"\p{L}")
NOT_LETTERS = re.compile(r"[\W\d_]+")


def features(text: str) -> np.ndarray:
    """Root counts of hashed byte n-grams of the letters in lower case, of unit length."""
    raw = np.frombuffer((" " + NOT_LETTERS.sub(" ", text.lower()) + " ").encode(), np.uint8).astype(np.uint32)
    counts = np.bincount(raw, minlength=BUCKETS).astype(np.float32)
    two = raw[:-1] * np.uint32(257) + raw[1:]
    counts += np.bincount((two * np.uint32(2654435761)) >> np.uint32(32 - BITS_OF_BUCKETS), minlength=BUCKETS)
    three = two[:-1] * np.uint32(263) + raw[2:]
    counts += np.bincount((three * np.uint32(2246822519)) >> np.uint32(32 - BITS_OF_BUCKETS), minlength=BUCKETS)
    counts = np.sqrt(counts)
    return counts / np.sqrt(np.dot(counts, counts))


def code_columns(k: int) -> np.ndarray:
    """Codewords of ``k`` languages as rows of -1 and 1.

    Up to six languages have all different columns. More have drawn ones (with a fixed seed), none twice or as its
    opposite: of DRAWN codes that whose nearest rows, then columns, are farthest apart. Of more than COMPARED languages
    the first draw with different rows is taken, for distances of long random codewords differ little.
    """
    if k == 1:
        return np.ones((1, 1), np.float32)
    if k <= 6:
        cols = [(1, *c) for c in itertools.product((1, -1), repeat=k - 1)][1:]
        return np.array(cols, np.float32).T
    draw = np.random.default_rng(7)
    bits = max(BITS, int(np.ceil(10 * np.log2(k))))
    best, value = None, (-1, -1)
    for _ in range(DRAWN if k <= COMPARED else 20):
        cols: dict[bytes, np.ndarray] = {}
        while len(cols) < bits:
            c = draw.integers(0, 2, k, np.int8)
            c = c if c[0] else 1 - c
            if c.min() != c.max():
                cols.setdefault(c.tobytes(), c)
        code = np.array(list(cols.values()), np.float32).T * 2 - 1
        if len({r.tobytes() for r in code}) < k:
            continue
        if k > COMPARED:
            return code
        rows = (bits - (code @ code.T)) / 2 + np.eye(k) * bits
        apart = k - np.abs(code.T @ code) - np.eye(bits) * -k
        if (found := (int(rows.min()), int(apart.min()))) > value:
            best, value = code, found
    return best


@dataclass
class LanguageCode:
    """``langs[i]`` has the codeword ``code[i]``; column b of ``weights`` predicts bit b, whose loss counts ``trust[i, b]``
    for language i."""

    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Nearest codewords under a weighted hinge loss, and a softmax of the losses as the score. Of codewords that are
        equally near, the language that comes first in code-point order is taken."""
        langs: list[str] = ["und"] * len(texts)
        scores = [0.0] * len(texts)
        some = [i for i, t in enumerate(texts) if LETTER.search(t)]
        if some and self.langs:
            f = np.vstack([features(texts[i]) for i in some]) @ self.weights
            one, two = self.trust * (self.code > 0), self.trust * (self.code < 0)
            loss = np.maximum(0, 1 - f) @ one.T + np.maximum(0, 1 + f) @ two.T
            p = np.exp(-STEEPNESS * (loss - loss.min(1, keepdims=True)))
            p /= p.sum(1, keepdims=True)
            for i, best, row in zip(some, loss.argmin(1), p, strict=True):
                langs[i], scores[i] = self.langs[best], float(row[best])
        return langs, scores


def ridge(blocks: Callable[[], Iterator[np.ndarray]], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of ridge classifiers for the columns of ``y``, and what each predicts for a row when fitted to the others.
    ``blocks`` gives the rows anew each time it is called. Up to BUCKETS rows are held with their products, of more only
    a matrix of the features by the features; both ways give the same."""
    if len(y) <= BUCKETS:
        x = np.vstack(list(blocks()))
        inverse = np.linalg.inv(x @ x.T + PENALTY * np.eye(len(x), dtype=np.float32))
        alpha = inverse @ y
        return x.T @ alpha, y - alpha / np.diag(inverse)[:, None]
    square, sums, at = PENALTY * np.eye(BUCKETS, dtype=np.float32), np.zeros((BUCKETS, y.shape[1]), np.float32), 0
    for x in blocks():
        square += x.T @ x
        sums += x.T @ y[at : at + len(x)]
        at += len(x)
    inverse = np.linalg.inv(square)
    weights, out, at = inverse @ sums, [], 0
    for x in blocks():
        own = y[at : at + len(x)]
        h = np.minimum(np.einsum("ij,ij->i", x @ inverse, x), 0.999)[:, None]  # a row's leverage
        out.append((x @ weights - h * own) / (1 - h))
        at += len(x)
    return weights, np.concatenate(out)


def trusts(code: np.ndarray, of: np.ndarray, left_out: np.ndarray) -> np.ndarray:
    """For each language and bit how far its texts' left-out predictions lie on the codeword's side, 0 to 1 on average;
    the bits of a language sum to 1."""
    good = np.clip(left_out * code[of], 0.01, 1)
    sums = np.zeros(code.shape)
    np.add.at(sums, of, good)
    mean = sums / np.bincount(of, minlength=len(code))[:, None]
    return (mean / mean.sum(1, keepdims=True)).astype(np.float32)


@one_thread()
def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageCode:
    """Fits the code on labelled texts with a letter, ids of the held-out third left out.

    Of each language the texts with the smallest hashes of id and text are taken, TEXTS_EACH at most, which ids that are
    null or repeat don't change; their feature vectors, not their texts, go to the driver, one partition at a time. Bits are
    ridge classifiers; their losses are weighted for each language by predictions for texts left out of the fit. Without
    labelled texts, or where none has a letter, nothing is learnt, and a language without one isn't.
    """
    text = df[text_col]
    rows = df.where(~held_out(df[id_col]) & df[lang_col].isNotNull() & F.rlike(text, F.lit("\\p{L}"))).select(df[lang_col].alias("lang"), text.alias("text"), F.pmod(F.xxhash64(df[id_col], text), F.lit(1 << 30)).alias("h"))
    sizes = rows.groupBy("lang").count()
    k = sizes.count()
    if not k:
        return LanguageCode([], np.ones((0, 1), np.float32), np.zeros((BUCKETS, 1), np.float32), np.ones((0, 1), np.float32))
    each = max(1, min(TEXTS_EACH, TEXTS // k))
    share = sizes.select("lang", (F.lit(1 << 30) * F.least(F.lit(1.0), F.lit(2.0 * each + 50) / F.col("count"))).alias("below"))
    share = F.broadcast(share) if k <= BROADCAST_LANGS else share
    near = rows.join(share, "lang").where(F.col("h") < F.col("below"))  # twice what is wanted, and some
    chosen = near.withColumn("turn", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("turn") <= each).select("lang", "text")

    def make():
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = b.column("text").to_pylist()
            return batch(lang=(b.column("lang"), None), x=([features(t).astype(np.float16).tobytes() for t in texts], pa.binary()))

        return run

    vectors = cut(map_batches(chosen, "lang string, x binary", make))  # read three times, in the order in which it lies
    langs = sorted(r["lang"] for r in vectors.select("lang").distinct().collect())
    at = {a: i for i, a in enumerate(langs)}
    of = np.array([at[r["lang"]] for r in vectors.select("lang").toLocalIterator()])

    def blocks() -> Iterator[np.ndarray]:
        held = []
        for r in vectors.select("x").toLocalIterator():
            held.append(np.frombuffer(r["x"], np.float16).astype(np.float32))
            if len(held) == 512:
                yield np.vstack(held)
                held = []
        if held:
            yield np.vstack(held)

    code = code_columns(len(langs))
    weights, left_out = ridge(blocks, code[of])
    return LanguageCode(langs, code, weights, trusts(code, of, left_out))


def identify(df: DataFrame, model: LanguageCode, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: doc_id, held_out, lang_pred, score, ambiguous.

    ``und`` with score 0 is what a text gets that is null or has no letter. Whole texts count, of any length. Of languages
    whose codewords are equally near the first by name is given. Ids may be null (then never held out) or repeat; an empty
    table gives no rows, and columns other than id and text (``score`` or ``lang_pred``, say) are left out. The model
    (16 KB a bit) goes along with the function; there is no shuffle.
    """

    def make():
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = b.column("text").to_pylist()
            langs, scores = [], []
            for i in range(0, len(texts), 256):
                one, two = model.predict(texts[i : i + 256])
                langs += one
                scores += two
            return batch(doc_id=(b.column("doc_id"), None), lang_pred=(langs, pa.string()), score=(scores, pa.float64()), ambiguous=([x < AMBIGUOUS for x in scores], pa.bool_()))

        return run

    rows = id_and_text(df, id_col, text_col)
    out = map_batches(rows, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean", make)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def keep_identified(df: DataFrame, model: LanguageCode, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, whose text has a language: neither ``und`` nor ambiguous."""

    def make():
        def one(texts: list[str]) -> list[bool]:
            langs, scores = model.predict(texts)
            return [a != "und" and s >= AMBIGUOUS for a, s in zip(langs, scores, strict=True)]

        return one

    return keep_rows(df, text_col, make)
