"""Toxicity by a linear classifier of character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.llm.common import batch, cut, held_out, id_and_text, map_batches, one_thread

#: Lengths of n-grams in characters (code points), and bits of their hashes.
LENGTHS = (4, 5, 6)
HASH_BITS = 20
#: Labelled texts of each class that train the classifier, at most.
TEXTS_EACH = 1500
#: A feature counts if so many training texts have it, and if the likelihood ratio of its being as frequent in both classes
#: is as large as this (chance gives that to one feature in a thousand).
LEAST_TEXTS, LEAST_EVIDENCE = 3, 11.0
#: What a text of the rarer class weighs beside one of the other, at most; less where the classes are more even.
RARER = 3.0
#: Tasks that count the features of the training texts.
TASKS = 4
ROUNDS, RATE, PENALTY = 600, 0.5, 1e-4
THRESHOLD = 0.7
#: Characters of a text that are hashed at a time.
STRETCH = 1 << 19


def present(text: str, table: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the character n-grams of a text in lower case, each once; with ``table`` only those it marks."""
    raw = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le"), "<u4")
    found = []
    for start in range(0, len(raw), STRETCH):
        part = raw[start : start + STRETCH + max(LENGTHS) - 1]
        h = np.zeros(len(part), np.uint32)
        for n in range(1, max(LENGTHS) + 1):
            if len(part) < n:
                break
            h = h[: len(part) - n + 1] * np.uint32(16777619) + part[n - 1 :]
            if n in LENGTHS:
                x = ((h ^ (h >> np.uint32(15))) * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(32 - HASH_BITS)
                found.append(x[table[x]] if table is not None else x)
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint32)


@dataclass
class ToxicityModel:
    """``hashes`` (ascending) of the features and their weights, which hold the log-count ratios already."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self.table = np.zeros(1 << HASH_BITS, bool)
        self.table[self.hashes] = True

    def score(self, text: str) -> float:
        x = present(text, self.table)
        z = self.bias + float(self.weights[np.searchsorted(self.hashes, x)].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def select(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> tuple[np.ndarray, np.ndarray]:
    """Features that count, and their log-count ratios, from the numbers of texts of each class that have them."""
    n, both = n_pos + n_neg, pos + neg
    evidence = np.zeros(len(pos))
    for seen, total, texts in ((pos, both, n_pos), (neg, both, n_neg), (n_pos - pos, n - both, n_pos), (n_neg - neg, n - both, n_neg)):
        some = seen > 0
        evidence[some] += 2 * seen[some] * np.log(seen[some] * n / (total[some] * texts))
    hashes = np.flatnonzero((both >= LEAST_TEXTS) & (evidence >= LEAST_EVIDENCE))
    ratio = np.log((pos[hashes] + 1) / (n_pos + 2)) - np.log((neg[hashes] + 1) / (n_neg + 2))
    return hashes, ratio


def fit(rows: list[tuple[np.ndarray, int]], hashes: np.ndarray, r: np.ndarray) -> ToxicityModel:
    """A logistic regression over presence times ratio; full batches, so the same rows in the same order give the same
    model. With one class only, its share is all that is learnt."""
    y = np.array([k for _, k in rows], np.float32)
    if not len(rows) or y.min() == y.max():
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), -3.0 if not len(rows) or y[0] == 0 else 3.0)
    share = y.mean()
    weight = np.where(y == (share < 0.5), min(RARER, max(share, 1 - share) / min(share, 1 - share)), 1.0)
    weight /= weight.sum()
    col = np.searchsorted(hashes, np.concatenate([x for x, _ in rows]))
    row = np.repeat(np.arange(len(rows)), [len(x) for x, _ in rows])
    w, bias = np.zeros(len(hashes)), 0.0
    length = np.sqrt(np.bincount(row, r[col] ** 2, len(rows))).mean() + 1e-9  # keeps the steps of a fit size
    for _ in range(ROUNDS):
        z = bias + np.bincount(row, (w * r)[col], len(rows))
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        w -= RATE * (np.bincount(col, g[row], len(hashes)) * r / length + PENALTY * w)
        bias -= RATE * g.sum() * 4
    return ToxicityModel(hashes, w * r, bias)


def presence_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """For each feature the texts of either class that have it. TASKS tasks count; each sends two arrays of a fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros((2, 1 << HASH_BITS), np.uint16), [0, 0]
        for b in batches:
            for text, y in zip(b.column("text").to_pylist(), b.column("_y").to_pylist(), strict=True):
                counts[y][present(text)] += 1
                n[y] += 1
        yield batch(c=([zlib.compress(counts.tobytes(), 1)], pa.binary()), pos=([n[1]], pa.int64()), neg=([n[0]], pa.int64()))

    total, n_pos, n_neg = np.zeros((2, 1 << HASH_BITS), np.int64), 0, 0
    for r in rows.repartition(TASKS).mapInArrow(run, "c binary, pos long, neg long").toLocalIterator():
        total += np.frombuffer(zlib.decompress(r["c"]), np.uint16).reshape(2, -1)
        n_pos, n_neg = n_pos + r["pos"], n_neg + r["neg"]
    return total[1], total[0], n_pos, n_neg


@one_thread()
def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Fits on labelled texts of ``df``, ids of the held-out third left out: of each class TEXTS_EACH rows at most, those
    with the smallest hashes of their ids, and of more rows by repeated ids those with the smallest hashes of id and text.
    Neither texts nor their n-grams go to the driver: counts of a fixed size do, and then for each text which of the chosen
    features it has. Labels that are null or contradict each other for one id aren't used; empty tables teach nothing."""
    mark = labels.where(labels[label_col].isNotNull() & ~held_out(labels[id_col])).groupBy(labels[id_col].alias("_id")).agg(F.min(label_col).alias("_lo"), F.max(label_col).alias("_hi")).where("_lo = _hi")
    mark = mark.select("_id", (F.col("_lo") > 0).cast("int").alias("_y"), F.pmod(F.xxhash64("_id"), F.lit(1 << 30)).alias("_h"))
    sizes = {r["_y"]: r["count"] for r in mark.groupBy("_y").count().collect()}
    upto = lambda k: int((1 << 30) * min(1.0, TEXTS_EACH / max(1, sizes.get(k, 0))))
    mark = mark.where(F.col("_h") < F.when(F.col("_y") == 1, upto(1)).otherwise(upto(0))).select("_id", "_y")
    met = id_and_text(df, id_col, text_col).join(F.broadcast(mark), F.col("doc_id") == F.col("_id")).withColumn("_h", F.xxhash64("doc_id", "text"))
    turn = F.row_number().over(Window.partitionBy("_y").orderBy("_h", "text"))  # ranked map-side first
    rows = cut(met.withColumn("_turn", turn).where(F.col("_turn") <= TEXTS_EACH).select("doc_id", "text", "_y"))
    hashes, ratio = select(*presence_counts(rows))
    table = np.zeros(1 << HASH_BITS, bool)
    table[hashes] = True

    def make():
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            x = [present(t, table).astype("<u4").tobytes() for t in b.column("text").to_pylist()]
            return batch(id=(b.column("doc_id"), None), x=(x, pa.binary()), y=(b.column("_y"), None))

        return run

    kind = rows.schema["doc_id"].dataType.simpleString()
    got = sorted(((r["id"], r["x"], r["y"]) for r in map_batches(rows, f"id {kind}, x binary, y int", make).collect()))
    return fit([(np.frombuffer(x, "<u4"), y) for _, x, y in got], hashes, ratio)


def score_toxicity(df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: doc_id, held_out, score, predicted.

    A feature counts once however often a text has it, so a toxic passage weighs the same in a long text. A null text
    is an empty one and gets the score of no feature. Texts with the same features get the same score; repeated rows
    each get theirs. Ids may be null (then never held out) or repeat; an empty table gives no rows, and columns other than
    id and text (``score`` or ``held_out``, say) are left out. There is no shuffle.
    """

    def make():
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            scores = [model.score(t) for t in b.column("text").to_pylist()]
            return batch(doc_id=(b.column("doc_id"), None), score=(scores, pa.float64()), predicted=([int(s >= THRESHOLD) for s in scores], pa.int32()))

        return run

    rows = id_and_text(df, id_col, text_col)
    out = map_batches(rows, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, predicted int", make)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
