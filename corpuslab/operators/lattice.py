"""Decoding of candidates in layers with a back-off model: one path for each last word, or the best few as a beam.

A path carries the model's state, the words that the next one is scored on. All rows of a batch go forward together, a layer at
a time: every path is extended by every candidate of its row's layer, scored in one look-up of arrays, and cut. A model
that is too large to go along is joined instead, a layer at a time as well; both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.operators.language_model import AT_HAND, BOS, EOS, MILLION, PackedModel, packed, with_logp
from corpuslab.operators.storage import cut

#: Rows that go forward together.
TOGETHER = 512


@dataclass(frozen=True)
class Decoder:
    """``width`` None: the best path for each last word (of equal ones the first), else the best ``width`` paths of a layer.
    ``bos``: paths begin with the begin of a sentence, else without context. ``eos``: the chosen path's score has the end of
    the sentence in it, which has no part in the choice. ``each``: candidates of a layer that are tried, from the first.
    ``known``: candidates that the model lacks are left out."""

    width: int | None = None
    bos: bool = False
    eos: bool = False
    each: int | None = None
    known: bool = False


VITERBI = Decoder()
RESCORED = Decoder(bos=True, eos=True)
BEAM = Decoder(width=12, bos=True, each=12, known=True)


def _cut_paths(kind: Decoder, row: np.ndarray, cand: np.ndarray, rank: np.ndarray, order: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(kept, rank): the paths that go on, and the place of each among its row's, by which later ties are broken."""
    if kind.width is None:
        by = np.lexsort((rank, -score, cand, row))
        r, c = row[by], cand[by]
        kept = by[np.concatenate([[True], (r[1:] != r[:-1]) | (c[1:] != c[:-1])])] if len(by) else by
        kept = kept[np.lexsort((order[kept], row[kept]))]
    else:
        kept = np.lexsort((order, rank, -score, row))
        r = row[kept]
        kept = kept[np.arange(len(r)) - np.searchsorted(r, r) < kind.width]
    r = row[kept]
    return kept, np.arange(len(r)) - np.searchsorted(r, r)


def decode_arrays(layers: Sequence[Sequence[Sequence[str]]], model: PackedModel, kind: Decoder, place: int = 0) -> tuple[list[str], np.ndarray]:
    """(texts, millionths) of the path at ``place`` (of fewer the last) for each row's layers of candidates. A row without
    layers, or with a layer without candidates, has the empty text and the score 0."""
    n, before = len(layers), model.order - 1
    sizes = np.array([len(x) for x in layers], np.int64)
    names: dict[str, int] = {}
    empty = [-1] * before
    if kind.bos and before:
        empty[-1] = model.words.get(BOS, 0)
    row = np.flatnonzero(sizes > 0)
    rank, score, alive = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64), np.arange(len(row))
    state = [np.full(len(row), w, np.int64) for w in empty]
    trail: list[tuple[np.ndarray, np.ndarray]] = []  # of each layer's paths: their place in the layer before, their word
    texts, scores = [""] * n, np.zeros(n, np.int64)
    while len(row):
        # each row's candidates of this layer, without repeats, numbered over all rows
        own: dict[int, list[int]] = {}
        for r in np.unique(row).tolist():
            tried = list(dict.fromkeys(layers[r][len(trail)][: kind.each]))
            own[r] = [names.setdefault(c, len(names)) for c in tried if not kind.known or c in model.words]
        many = np.array([len(own[r]) for r in row.tolist()], np.int64)
        parent = np.repeat(np.arange(len(row)), many)
        cand = np.array([c for r in row.tolist() for c in own[r]], np.int64)
        order = np.arange(len(cand)) - np.repeat(np.cumsum(many) - many, many)
        used, of = np.unique(cand, return_inverse=True)
        back = list(names)
        word = model.ids([back[c] for c in used.tolist()])[of]
        grown = score[parent] + model.scores([x[parent] for x in state], word)
        kept, rank = _cut_paths(kind, row[parent], cand, rank[parent], order, grown)
        trail.append((alive[parent[kept]], cand[kept]))
        row, score = row[parent][kept], grown[kept]
        state = [*(x[parent][kept] for x in state[1:]), word[kept]] if before else []
        alive = np.arange(len(row))
        last = sizes[row] == len(trail)
        if last.any():
            at = np.flatnonzero(last)
            if kind.width is None:
                at = at[np.lexsort((at, -score[at], row[at]))]
            r = row[at]
            first, after = np.searchsorted(r, r), np.searchsorted(r, r, "right")
            at = at[np.arange(len(r)) - first == np.minimum(place, after - first - 1)]
            end = model.scores([x[at] for x in state], np.full(len(at), model.words.get(EOS, 0), np.int64)) if kind.eos else 0
            scores[row[at]] = score[at] + end
            path, words = at, []
            for up, own_words in reversed(trail):
                words.append(own_words[path])
                path = up[path]
            for k, r in enumerate(row[at].tolist()):
                texts[r] = "".join(back[x[k]] for x in reversed(words))
            go = ~last
            row, score, rank, alive, state = row[go], score[go], rank[go], alive[go], [x[go] for x in state]
    return texts, scores


def decode(rows: DataFrame, keys: Sequence[str], layers: str, model: DataFrame, kind: Decoder = VITERBI, place: int = 0, at_hand: int = AT_HAND) -> DataFrame:
    """(keys, text, score): the best path through each row's layers (array of arrays of words), or the one at ``place`` of a
    beam, of fewer paths the last; ``score`` is its logarithm. No layers, or one without candidates: the empty text and 0.
    Null layers count as none, null candidates aren't candidates. Models of more than ``at_hand`` n-grams are joined; then
    ``keys`` must tell the rows apart and not be null."""
    own = packed(model, at_hand)
    clean = F.transform(F.coalesce(layers, F.array().cast("array<array<string>>")), lambda a: F.filter(F.coalesce(a, F.array().cast("array<string>")), lambda c: c.isNotNull()))
    rows = rows.select(*keys, clean.alias("_layers"))
    if own is None:
        return _by_joins(rows, keys, model, kind, place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, TOGETHER):
                part = b.slice(i, TOGETHER)
                texts, scores = decode_arrays(part.column(len(keys)).to_pylist(), own, kind, place)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keys))), pa.array(texts, pa.string()), pa.array(scores / MILLION)], names=[*keys, "text", "score"])

    kinds = "".join(f"{k} {rows.schema[k].dataType.simpleString()}, " for k in keys)
    return rows.mapInArrow(run, f"{kinds}text string, score double")


def _by_joins(rows: DataFrame, keys: Sequence[str], model: DataFrame, kind: Decoder, place: int) -> DataFrame:
    """The same with states as rows, a round for each layer: each is joined with its row's candidates and with the model."""
    order = model.agg(F.max("order")).first()[0]
    before = [f"_before{i}" for i in range(order - 1)]
    rows = cut(rows)
    flat = rows.select(*keys, F.size("_layers").alias("_size"), F.posexplode("_layers").alias("_layer", "_tried"))
    tried = F.array_distinct(F.slice("_tried", 1, kind.each) if kind.each else F.col("_tried"))
    flat = flat.select(*keys, "_size", "_layer", F.posexplode(tried).alias("_order", "_word"))
    if kind.known:
        flat = flat.join(model.where("order = 1").select(F.get("ngram", F.lit(0)).alias("_word")), "_word", "left_semi")
    flat = cut(flat)
    paths = rows.where(F.size("_layers") > 0).select(*keys, *[F.lit(BOS if kind.bos and c == before[-1] else None).cast("string").alias(c) for c in before], F.lit(0).alias("_rank"), F.lit(0).cast("bigint").alias("_score"), F.lit("").alias("_text"))
    done: list[DataFrame] = []
    layer = 0
    while not paths.isEmpty():
        grown = paths.join(flat.where(F.col("_layer") == layer), list(keys))
        grown = with_logp(grown, before, "_word", model, order, "_p").withColumn("_score", F.col("_score") + F.col("_p"))
        if kind.width is None:
            first = Window.partitionBy(*keys, "_word").orderBy(F.desc("_score"), "_rank")
            grown = grown.withColumn("_first", F.row_number().over(first)).where("_first = 1")
            by: list[Column] = [F.col("_order")]
        else:
            by = [F.desc("_score"), F.col("_rank"), F.col("_order")]
        grown = grown.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*by)) - 1)
        if kind.width is not None:
            grown = grown.where(F.col("_rank") < kind.width)
        state = [F.col(c).alias(d) for c, d in zip([*before[1:], "_word"], before, strict=True)]
        grown = cut(grown.select(*keys, "_size", *state, "_rank", "_score", F.concat("_text", "_word").alias("_text")))
        done.append(grown.where(F.col("_size") == layer + 1).drop("_size"))
        paths = grown.where(F.col("_size") > layer + 1).drop("_size")
        layer += 1
    ended = reduce(DataFrame.unionByName, done, paths.where("false"))
    best = Window.partitionBy(*keys).orderBy(F.desc("_score"), "_rank")
    every = Window.partitionBy(*keys)
    chosen = ended.withColumn("_at", F.row_number().over(best) - 1).withColumn("_n", F.count("*").over(every)).where(F.col("_at") == F.least(F.lit(place), F.col("_n") - 1))
    if kind.eos:
        chosen = with_logp(chosen.withColumn("_end", F.lit(EOS)), before, "_end", model, order, "_p").withColumn("_score", F.col("_score") + F.col("_p"))
    same = reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])
    out = rows.select(*keys).alias("l").join(chosen.select(*keys, "_text", "_score").alias("r"), same, "left")
    return out.select(*[F.col(f"l.{k}").alias(k) for k in keys], F.coalesce("r._text", F.lit("")).alias("text"), (F.coalesce("r._score", F.lit(0)) / MILLION).alias("score"))

