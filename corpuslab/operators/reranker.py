"""A small causal transformer over characters, in numpy, run on Arrow batches."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

PAD, UNK, BOS = 0, 1, 2


def erf(x: np.ndarray) -> np.ndarray:
    """Abramowitz and Stegun 7.1.26."""
    z = np.abs(x)
    t = 1 / (1 + 0.3275911 * z)
    poly = t * (0.2548296 + t * (-0.28449674 + t * (1.4214137 + t * (-1.453152 + t * 1.0614054))))
    return np.sign(x) * (1 - poly * np.exp(-z * z))


@dataclass
class CharTransformer:
    """Weights by the names of the file format; ``vocab[i]`` is the token of id i."""

    weights: dict[str, np.ndarray]
    vocab: list[str]
    layers: int
    heads: int
    context: int

    def __post_init__(self) -> None:
        self.index = {t: i for i, t in enumerate(self.vocab) if len(t) == 1}

    @classmethod
    def random(cls, vocab: list[str], layers: int = 2, heads: int = 2, width: int = 16, context: int = 48, seed: int = 1) -> CharTransformer:
        """Untrained weights from a seed, for tests and timing."""
        r = np.random.default_rng(seed)
        w = {"tok.weight": r.normal(0, 0.2, (len(vocab), width)), "pos.weight": r.normal(0, 0.2, (context, width)), "ln_f.weight": np.ones(width), "ln_f.bias": np.zeros(width)}
        for i in range(layers):
            for name, rows, cols in (("qkv", 3 * width, width), ("proj", width, width), ("fc", 4 * width, width), ("out", width, 4 * width)):
                w[f"blocks.{i}.{name}.weight"], w[f"blocks.{i}.{name}.bias"] = r.normal(0, 0.2, (rows, cols)), np.zeros(rows)
            for name in ("ln1", "ln2"):
                w[f"blocks.{i}.{name}.weight"], w[f"blocks.{i}.{name}.bias"] = np.ones(width), np.zeros(width)
        return cls(w, vocab, layers, heads, context)

    def encode(self, text: str) -> list[int]:
        return [self.index.get(c, UNK) for c in text]

    def _norm(self, x: np.ndarray, name: str) -> np.ndarray:
        centred = x - x.mean(-1, keepdims=True)
        return centred / np.sqrt((centred * centred).mean(-1, keepdims=True) + 1e-5) * self.weights[f"{name}.weight"] + self.weights[f"{name}.bias"]

    def _linear(self, x: np.ndarray, name: str) -> np.ndarray:
        return x @ self.weights[f"{name}.weight"].T + self.weights[f"{name}.bias"]

    def log_probabilities(self, tokens: np.ndarray) -> np.ndarray:
        """Of the next token after each position of a batch (rows, positions)."""
        n = tokens.shape[1]
        x = self.weights["tok.weight"][tokens] + self.weights["pos.weight"][:n]
        hidden = np.triu(np.full((n, n), -np.inf), 1)
        for i in range(self.layers):
            b = f"blocks.{i}"
            q, k, v = (self._split(a) for a in np.split(self._linear(self._norm(x, f"{b}.ln1"), f"{b}.qkv"), 3, axis=-1))
            s = q @ k.swapaxes(-1, -2) / np.sqrt(q.shape[-1]) + hidden
            s = np.exp(s - s.max(-1, keepdims=True))
            a = (s / s.sum(-1, keepdims=True)) @ v
            x = x + self._linear(a.swapaxes(1, 2).reshape(x.shape), f"{b}.proj")
            h = self._linear(self._norm(x, f"{b}.ln2"), f"{b}.fc")
            x = x + self._linear(0.5 * h * (1 + erf(h / np.sqrt(2))), f"{b}.out")
        logits = self._norm(x, "ln_f") @ self.weights["tok.weight"].T
        top = logits.max(-1, keepdims=True)
        return logits - top - np.log(np.exp(logits - top).sum(-1, keepdims=True))

    def _split(self, a: np.ndarray) -> np.ndarray:
        return a.reshape(*a.shape[:2], self.heads, -1).swapaxes(1, 2)

    def score(self, context: str, candidates: list[str]) -> list[float]:
        """Mean log-probability of each candidate's characters after BOS and the tail of the context that leaves room;
        minus infinity for an empty one. What lies beyond the window of the model has no score: of a candidate that is longer
        only the characters that fit after BOS count. All candidates are one padded batch."""
        bodies = [self.encode(c[: self.context]) for c in candidates]
        longest = max((len(b) for b in bodies), default=0)
        room = max(0, self.context - 1 - longest)
        prefix = [BOS, *self.encode(context)[max(0, len(context) - room) :]] if room else [BOS]
        if not longest:
            return [float("-inf")] * len(candidates)
        batch = np.array([prefix + b + [PAD] * (longest - len(b)) for b in bodies])[:, : self.context]
        p = self.log_probabilities(batch)
        out = []
        for row, body in enumerate(bodies):
            at = np.arange(len(prefix) - 1, len(prefix) - 1 + len(body))
            out.append(float(p[row, at, body].mean()) if body else float("-inf"))
        return out

    def next_log_probabilities(self, text: str) -> np.ndarray:
        """Distribution of the character after BOS and the tail of a text."""
        tokens = [BOS, *self.encode(text)[max(0, len(text) - self.context + 1) :]]
        return self.log_probabilities(np.array([tokens]))[0, -1]


def score_candidates(rows: DataFrame, model: CharTransformer, key: str, context: str, candidates: str) -> DataFrame:
    """(key, scores): scores of each row's candidates. The model goes along with the function."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "scores": [model.score(c or "", [x or "" for x in a]) if a is not None and len(a) else [] for c, a in zip(pdf[context], pdf[candidates], strict=True)]})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, context, candidates).mapInPandas(run, f"{key} {kind}, scores array<double>")
