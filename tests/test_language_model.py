"""Back-off models and decoders over them against plain Python."""

import itertools
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpuslab import registry
from corpuslab.operators import language_model as L
from corpuslab.operators import lattice
from corpuslab.sources.readers import arpa_ngrams


def plain_model(sentences, order=3):
    """{ngram: (p, backoff)} by loops, and how sentences are scored with it."""
    rows = [(L.BOS, *s, L.EOS) for s in sentences]
    counts = {order: Counter(r[i : i + order] for r in rows for i in range(len(r) - order + 1))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
        if k > 1:
            counts[k].update(r[:k] for r in rows if len(r) >= k)
    p, gamma = {}, {}
    for k in range(1, order + 1):
        n = [sum(v == j for v in counts[k].values()) for j in range(5)]
        d = L.FALLBACK
        if all(n[1:]):
            y = n[1] / (n[1] + 2 * n[2])
            e = tuple(j - (j + 1) * y * n[j + 1] / n[j] for j in (1, 2, 3))
            d = e if all(0 <= x <= j for j, x in enumerate(e, 1)) else d
        total, left = Counter(), Counter()
        for g, v in counts[k].items():
            total[g[:-1]] += v
            left[g[:-1]] += d[min(v, 3) - 1]
        gamma.update({h: left[h] / total[h] for h in total})
        for g, v in counts[k].items():
            own = (v - d[min(v, 3) - 1]) / total[g[:-1]]
            p[g] = own + gamma[g[:-1]] * (p[g[1:]] if k > 1 else 1 / (len(counts[1]) + 1))
        if k == 1:
            p[L.UNKNOWN,] = gamma[()] / (len(counts[1]) + 1)
    logs = {g: round(math.log10(x), 6) for g, x in p.items()} | {(L.BOS,): L.NEVER}
    weights = {h: round(math.log10(x), 6) if x > 0 else L.NEVER for h, x in gamma.items()}

    def log_p(context, w):
        known = lambda x: x if (x,) in logs else L.UNKNOWN
        h, w = tuple(known(x) for x in context)[-(order - 1) :], known(w)
        if (*h, w) in logs:
            return logs[(*h, w)]
        return weights.get(h, 0.0) + log_p(h[1:], w)

    return logs, weights, p, log_p


def some_sentences(seed=1, n=150, letters="abcd"):
    r = random.Random(seed)
    return [list(r.choice(["ab", "abc", "dab", "", "ccc"]) + "".join(r.choice(letters) for _ in range(r.randrange(5)))) for _ in range(n)]


def model_of(spark, sentences, order=3):
    return L.estimate(spark.createDataFrame([(s,) for s in sentences], "t array<string>").repartition(3), F.col("t"), order)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_model(spark, order):
    sentences = some_sentences()
    logs, weights, p, _ = plain_model(sentences, order)
    got = model_of(spark, [*sentences, None], order).collect()
    assert {tuple(r["ngram"]): r["logp"] for r in got} == pytest.approx(logs, abs=2e-6) and len(got) == len(logs)
    assert {tuple(r["ngram"]): r["backoff"] for r in got} == pytest.approx({g: weights.get(g, 0.0) if len(g) < order else 0.0 for g in logs}, abs=2e-6)
    assert all(r["order"] == len(r["ngram"]) for r in got)
    words = [w for (w,) in (g for g in logs if len(g) == 1) if w != L.BOS]
    log_p = plain_model(sentences, order)[3]
    for h in [(), ("a",), ("a", "b"), (L.BOS, "a"), ("x",), ("d", "d", "d"), (L.BOS,)]:
        assert sum(10 ** log_p(h, w) for w in words) == pytest.approx(1, abs=1e-4)


def test_model_without_sentences_and_of_one(spark):
    assert model_of(spark, []).collect() == [] == model_of(spark, [None]).collect()
    one = {tuple(r["ngram"]): 10 ** r["logp"] for r in model_of(spark, [["a"]]).collect()}
    assert one.keys() == {("a",), ("</s>",), ("<unk>",), ("<s>",), ("<s>", "a"), ("a", "</s>"), ("<s>", "a", "</s>")}
    assert one["a",] + one["</s>",] + one["<unk>",] == pytest.approx(1, abs=1e-5)
    empty = model_of(spark, [[], []]).collect()
    assert {tuple(r["ngram"]) for r in empty} == {("</s>",), ("<unk>",), ("<s>",), ("<s>", "</s>")}
    with pytest.raises(ValueError):
        model_of(spark, [["a"]], 1)


@pytest.mark.parametrize("bos,eos,at_hand", list(itertools.product([True, False], [True, False], [10**6, 0])))
def test_scores(spark, bos, eos, at_hand):
    sentences = some_sentences()
    model = model_of(spark, sentences).cache()
    log_p = plain_model(sentences)[3]
    texts = {1: list("abcd"), 2: list("zzab"), 3: [], 4: None, 5: list("ddddabzcc"), 6: ["<unk>", "a"], 7: list("ab") * 300}
    rows = spark.createDataFrame(list(texts.items()), "id long, t array<string>")
    got = {r["id"]: r for r in L.score_sentences(rows, ["id"], "t", model, bos, eos, at_hand).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        line = [*([L.BOS] if bos else []), *(t or []), *([L.EOS] if eos else [])]
        want = sum(log_p(line[max(0, k - 2) : k], line[k]) for k in range(bos, len(line)))
        assert got[i]["logp"] == pytest.approx(want, abs=3e-6 * (len(line) + 1))
        assert (got[i]["words"], got[i]["unknown"]) == (len(t or []), sum(w not in "abcd" for w in t or []))


def test_arpa_file(spark, tmp_path):
    model = model_of(spark, some_sentences()).cache()
    L.write_arpa(model, str(tmp_path / "arpa"))
    lines = [x for f in sorted((tmp_path / "arpa").glob("part-*")) for x in f.read_text().split("\n")[:-1]]
    sizes = Counter(len(r["ngram"]) for r in model.collect())
    assert lines[:5] == ["\\data\\", *[f"ngram {k}={sizes[k]}" for k in (1, 2, 3)], ""] and lines[-1] == "\\end\\"
    for k in (1, 2, 3):
        at = lines.index(f"\\{k}-grams:")
        assert lines[at + sizes[k] + 1] == "" and all(len(x.split("\t")[1].split(" ")) == k for x in lines[at + 1 : at + sizes[k] + 1])
    back = {(r["order"], *r["ngram"]): (r["logp"], r["backoff"]) for r in L.read_arpa(spark.read.text(str(tmp_path / "arpa"))).collect()}
    assert back == {(r["order"], *r["ngram"]): (r["logp"], r["backoff"]) for r in model.collect()}
    assert {r["ngram"]: r["logp"] for r in arpa_ngrams(spark, str(tmp_path / "arpa"), 2).collect()} == {" ".join(k[1:]): v[0] for k, v in back.items() if k[0] == 2}
    with pytest.raises(ValueError):
        L.write_arpa(model_of(spark, [["a b"]]), str(tmp_path / "none"))


def plain_paths(layers, log_p, kind, letters="abcd"):
    """Paths (text, score) in order, as the decoder keeps them."""
    paths = [((L.BOS,) if kind.bos else (), 0)]
    for layer in layers:
        tried = list(dict.fromkeys(layer[: kind.each]))
        grown = [(t + (c,), s + round(1e6 * log_p(t[-2:], c))) for t, s in paths for c in tried if not (kind.known and c not in set(letters))]
        if kind.width is None:
            paths = [max((g for g in grown if g[0][-1] == c), key=lambda g: g[1]) for c in tried]
        else:
            paths = sorted(grown, key=lambda g: -g[1])[: kind.width]
    return paths


@pytest.mark.parametrize("at_hand", [10**6, 0])
@pytest.mark.parametrize("name,kind,place", [("viterbi", lattice.VITERBI, 0), ("rescored", lattice.RESCORED, 0), ("beam", lattice.BEAM, 0), ("third", lattice.Decoder(width=3, bos=True), 2)])
def test_decoders(spark, monkeypatch, at_hand, name, kind, place):
    monkeypatch.setattr(lattice, "TOGETHER", 7)
    sentences = some_sentences()
    model = model_of(spark, sentences).cache()
    log_p = plain_model(sentences)[3]
    r = random.Random(4)
    rows = {i: [[r.choice("abcdz") for _ in range(r.choice([1, 2, 3, 14]))] for _ in range(r.randrange(7))] for i in range(25 if at_hand else 8)}
    rows |= {100: None, 101: [["a"], [], ["b"]], 102: [["z"]], 103: [["a", None, "b"]], 104: [["ab"], ["d"]], 105: [None]}
    df = spark.createDataFrame(list(rows.items()), "id long, layers array<array<string>>")
    got = {x["id"]: (x["text"], x["score"]) for x in lattice.decode(df, ["id"], "layers", model, kind, place, at_hand).collect()}
    assert got.keys() == rows.keys()
    for i, layers in rows.items():
        layers = [[c for c in x or [] if c is not None] for x in layers or []]
        paths = plain_paths(layers, log_p, kind) if layers and all(layers) else []
        if not paths:
            assert got[i] == ("", 0.0)
            continue
        path, score = max(paths, key=lambda p: p[1]) if kind.width is None else paths[min(place, len(paths) - 1)]
        if kind.eos:
            score += round(1e6 * log_p(path[-2:], L.EOS))
        assert got[i] == ("".join(path[kind.bos :]), pytest.approx(score / 1e6, abs=1e-9))


def test_long_row(spark):
    """A row of many layers goes forward in linear time and memory."""
    model = model_of(spark, some_sentences()).cache()
    df = spark.createDataFrame([(1, [["a", "b"]] * 5000)], "id long, layers array<array<string>>")
    assert len(lattice.decode(df, ["id"], "layers", model).first()["text"]) == 5000


@pytest.mark.parametrize("name,kind,place", [("d01_viterbi_words", lattice.VITERBI, 0), ("d02_viterbi_rescored", lattice.RESCORED, 0), ("d03_beam", lattice.BEAM, 0), ("t04_beam_top", lattice.Decoder(width=3, bos=True, known=True), 2)])
def test_decoders_of_all_words(spark, tmp_path, name, kind, place):
    """Every word, long, repeated and empty ones too, by the model of the benchmark's words."""
    texts = ["the the  cat", "Zz y.\n a", "", "é9 " + "abcxyz" * 7, "ab ab ab cd"]
    known = ["abcdef aabbcc defabc abab", "xyz the bat\ncat dog é. xz xy ya"]
    spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(texts)], "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    spark.createDataFrame([(str(i), t) for i, t in enumerate(known)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["word"]: r for r in registry.queries()[name](spark, str(tmp_path)).collect()}
    words = [w for t in texts for w in re.split("[ \n]", t.lower())]
    assert {w: r["n"] for w, r in got.items()} == Counter(words) and "" in got and max(map(len, got)) == 42
    sentences = [list(w) for t in known for w in re.split("[ \n]", t.lower()) if w]
    letters, log_p = {c for w in sentences for c in w}, plain_model(sentences)[3]
    for word, r in got.items():
        layers = [list(dict.fromkeys(chr(97 + (ord(c) - 97 + k) % 26) for k in range(3))) if "a" <= c <= "z" else [c] for c in word]
        paths = plain_paths(layers, log_p, kind, letters) if word else []
        if not paths:
            assert (r["text"], r["score"]) == ("", 0.0)
            continue
        path, score = max(paths, key=lambda p: p[1]) if kind.width is None else paths[min(place, len(paths) - 1)]
        score += round(1e6 * log_p(path[-2:], L.EOS)) if kind.eos else 0
        assert (r["text"], r["score"]) == ("".join(path[kind.bos :]), pytest.approx(score / 1e6, abs=1e-9))
