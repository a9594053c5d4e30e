"""Language, toxicity and the pipeline: held-out accuracy, edge cases, and the stages against plain Python."""

import hashlib
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpuslab.llm import common, exact_dedup, language_id, toxicity
from corpuslab.llm.shingles import shingle_strings

DATA = "/root/testdata/sf0.01"


def held(d):
    return zlib.crc32(str(d).encode()) % 3 == 1


def test_language(spark):
    docs = common.as_table(spark, DATA, "documents")
    model = language_id.train(docs)
    got = language_id.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 for r in got)
    out = [r for r in got if r["held_out"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.99
    odd = spark.createDataFrame([(1, None, "x"), (None, "", "x"), (3, "12 $$ 34", "x"), (4, "é", "x"), (4, "the and of " * 20000, "x")], "doc_id long, text string, lang_pred string")
    rows = {(r["doc_id"], r["lang_pred"]) for r in language_id.identify(odd, model).collect()}
    assert {(1, "und"), (None, "und"), (3, "und"), (4, "en")} <= rows and len(rows) in (4, 5)
    assert language_id.identify(odd.where("false"), model).collect() == []
    kept = language_id.keep_identified(odd, model).collect()
    assert {r["doc_id"] for r in kept} <= {4} and kept and set(kept[0].asDict()) == {"doc_id", "text", "lang_pred"}


def test_language_without_or_with_one_label(spark):
    docs = spark.createDataFrame([(i, "the cat of the house", None if i else "en") for i in range(6)], "doc_id long, text string, lang string")
    none = language_id.train(docs.where("lang is null"))
    assert {r["lang_pred"] for r in language_id.identify(docs, none).collect()} == {"und"}
    assert {r["lang_pred"] for r in language_id.identify(docs, language_id.train(docs.withColumn("lang", F.lit("en")))).collect()} == {"en"}


def test_every_language_is_learnt(spark):
    """op8: more languages than a code of the usual length is for."""
    word = lambda i, k: "".join(chr(97 + int(c, 16)) for c in hashlib.md5(f"{i} {k % 12}".encode()).hexdigest()[:6])
    rows = [(i * 50 + j, " ".join(word(i, j + k) for k in range(8)), f"l{i}") for i in range(90) for j in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = language_id.train(docs)
    assert model.langs == sorted({r[2] for r in rows})
    lang = {r[0]: r[2] for r in rows}
    got = language_id.identify(docs, model).collect()
    assert np.mean([lang[r["doc_id"]] == r["lang_pred"] for r in got]) > 0.95
    for k in (65, 1000, 5000):
        assert len({x.tobytes() for x in language_id.code_columns(k)}) == k


@pytest.mark.parametrize("ids", ["null", "same"])
def test_sample_of_texts_is_bounded(spark, monkeypatch, ids):
    """op8: null and repeated ids, also of equal texts."""
    seen = []
    monkeypatch.setattr(language_id, "map_batches", lambda df, *a: seen.append(df.groupBy("lang").count().collect()) or common.map_batches(df, *a))
    n = F.lit(None).cast("long") if ids == "null" else F.lit(7)
    docs = spark.range(3000).select(n.alias("doc_id"), F.when(F.col("id") % 3 == 0, "one and the same").otherwise(F.concat_ws(" ", F.lit("words"), F.md5(F.col("id").cast("string")))).alias("text"), F.when(F.col("id") < 2900, "a").otherwise("b").alias("lang"))
    language_id.train(docs)
    assert {r["lang"]: r["count"] for r in seen[0]} == {"a": language_id.TEXTS_EACH, "b": 100}


def test_shares_of_languages_are_broadcast_or_joined(spark, monkeypatch):
    """op8: the same sample, so the same classifiers."""
    docs = common.as_table(spark, "/root/testdata/sf0.001", "documents")
    one = language_id.train(docs)
    monkeypatch.setattr(language_id, "BROADCAST_LANGS", 0)
    two = language_id.train(docs)
    assert one.langs == two.langs and np.allclose(one.weights, two.weights, atol=1e-5)


def test_codewords_are_far_apart():
    """op8: rows, and columns neither equal nor opposite."""
    for k, least in ((2, 1), (3, 2), (4, 4), (6, 16), (7, 12), (20, 12), (64, 16)):
        c = language_id.code_columns(k)
        assert min((c[i] != c[j]).sum() for i in range(k) for j in range(i)) >= least
        assert k == 2 or len({tuple(x * x[0]) for x in c.T}) == c.shape[1]


def plain_features(text):
    """op8: hashed n-grams by loops."""
    raw = (" " + re.sub(r"[\W\d_]+", " ", text.lower()) + " ").encode()
    counts = [0.0] * language_id.BUCKETS
    shift = 32 - language_id.BITS_OF_BUCKETS
    for i, x in enumerate(raw):
        counts[x] += 1
        if i + 1 < len(raw):
            two = x * 257 + raw[i + 1]
            counts[two * 2654435761 % 2**32 >> shift] += 1
            if i + 2 < len(raw):
                counts[(two * 263 + raw[i + 2]) % 2**32 * 2246822519 % 2**32 >> shift] += 1
    size = sum(counts) ** 0.5
    return [c**0.5 / size for c in counts]


def plain_language(model, text):
    """op8: the prediction by loops: bits, weighted hinge losses, the first nearest codeword, softmax."""
    if not any(c.isalpha() for c in text):
        return "und", 0.0
    x = plain_features(text)
    bits = [sum(v * float(model.weights[i, b]) for i, v in enumerate(x) if v) for b in range(model.weights.shape[1])]
    losses = [sum(float(model.trust[k, b]) * max(0.0, 1 - float(model.code[k, b]) * f) for b, f in enumerate(bits)) for k in range(len(model.langs))]
    best = min(range(len(losses)), key=lambda k: (losses[k], k))
    return model.langs[best], 1 / sum(np.exp(-language_id.STEEPNESS * (v - losses[best])) for v in losses)


ODD_TEXTS = ["", " ", "12 $$", "\u00bd \u00b2", "é", "\u4e2d", "a1b", "_", "İß ΣΑΣ", "x" * 3000, "the and of " * 500]


def test_language_as_plain_loops(spark):
    docs = common.as_table(spark, "/root/testdata/sf0.001", "documents")
    model = language_id.train(docs)
    texts = ODD_TEXTS + [r["text"] or "" for r in docs.orderBy("doc_id").limit(40).collect()]
    langs, scores = model.predict(texts)
    for t, a, s in zip(texts, langs, scores):
        want, p = plain_language(model, t)
        assert a == want and s == pytest.approx(p, abs=1e-4), t[:40]


@pytest.mark.parametrize("way", ["rows", "features"])
def test_predictions_of_what_is_left_out(monkeypatch, way):
    """op8: the closed form for rows left out, held against fits without them."""
    monkeypatch.setattr(language_id, "BUCKETS", 30 if way == "rows" else 8)
    r = np.random.default_rng(3)
    x, y = r.normal(size=(20, language_id.BUCKETS)).astype(np.float32), np.sign(r.normal(size=(20, 3))).astype(np.float32)
    weights, out = language_id.ridge(lambda: iter([x[:7], x[7:]]), y)
    fit = lambda a, b: np.linalg.solve(a.T @ a + language_id.PENALTY * np.eye(a.shape[1]), a.T @ b)
    assert np.allclose(weights, fit(x, y), atol=1e-3)
    for i in range(20):
        rest = np.arange(20) != i
        assert np.allclose(out[i], x[i] @ fit(x[rest], y[rest]), atol=2e-3)


def test_labels_without_letters(spark):
    """op8: such texts teach nothing, alone or beside others."""
    rows = [(i, "12 34", "xx") for i in range(9)]
    none = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert none.langs == [] and none.predict(["some words", "1"]) == (["und", "und"], [0.0, 0.0])
    mixed = language_id.train(spark.createDataFrame([*rows, *((20 + i, "the cat", "en") for i in range(6)), (40, None, "fr"), (41, "le chat", None)], "doc_id long, text string, lang string"))
    assert mixed.langs == ["en"]


def test_equally_near_codewords():
    """op8: the first language by name."""
    model = language_id.LanguageCode(["a", "b"], np.array([[1], [-1]], np.float32), np.zeros((language_id.BUCKETS, 1), np.float32), np.ones((2, 1), np.float32))
    assert model.predict(["words"]) == (["a"], [0.5])


def plain_toxicity(model, text):
    """op7: the score by loops over the character n-grams of a text."""
    t = [ord(c) for c in " " + text.lower() + " "]
    seen = set()
    for n in toxicity.LENGTHS:
        for i in range(len(t) - n + 1):
            h = 0
            for c in t[i : i + n]:
                h = (h * 16777619 + c) % 2**32
            seen.add(((h ^ (h >> 15)) * 2654435761 + n * 40503) % 2**32 >> (32 - toxicity.HASH_BITS))
    weight = dict(zip(model.hashes.tolist(), model.weights.tolist()))
    z = model.bias + sum(weight.get(h, 0.0) for h in sorted(seen))
    return 1 / (1 + np.exp(-min(30, max(-30, z))))


def test_toxicity_as_plain_loops(spark, monkeypatch):
    docs, labels = common.as_table(spark, DATA, "documents"), common.as_table(spark, DATA, "labels")
    model = toxicity.train(docs, labels)
    texts = ODD_TEXTS + ["ты идиот, дурак", *(r["text"] or "" for r in docs.orderBy("doc_id").limit(60).collect())]
    for t in texts:
        assert model.score(t) == pytest.approx(plain_toxicity(model, t), abs=1e-9)
    whole = toxicity.present("ab" * 3000 + "é" * 50)
    monkeypatch.setattr(toxicity, "STRETCH", 100)  # stretches lose no n-gram
    assert (toxicity.present("ab" * 3000 + "é" * 50) == whole).all()


def test_sample_of_marked_texts_is_bounded(spark, monkeypatch):
    """op7: ids that many rows share."""
    monkeypatch.setattr(toxicity, "TEXTS_EACH", 20)
    seen = []
    monkeypatch.setattr(toxicity, "presence_counts", lambda rows, f=toxicity.presence_counts: seen.append({r["_y"]: r["count"] for r in rows.groupBy("_y").count().collect()}) or f(rows))
    docs = spark.range(3000).select((F.col("id") % 3).alias("doc_id"), F.concat_ws(" ", F.lit("words"), F.when(F.col("id") % 2 == 0, F.md5(F.col("id").cast("string"))).otherwise("alike")).alias("text"))
    toxicity.train(docs, spark.createDataFrame([(0, 1), (1, 0), (2, 0), (2, 0), (None, 1)], "doc_id long, toxic int"))
    assert seen and all(n <= 20 for n in seen[0].values())


def test_models_on_clashing_columns(spark):
    odd = spark.createDataFrame([(1, "the cat and the dog", "en", 0.5, True, 1), (None, None, None, None, None, None), (1, "the cat and the dog", "en", 0.5, True, 1)], "doc_id long, text string, lang string, score double, held_out boolean, predicted int")
    labels = spark.createDataFrame([(1, 1, "x", 0.5)], "doc_id long, toxic int, text string, score double")
    got = toxicity.score_toxicity(odd, toxicity.train(odd, labels)).collect()
    assert len(got) == 3 and set(got[0].asDict()) == {"doc_id", "held_out", "score", "predicted"}
    got = language_id.identify(odd, language_id.train(odd)).collect()
    assert len(got) == 3 and set(got[0].asDict()) == {"doc_id", "held_out", "lang_pred", "score", "ambiguous"}


@pytest.mark.parametrize("sf,least", [("0.01", 0.95), ("0.1", 0.95)])
def test_toxicity(spark, sf, least):
    """The smaller table has 33 toxic texts to learn from, the larger some 300. Measured: 0.965 and 0.963; in either some
    texts are marked that hold none of the words that others are marked for."""
    data = f"/root/testdata/sf{sf}"
    docs, labels = common.as_table(spark, data, "documents"), common.as_table(spark, data, "labels")
    model = toxicity.train(docs, labels)
    got = toxicity.score_toxicity(docs, model).join(labels, "doc_id").collect()
    assert all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    out = [r for r in got if r["held_out"]]
    clean, toxic = [r["score"] for r in out if not r["toxic"]], [r["score"] for r in out if r["toxic"]]
    assert np.mean([t > c for t in toxic for c in clean]) > least
    assert np.mean([s >= 0.7 for s in clean]) < 0.02
    long = " ".join(["the and of"] * 30000) + " you pathetic worthless idiot scum " + " ".join(["in on at"] * 30000)
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, long)], "doc_id long, text string")
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(odd, model).collect()}
    assert scores[1] == scores[2] < 0.5 and scores[3] >= 0.7
    assert toxicity.score_toxicity(odd.where("false"), model).collect() == []


def test_toxicity_with_one_class_or_none(spark):
    docs = spark.createDataFrame([(i, "some words here") for i in range(9)], "doc_id long, text string")
    one = spark.createDataFrame([(i, 0) for i in range(9)], "doc_id long, toxic int")
    assert {r["predicted"] for r in toxicity.score_toxicity(docs, toxicity.train(docs, one)).collect()} == {0}
    assert {r["predicted"] for r in toxicity.score_toxicity(docs, toxicity.train(docs, one.where("false"))).collect()} == {0}


def test_pipeline_as_plain_python(spark):
    sf = "/root/testdata/sf0.001"
    docs = common.as_table(spark, sf, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "BPE encoding and decoding"]
    rows = [r.asDict() for r in docs.collect()]
    model = language_id.train(docs)
    said = [plain_language(model, r["text"] or "") for r in rows]
    rows = [r for r, (a, s) in zip(rows, said) if a != "und" and s >= language_id.AMBIGUOUS]
    best = {}
    for r in rows:
        k = re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")
        if k not in best or (-len(r["text"]), r["doc_id"]) < (-len(best[k]["text"]), best[k]["doc_id"]):
            best[k] = r
    rows = sorted(best.values(), key=lambda r: r["doc_id"])
    sets = [shingle_strings(r["text"]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if inter and 100 * inter >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    rows = [(r, s) for i, (r, s) in enumerate(zip(rows, sets)) if find(i) == i]
    items = [shingle_strings(r["text"]) for r in common.as_table(spark, sf, "benchmark").collect()]
    want = [r for r, s in rows if not any(x and len(x & s) >= 0.75 * len(x) for x in items)]
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(common.tokenizer_path("word_bpe_49k.json"))
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r["doc_id"], r["ids"]) for r in got) == sorted((r["doc_id"], lib.encode(r["text"], add_special_tokens=False).ids) for r in want)


def test_stages_keep_columns(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the cat and the dog of the house", "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0)], common.as_table(spark, DATA, "documents").schema)
    sf = "/root/testdata/sf0.001"
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[1:-1]):
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, i
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
    assert sorted(r["doc_id"] for r in docs.collect()) == [1, 2]  # null and empty are one text
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).collect() == []


def test_stages_on_clashing_columns(spark):
    """Columns named like what a stage adds stay as they are, in all stages but the last."""
    sf = "/root/testdata/sf0.001"
    names = "lang_pred score kept keep_id _sha _len _turn gid n fp _id _kept component_id n_item ids n_tokens".split()
    docs = common.as_table(spark, sf, "documents").where("doc_id < 60").select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = common.cut(stage(spark, docs, sf))
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
        docs = out
    assert all(r[n] == i for r in docs.collect() for i, n in enumerate(names))
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()


def test_nothing_else_imports_this(spark):
    top = Path(exact_dedup.__file__).resolve().parents[1]
    for p in top.rglob("*.py"):
        if "llm" not in p.parts:
            assert "corpuslab.llm" not in p.read_text()
