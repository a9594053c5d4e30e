"""Model math on embeddings, decoders, and the transformer over conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslab.functions import stats as A
from corpuslab.functions import tensor as M
from corpuslab.functions import text as X
from corpuslab.operators import decoding as D
from corpuslab.operators import ordered as O
from corpuslab.operators import pools
from corpuslab.operators.reranker import CharTransformer, score_candidates
from corpuslab.plans.language_queries import word_layers
from corpuslab.plans.text_functions import SYLLABLES
from corpuslab.registry import query
from corpuslab.sources import table

E = "WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS a FROM embeddings)\n"


def _emb(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", "embedding")


def _flat(df, name, digits=5):
    """Long form of an array column."""
    return df.select("vec_id", F.posexplode(name).alias("pos", "v")).select("vec_id", F.col("pos").cast("bigint").alias("pos"), F.round("v", digits).alias("v"))


LONG = "SELECT vec_id, unnest(range(len(b))) AS pos, round(unnest(b), 5) AS v FROM b"


@query(E + """, m AS (SELECT vec_id, a, list_sum(a) / len(a) AS mu FROM e), s AS (SELECT vec_id, a, mu, list_sum(list_transform(a, lambda x: (x - mu) * (x - mu))) / len(a) AS var FROM m),
b AS (SELECT vec_id, list_transform(a, lambda x: (x - mu) / sqrt(var + 1e-5)) AS b FROM s) """ + LONG)
def m02_layer_norm(spark, sf):
    return _flat(_emb(spark, sf).select("vec_id", M.layer_norm(F.col("embedding")).alias("b")), "b")


GELU = "0.5 * x * (1 + (CASE WHEN x < 0 THEN -1 ELSE 1 END) * (1 - (1 / (1 + 0.3275911 * abs(x * 0.7071067811865476))) * (0.2548296 + (1 / (1 + 0.3275911 * abs(x * 0.7071067811865476))) * (-0.28449674 + (1 / (1 + 0.3275911 * abs(x * 0.7071067811865476))) * (1.4214137 + (1 / (1 + 0.3275911 * abs(x * 0.7071067811865476))) * (-1.453152 + (1 / (1 + 0.3275911 * abs(x * 0.7071067811865476))) * 1.0614054)))) * exp(-(x * 0.7071067811865476) * (x * 0.7071067811865476))))"


@query(E + f", b AS (SELECT vec_id, list_transform(a, lambda x: {GELU}) AS b FROM e) " + LONG)
def m03_gelu(spark, sf):
    return _flat(_emb(spark, sf).select("vec_id", F.transform("embedding", lambda x: M.gelu(x)).alias("b")), "b")


@query(E + "SELECT vec_id, round(list_sum(list_transform(a, lambda x: x * x)), 5) AS norm2, round(list_dot_product(a, list_reverse(a)), 5) AS turned FROM e")
def m04_dot(spark, sf):
    e = F.col("embedding")
    return _emb(spark, sf).select("vec_id", F.round(M.dot(e, e), 5).alias("norm2"), F.round(M.dot(e, F.reverse(e)), 5).alias("turned"))


@query(E + """, s AS (SELECT vec_id, a, greatest(list_max(list_transform(a, lambda x: abs(x))), 1e-8) / 127.0 AS scale FROM e)
SELECT vec_id, unnest(range(len(a))) AS pos, CAST(greatest(-127, least(127, round_even(unnest(a) / scale, 0))) AS BIGINT) AS q, round(scale, 8) AS scale FROM s""")
def m05_quantize(spark, sf):
    q = _emb(spark, sf).select("vec_id", M.quantize_int8(F.col("embedding")).alias("q"))
    return q.select("vec_id", F.posexplode("q.values").alias("pos", "v"), F.col("q.scale").alias("s")).select("vec_id", F.col("pos").cast("bigint").alias("pos"), F.col("v").cast("bigint").alias("q"), F.round("s", 8).alias("scale"))


@query("""WITH p AS (SELECT DISTINCT p_brand AS page, left(p_name, k) AS prefix, k FROM (SELECT p_brand, p_name, unnest(range(1, length(p_name) + 1)) AS k FROM part)),
n AS (SELECT p_brand AS page, CAST(sum(length(p_name)) AS BIGINT) AS all_positions FROM part GROUP BY 1)
SELECT page, all_positions, count(*) AS distinct_prefixes FROM p JOIN n USING (page) GROUP BY 1, 2""")
def m07_prefix_tree(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_brand").alias("page"), "p_name")
    every = p.select("page", F.explode(X.prefixes(F.col("p_name"))).alias("prefix"))
    return every.groupBy("page").agg(F.count("*").alias("all_positions"), F.countDistinct("prefix").alias("distinct_prefixes"))


@query(E + """, n AS (SELECT vec_id, a, lead(a) OVER (PARTITION BY label ORDER BY vec_id) AS c FROM e), b AS (SELECT vec_id, list_transform(list_zip(a, c), lambda x: x[1] + 0.25 * (x[2] - x[1])) AS b FROM n WHERE c IS NOT NULL) """ + LONG)
def m08_interpolate(spark, sf):
    """Each vector with the next one of its label, met by number, so that a label of any size is spread."""
    e = O.numbered(_emb(spark, sf), ["vec_id"], "k", ["label"])
    after = e.select("label", (F.col("k") - 1).alias("k"), F.col("embedding").alias("c"))
    return _flat(O.same_groups(e, after, ["label", "k"]).select("vec_id", M.interpolate(F.col("embedding"), F.col("c"), 0.25).alias("b")), "b")


@query("""WITH s AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS step, count(*) OVER () AS total FROM documents), w AS (SELECT *, total // 10 AS warm FROM s)
SELECT doc_id, step, round(CASE WHEN step < warm THEN 3e-4 * (step + 1) / warm ELSE 3e-4 * (0.1 + 0.45 * (1 + cos(pi() * (step - warm) / (total - warm)))) END, 12) AS rate FROM w""")
def m09_learning_rate(spark, sf):
    """The rate at each document, as the step of one pass over the table, a tenth of which is the warm-up."""
    docs = table(spark, sf, "documents").select("doc_id")
    total = docs.count()
    steps = O.numbered(docs, ["doc_id"], "k").select("doc_id", (F.col("k") - 1).alias("step"))
    return steps.select("doc_id", "step", F.round(A.learning_rate(F.col("step"), total, 3e-4, total // 10), 12).alias("rate"))


@query("""WITH c AS (SELECT lang, unnest(string_split(text, '')) AS ch FROM documents), v AS (SELECT lang, count(DISTINCT ch) + 3 AS v FROM c WHERE ch <> '' GROUP BY lang)
SELECT lang, name, v * w + x * w + l * (12 * w * w + 9 * w) + 2 * w AS parameters FROM v, (VALUES ('keyboard', 64, 6, 256), ('desktop', 128, 8, 448), ('published', 64, 6, 192)) t(name, x, l, w)""")
def m10_parameters(spark, sf):
    """Parameters of three shapes over the characters of each language and three reserved words."""
    ch = table(spark, sf, "documents").select("lang", F.explode(F.split("text", "")).alias("ch")).where("ch <> ''")
    sizes = ch.groupBy("lang").agg((F.countDistinct("ch") + 3).alias("v"))
    shapes = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(c).alias("c"), F.lit(l).alias("l"), F.lit(w).alias("w")) for n, c, l, w in (("keyboard", 64, 6, 256), ("desktop", 128, 8, 448), ("published", 64, 6, 192))])
    each = sizes.select("lang", "v", F.explode(shapes).alias("s"))
    return each.select("lang", "s.name", A.transformer_parameters(F.col("v"), F.col("s.c"), F.col("s.l"), F.col("s.w")).alias("parameters"))


@query(E + "SELECT vec_id, round(list_max(a) + ln(list_sum(list_transform(a, lambda x: exp(x - list_max(a))))), 6) AS z FROM e")
def a25_log_sum_exp(spark, sf):
    return _emb(spark, sf).select("vec_id", F.round(M.log_normalizer(F.col("embedding")), 6).alias("z"))


def _model():
    vocab = ["<pad>", "<unk>", "<bos>", *"abcdefghijklmnopqrstuvwxyzéèêç .,"]
    return CharTransformer.random(vocab)


@query()
def m01_transformer_scores(spark, sf):
    """Scores of a turn's first words as candidates for the turn before it; untrained weights from a fixed seed."""
    c = table(spark, sf, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.lower("text").alias("context"), F.slice(F.split(F.lower("text"), "[ \\n]"), 1, 9).alias("candidates"))
    out = score_candidates(c, _model(), "id", "context", "candidates")
    return out.select("id", F.round(F.get("scores", F.lit(0)), 5).alias("first"), pools.pick_of(F.col("scores")).alias("pick"))


@query()
def m06_next_character(spark, sf):
    import pandas as pd

    model = _model()

    def run(batches):
        for pdf in batches:
            p = [model.next_log_probabilities(t) for t in pdf["page"]]
            yield pd.DataFrame({"page": pdf["page"], "next": [model.vocab[int(x.argmax())] for x in p], "logp": [round(float(x.max()), 5) for x in p]})

    return table(spark, sf, "part").select(F.col("p_name").alias("page")).distinct().mapInPandas(run, "page string, next string, logp double")


WORDS = "SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]+')) AS word FROM conversations"
SYL = ", ".join(f"('{s}')" for s in SYLLABLES)


SEGMENTED = f"""WITH RECURSIVE w AS ({WORDS}), s(s) AS (VALUES {SYL}), g AS (SELECT word, word AS rest, '' AS parts, 0 AS n FROM w
 UNION ALL SELECT word, substr(rest, length(s) + 1), parts || CASE WHEN n > 0 THEN ' ' ELSE '' END || s, n + 1 FROM g JOIN s ON starts_with(rest, s) WHERE n < 4 AND rest <> '')"""


@query(SEGMENTED + " SELECT word, parts, n FROM g WHERE rest = '' AND n > 0")
def f29_segmentations(spark, sf):
    w = table(spark, sf, "conversations").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    return D.segmentations(w, "word", spark.createDataFrame([(s,) for s in SYLLABLES], "syllable string"), 4)


@query(f"""{SEGMENTED}, r AS (SELECT word, parts, string_split(parts, ' ') AS a FROM g WHERE rest = '' AND n > 0),
t AS (SELECT word, parts, a, array_to_string(list_transform(a, lambda x, i: CASE WHEN i % 2 = 1 THEN x ELSE left(x, 1) END), '') AS code FROM r),
h AS (SELECT word, parts, a, code, 0 AS i, 0 AS done, []::INTEGER[] AS sizes, []::VARCHAR[] AS slots FROM t
 UNION ALL SELECT word, parts, a, code, i + 1, done + k, list_append(sizes, k), list_append(slots, left(a[i + 1], k)) FROM h, (SELECT CAST(k AS INTEGER) AS k FROM range(1, {max(map(len, SYLLABLES)) + 1}) u(k)) u
 WHERE i < len(a) AND k <= length(a[i + 1]) AND (k = length(a[i + 1]) OR i + 1 = len(a) OR k = 1 OR (k = 2 AND left(a[i + 1], 2) IN ('zh', 'ch', 'sh'))) AND substr(code, done + 1, k) = left(a[i + 1], k))
SELECT word, code, array_to_string(arg_max(slots, sizes), ' ') AS slots FROM h WHERE i = len(a) AND done = length(code) GROUP BY word, parts, code""")
def f30_typed_slots(spark, sf):
    import pandas as pd

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"word": pdf["word"], "code": pdf["code"], "slots": [" ".join(D.typed_slots(p.split(" "), c)) for p, c in zip(pdf["parts"], pdf["code"], strict=True)]})

    s = f29_segmentations(spark, sf)
    code = F.array_join(F.transform(F.split("parts", " "), lambda p, i: F.when(i % 2 == 0, p).otherwise(F.substring(p, 1, 1))), "")
    return s.select("word", "parts", code.alias("code")).mapInPandas(run, "word string, code string, slots string")


@query("""WITH w AS (SELECT unnest(string_split_regex(lower(text), '[ \\n]')) AS word FROM conversations), s AS (SELECT word, count(*) AS n FROM w GROUP BY word),
p AS (SELECT DISTINCT word, n, i, CASE WHEN substr(word, i, 1) BETWEEN 'a' AND 'z' THEN 97 + (ascii(substr(word, i, 1)) - 97 + k) % 26 ELSE unicode(substr(word, i, 1)) END AS c FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM s), range(3) u(k))
SELECT a.word, a.n, a.i, count(*) AS pairs, min(abs(a.c - b.c)) AS nearest FROM p a JOIN p b ON a.word = b.word AND b.i = a.i + 1 GROUP BY 1, 2, 3""")
def j15_word_transitions(spark, sf):
    """Each layer of every word with the next one: at most nine pairs of an array, no join."""
    w = word_layers(spark, sf).where("size(layers) > 1")
    i = w.select("word", "n", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("layers") - 1), lambda k: F.struct(F.element_at("layers", k).alias("a"), F.element_at("layers", k + 1).alias("b")))).alias("i", "two"))
    pairs = F.flatten(F.transform("two.a", lambda x: F.transform("two.b", lambda y: F.abs(F.ascii(x) - F.ascii(y)))))
    return i.select("word", "n", (F.col("i") + 1).cast("bigint").alias("i"), F.size(pairs).cast("bigint").alias("pairs"), F.array_min(pairs).cast("bigint").alias("nearest"))
