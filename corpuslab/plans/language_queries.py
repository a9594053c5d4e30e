"""Back-off models of the benchmark's lines and words, and what they score and decode."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslab.functions import text as X
from corpuslab.operators import language_model as L
from corpuslab.operators import lattice
from corpuslab.registry import query
from corpuslab.sources import table


def _discounts(k: int) -> str:
    ratios = [f"({j} - {j + 1} * (n1 / (n1 + 2 * n2)) * n{j + 1} / n{j})" for j in (1, 2, 3)]
    told = "n1 > 0 AND n2 > 0 AND n3 > 0 AND n4 > 0 AND " + " AND ".join(f"{r} BETWEEN 0 AND {j}" for j, r in enumerate(ratios, 1))
    out = ", ".join(f"CASE WHEN {told} THEN {r} ELSE {f} END AS d{j}" for j, (r, f) in enumerate(zip(ratios, L.FALLBACK, strict=True), 1))
    return f"SELECT {out} FROM (SELECT {', '.join(f'CAST(count(*) FILTER (WHERE n = {j}) AS DOUBLE) AS n{j}' for j in (1, 2, 3, 4))} FROM c{k})"


LEFT = "(d1 * count(*) FILTER (WHERE n = 1) + d2 * count(*) FILTER (WHERE n = 2) + d3 * count(*) FILTER (WHERE n > 2)) / CAST(sum(n) AS DOUBLE)"
OWN = "(n - CASE n WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END)"
WEIGHT = "coalesce(CASE WHEN g > 0 THEN round(log10(g), 6) WHEN g = 0 THEN -99 END, 0)"
#: The model of the padded arrays s of a table sent: t1, t2, t3 (a, b, c, n, logp, bo).
MODEL = f"""c3 AS MATERIALIZED (SELECT s[i] AS a, s[i + 1] AS b, s[i + 2] AS c, count(*) AS n FROM (SELECT s, unnest(range(1, len(s) - 1)) AS i FROM sent) GROUP BY ALL),
c2 AS MATERIALIZED (SELECT b AS a, c AS b, count(*) AS n FROM c3 GROUP BY 1, 2 UNION ALL SELECT s[1], s[2], count(*) FROM sent GROUP BY ALL),
c1 AS MATERIALIZED (SELECT b AS a, count(*) AS n FROM c2 GROUP BY b),
e1 AS ({_discounts(1)}), e2 AS ({_discounts(2)}), e3 AS ({_discounts(3)}),
h1 AS (SELECT {LEFT} AS g, CAST(sum(n) AS DOUBLE) AS total, count(*) AS types FROM c1, e1 GROUP BY d1, d2, d3),
h2 AS MATERIALIZED (SELECT a, {LEFT} AS g, CAST(sum(n) AS DOUBLE) AS total FROM c2, e2 GROUP BY a, d1, d2, d3),
h3 AS MATERIALIZED (SELECT a, b, {LEFT} AS g, CAST(sum(n) AS DOUBLE) AS total FROM c3, e3 GROUP BY a, b, d1, d2, d3),
p1 AS MATERIALIZED (SELECT a, n, {OWN} / total + g / (types + 1) AS p FROM c1, e1, h1 UNION ALL SELECT '<unk>', 0, g / (types + 1) FROM h1),
p2 AS MATERIALIZED (SELECT c2.a, c2.b, c2.n, {OWN.replace('n ', 'c2.n ')} / total + g * p1.p AS p FROM c2 JOIN h2 ON h2.a = c2.a JOIN p1 ON p1.a = c2.b, e2),
p3 AS MATERIALIZED (SELECT c3.a, c3.b, c3.c, c3.n, {OWN.replace('n ', 'c3.n ')} / total + g * p2.p AS p FROM c3 JOIN h3 ON h3.a = c3.a AND h3.b = c3.b JOIN p2 ON p2.a = c3.b AND p2.b = c3.c, e3),
t1 AS MATERIALIZED (SELECT q.a, n, logp, {WEIGHT} AS bo FROM (SELECT a, n, round(log10(p), 6) AS logp FROM p1 UNION ALL SELECT * FROM (SELECT '<s>', count(*) AS n, -99.0::DOUBLE FROM sent) WHERE n > 0) q LEFT JOIN h2 ON h2.a = q.a),
t2 AS MATERIALIZED (SELECT p2.a, p2.b, n, round(log10(p), 6) AS logp, {WEIGHT} AS bo FROM p2 LEFT JOIN h3 ON h3.a = p2.a AND h3.b = p2.b),
t3 AS MATERIALIZED (SELECT a, b, c, n, round(log10(p), 6) AS logp FROM p3),
"""
#: Tables that tell the score of a word x after the words y, z, in millionths.
LOOKUPS = """LEFT JOIN t3 ON t3.a = {y} AND t3.b = {z} AND t3.c = {x} LEFT JOIN t2 b2 ON b2.a = {y} AND b2.b = {z}
 LEFT JOIN t2 ON t2.a = {z} AND t2.b = {x} LEFT JOIN t1 b1 ON b1.a = {z} JOIN t1 ON t1.a = {x}"""
M = "CAST(round({} * 1000000) AS BIGINT)"
SCORE = f"coalesce({M.format('t3.logp')}, coalesce({M.format('b2.bo')}, 0) + coalesce({M.format('t2.logp')}, coalesce({M.format('b1.bo')}, 0) + {M.format('t1.logp')}))"

LINES = "SELECT {keys} list_filter(string_split_regex(lower(line), '[ ]+'), lambda x: x <> '') AS w FROM (SELECT {keys} unnest(string_split(text, chr(10))) AS line{pos} FROM {table})"
LINE_MODEL = f"WITH sent AS (SELECT list_concat(['<s>'], w, ['</s>']) AS s FROM ({LINES.format(keys='', pos='', table='benchmark')})),\n{MODEL}"


def _lines(spark, sf, name, *keys):
    """Lines with their words."""
    lines = table(spark, sf, name).select(*keys, F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select(*keys, F.col("pos").cast("bigint").alias("pos"), F.filter(F.split(F.lower("line"), "[ ]+"), lambda w: w != "").alias("w"))


def line_model(spark, sf):
    """The model of order 3 of the benchmark's lines, by words."""
    return L.estimate(_lines(spark, sf, "benchmark"), F.col("w"))


@query(LINE_MODEL + """m AS (SELECT 1 AS "order", a AS ngram, n, logp, bo AS backoff FROM t1 UNION ALL SELECT 2, a || ' ' || b, n, logp, bo FROM t2 UNION ALL SELECT 3, a || ' ' || b || ' ' || c, n, logp, 0.0 FROM t3)
SELECT * FROM m""")
def a05_backoff_model(spark, sf):
    return line_model(spark, sf).select("order", F.array_join("ngram", " ").alias("ngram"), "n", "logp", "backoff")


@query(LINE_MODEL + f"""l AS (SELECT conv_id, turn, pos, list_concat(['<s>'], w, ['</s>']) AS s FROM ({LINES.format(keys='conv_id, turn,', pos=', unnest(range(len(string_split(text, chr(10))))) AS pos', table='conversations').replace('SELECT conv_id, turn, list', 'SELECT conv_id, turn, pos, list')})),
f AS (SELECT conv_id, turn, pos, i, coalesce(a, '<unk>') AS x, a IS NULL OR a = '<unk>' AS lost, size FROM (SELECT conv_id, turn, pos, unnest(s) AS w, unnest(range(len(s))) AS i, len(s) AS size FROM l) u LEFT JOIN t1 ON a = w),
g AS (SELECT *, lag(x) OVER o AS z, lag(x, 2) OVER o AS y FROM f WINDOW o AS (PARTITION BY conv_id, turn, pos ORDER BY i))
SELECT conv_id, turn, pos, count(*) FILTER (WHERE i < g.size - 1) AS words, count(*) FILTER (WHERE lost AND i < g.size - 1) AS unknown, round(CAST(sum({SCORE}) AS BIGINT) / 1000000, 6) AS logp
FROM g {LOOKUPS.format(x='x', y='y', z='z')} WHERE i > 0 GROUP BY conv_id, turn, pos""")
def a05_backoff_scores(spark, sf):
    """Lines of conversations by the model of the benchmark's lines; unseen n-grams by back-off, unknown words as such."""
    return L.score_sentences(_lines(spark, sf, "conversations", "conv_id", "turn"), ["conv_id", "turn", "pos"], "w", line_model(spark, sf)).withColumn("logp", F.round("logp", 6))


@query("""WITH c AS (SELECT list_filter(string_split(text, ''), lambda x: x <> '') AS a FROM conversations)
SELECT k AS "order", array_to_string(a[i:i + k - 1], '') AS ngram, count(*) AS n FROM (SELECT a, k, unnest(range(1, greatest(1, len(a) - k + 2))) AS i FROM c, range(1, 4) t(k)) GROUP BY ALL""")
def a04_character_ngrams(spark, sf):
    """Counts of single characters, pairs and triples."""
    named = lambda a, k: F.transform(X.windows(a, k, ""), lambda g: F.struct(F.lit(k).cast("bigint").alias("order"), g.alias("ngram")))
    both = X.let(X.chars(F.col("text")), lambda a: F.concat(*[named(a, k) for k in (1, 2, 3)]))
    return table(spark, sf, "conversations").select(F.explode(both).alias("g")).groupBy("g.order", "g.ngram").agg(F.count("*").alias("n"))


def word_layers(spark, sf):
    """Words of conversations with how often they come: the word, n, layers of a letter and the two after it in the
    alphabet; other signs, and the empty word between two blanks, stay as they are."""
    w = table(spark, sf, "conversations").select(F.explode(F.split(F.lower("text"), "[ \n]")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    abc = "abcdefghijklmnopqrstuvwxyz"
    nxt = lambda ch, k: F.translate(ch, abc, abc[k:] + abc[:k])
    return w.select("word", "n", F.transform(X.chars(F.col("word")), lambda ch: F.array_distinct(F.array(ch, nxt(ch, 1), nxt(ch, 2)))).alias("layers"))


def letter_model(spark, sf):
    """The model of order 3 of the benchmark's words, by letters."""
    words = table(spark, sf, "benchmark").select(F.explode(F.split(F.lower("text"), "[ \n]")).alias("w")).where("w <> ''")
    return L.estimate(words.select(X.chars(F.col("w")).alias("w")), F.col("w"))


def _decoded(spark, sf, kind, place=0):
    out = lattice.decode(word_layers(spark, sf), ["word", "n"], F.col("layers"), letter_model(spark, sf), kind, place)
    return out.withColumn("score", F.round("score", 6))


#: The model, the words of conversations, and their candidates (k: the place in a layer, x: as the model knows it).
DECODED = f"""WITH RECURSIVE sent AS (SELECT list_concat(['<s>'], list_filter(string_split(w, ''), lambda x: x <> ''), ['</s>']) AS s FROM (SELECT unnest(string_split_regex(lower(text), '[ \\n]')) AS w FROM benchmark) WHERE w <> ''),
{MODEL}s AS MATERIALIZED (SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(text), '[ \\n]')) AS word FROM conversations) GROUP BY word),
l AS (SELECT word, i, substr(word, i, 1) AS c FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM s)),
q AS (SELECT word, i, CAST(k AS INTEGER) AS k, chr(CAST(97 + (ascii(c) - 97 + k) % 26 AS INTEGER)) AS c FROM l, range(3) t(k) WHERE c BETWEEN 'a' AND 'z' UNION ALL SELECT word, i, 0, c FROM l WHERE NOT c BETWEEN 'a' AND 'z'),
p AS MATERIALIZED (SELECT word, i, k, c, coalesce(a, '<unk>') AS x FROM q LEFT JOIN t1 ON a = c),
"""
BEFORE = LOOKUPS.format(x="p.x", y="v.y", z="v.z")
#: Paths from a begin (z) on, cut at each letter to the first by an order within a part.
PATHS = DECODED + f"""v AS (SELECT word, 0::BIGINT AS i, 0::BIGINT AS r, NULL::VARCHAR AS y, {{begin}}::VARCHAR AS z, '' AS path, 0::BIGINT AS score FROM s
 UNION ALL SELECT word, i, {{rank}}, z, x, path, score FROM (SELECT v.word, p.i, p.k, v.z, p.x, v.path || p.c AS path, v.score + {SCORE} AS score,
  row_number() OVER (PARTITION BY v.word {{part}} ORDER BY v.score + {SCORE} DESC, v.r, p.k) AS r FROM v JOIN p ON p.word = v.word AND p.i = v.i + 1 {{known}} {BEFORE}) WHERE r <= {{width}}),
e AS (SELECT word, path, score, y, z, row_number() OVER (PARTITION BY word ORDER BY {{order}}) AS first FROM v WHERE i = length(word) AND i > 0)
"""
ONE = "SELECT s.word, s.n, coalesce(path, '') AS text, round(coalesce(score, 0) / 1000000, 6) AS score FROM s LEFT JOIN e ON e.word = s.word AND first = 1"
LAST = PATHS.format(begin="{begin}", rank="k", part=", p.k", width=1, order="score DESC, r", known="")
KNOWN = "AND p.x = p.c"


@query(LAST.format(begin="NULL") + ONE)
def d01_viterbi_words(spark, sf):
    """All words of conversations, each once with its count: the best path for each last letter, without begin or end."""
    return _decoded(spark, sf, lattice.VITERBI)


@query(LAST.format(begin="'<s>'") + f"""SELECT s.word, s.n, coalesce(path, '') AS text, round(coalesce(score, 0) / 1000000, 6) AS score FROM s
 LEFT JOIN (SELECT v.word, path, score + {SCORE} AS score FROM (SELECT * FROM e WHERE first = 1) v {LOOKUPS.format(x="'</s>'", y="v.y", z="v.z")}) f ON f.word = s.word""")
def d02_viterbi_rescored(spark, sf):
    """Paths that begin with the begin of a sentence; the best one is scored with the end."""
    return _decoded(spark, sf, lattice.RESCORED)


@query(PATHS.format(begin="'<s>'", rank="r", part="", width=12, order="r", known=KNOWN) + ONE)
def d03_beam(spark, sf):
    return _decoded(spark, sf, lattice.BEAM)


@query(PATHS.format(begin="'<s>'", rank="r", part="", width=3, order="r DESC", known=KNOWN) + ONE)
def t04_beam_top(spark, sf):
    """The third of the best three paths, or the last of fewer."""
    return _decoded(spark, sf, lattice.Decoder(width=3, bos=True, known=True), 2)
