"""Corpus building, vocabularies, n-grams and sources over the standard tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpuslab.functions import text as X
from corpuslab.functions.presets import LATIN
from corpuslab.operators import contexts as K
from corpuslab.operators import corpus as C
from corpuslab.plans.text_functions import LINES
from corpuslab.registry import query
from corpuslab.sources import table
from corpuslab.sources.multistream import pages_in_streams, written_streams
from corpuslab.sources.pages import balanced_div, paragraphs

BUILD = LINES + r""", p AS (SELECT doc_id, lang, pos, unnest(r) AS run, unnest(range(len(r))) AS k FROM (SELECT doc_id, lang, pos, regexp_extract_all(line, '[\p{L} ,.]+') AS r FROM l)),
f AS (SELECT * FROM p WHERE length(run) >= 4),
d AS (SELECT lang, run, row_number() OVER (PARTITION BY run ORDER BY doc_id, pos, k) AS n FROM f)
"""


@query(BUILD + """SELECT lang, count(*) AS lines, CAST(sum(length(run)) AS BIGINT) AS chars, count(*) FILTER (WHERE n = 1) AS kept_lines,
 CAST(coalesce(sum(length(run)) FILTER (WHERE n = 1), 0) AS BIGINT) AS kept_chars, round(coalesce(sum(length(run)) FILTER (WHERE n = 1), 0) / sum(length(run)), 6) AS survival FROM d GROUP BY lang""")
def corpus_build(spark, sf):
    """Runs of letters, spaces and commas of all lines, kept where they first stand, by language."""
    lines = C.lines_of(table(spark, sf, "documents"), "doc_id", "lang")
    runs = lines.select("doc_id", "lang", "pos", F.posexplode(X.script_runs(F.col("line"), "\\p{L} ,.")).alias("k", "run")).where(F.length("run") >= 4)
    return C.survival(runs, C.keep_first(runs, "run", ["doc_id", "pos", "k"]), "lang", "run")


@query(LINES + "SELECT doc_id, pos, line FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS n FROM l) WHERE n = 1")
def a01_keep_first(spark, sf):
    out = C.keep_first(C.lines_of(table(spark, sf, "documents"), "doc_id"), "line", ["doc_id", "pos"])
    return out.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "line")


@query(LINES + """, u AS (SELECT 0 AS priority, doc_id AS unit, pos, line FROM l UNION ALL SELECT 1, conv_id * 1000 + turn, k, line FROM (
 SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM conversations))
SELECT priority, count(*) AS lines, count(*) FILTER (WHERE n = 1) AS kept FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY priority, unit, pos) AS n FROM u) GROUP BY priority""")
def a02_cross_source(spark, sf):
    a = C.lines_of(table(spark, sf, "documents"), "doc_id").select(F.lit(0).alias("priority"), F.col("doc_id").alias("unit"), "pos", "line")
    b = C.lines_of(table(spark, sf, "conversations"), "conv_id", "turn").select(F.lit(1).alias("priority"), (F.col("conv_id") * 1000 + F.col("turn")).alias("unit"), "pos", "line")
    rows = a.unionByName(b)
    kept = C.keep_first(rows, "line", ["priority", "unit", "pos"]).groupBy("priority").agg(F.count("*").alias("kept"))
    return rows.groupBy("priority").agg(F.count("*").alias("lines")).join(kept, "priority", "left").select("priority", "lines", F.coalesce("kept", F.lit(0)).alias("kept"))


@query("""WITH c AS (SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY ch), t AS (SELECT sum(n) AS total FROM c)
SELECT CAST(token_id AS BIGINT) AS token_id, token, n, round(n / total, 9) AS share FROM (SELECT ch AS token, n, row_number() OVER (ORDER BY n DESC, ch) + 2 AS token_id FROM c ORDER BY n DESC, ch LIMIT 61), t
UNION ALL SELECT i, t, 0, 0.0 FROM (VALUES (0, '<pad>'), (1, '<unk>'), (2, '<bos>')) r(i, t)""")
def a03_vocabulary(spark, sf):
    docs = table(spark, sf, "documents")
    total = docs.agg(F.sum(F.length("text")).alias("total"))
    v = C.vocabulary(docs, "text", 64).join(F.broadcast(total), F.lit(True))  # one row
    return v.select(F.col("token_id").cast("bigint").alias("token_id"), "token", "n", F.round(F.col("n") / F.col("total"), 9).alias("share"))


def _words(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.filter(F.split(F.lower("text"), "[^\\p{L}]+"), lambda w: w != "").alias("w"))


WORDS = r"w AS (SELECT conv_id, turn, list_filter(string_split_regex(lower(text), '[^\p{L}]+'), lambda x: x <> '') AS w FROM conversations)"


@query(f"""WITH {WORDS}, f AS (SELECT conv_id, turn, unnest(w) AS a, unnest(range(len(w))) AS k FROM w),
g AS (SELECT a, lead(a) OVER p AS b, lead(a, 2) OVER p AS c FROM f WINDOW p AS (PARTITION BY conv_id, turn ORDER BY k))
SELECT 1 AS "order", a AS ngram, count(*) AS n FROM g GROUP BY 2 UNION ALL SELECT 2, a || ' ' || b, count(*) FROM g WHERE b IS NOT NULL GROUP BY 2
UNION ALL SELECT 3, a || ' ' || b || ' ' || c, count(*) FROM g WHERE c IS NOT NULL GROUP BY 2""")
def a04_ngram_counts(spark, sf):
    w = _words(spark, sf)
    parts = [C.ngrams(w, F.col("w"), k).select(F.lit(k).alias("order"), "ngram", "n") for k in (1, 2, 3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


BIGRAMS = f"""WITH {WORDS}, f AS (SELECT conv_id, turn, unnest(w) AS w1, unnest(range(len(w))) AS k FROM w),
g AS (SELECT conv_id, turn, k, w1, lead(w1) OVER (PARTITION BY conv_id, turn ORDER BY k) AS w2 FROM f),
b AS (SELECT w1, w2, count(*) AS n FROM g WHERE w2 IS NOT NULL GROUP BY 1, 2),
p AS (SELECT w1, w2, greatest(n - 0.75, 0) / sum(n) OVER (PARTITION BY w1) + 0.75 * count(*) OVER (PARTITION BY w1) / sum(n) OVER (PARTITION BY w1)
 * count(*) OVER (PARTITION BY w2) / count(*) OVER () AS p FROM b)
"""


def _bigrams(spark, sf):
    pairs = _words(spark, sf).select("conv_id", "turn", F.explode(F.zip_with("w", F.slice("w", F.lit(2), F.size("w")), lambda a, b: F.struct(a.alias("w1"), b.alias("w2")))).alias("g"))
    return pairs.select("conv_id", "turn", "g.*").where("w2 is not null")


@query(BIGRAMS + "SELECT w1, w2, round(CAST(p AS DOUBLE), 9) AS p FROM p")
def a05_kneser_ney(spark, sf):
    b = _bigrams(spark, sf).groupBy("w1", "w2").agg(F.count("*").alias("n"))
    return C.kneser_ney(b).select("w1", "w2", F.round("p", 9).alias("p"))


@query("""WITH i AS (SELECT text, unnest(range(1, greatest(1, length(text) - 1))) AS i FROM conversations),
t AS (SELECT substr(text, i, 1) AS w1, substr(text, i + 1, 1) AS w2, substr(text, i + 2, 1) AS w3, count(*) AS n FROM i GROUP BY ALL),
b AS (SELECT w2, w3, count(*) AS n FROM t GROUP BY ALL), u AS (SELECT w3, count(*) AS n FROM b GROUP BY ALL),
q AS (SELECT b.w2, b.w3, greatest(b.n - 0.75, 0) / sum(b.n) OVER p + 0.75 * count(*) OVER p / sum(b.n) OVER p * u.n / (SELECT count(*) FROM b) AS p2 FROM b JOIN u USING (w3) WINDOW p AS (PARTITION BY b.w2))
SELECT w1, w2, w3, round(CAST(greatest(n - 0.75, 0) / sum(n) OVER p + 0.75 * count(*) OVER p / sum(n) OVER p * p2 AS DOUBLE), 9) AS p FROM t JOIN q USING (w2, w3) WINDOW p AS (PARTITION BY w1, w2)""")
def a05_kneser_ney_trigrams(spark, sf):
    """Order 3 over characters, interpolated with the lower orders."""
    three = lambda a: F.transform(F.sequence(F.lit(1), F.size(a) - 2), lambda i: F.slice(a, i, 3))
    grams = X.let(X.chars(F.col("text")), lambda a: F.when(F.size(a) > 2, three(a)))
    g = table(spark, sf, "conversations").select(F.explode(grams).alias("g"))
    t = g.groupBy(*[F.get("g", F.lit(i)).alias(f"w{i + 1}") for i in range(3)]).agg(F.count("*").alias("n"))
    return C.kneser_ney_trigrams(t).select("w1", "w2", "w3", F.round("p", 9).alias("p"))


@query(BIGRAMS + "SELECT conv_id, turn, count(*) AS n, round(avg(ln(CAST(p AS DOUBLE))), 6) AS mean_logp FROM g JOIN p USING (w1, w2) GROUP BY conv_id, turn")
def a24_mean_log_probability(spark, sf):
    rows = _bigrams(spark, sf)
    p = C.kneser_ney(rows.groupBy("w1", "w2").agg(F.count("*").alias("n")))
    return rows.join(p, ["w1", "w2"]).groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.round(F.avg(F.log("p")), 6).alias("mean_logp"))


@query("SELECT source, count(*) AS lines, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY source")
def a29_chars_by_source(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("lines"), F.sum(F.length("text")).alias("chars"))


@query("""WITH s AS (SELECT DISTINCT lang, source FROM documents)
SELECT lang, CASE WHEN n = 1 THEN a[1] ELSE array_to_string(a[1:n-1], ', ') || ' and ' || a[n] END AS attribution, share_alike FROM (
 SELECT lang, list_sort(list(source)) AS a, count(*) AS n, bool_or(source = 'src7') AS share_alike FROM s GROUP BY lang)""")
def a28_attribution(spark, sf):
    s = table(spark, sf, "documents").groupBy("lang").agg(F.sort_array(F.collect_set("source")).alias("a"), F.bool_or(F.col("source") == "src7").alias("share_alike"))
    n = F.size("a")
    joined = F.when(n == 1, F.get("a", F.lit(0))).otherwise(F.concat(F.array_join(F.slice("a", F.lit(1), n - 1), ", "), F.lit(" and "), F.get("a", n - 1)))
    return s.select("lang", joined.alias("attribution"), "share_alike")


@query("SELECT doc_id, n FROM (SELECT doc_id, length(text) AS n, coalesce(sum(length(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents) WHERE before < 500000")
def w01_char_budget(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.length("text").cast("bigint").alias("n"))
    return C.within_budget(rows, F.col("n"), ["doc_id"], 500_000)


@query("SELECT source, doc_id, n FROM (SELECT source, doc_id, length(text) AS n, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents) WHERE before < 20000")
def w02_budget_by_source(spark, sf):
    rows = table(spark, sf, "documents").select("source", "doc_id", F.length("text").cast("bigint").alias("n"))
    return C.within_budget(rows, F.col("n"), ["doc_id"], 20_000, ["source"])


@query(LINES + """, k AS (SELECT doc_id, pos, line, length(line) >= 40 AS keep, sum(CASE WHEN length(line) >= 40 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM l)
SELECT doc_id, CAST(island AS BIGINT) AS island, count(*) AS lines, string_agg(line, chr(10) ORDER BY pos) AS text FROM k WHERE keep GROUP BY doc_id, island""")
def w03_islands(spark, sf):
    rows = C.lines_of(table(spark, sf, "documents"), "doc_id")
    kept = C.islands(rows, F.length("line") >= 40, "doc_id", "pos")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    return kept.groupBy("doc_id", F.col("island").cast("bigint").alias("island")).agg(F.count("*").alias("lines"), joined.alias("text"))


@query("SELECT conv_id, turn, coalesce(string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before FROM conversations")
def w04_text_before(spark, sf):
    """Cut for each turn out of its conversation's one text."""
    return K.whole_contexts(_placed(spark, sf), ["conv_id"], ["turn"])


def _placed(spark, sf):
    return K.offsets(table(spark, sf, "conversations").select("conv_id", "turn", "text"), ["conv_id"], ["turn"])


PLACED = """WITH p AS (SELECT conv_id, turn, text, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM conversations),
w AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS whole FROM conversations GROUP BY conv_id)
"""


@query(PLACED + 'SELECT conv_id, turn, start, start + length(text) AS "end" FROM p')
def w04_context_offsets(spark, sf):
    """Where each turn's text lies in its conversation's: what comes before it ends one before its start."""
    return _placed(spark, sf).select("conv_id", "turn", "start", "end")


@query(PLACED + "SELECT conv_id, block, substr(whole, block * 4096 + 1, 4096) AS text FROM (SELECT conv_id, whole, unnest(range(0, CAST(ceil(greatest(length(whole), 1) / 4096) AS BIGINT))) AS block FROM w)")
def w04_context_blocks(spark, sf):
    """Texts of conversations, once, in blocks of 4096 characters."""
    return K.blocks(_placed(spark, sf), ["conv_id"])


@query(PLACED + "SELECT conv_id, turn, right(left(whole, greatest(start - 1, 0)), 300) AS before FROM p JOIN w USING (conv_id)")
def w04_context_tails(spark, sf):
    """The last 300 characters before each turn, from the blocks they lie in."""
    return K.tails(_placed(spark, sf), ["conv_id"], ["turn"], 300)


@query(LINES + "SELECT doc_id, pos, line, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS previous FROM l")
def w05_previous_run(spark, sf):
    from corpuslab.operators.overlap import with_previous

    out = with_previous(C.lines_of(table(spark, sf, "documents"), "doc_id"), "doc_id", "pos", "line")
    return out.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "line", "previous")


@query("""WITH c AS (SELECT conv_id, turn, text, unnest(range(1, greatest(1, length(text) - 6))) AS i FROM conversations)
SELECT substr(text, i, 8) AS win, count(*) AS n, min(conv_id) AS first_conv FROM c GROUP BY 1 HAVING count(*) > 1""")
def w11_char_windows(spark, sf):
    w = table(spark, sf, "conversations").select("conv_id", F.explode(X.char_windows(F.col("text"), 8)).alias("win"))
    return w.groupBy("win").agg(F.count("*").alias("n"), F.min("conv_id").alias("first_conv")).where("n > 1")


@query("SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) AS n FROM documents WHERE n_chars >= 500) WHERE n BETWEEN 51 AND 150")
def w12_skip_take(spark, sf):
    from corpuslab.operators.sampling import bounded

    return bounded(table(spark, sf, "documents").where("n_chars >= 500").select("doc_id", "n_chars"), 51, 150, ["doc_id"])


@query(r"SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, regexp_extract(html, 'lang=\"([a-z]+)\"', 1) AS lang, length(regexp_replace(html, '(?s)<[^>]*>', '', 'g')) AS text_chars FROM pages")
def src02_page_stream(spark, sf):
    h = F.col("html")
    return table(spark, sf, "pages").select("page_id", F.regexp_extract(h, "(?s)<title>(.*?)</title>", 1).alias("title"), F.regexp_extract(h, 'lang="([a-z]+)"', 1).alias("lang"), F.length(F.regexp_replace(h, "(?s)<[^>]*>", "")).cast("bigint").alias("text_chars"))


@query("SELECT url AS title, CAST(page_id % 3 AS INTEGER) AS ns, html AS text FROM pages WHERE page_id % 3 = 0")
def src02_dump_streams(spark, sf):
    """Pages written as a dump of compressed streams, and read from it again, those of one namespace."""
    pages = table(spark, sf, "pages")
    streams = written_streams(pages, (F.col("url"), F.col("page_id") % 3, F.col("html")), ["page_id", "url", "html"], 20)
    return pages_in_streams(streams)


@query("SELECT conv_id, count(*) AS turns, max(turn) AS last_turn, string_agg(replace(text, ' ', ''), '|' ORDER BY turn) AS turns_text FROM conversations GROUP BY conv_id")
def src03_dialogues(spark, sf):
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: F.replace(x["text"], F.lit(" "), F.lit(""))), "|")
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.max("turn").alias("last_turn"), joined.alias("turns_text"))


@query("SELECT doc_id, text FROM documents")
def src05_all_documents(spark, sf):
    """Every row of every shard."""
    return table(spark, sf, "documents").select("doc_id", "text")


@query("SELECT lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY lang")
def src07_projected_scan(spark, sf):
    return table(spark, sf, "documents").select("lang", "text").groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query(r"""WITH p AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<p[^>]*>(.*?)</p>', 1)) AS p, unnest(range(len(regexp_extract_all(html, '(?s)<p[^>]*>(.*?)</p>', 1)))) AS pos FROM pages)
SELECT page_id, pos, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(p, '<[^>]*>', '', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&amp;?', '&', 'g'), '[\s\x{3000}\x{a0}]+', ' ', 'g')) AS text FROM p
WHERE trim(regexp_replace(regexp_replace(p, '<[^>]*>', '', 'g'), '[\s\x{3000}\x{a0}]+', ' ', 'g')) <> ''""")
def src12_html_paragraphs(spark, sf):
    """Paragraphs of pages. The SQL names the six character references that the tables hold, the query resolves all."""
    out = table(spark, sf, "pages").select("page_id", F.posexplode(paragraphs(F.col("html"))).alias("pos", "text")).where("text <> ''")
    return out.select("page_id", F.col("pos").cast("bigint").alias("pos"), "text")


@query(r"SELECT page_id, regexp_extract(html, '(?s)<div class=\"ad\">(.*?)</div>', 1) AS block FROM pages")
def src12_balanced_div(spark, sf):
    return table(spark, sf, "pages").select("page_id", balanced_div(F.col("html"), '<div class="ad">').alias("block"))


@query(LINES + r""", w AS (SELECT doc_id, quantile_disc(length(line), 0.9) AS wide FROM l WHERE line <> '' GROUP BY doc_id),
e AS (SELECT doc_id, pos, line, CASE WHEN length(line) < wide * 0.8 OR regexp_matches(line, '[.!?]$') THEN 1 ELSE 0 END AS is_end FROM l JOIN w USING (doc_id) WHERE line <> ''),
g AS (SELECT doc_id, pos, line, coalesce(sum(is_end) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS par FROM e)
SELECT doc_id, CAST(par AS BIGINT) AS paragraph, string_agg(line, '' ORDER BY pos) AS text FROM g GROUP BY doc_id, par""")
def src13_pdf_paragraphs(spark, sf):
    l = C.lines_of(table(spark, sf, "documents"), "doc_id").where("line <> ''")  # noqa: E741
    of = Window.partitionBy("doc_id")
    wide = F.expr("percentile_disc(0.9) within group (order by length(line))")
    l = l.join(l.groupBy("doc_id").agg(wide.alias("wide")), "doc_id")  # noqa: E741
    ends = F.when((F.length("line") < F.col("wide") * 0.8) | F.rlike("line", F.lit("[.!?]$")), 1).otherwise(0)
    before = of.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    l = l.withColumn("e", ends).withColumn("paragraph", F.coalesce(F.sum("e").over(before), F.lit(0)).cast("bigint"))  # noqa: E741
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "")
    return l.groupBy("doc_id", "paragraph").agg(joined.alias("text"))


@query("SELECT doc_id, source, length(text) AS n FROM documents WHERE lang = 'de'")
def src15_language_filter(spark, sf):
    return table(spark, sf, "documents").where("lang = 'de'").select("doc_id", "source", F.length("text").cast("bigint").alias("n"))


@query("""SELECT 'documents' AS name, source, count(*) AS lines, CAST(sum(length(text)) AS BIGINT) AS chars, bool_or(lang = 'fr') AS share_alike FROM documents GROUP BY source""")
def snk01_lineage_record(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("lines"), F.sum(F.length("text")).alias("chars"), F.bool_or(F.col("lang") == "fr").alias("share_alike")).select(F.lit("documents").alias("name"), "*")


@query("SELECT conv_id, turn, contains(text, chr(9)) OR contains(text, chr(10)) AS broken, replace(text, chr(10), '\\n') AS escaped FROM conversations")
def snk03_escaped_context(spark, sf):
    t = F.col("text")
    return table(spark, sf, "conversations").select("conv_id", "turn", (F.contains(t, F.lit("\t")) | F.contains(t, F.lit("\n"))).alias("broken"), X.escape_newlines(t).alias("escaped"))


@query("SELECT conv_id, turn, array_to_string(list_filter(string_split(text, ''), lambda x: x <> ''), ' ') AS spaced FROM conversations")
def snk06_spaced_text(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", X.spaced(F.col("text")).alias("spaced"))


@query("SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def snk08_resume(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT doc_id, sha256(text) AS sha, octet_length(encode(text)) AS size FROM documents")
def m13_digests(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("bigint").alias("size"))


@query(rf"SELECT count(DISTINCT c) AS n, count(*) AS runs FROM (SELECT unnest(regexp_extract_all(text, '[{LATIN.letters}]+')) AS c FROM documents)")
def s06_distinct_set(spark, sf):
    runs = table(spark, sf, "documents").select(F.explode(X.script_runs(F.col("text"), LATIN.letters)).alias("c")).groupBy("c").agg(F.count("*").alias("k"))
    return runs.agg(F.count("*").alias("n"), F.sum("k").alias("runs"))
