"""Joins, sampling, conversations and set operations over the standard tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpuslab.functions import text as X
from corpuslab.operators import contexts as K
from corpuslab.operators import corpus as C
from corpuslab.operators import ordered as O
from corpuslab.operators import overlap as V
from corpuslab.operators import overlap_filter as OF
from corpuslab.operators import sampling as S
from corpuslab.operators.prefix_join import beginnings
from corpuslab.plans.text_functions import LINES
from corpuslab.registry import query
from corpuslab.sources import table

BENCH_LINES = "b AS (SELECT item_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM benchmark)"
WORDS8 = """w AS (SELECT doc_id, unnest(string_split_regex(text, '[ \\n]')) AS word, unnest(range(len(string_split_regex(text, '[ \\n]')))) AS k FROM documents),
d8 AS (SELECT doc_id, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS g, count(*) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS n FROM w),
v AS (SELECT item_id, unnest(string_split_regex(text, '[ \\n]')) AS word, unnest(range(len(string_split_regex(text, '[ \\n]')))) AS k FROM benchmark),
b8 AS (SELECT item_id, string_agg(word, ' ') OVER (PARTITION BY item_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS g, count(*) OVER (PARTITION BY item_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS n FROM v)"""


def _lines(spark, sf, name, key):
    return C.lines_of(table(spark, sf, name), key)


@query("SELECT d.doc_id, lang, n_chars, quality, toxic, n_chars = length(text) AS equal FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def j01_assert_join(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars", (F.col("n_chars") == F.length("text")).alias("equal"))
    return d.join(table(spark, sf, "labels"), "doc_id")


@query("SELECT count(*) AS missing FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def j01_coverage_check(spark, sf):
    return V.unmatched(table(spark, sf, "labels"), table(spark, sf, "documents"), ["doc_id"]).agg(F.count("*").alias("missing"))


POOL = """p AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS candidates FROM lineitem GROUP BY l_orderkey)"""


@query(f"WITH {POOL} SELECT o_orderkey, o_custkey % len(candidates) AS pick, candidates[o_custkey % len(candidates) + 1] AS picked FROM orders JOIN p ON o_orderkey = l_orderkey")
def j02_picks(spark, sf):
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    pool = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["l_partkey"]).alias("candidates"))
    out = table(spark, sf, "orders").join(pool, F.col("o_orderkey") == F.col("l_orderkey"))
    pick = F.col("o_custkey") % F.size("candidates")
    return out.select("o_orderkey", pick.alias("pick"), F.element_at("candidates", (pick + 1).cast("int")).alias("picked"))


@query("""WITH s AS (SELECT event_type AS scorer, user_id AS id, avg(value) AS v FROM events GROUP BY 1, 2)
SELECT a.scorer AS a, b.scorer AS b, count(*) AS n, count(*) FILTER (WHERE a.v > b.v) AS a_wins FROM s a JOIN s b ON a.id = b.id AND a.scorer < b.scorer GROUP BY 1, 2""")
def j03_scorer_pairs(spark, sf):
    s = table(spark, sf, "events").groupBy(F.col("event_type").alias("scorer"), F.col("user_id").alias("id")).agg(F.avg("value").alias("v"))
    a, b = s.select("id", F.col("scorer").alias("a"), F.col("v").alias("va")), s.select("id", F.col("scorer").alias("b"), F.col("v").alias("vb"))
    return a.join(b, "id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.count_if(F.col("va") > F.col("vb")).alias("a_wins"))


@query("SELECT user_id, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)")
def j04_shared_ids(spark, sf):
    e = table(spark, sf, "events")
    kinds = e.agg(F.countDistinct("event_type").alias("k"))
    per = e.groupBy("user_id").agg(F.countDistinct("event_type").alias("kinds"))
    return per.join(F.broadcast(kinds), F.col("kinds") == F.col("k")).select("user_id", "kinds")  # one row


@query("""WITH p AS (SELECT DISTINCT event_type AS scorer, user_id FROM events), k AS (SELECT user_id, count(*) = (SELECT count(DISTINCT event_type) FROM events) AS shared FROM p GROUP BY user_id)
SELECT scorer, count(*) AS cases, count(*) FILTER (WHERE shared) AS compared, bool_and(shared) AS same_cases FROM p JOIN k USING (user_id) GROUP BY scorer""")
def j04_coverage(spark, sf):
    """What each scorer covers of the cases that all have: those compared, and whether it has others."""
    p = table(spark, sf, "events").select(F.col("event_type").alias("scorer"), "user_id").distinct()
    shared = p.groupBy("user_id").count().join(F.broadcast(p.agg(F.countDistinct("scorer").alias("k"))), F.col("count") == F.col("k")).select("user_id", F.lit(True).alias("shared"))  # one row
    return p.join(shared, "user_id", "left").groupBy("scorer").agg(F.count("*").alias("cases"), F.count("shared").alias("compared"), (F.count("*") == F.count("shared")).alias("same_cases"))


@query(f"WITH {WORDS8} SELECT DISTINCT doc_id FROM d8 WHERE n = 8 AND g IN (SELECT g FROM b8 WHERE n = 8)")
def j05_window_members(spark, sf):
    """Documents that share eight words in a row with the benchmark."""
    return OF.sharing(table(spark, sf, "documents"), "doc_id", table(spark, sf, "benchmark"))


@query(LINES + f", {BENCH_LINES} SELECT DISTINCT doc_id FROM l WHERE line IN (SELECT line FROM b)")
def j05_exact_members(spark, sf):
    return OF.sharing(table(spark, sf, "documents"), "doc_id", table(spark, sf, "benchmark"), OF.LINES)


@query("SELECT d.doc_id, d.source, d.lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents x JOIN labels l USING (doc_id) WHERE l.toxic = 1 AND x.doc_id = d.doc_id AND x.source = d.source AND x.lang = d.lang)")
def j06_review_drops(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "lang")
    review = d.join(table(spark, sf, "labels").where("toxic = 1").select("doc_id"), "doc_id")
    return d.join(review, ["doc_id", "source", "lang"], "left_anti")


@query("SELECT conv_id, turn FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.text = c.text) AND conv_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def j07_taken(spark, sf):
    c = table(spark, sf, "conversations")
    c = c.join(table(spark, sf, "documents").select("text"), "text", "left_anti")
    return c.join(table(spark, sf, "labels").where("quality = 0").select(F.col("doc_id").alias("conv_id")), "conv_id", "left_anti").select("conv_id", "turn")


@query(LINES + f""", {BENCH_LINES}, {WORDS8},
h AS (SELECT item_id, 'exact' AS kind, doc_id FROM b JOIN l USING (line) UNION SELECT item_id, 'window8', doc_id FROM b8 JOIN d8 USING (g) WHERE b8.n = 8 AND d8.n = 8)
SELECT item_id, kind, count(DISTINCT doc_id) AS docs FROM h GROUP BY 1, 2""")
def j08_inverted_index(spark, sf):
    b, d = table(spark, sf, "benchmark"), table(spark, sf, "documents")
    found = [OF.hits(d, "doc_id", b, "item_id", k).select("item_id", F.lit(name).alias("kind")) for name, k in (("exact", OF.LINES), ("window8", OF.Windows()))]
    return found[0].unionByName(found[1]).groupBy("item_id", "kind").agg(F.count("*").alias("docs"))


@query(LINES + f""", {BENCH_LINES}, lp AS (SELECT doc_id, line, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM l),
bp AS (SELECT item_id, line, lag(line) OVER (PARTITION BY item_id ORDER BY pos) AS prev FROM b)
SELECT item_id, count(DISTINCT doc_id) AS docs FROM bp JOIN lp USING (line, prev) GROUP BY item_id""")
def j09_adjacent_pairs(spark, sf):
    """A line and the one before it are a window of two lines."""
    return OF.hits(table(spark, sf, "documents"), "doc_id", table(spark, sf, "benchmark"), "item_id", OF.Windows("\n", 2, "\n")).groupBy("item_id").agg(F.count("*").alias("docs"))


@query("SELECT p_brand AS reading, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS chars FROM part GROUP BY p_brand")
def j10_reading_table(spark, sf):
    return table(spark, sf, "part").groupBy(F.col("p_brand").alias("reading")).agg(F.array_join(F.sort_array(F.collect_set("p_type")), ",").alias("chars"))


@query("WITH k AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS k FROM part) SELECT k, count(*) AS n, min(p_partkey) AS first_part FROM k JOIN part ON starts_with(p_name, k) GROUP BY k")
def j11_prefix_join(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    keys = p.select(F.substring_index("p_name", " ", 1).alias("k")).distinct()
    return beginnings(p, "p_name", keys, "k").groupBy("k").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_part"))


@query("SELECT c_custkey, coalesce(n_name, CAST(c_nationkey AS VARCHAR)) AS name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) n ON c_nationkey = n_nationkey")
def j12_left_default(spark, sf):
    n = table(spark, sf, "nation").where("n_regionkey <> 2")
    return table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.coalesce("n_name", F.col("c_nationkey").cast("string")).alias("name"))


@query("""WITH t AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id), s AS (SELECT doc_id AS conv_id, length(text) % 7 + 1 AS m FROM documents)
SELECT t.conv_id, n FROM t JOIN s ON t.conv_id = s.conv_id WHERE n = m""")
def j13_teacher_scores(spark, sf):
    t = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    s = table(spark, sf, "documents").select(F.col("doc_id").alias("conv_id"), (F.length("text") % 7 + 1).alias("m"))
    return t.join(s, "conv_id", "left").where("n = m").select("conv_id", "n")


@query(LINES + f""", {BENCH_LINES}, c AS (SELECT unnest(string_split(text, chr(10))) AS line FROM conversations),
h AS (SELECT item_id, 'documents' AS corpus FROM b JOIN l USING (line) UNION SELECT item_id, 'conversations' FROM b JOIN c USING (line))
SELECT item_id, coalesce(seen, '') AS seen_in FROM benchmark LEFT JOIN (SELECT item_id, string_agg(corpus, ',' ORDER BY corpus) AS seen FROM h GROUP BY item_id) USING (item_id)""")
def j14_seen_in(spark, sf):
    b = table(spark, sf, "benchmark")
    bits = OF.filter_of(b, "text", OF.LINES)
    lines = OF.possible(b, "item_id", "text", OF.LINES)
    hits = None
    for name, key in (("documents", "doc_id"), ("conversations", "conv_id")):
        seen = OF.possible(table(spark, sf, name), key, "text", OF.LINES, bits).select("window")
        h = lines.join(seen, "window", "left_semi").select("item_id", F.lit(name).alias("corpus")).distinct()
        hits = h if hits is None else hits.unionByName(h)
    out = table(spark, sf, "benchmark").select("item_id").join(V.seen_in(hits, "item_id", "corpus"), "item_id", "left")
    return out.select("item_id", F.coalesce("seen_in", F.lit("")).alias("seen_in"))


@query("""WITH a AS (SELECT doc_id FROM documents WHERE lang = 'en'), b AS (SELECT doc_id FROM labels)
SELECT count(*) FILTER (WHERE a.doc_id IS NULL) AS only_right, count(*) FILTER (WHERE b.doc_id IS NULL) AS only_left, count(*) AS n FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def j16_set_equality(spark, sf):
    a = table(spark, sf, "documents").where("lang = 'en'").select(F.col("doc_id").alias("a"))
    b = table(spark, sf, "labels").select(F.col("doc_id").alias("b"))
    return a.join(b, F.col("a") == F.col("b"), "full").agg(F.count_if(F.col("a").isNull()).alias("only_right"), F.count_if(F.col("b").isNull()).alias("only_left"), F.count("*").alias("n"))


@query("SELECT conv_id, turn, n FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'user') WHERE n <= 3")
def w06_per_dialogue_cap(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", F.row_number().over(w).cast("bigint").alias("n")).where("n <= 3")


@query("""SELECT conv_id, turn, coalesce(string_agg(text, chr(10)) OVER (PARTITION BY conv_id, role ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS own FROM conversations""")
def w07_own_history(spark, sf):
    """Cut for each turn out of the one text of its speaker in the conversation."""
    rows = table(spark, sf, "conversations").select("conv_id", "role", "turn", "text")
    own = K.whole_contexts(K.offsets(rows, ["conv_id", "role"], ["turn"]), ["conv_id", "role"], ["turn"])
    return own.select("conv_id", "turn", F.col("before").alias("own"))


@query("""WITH p AS (SELECT conv_id, role, turn, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id, role ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM conversations),
w AS (SELECT conv_id, role, string_agg(text, chr(10) ORDER BY turn) AS whole FROM conversations GROUP BY conv_id, role)
SELECT conv_id, turn, right(left(whole, greatest(start - 1, 0)), 200) AS own FROM p JOIN w USING (conv_id, role)""")
def w07_own_tails(spark, sf):
    """The last 200 characters of what the same speaker said before."""
    rows = table(spark, sf, "conversations").select("conv_id", "role", "turn", "text")
    own = K.tails(K.offsets(rows, ["conv_id", "role"], ["turn"]), ["conv_id", "role"], ["turn"], 200)
    return own.select("conv_id", "turn", F.col("before").alias("own"))


@query("""SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier,
 CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS chars FROM conversations""")
def w08_earlier_messages(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.count("*").over(w).alias("earlier"), F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)).alias("chars"))


SEEDED = "md5('s1' || ':' || {k})"


@query("SELECT conv_id, CASE WHEN row_number() OVER (PARTITION BY role ORDER BY md5('s1' || ':' || conv_id || ':' || turn), conv_id, turn) % 2 = 1 THEN 'none' ELSE 'context' END AS stratum, turn FROM conversations")
def w09_alternating_strata(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", S.seeded("s1", "conv_id", "turn").alias("hash"))
    c = O.numbered(c, ["hash", "conv_id", "turn"], "k", ["role"])
    return c.select("conv_id", F.when(F.col("k") % 2 == 1, "none").otherwise("context").alias("stratum"), "turn")


@query("SELECT doc_id, substr(source, 1, 1) || '-' || lpad(CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS VARCHAR), 6, '0') AS id FROM documents")
def w10_running_ids(spark, sf):
    d = O.numbered(table(spark, sf, "documents").select("doc_id", "source"), ["doc_id"], "k", ["source"])
    return d.select("doc_id", F.concat(F.substring("source", 1, 1), F.lit("-"), F.lpad(F.col("k").cast("string"), 6, "0")).alias("id"))


@query("WITH r AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2) SELECT lang, source, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) AS k FROM r) WHERE k <= 3")
def t03_top_per_key(spark, sf):
    r = table(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return S.first_of_each(r, "lang", [F.desc("n"), "source"], 3)


@query(LINES + "SELECT line, row_number() OVER (ORDER BY line, doc_id, pos) AS k FROM l")
def t05_all_sorted_lines(spark, sf):
    """Every line, repeats included; equal lines by document and position."""
    return O.numbered(_lines(spark, sf, "documents", "doc_id"), ["line", "doc_id", "pos"], "k").select("line", "k")


@query("SELECT doc_id, text, row_number() OVER (ORDER BY md5('seed' || ':' || doc_id), doc_id) AS k FROM documents")
def t06_shuffled_documents(spark, sf):
    """Every document at its place in the seeded order."""
    return S.shuffled(table(spark, sf, "documents").select("doc_id", "text"), "seed", ["doc_id"], "k")


@query("SELECT doc_id, CASE WHEN ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT % 25 = 0 THEN 'dev' ELSE 'train' END AS split FROM documents")
def t07_hash_split(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.split_of(F.col("doc_id").cast("string"), 25).alias("split"))


@query("SELECT page_id, url FROM pages ORDER BY md5('pages' || ':' || page_id), page_id LIMIT 60")
def t08_fixed_sample(spark, sf):
    return S.sample(table(spark, sf, "pages").select("page_id", "url"), 60, "pages", "page_id")


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('strata' || ':' || doc_id), doc_id) AS k FROM documents) WHERE k <= 60")
def t09_stratified_sample(spark, sf):
    return S.per_stratum(table(spark, sf, "documents").select("doc_id", "lang"), ["lang"], 60, "strata", "doc_id")


@query(LINES + f""", {BENCH_LINES}, f AS (SELECT doc_id, lang, pos, line FROM l WHERE line NOT IN (SELECT line FROM b)),
o AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY md5('q' || ':' || doc_id || ':' || pos), doc_id, pos) AS r FROM f)
SELECT doc_id, lang, pos, line FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('q' || ':' || doc_id || ':' || pos), doc_id, pos) AS k FROM o WHERE r = 1) WHERE k <= 100""")
def t10_quota(spark, sf):
    lines = C.lines_of(table(spark, sf, "documents"), "doc_id", "lang")
    out = S.quota(lines, "line", _lines(spark, sf, "benchmark", "item_id"), ["lang"], 100, "q", "doc_id", "pos")
    return out.select("doc_id", "lang", F.col("pos").cast("bigint").alias("pos"), "line")


@query("""WITH n AS (SELECT count(*) AS n FROM documents) SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= floor(0.999 * n) THEN 'train' ELSE 'valid' END AS part FROM documents, n""")
def t11_contiguous_split(spark, sf):
    """Ids are numbered by ranges, so the tail isn't gathered in one task however long it is."""
    d = table(spark, sf, "documents").select("doc_id")
    n = d.agg(F.count("*").alias("n"))
    k = O.numbered(d, ["doc_id"], "k").join(F.broadcast(n), F.lit(True))  # one row
    return k.select("doc_id", F.when(F.expr("k <= floor(0.999BD * n)"), "train").otherwise("valid").alias("part"))


@query("""WITH w AS (SELECT doc_id, string_split_regex(text, '[ \\n]') AS w FROM documents),
s AS (SELECT doc_id, w, ('0x' || substr(md5('t12:' || doc_id), 1, 15))::BIGINT % greatest(len(w) - 63, 1) AS start FROM w)
SELECT doc_id, CAST(start AS INTEGER) AS start, array_to_string(w[start + 1:start + 64], ' ') AS "window" FROM s""")
def t12_token_windows(spark, sf):
    words = F.split("text", "[ \\n]")
    d = table(spark, sf, "documents").select("doc_id", words.alias("w"))
    at = X.hash_bucket(F.concat(F.lit("t12:"), F.col("doc_id").cast("string")), F.greatest(F.size("w") - 63, F.lit(1))).cast("int")
    return d.select("doc_id", at.alias("start"), F.array_join(F.slice("w", at + 1, 64), " ").alias("window"))


@query("SELECT conv_id, ['ann', 'bob', 'cat', 'dan', 'eve'][conv_id % 5 + 1] AS recipient, count(*) AS turns FROM conversations GROUP BY conv_id")
def t13_cyclic_plan(spark, sf):
    names = F.array(*map(F.lit, ("ann", "bob", "cat", "dan", "eve")))
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns")).select("conv_id", F.element_at(names, (F.col("conv_id") % 5 + 1).cast("int")).alias("recipient"), "turns")


@query("""WITH s AS (SELECT conv_id, turn, text, left(repeat(text, CAST(ceil(64.0 / length(text)) AS INTEGER)), 64) AS cut, CAST(ceil(64.0 / length(text)) AS INTEGER) AS repeats FROM conversations WHERE length(text) > 0)
SELECT cut, min(conv_id) AS first_conv, max(repeats) AS repeats FROM s GROUP BY cut""")
def t14_equal_prefixes(spark, sf):
    c = table(spark, sf, "conversations").where("length(text) > 0").withColumn("repeats", F.ceil(F.lit(64.0) / F.length("text")).cast("int"))
    c = c.select("conv_id", "repeats", F.substring(F.repeat("text", F.col("repeats")), 1, 64).alias("cut"))
    return c.groupBy("cut").agg(F.min("conv_id").alias("first_conv"), F.max("repeats").alias("repeats"))


@query("SELECT 0 AS priority, text FROM benchmark UNION ALL SELECT 1, text FROM conversations UNION ALL SELECT 2, text FROM documents")
def s01_priority_union(spark, sf):
    parts = [table(spark, sf, n).select(F.lit(i).alias("priority"), "text") for i, n in enumerate(("benchmark", "conversations", "documents"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def s02_intersection(spark, sf):
    return table(spark, sf, "documents").select("doc_id").intersect(table(spark, sf, "labels").select("doc_id"))


@query("SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels")
def s03_difference(spark, sf):
    return table(spark, sf, "documents").select("doc_id").exceptAll(table(spark, sf, "labels").select("doc_id"))


@query("SELECT doc_id FROM labels WHERE quality = 1 UNION SELECT doc_id FROM labels WHERE toxic = 1")
def s04_union_distinct(spark, sf):
    a = table(spark, sf, "labels")
    return a.where("quality = 1").select("doc_id").union(a.where("toxic = 1").select("doc_id")).distinct()


@query("""SELECT event_type, count(*) FILTER (WHERE b AND NOT a) = 0 AND count(*) FILTER (WHERE a AND NOT b) > 0 AS superset FROM (SELECT event_type, user_id, max(value) > 20 AS a, max(value) > 60 AS b FROM events GROUP BY 1, 2) GROUP BY event_type""")
def s05_strict_superset(spark, sf):
    u = table(spark, sf, "events").groupBy("event_type", "user_id").agg((F.max("value") > 20).alias("a"), (F.max("value") > 60).alias("b"))
    return u.groupBy("event_type").agg(((F.count_if(F.col("b") & ~F.col("a")) == 0) & (F.count_if(F.col("a") & ~F.col("b")) > 0)).alias("superset"))


@query("""WITH s AS (SELECT doc_id, text, ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT % 25 = 0 AS dev FROM documents)
SELECT doc_id FROM s WHERE NOT dev AND text NOT IN (SELECT text FROM s WHERE dev)""")
def s07_train_clear_of_dev(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", S.split_of(F.col("doc_id").cast("string"), 25).alias("split"))
    return d.where("split = 'train'").join(d.where("split = 'dev'").select("text"), "text", "left_anti").select("doc_id")
