"""Projections, filters and scalar functions over text."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslab.functions import presets as P
from corpuslab.functions import text as X
from corpuslab.operators import corpus as C
from corpuslab.operators import words as W
from corpuslab.registry import query
from corpuslab.sources import table

LINES = "WITH l AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)\n"
ACCENTS = "äöüßéèêçñíó"


def _lines(spark, sf):
    return C.lines_of(table(spark, sf, "documents"), "doc_id", "lang")


@query(r"""SELECT doc_id, unnest(r) AS run, unnest(range(len(r))) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '\p{L}+') AS r FROM documents)""")
def f01_script_runs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(X.script_runs(F.col("text"), P.LATIN.letters)).alias("pos", "run")).select("doc_id", "run", F.col("pos").cast("bigint").alias("pos"))


@query(LINES + """, p AS (SELECT doc_id, pos, line, unnest(range(greatest(1, CAST(ceil(length(line) / 96.0) AS BIGINT)))) AS k FROM l)
SELECT doc_id, pos, k AS piece_no, substring(line, k * 96 + 1, 96) AS piece FROM p WHERE length(substring(line, k * 96 + 1, 96)) >= 4""")
def f02_clip_runs(spark, sf):
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length("line") / 96), F.lit(1)).cast("int") - 1)
    flat = _lines(spark, sf).select("doc_id", "pos", "line", F.explode(starts).alias("k"))
    return flat.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.col("k").cast("bigint").alias("piece_no"), F.substring("line", F.col("k") * 96 + 1, F.lit(96)).alias("piece")).where(F.length("piece") >= 4)


@query(r"""SELECT doc_id, len(w) AS n_runs, array_to_string(w, ' ') AS runs FROM (SELECT doc_id, list_filter(string_split_regex(regexp_replace(text, '[^\p{L}]', ' ', 'g'), ' +'), lambda x: x <> '') AS w FROM documents)""")
def f03_connected_runs(spark, sf):
    w = X.connected_runs(F.col("text"), "\\p{L}")
    return table(spark, sf, "documents").select("doc_id", F.size(w).cast("bigint").alias("n_runs"), F.array_join(w, " ").alias("runs"))


@query(f"""SELECT doc_id, round(length(regexp_replace(text, '[^{ACCENTS}]', '', 'g')) / greatest(1, length(text)), 9) AS share,
 length(regexp_replace(text, '[^{ACCENTS}]', '', 'g')) / greatest(1, length(text)) > 0.005 AS dropped FROM documents""")
def f04_marker_share(spark, sf):
    share = X.marker_share(F.col("text"), ACCENTS)
    return table(spark, sf, "documents").select("doc_id", F.round(share, 9).alias("share"), (share > P.MARKER_SHARE).alias("dropped"))


@query(LINES + f"SELECT doc_id, pos, line FROM l WHERE line <> '' AND NOT regexp_matches(line, '[{ACCENTS}]')")
def f05_fragment_filter(spark, sf):
    return _lines(spark, sf).where((F.col("line") != "") & ~X.has_marker(F.col("line"), ACCENTS)).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "line")


@query(r"""WITH h AS (SELECT doc_id, left(text, 4000) AS h FROM documents)
SELECT doc_id, length(regexp_replace(h, '[\s\x{3000}\x{a0}]', '', 'g')) >= 64
 AND length(regexp_replace(h, '[^\p{L}]', '', 'g')) >= 0.5 * length(regexp_replace(h, '[\s\x{3000}\x{a0}]', '', 'g'))
 AND regexp_matches(h, '[\p{L}]{8,}') AS prose FROM h""")
def f06_is_prose(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.is_prose(F.col("text"), P.LATIN.letters).alias("prose"))


@query(r"""SELECT page_id, replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<code[^>]*>.*?</code>|(?s)<pre[^>]*>.*?</pre>', ' ', 'g'),
 '</?[a-zA-Z][^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS plain FROM pages""")
def f07_strip_markup(spark, sf):
    t = F.regexp_replace(F.col("html"), "(?s)<!--.*?-->", " ")
    t = F.regexp_replace(F.regexp_replace(t, "(?s)<(code|pre)[^>]*>.*?</\\1>", " "), "</?[a-zA-Z][^>]*>", " ")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return table(spark, sf, "pages").select("page_id", t.alias("plain"))


def _in_turn(of: str, patterns: tuple[str, ...]) -> str:
    """SQL that replaces patterns by a space, one after the other."""
    for p in patterns:
        of = f"regexp_replace({of}, '{p}', ' ', 'g')"
    return of


#: The wiki patterns, without a reference back to a group, before and after that of templates.
BODIES = "|".join(f"(?s)<{t}[^>]*>.*?</{t}>" for t in ("math", "code", "pre", "gallery", "timeline"))
AT = P.WIKI_NOISE.index(P.WIKI_TEMPLATE)
WIKI_BEFORE = tuple(BODIES if "\\1" in p else p for p in P.WIKI_NOISE[:AT])


@query(f"""WITH RECURSIVE w AS (SELECT page_id, regexp_replace(regexp_replace(html, '<div[^>]*>', '{{{{', 'g'), '</div>', '}}}}', 'g') AS raw FROM pages),
r AS (SELECT page_id, 0 AS k, {_in_turn(f"regexp_replace(raw, '{P.WIKI_LINK}', chr(92) || '1', 'g')", WIKI_BEFORE)} AS t FROM w
 UNION ALL SELECT page_id, k + 1, {_in_turn("t", (P.WIKI_TEMPLATE,))} FROM r WHERE regexp_matches(t, '{P.WIKI_TEMPLATE}')),
z AS (SELECT page_id, arg_max(t, k) AS t FROM r GROUP BY page_id)
SELECT page_id, replace(replace(replace({_in_turn("t", P.WIKI_NOISE[AT + 1:])}, '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS plain FROM z""")
def f07_strip_wikitext(spark, sf):
    """Pages whose divisions are templates, nested as the divisions are."""
    raw = F.regexp_replace(F.regexp_replace("html", "<div[^>]*>", "{{"), "</div>", "}}")
    return table(spark, sf, "pages").select("page_id", X.strip_wikitext(raw).alias("plain"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
 '(?s)\A---\n.*?\n---\n', ' ', 'g'), '(?s)```.*?```', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)\{\{%.*?%\}\}', ' ', 'g'), '(?s)\{\{<.*?>\}\}', ' ', 'g'), '`[^`]*`', ' ', 'g'),
 '!?\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '</?[a-zA-Z][^>]*>', ' ', 'g'), '(?m)^\s*\|.*$', ' ', 'g') AS plain FROM pages""")
def f08_strip_markdown(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.strip_markdown(F.col("html")).alias("plain"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '[\s\x{3000}\x{a0}]+', ' ', 'g')) AS text FROM documents")
def f09_collapse_space(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.collapse_space(F.col("text")).alias("text"))


@query(LINES + r"""SELECT doc_id, pos, CASE WHEN length(line) - length(replace(line, ' ', '')) >= 3
 AND (length(line) - length(replace(line, ' ', ''))) * 2 >= length(regexp_replace(line, '[^\p{L}]', '', 'g')) THEN replace(line, ' ', '') ELSE line END AS line FROM l""")
def f10_repair_spacing(spark, sf):
    return _lines(spark, sf).select("doc_id", F.col("pos").cast("bigint").alias("pos"), X.repair_spacing(F.col("line"), P.LATIN.letters).alias("line"))


CLAUSES = r"""WITH p AS (SELECT doc_id, string_split_regex(text, '{edges}') AS a FROM documents),
q AS (SELECT doc_id, unnest(a) AS clause, unnest(range(len(a))) AS k, a FROM p),
s AS (SELECT doc_id, clause, k, len(a) AS n, coalesce(sum(length(clause) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM q)
SELECT doc_id, CAST(start AS BIGINT) AS start, clause FROM s WHERE regexp_full_match(clause, '[\p{{L}}]{{4,16}}') {more}"""


@query(CLAUSES.format(edges=r"[,.!?;: \n]", more=""))
def f11_clauses(spark, sf):
    return C.clause_rows(table(spark, sf, "documents"), "doc_id", P.LATIN)


@query(CLAUSES.format(edges=r"[,.!?;:\n]", more="AND k > 0 AND k < n - 1"))
def f12_strict_clauses(spark, sf):
    return C.clause_rows(table(spark, sf, "documents"), "doc_id", P.LATIN, strict=True)


@query(LINES + "SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE regexp_matches(line, '[,.;:!?]')) AS prose_lines FROM l GROUP BY doc_id")
def f13_prose_paragraphs(spark, sf):
    return _lines(spark, sf).groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(X.is_prose_paragraph(F.col("line"), P.LATIN.prose_marks)).alias("prose_lines"))


@query("""WITH b AS (SELECT doc_id, text, hex(encode(text)) AS h FROM documents)
SELECT doc_id, CASE WHEN length(h) <= 512 THEN text ELSE decode(unhex(regexp_replace(right(h, 512), '^([89AB][0-9A-F]){1,3}', ''))) END AS tail FROM b""")
def f14_byte_tail(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.byte_tail(F.col("text"), 256).alias("tail"))


@query("SELECT doc_id, right(text, 200) AS tail, length(right(text, 200)) AS n FROM documents")
def f36_char_tail(spark, sf):
    t = X.char_tail(F.col("text"), 200)
    return table(spark, sf, "documents").select("doc_id", t.alias("tail"), F.length(t).cast("bigint").alias("n"))


READINGS = "string_split_regex(lower(text), '[ \\n]')"


@query(f"SELECT doc_id, len(list_filter({READINGS}, lambda x: NOT (regexp_full_match(x, '[A-Za-z]+') AND x NOT IN ('n', 'ng', 'm', 'hm', 'hng')))) = 0 AS valid FROM documents")
def f15_valid_readings(spark, sf):
    r = F.split(F.lower("text"), "[ \\n]")
    return table(spark, sf, "documents").select("doc_id", X.valid_readings(r).alias("valid"))


WORDS = r"WITH w AS (SELECT conv_id, turn, unnest(string_split_regex(text, '[ \n]')) AS word, unnest(range(len(string_split_regex(text, '[ \n]')))) AS pos FROM conversations)"


@query(WORDS + """, d AS (SELECT substr(p_name, 1, 1) AS head, min(p_brand) AS reading FROM part GROUP BY 1)
SELECT conv_id, turn, pos, word, coalesce(reading, word) AS reading FROM w LEFT JOIN d ON head = lower(substr(word, 1, 1))""")
def f16_readings_by_table(spark, sf):
    words = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "[ \\n]")).alias("pos", "word"))
    d = table(spark, sf, "part").groupBy(F.substring("p_name", 1, 1).alias("head")).agg(F.min("p_brand").alias("reading"))
    out = words.join(d, F.col("head") == F.lower(F.substring("word", 1, 1)), "left")
    return out.select("conv_id", "turn", F.col("pos").cast("bigint").alias("pos"), "word", F.coalesce("reading", "word").alias("reading"))


@query(WORDS + """, g AS (SELECT conv_id, turn, pos, 1 AS words, word AS win FROM w UNION ALL SELECT conv_id, turn, pos, 2, word || lead(word) OVER (PARTITION BY conv_id, turn ORDER BY pos) FROM w)
SELECT conv_id, turn, arg_min(win, md5(conv_id || ':' || turn || ':' || pos || ':' || words)) AS win FROM g WHERE length(win) BETWEEN 2 AND 4 GROUP BY conv_id, turn""")
def f17_word_windows(spark, sf):
    a = F.split("text", "[ \\n]")
    flat = table(spark, sf, "conversations").select("conv_id", "turn", a.alias("a")).select("conv_id", "turn", "a", F.posexplode("a").alias("pos", "word"))
    one = F.array(F.struct(F.lit(1).alias("words"), F.col("word").alias("win")), F.struct(F.lit(2).alias("words"), F.concat("word", F.get("a", F.col("pos") + 1)).alias("win")))
    g = flat.select("conv_id", "turn", "pos", F.explode(one).alias("g")).where(F.length("g.win").between(P.WORD_MIN, P.WORD_MAX))
    return g.groupBy("conv_id", "turn").agg(F.min_by("g.win", F.md5(F.concat_ws(":", "conv_id", "turn", "pos", "g.words"))).alias("win"))


#: Readings of single letters, and of words around them that decide otherwise.
SOUNDS = [("a", ["A"]), ("e", ["E"]), ("i", ["I"]), ("o", ["O"]), ("u", ["U"]), ("ou", ["U", ""]), ("qu", ["K", "W"]), ("ch", ["T", "X"]), ("sch", ["S", "X", ""])]


def _replaced(column: str, pairs: list[tuple[str, str]]) -> str:
    for a, b in pairs:
        column = f"replace({column}, '{a}', '{b}')"
    return column


@query(f"SELECT conv_id, turn, {_replaced('lower(text)', [(w, ''.join(r)) for w, r in sorted(SOUNDS, key=lambda x: -len(x[0]))])} AS sounds FROM conversations")
def f16_readings_by_word(spark, sf):
    """Readings of all characters, of which words decide before single letters; what has none stands for itself."""
    t = table(spark, sf, "conversations").select("conv_id", "turn", F.lower("text").alias("text"))
    t = W.with_readings(t, "text", spark.createDataFrame(SOUNDS, "word string, readings array<string>"))
    both = F.zip_with("readings", X.chars(F.col("text")), lambda r, c: F.coalesce(r, c))
    return t.select("conv_id", "turn", F.array_join(both, "").alias("sounds"))


@query("""WITH RECURSIVE bw AS (SELECT unnest(string_split_regex(lower(text), '[ \\n]')) AS w FROM benchmark),
t AS MATERIALIZED (SELECT substr(w, i, l) AS piece, count(*) AS n FROM (SELECT w, unnest(range(1, length(w) + 1)) AS i FROM bw) a, range(1, 5) b(l) WHERE i + l - 1 <= length(w) GROUP BY 1),
tot AS MATERIALIZED (SELECT sum(n) AS total FROM t),
cw AS MATERIALIZED (SELECT DISTINCT unnest(string_split_regex(lower(text), '[ \\n]')) AS w FROM conversations),
s AS (SELECT w, e, l, substr(w, CAST(e - l + 1 AS BIGINT), l) AS piece FROM (SELECT w, unnest(range(1, length(w) + 1)) AS e FROM cw) x, range(1, 5) b(l) WHERE l <= e),
o AS MATERIALIZED (SELECT w, e, list({'l': l, 'piece': piece, 'cost': CAST(round(1000 * ln(total / coalesce(n, 0.5))) AS BIGINT)}) AS opts
 FROM s LEFT JOIN t USING (piece) CROSS JOIN tot WHERE n IS NOT NULL OR l = 1 GROUP BY w, e),
r AS (SELECT w, CAST(0 AS BIGINT) AS e, [{'cost': CAST(0 AS BIGINT), 'neg': CAST(0 AS BIGINT), 'segs': CAST([] AS VARCHAR[])}] AS best FROM cw
 UNION ALL SELECT r.w, r.e + 1, list_append(r.best, list_sort(list_transform(o.opts, lambda x: {'cost': r.best[r.e + 2 - x.l].cost + x.cost, 'neg': -x.l, 'segs': list_append(r.best[r.e + 2 - x.l].segs, x.piece)}))[1])
 FROM r JOIN o ON o.w = r.w AND o.e = r.e + 1),
p AS MATERIALIZED (SELECT w AS word, best[e + 1].segs AS a FROM r WHERE e = length(w)),
g AS (SELECT word, a, list_filter(flatten(list_transform(range(1, len(a) + 1), lambda i: [a[i], CASE WHEN i < len(a) THEN a[i] || a[i + 1] END])), lambda x: x IS NOT NULL AND length(x) BETWEEN 2 AND 4) AS wins FROM p)
SELECT word, array_to_string(a, ' ') AS pieces, list_sort(list_transform(range(len(wins)), lambda i: {'h': md5(word || ':' || i), 'x': wins[i + 1]}))[1].x AS win FROM g""")
def f17_segmented_windows(spark, sf):
    """Each distinct word of conversations parted by the shares of strings of up to four letters in the benchmark's words,
    and one window of a piece or two."""
    split = lambda name: table(spark, sf, name).select(F.explode(F.split(F.lower("text"), "[ \\n]")).alias("w"))
    grams = split("benchmark").where("w <> ''").select(F.explode(F.expr("flatten(transform(sequence(1, length(w)), i -> transform(sequence(1, least(4, length(w) - i + 1)), l -> substr(w, i, l))))")).alias("word"))
    out = W.segmented(split("conversations").select(F.col("w").alias("word")).distinct(), "word", grams.groupBy("word").agg(F.count("*").alias("n")), "found")
    return out.select("word", F.array_join("found", " ").alias("pieces"), W.picked(W.word_windows(F.col("found")), F.col("word")).alias("win"))


@query(f"""WITH r AS (SELECT conv_id, turn, {READINGS} AS a FROM conversations)
SELECT conv_id, turn, array_to_string(a, '') AS full_key, array_to_string(list_transform(a, lambda x: substr(x, 1, 1)), '') AS initials FROM r""")
def f18_typed_keys(spark, sf):
    r = F.split(F.lower("text"), "[ \\n]")
    return table(spark, sf, "conversations").select("conv_id", "turn", X.typed_key(r, "full").alias("full_key"), X.typed_key(r, "initials").alias("initials"))


@query(f"""WITH r AS (SELECT conv_id, turn, {READINGS} AS a FROM conversations),
u AS (SELECT conv_id, turn, unnest(a) AS r, unnest(range(len(a))) AS i FROM r),
h AS (SELECT *, CAST('0x' || substr(md5(conv_id || ':' || turn || ':' || i), 1, 4) AS INTEGER) % 2 = 1 AS bit FROM u),
s AS (SELECT *, bool_or(bit) OVER p AND NOT bool_and(bit) OVER p AS varied FROM h WINDOW p AS (PARTITION BY conv_id, turn))
SELECT conv_id, turn, string_agg(CASE WHEN CASE WHEN varied THEN bit ELSE i = 0 END THEN r ELSE substr(r, 1, 1) END, '' ORDER BY i) AS mixed FROM s GROUP BY conv_id, turn""")
def f18_typed_keys_mixed(spark, sf):
    r = F.split(F.lower("text"), "[ \\n]")
    return table(spark, sf, "conversations").select("conv_id", "turn", X.typed_key(r, "mixed", F.concat_ws(":", "conv_id", "turn")).alias("mixed"))


def _case(table_: dict[str, str], of: str) -> str:
    return f"CASE {of} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table_.items()) + " END"


@query(f"""WITH s AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]+')) AS s FROM documents)
SELECT s AS syllable, CASE WHEN length(s) = 1 THEN s || s WHEN length(s) = 2 THEN s
 WHEN {_case(P.DOUBLE_KEY_FINALS, 's')} IS NOT NULL THEN substr(s, 1, 1) || {_case(P.DOUBLE_KEY_FINALS, 's')}
 WHEN substr(s, 1, 2) IN ('sh', 'ch', 'zh') THEN {_case(P.DOUBLE_KEY_INITIALS, 'substr(s, 1, 2)')} || {_case(P.DOUBLE_KEY_FINALS, 'substr(s, 3)')}
 ELSE substr(s, 1, 1) || {_case(P.DOUBLE_KEY_FINALS, 'substr(s, 2)')} END AS keys FROM s""")
def f19_double_key(spark, sf):
    s = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))).alias("syllable")).distinct()
    return s.select("syllable", X.double_key(F.col("syllable")).alias("keys"))


@query("""WITH c AS (SELECT page_id, list_filter(string_split(lower(url), ''), lambda x: x <> '') AS a FROM pages)
SELECT page_id, array_to_string(list_transform(a, lambda x: CAST(instr('abcdefghijklmnopqrstuvwxyz''', x) AS VARCHAR)), ' ') AS ids FROM c""")
def f20_letter_ids(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.array_join(X.letter_ids(F.col("url")).cast("array<string>"), " ").alias("ids"))


@query("SELECT doc_id, regexp_matches(text, 'idiot|scum|trash|loser|moron') AS spam FROM documents")
def f21_spam_terms(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.is_spam(F.col("text"), ("idiot", "scum", "trash", "loser", "moron")).alias("spam"))


@query(r"SELECT conv_id, turn, regexp_matches(text, '[éèäöüñç]') AND NOT regexp_matches(text, '[0-9\n\r]') AS clean FROM conversations")
def f22_clean_messages(spark, sf):
    ok = X.is_clean_message(F.col("text"), "éèäöüñç", "0-9")
    return table(spark, sf, "conversations").select("conv_id", "turn", ok.alias("clean"))


@query(r"SELECT doc_id, regexp_matches(text, '[\\\t\r]') AS unsafe FROM documents")
def f23_control_guard(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.has_control(F.col("text")).alias("unsafe"))


@query("""WITH w AS MATERIALIZED (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-zéè]+')) AS w FROM documents),
k AS MATERIALIZED (SELECT w, translate(w, 'eéè', 'eee') AS key FROM w), m AS MATERIALIZED (SELECT * FROM k WHERE key IN (SELECT key FROM k GROUP BY key HAVING count(*) > 1))
SELECT a.w AS a, b.w AS b FROM m a JOIN m b USING (key) WHERE a.w < b.w""")
def f24_swaps(spark, sf):
    w = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-zéè]+"), F.lit(0))).alias("w")).distinct()
    w = w.withColumn("key", F.translate("w", "eéè", "eee"))
    a, b = w.select(F.col("w").alias("a"), "key"), w.select(F.col("w").alias("b"), "key")
    return a.join(b, "key").where((F.col("a") < F.col("b")) & X.differs_only_in(F.col("a"), F.col("b"), "eéè")).select("a", "b")


@query("""WITH r AS (SELECT conv_id, turn, text, greatest(0, 64 - (CAST(turn AS INTEGER) + 8 + 1)) AS room FROM conversations)
SELECT conv_id, turn, CASE WHEN length(text) <= room THEN text WHEN room // 16 > 0 THEN right(text, room // 16 * 16) ELSE '' END AS context FROM r""")
def f25_rerank_context(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", X.rerank_context(F.col("text"), 64, F.col("turn").cast("int") + 8).alias("context"))


@query("""WITH c AS (SELECT conv_id, turn, list_transform(list_filter(string_split(text, ''), lambda x: x <> ''), lambda x: CAST(unicode(x) AS INTEGER)) AS a FROM conversations)
SELECT conv_id, turn, '2 ' || array_to_string(a[greatest(1, len(a) - 31 + 1):], ' ') AS tokens FROM c WHERE len(a) > 0""")
def f26_prefix_tokens(spark, sf):
    a = F.transform(X.chars(F.col("text")), lambda c: F.ascii(c))
    t = X.prefix_tokens(a, 40, F.lit(8))
    return table(spark, sf, "conversations").where("text <> ''").select("conv_id", "turn", F.array_join(t.cast("array<string>"), " ").alias("tokens"))


VOCAB = """v AS (SELECT ch, row_number() OVER (ORDER BY n DESC, ch) + 2 AS token_id FROM (SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY ch ORDER BY n DESC, ch LIMIT 29))"""


@query(f"""WITH {VOCAB}, c AS (SELECT conv_id, turn, unnest(string_split(text, '')) AS ch, unnest(range(len(string_split(text, '')))) AS pos FROM conversations)
SELECT conv_id, turn, pos, coalesce(token_id, 1) AS token_id FROM c LEFT JOIN v USING (ch) WHERE ch <> ''""")
def f27_encode(spark, sf):
    vocab = C.vocabulary(table(spark, sf, "documents"), "text", 32)
    out = C.encode(table(spark, sf, "conversations"), ["conv_id", "turn"], X.chars(F.col("text")), vocab.where("token_id > 2"))
    return out.select("conv_id", "turn", F.col("pos").cast("bigint").alias("pos"), F.col("token_id").cast("bigint").alias("token_id"))


SYLLABLES = ("th", "the", "re", "er", "an", "in", "on", "ti", "tion", "ing", "ed", "es", "en", "at", "or", "ha", "he", "nd", "ou", "ea", "st", "ly", "sh", "nt", "ble", "wh", "is", "to", "of", "and", "a", "it", "for", "was", "be", "by", "as", "with", "that", "this", "are", "from")
LONGEST_FIRST = "|".join(sorted(SYLLABLES, key=lambda s: (-len(s), s)))


@query(f"""WITH RECURSIVE w AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(text, '[a-z]+')) AS w FROM documents)),
g AS (SELECT w, w AS rest, '' AS parts FROM w
 UNION ALL SELECT w, substr(rest, length(regexp_extract(rest, '^({LONGEST_FIRST})', 1)) + 1), parts || ' ' || regexp_extract(rest, '^({LONGEST_FIRST})', 1) FROM g WHERE rest <> '' AND regexp_extract(rest, '^({LONGEST_FIRST})', 1) <> '')
SELECT w AS word, ltrim(parts) AS parts FROM g WHERE rest = ''""")
def f28_greedy_syllables(spark, sf):
    w = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    return w.withColumn("p", X.greedy_syllables(F.col("word"), SYLLABLES)).where("p is not null").select("word", F.array_join("p", " ").alias("parts"))


@query("""WITH i AS (SELECT conv_id, turn, text, unnest(range(1, greatest(1, length(text) - 1))) AS i FROM conversations)
SELECT conv_id, turn, count(DISTINCT substr(text, i, 3)) AS grams FROM i GROUP BY conv_id, turn""")
def f31_ngram_counts(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.explode(X.char_windows(F.col("text"), 3)).alias("s"))
    return rows.groupBy("conv_id", "turn").agg(F.countDistinct("s").alias("grams"))


@query("""WITH i AS (SELECT text, w, unnest(range(1, greatest(1, length(text) - w + 2))) AS i FROM conversations, (VALUES (2), (3)) t(w))
SELECT ('0x' || substr(md5(substr(text, i, w)), 1, 15))::BIGINT % 4096 AS bucket, count(*) AS n FROM i GROUP BY 1""")
def f31_ngram_buckets(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.explode(F.concat(X.ngram_buckets(F.col("text"), 2, 4096), X.ngram_buckets(F.col("text"), 3, 4096))).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT p_partkey, left(p_name, k) AS page, k FROM (SELECT p_partkey, p_name, unnest(range(1, length(p_name) + 1)) AS k FROM part))
SELECT page, min(p_partkey) AS first_part, max(k) AS n FROM p GROUP BY page""")
def f32_keystroke_pages(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.explode(X.prefixes(F.col("p_name"))).alias("page"))
    return p.groupBy("page").agg(F.min("p_partkey").alias("first_part"), F.max(F.length("page")).cast("bigint").alias("n"))


@query("SELECT doc_id, translate(text, 'äöüßéèêçñíó', 'aouseeecnio') AS plain FROM documents")
def f33_variant_conversion(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.translate("text", "äöüßéèêçñíó", "aouseeecnio").alias("plain"))


VARIANTS = [("ée", "ea"), ("éd", "ed"), ("ñe", "nie"), ("ß", "ss"), *zip("äöüéèêçñíó", "aoueeecnio", strict=True)]


@query(f"SELECT doc_id, {_replaced('text', VARIANTS)} AS plain FROM documents")
def f33_variants_by_table(spark, sf):
    """Variants by a table that has phrases as well as letters."""
    return W.converted(table(spark, sf, "documents").select("doc_id", F.col("text").alias("plain")), "plain", spark.createDataFrame(VARIANTS, "variant string, plain string"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, substr(props, instr(props, '{')) AS repaired FROM events""")
def f34_json_repair(spark, sf):
    s = X.json_slice(F.concat(F.lit("noise "), F.col("props"), F.lit(" tail")))
    return table(spark, sf, "events").select("event_id", F.get_json_object(s, "$.k").alias("k"), s.alias("repaired"))


@query("""WITH l AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'MIT' WHEN 1 THEN 'GPL-3.0' WHEN 2 THEN 'CC0-1.0' ELSE 'Apache-2.0' END AS license, html FROM pages)
SELECT license, count(*) AS n, bool_and(license IN ('Apache-2.0', 'MIT', 'BSD-2-Clause', 'BSD-3-Clause', 'CC0-1.0', 'CC-BY-4.0', 'Unlicense')) AS permissive,
 count(*) FILTER (WHERE contains(html, 'Wikipedia') OR contains(html, 'MDN') OR contains(html, 'CC BY-SA') OR contains(html, 'CC-BY-SA')) AS share_alike FROM l GROUP BY license""")
def f35_license_policy(spark, sf):
    lic = F.element_at(F.array(*map(F.lit, ("MIT", "GPL-3.0", "CC0-1.0", "Apache-2.0"))), (F.col("page_id") % 4 + 1).cast("int"))
    l = table(spark, sf, "pages").select(lic.alias("license"), "html")  # noqa: E741
    return l.groupBy("license").agg(F.count("*").alias("n"), F.bool_and(X.is_permissive(F.col("license"))).alias("permissive"), F.count_if(X.is_share_alike(F.col("html"))).alias("share_alike"))
