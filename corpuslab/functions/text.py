"""Column functions over text. All stay inside the JVM; a script's classes are parameters."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpuslab.functions import presets as P


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once a row: inside the functions of arrays a plain expression would be
    computed again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def chars(text: Column) -> Column:
    """Code points as an array; an empty text has none."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def class_of(signs: str) -> str:
    """A regular-expression class of literal signs."""
    return "[" + "".join("\\" + c if c in "\\]^-[&~" else c for c in signs) + "]"


def script_runs(text: Column, letters: str = P.HAN.letters) -> Column:
    """Maximal runs of a character class, in order."""
    return F.regexp_extract_all(text, F.lit(f"[{letters}]+"), F.lit(0))


def clip_run(run: Column, most: int = P.MAX_RUN, least: int = P.MIN_RUN) -> Column:
    """Pieces of at most ``most`` characters; a last piece shorter than ``least`` is dropped."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(run), F.lit(1)), F.lit(most))
    return F.filter(F.transform(starts, lambda i: F.substring(run, i, F.lit(most))), lambda p: F.length(p) >= least)


def connected_runs(line: Column, letters: str = "\\p{IsHan}") -> Column:
    """Everything outside the class becomes a boundary; what is left, as an array."""
    return F.filter(F.split(F.regexp_replace(line, f"[^{letters}]", " "), " +"), lambda w: w != "")


def marker_share(text: Column, markers: str = P.HAN.markers) -> Column:
    """Share of characters that are markers of the unwanted variant."""
    kept = F.length(F.regexp_replace(text, "[^" + class_of(markers)[1:], ""))
    return kept / F.greatest(F.lit(1), F.length(text))


def has_marker(text: Column, markers: str = P.HAN.markers) -> Column:
    return F.rlike(text, F.lit(class_of(markers)))


def is_prose(text: Column, letters: str = P.PROSE_LETTERS, sample: int = P.PROSE_SAMPLE, least: int = P.PROSE_LEAST, share: float = P.PROSE_SHARE, run: int = P.PROSE_RUN) -> Column:
    """Dense enough, mostly of the script, and with one long run, judged on the first ``sample`` characters."""
    head = F.substring(text, 1, sample)
    dense = F.length(F.regexp_replace(head, "[\\s\\x1c-\\x1f\\x85\\p{Z}]", ""))
    own = F.length(F.regexp_replace(head, f"[^{letters}]", ""))
    return (dense >= least) & (own >= share * dense) & F.rlike(head, F.lit(f"[{letters}]{{{run},}}"))


def without_templates(text: str) -> str:
    """Templates become a space, innermost first, however deep they are nested, in one pass. A template is a pair of
    opening signs, what has no brace, and a pair of closing ones. What ends a template takes out all from its beginning on,
    so that the one around it finds a space; braces that are left over stay."""
    if "{{" not in text or "}}" not in text:
        return text
    out: list[str] = []
    braces: list[int] = []  # places in ``out`` of braces that no template took
    for piece in re.split("([{}])", text):
        if piece in ("{", "}"):
            braces.append(len(out))
            out.append(piece)
            if piece == "}" and len(braces) > 3:
                a, b, c, d = braces[-4:]
                if b == a + 1 and d == c + 1 and out[a] == out[b] == "{" and out[c] == "}":
                    del out[a:], braces[-4:]
                    out.append(" ")
        elif piece:
            out.append(piece)
    return "".join(out)


@F.pandas_udf(StringType())
def strip_templates(texts: pd.Series) -> pd.Series:
    """:func:`without_templates` of each text; null stays null."""
    return texts.map(without_templates, na_action="ignore")


def strip_wikitext(raw: Column) -> Column:
    """Link labels stay, markup becomes a space, three entities are resolved. Templates are removed at any depth."""
    text = F.regexp_replace(raw, P.WIKI_LINK, "$1")
    for p in P.WIKI_NOISE:
        text = strip_templates(text) if p == P.WIKI_TEMPLATE else F.regexp_replace(text, p, " ")
    return F.replace(F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))


def strip_markdown(raw: Column) -> Column:
    """Link labels stay, other markup becomes a boundary."""
    for p in P.MARKDOWN_NOISE:
        raw = F.regexp_replace(raw, p, "$1" if p == P.MARKDOWN_LINK else " ")
    return raw


def collapse_space(text: Column) -> Column:
    """Runs of white space, ideographic and no-break space included, become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(text, "[\\s\\u3000\\u00a0]+", " "))


def repair_spacing(line: Column, letters: str = P.HAN.letters) -> Column:
    """A letter-spaced line loses its spaces: three or more, and twice as many as characters of the script at least."""
    spaces = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))
    own = F.length(F.regexp_replace(line, f"[^{letters}]", ""))
    return F.when((spaces >= 3) & (spaces * 2 >= own), F.replace(line, F.lit(" "), F.lit(""))).otherwise(line)


def clauses(text: Column, script: P.Script = P.HAN, strict: bool = False, least: int = P.CLAUSE_MIN, most: int = P.CLAUSE_MAX) -> Column:
    """(start, clause) of every run with an edge or an end of the text on both sides, of a length typed in one go.

    The text is split at edges, so no look-around is needed: a clause is a whole piece. ``strict`` takes neither
    spaces nor the ends of the text as edges. Starts count code points from 0. For paragraphs; for long texts see
    :func:`corpuslab.operators.corpus.clause_rows`.
    """
    edges = script.edges.replace(" ", "") if strict else script.edges
    pieces = F.split(text, class_of(edges))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,clause:string>>").alias("out"))
    whole = F.aggregate(
        pieces,
        zero,
        lambda acc, p: F.struct((acc["at"] + F.length(p) + 1).alias("at"), F.array_append(acc["out"], F.struct(acc["at"].alias("start"), p.alias("clause"))).alias("out")),
        lambda acc: acc["out"],
    )
    inner = F.slice(whole, F.lit(2), F.greatest(F.size(whole) - 2, F.lit(0))) if strict else whole
    return F.filter(inner, lambda c: F.rlike(c["clause"], F.lit(f"^[{script.letters}]{{{least},{most}}}$")))


def is_prose_paragraph(text: Column, marks: str = P.HAN.prose_marks) -> Column:
    return F.rlike(text, F.lit(class_of(marks)))


def byte_tail(text: Column, limit: int = P.CONTEXT_BYTES) -> Column:
    """The last ``limit`` bytes in UTF-8, cut on a character boundary: continuation bytes at the cut are left out."""
    raw = F.encode(text, "UTF-8")
    size = F.octet_length(text)
    cut = F.hex(F.substring(raw, size - limit + 1, F.lit(limit)))
    whole = F.regexp_replace(cut, "^((?:[89AB][0-9A-F]){1,3})", "")
    return F.when(size <= limit, text).otherwise(F.decode(F.unhex(whole), "UTF-8"))


def char_tail(text: Column, n: int) -> Column:
    """The last ``n`` code points."""
    return F.when(F.length(text) <= n, text).otherwise(F.substring(text, F.length(text) - n + 1, F.lit(n)))


def valid_readings(readings: Column, untypable: Sequence[str] = P.UNTYPABLE_READINGS) -> Column:
    """No reading is null, other than ASCII letters, or untypable."""
    return F.forall(readings, lambda r: r.isNotNull() & F.rlike(r, F.lit("^[A-Za-z]+$")) & ~r.isin(*untypable))


def typed_key(readings: Column, style: str, seed: Column | None = None) -> Column:
    """What is typed for readings: ``full``, ``initials``, or ``mixed``, where bits of a seeded hash choose, never all
    or none in full."""
    if style == "full":
        return F.array_join(readings, "")
    if style == "initials":
        return F.array_join(F.transform(readings, lambda r: F.substring(r, 1, 1)), "")
    bits = F.transform(readings, lambda r, i: F.conv(F.substring(F.md5(F.concat(seed, F.lit(":"), i.cast("string"))), 1, 4), 16, 10).cast("int") % 2 == 1)
    some = F.exists(bits, lambda b: b) & ~F.forall(bits, lambda b: b)
    keep = F.when(some, bits).otherwise(F.transform(readings, lambda r, i: i == 0))
    return F.array_join(F.zip_with(readings, keep, lambda r, k: F.when(k, r).otherwise(F.substring(r, 1, 1))), "")


def double_key(syllable: Column) -> Column:
    """The two keys of a syllable in the double-key layout."""
    finals = F.create_map(*[F.lit(x) for kv in P.DOUBLE_KEY_FINALS.items() for x in kv])
    initials = F.create_map(*[F.lit(x) for kv in P.DOUBLE_KEY_INITIALS.items() for x in kv])
    first, two = F.substring(syllable, 1, 1), F.substring(syllable, 1, 2)
    final = lambda n: F.try_element_at(finals, F.substring(syllable, F.lit(n + 1), F.length(syllable)))
    return (
        F.when(F.length(syllable) == 1, F.concat(syllable, syllable))
        .when(F.length(syllable) == 2, syllable)
        .when(F.try_element_at(finals, syllable).isNotNull(), F.concat(first, F.try_element_at(finals, syllable)))
        .when(two.isin(*P.DOUBLE_KEY_INITIALS), F.concat(F.try_element_at(initials, two), final(2)))
        .otherwise(F.concat(first, final(1)))
    )


def letter_ids(text: Column) -> Column:
    """1 to 26 for a to z, 27 for an apostrophe, 0 for other characters."""
    return F.transform(chars(F.lower(text)), lambda c: F.instr(F.lit("abcdefghijklmnopqrstuvwxyz'"), c))


def is_spam(text: Column, terms: Sequence[str] = P.SPAM_TERMS) -> Column:
    return F.rlike(text, F.lit("|".join(re.escape(t) for t in terms)))


def is_clean_message(text: Column, letters: str = P.HAN.letters, banned: str = "A-Za-z0-9") -> Column:
    """Has a character of the script, none of the banned (Latin letters and digits), no line break."""
    return F.rlike(text, F.lit(f"[{letters}]")) & ~F.rlike(text, F.lit(f"[{banned}\\n\\r]"))


def has_control(text: Column) -> Column:
    return F.rlike(text, F.lit("[\\\\\\t\\r]"))


def differs_only_in(a: Column, b: Column, signs: str = P.SWAPPED_PRONOUNS) -> Column:
    """Different texts that are equal once all of ``signs`` count as one."""
    one = lambda x: F.translate(x, signs, signs[0] * len(signs))
    return (a != b) & (F.length(a) == F.length(b)) & (one(a) == one(b))


def rerank_context(context: Column, window: int, longest: Column, step: int = P.CONTEXT_STEP) -> Column:
    """The context whole if it fits beside the longest candidate, else its tail cut in steps."""
    room = F.greatest(F.lit(0), F.lit(window) - (longest + 1))
    keep = (F.floor(room / step) * step).cast("int")
    return F.when(F.length(context) <= room, context).when(keep > 0, F.substring(context, F.length(context) - keep + 1, keep)).otherwise("")


def prefix_tokens(tokens: Column, context_length: int, longest: Column, bos: int = 2) -> Column:
    """BOS and the tail of the context that leaves room for the longest candidate."""
    room = F.greatest(F.lit(0), F.lit(context_length) - longest - 1)
    take = F.least(F.size(tokens), room)
    tail = F.when(take > 0, F.slice(tokens, F.size(tokens) - take + 1, take)).otherwise(F.array().cast("array<int>"))
    return F.concat(F.array(F.lit(bos)), tail)


def char_windows(text: Column, width: int = P.WINDOW) -> Column:
    """All windows of ``width`` characters; none in a shorter text. Split once, then sliced."""
    return let(chars(text), lambda c: windows(c, width, ""))


def windows(items: Column, width: int, sep: str) -> Column:
    """All runs of ``width`` items of an array, joined."""
    some = F.transform(F.sequence(F.lit(1), F.size(items) - width + 1), lambda i: F.array_join(F.slice(items, i, width), sep))
    return F.when(F.size(items) >= width, some).otherwise(F.array().cast("array<string>"))


def prefixes(text: Column) -> Column:
    """Every prefix that is not empty, shortest first."""
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, F.lit(1), i))).otherwise(F.array().cast("array<string>"))


def keep_first_distinct(items: Column) -> Column:
    """An array without repeats, each item where it first stood."""
    return F.array_distinct(items)


def json_slice(text: Column) -> Column:
    """From the first ``{`` to the last ``}``; null without both."""
    first = F.instr(text, "{")
    last = F.length(text) - F.instr(F.reverse(text), "}") + 1
    return F.when((first > 0) & (F.instr(text, "}") > 0) & (last >= first), F.substring(text, first, last - first + 1))


def is_permissive(license_: Column) -> Column:
    return license_.isin(*P.PERMISSIVE_LICENSES)


def is_share_alike(attribution: Column, markers: Sequence[str] = P.SHARE_ALIKE_MARKERS) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(attribution, F.lit(m))
    return out


def greedy_syllables(text: Column, syllables: Sequence[str]) -> Column:
    """Longest-match segmentation from the left; null where it gets stuck."""
    alternation = "|".join(sorted(syllables, key=lambda s: (-len(s), s)))
    found = F.regexp_extract_all(text, F.lit(f"\\G({alternation})"), F.lit(1))
    return F.when(F.array_join(found, "") == text, found)


def ngram_buckets(text: Column, n: int, buckets: int) -> Column:
    """Hashed character n-grams of a segment."""
    return F.transform(char_windows(text, n), lambda g: hash_bucket(g, buckets))


def hash_bucket(key: Column, buckets: int | Column) -> Column:
    """A bucket by md5, the same in any engine that has it."""
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint"), F.lit(buckets))


def spaced(text: Column) -> Column:
    """Characters with a space between them."""
    return F.array_join(chars(text), " ")


def escape_newlines(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit("\\n"))
