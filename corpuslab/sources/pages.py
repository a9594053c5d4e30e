"""Content of web pages by regular expressions and higher-order functions."""

from __future__ import annotations

import html.entities
import json
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslab.functions.text import collapse_space


#: A character reference, as web browsers read it: numeric, or a name; what isn't known stays.
REFERENCE = "&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\\t\\n\\f <&#;]{1,32};?)"


def _numbered(digits: Column, base: int) -> Column:
    """The character of a number; C1 numbers are those of Windows-1252, numbers of no character are empty or U+FFFD."""
    low = F.from_json(F.lit(json.dumps({str(n): html.unescape(f"&#{n};") for n in range(160)})), "map<string,string>")
    n = F.conv(digits, base, 10).cast("long")
    wide = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    lost = (F.length(digits) > 8) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
    none = n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    return F.when(F.length(digits) > 8, "\ufffd").when(n < 160, low[n.cast("string")]).when(lost, "\ufffd").when(none, "").otherwise(wide)


#: Names are looked up in one of so many maps, for a map is searched one entry after the other.
MAPS = 128


def _names(name: Column) -> Column:
    """What a name stands for, or null."""
    maps: list[dict[str, str]] = [{} for _ in range(MAPS)]
    for n, value in html.entities.html5.items():
        maps[zlib.crc32(n.encode()) % MAPS][n] = value
    own = F.from_json(F.lit(json.dumps(maps)), "array<map<string,string>>")
    return F.get(own, (F.crc32(name.cast("binary")) % MAPS).cast("int"))[name]


def _named(name: Column) -> Column:
    bare = sorted((n for n in html.entities.html5 if not n.endswith(";")), key=len, reverse=True)
    head = F.regexp_extract(name, "^(?:" + "|".join(bare) + ")", 0)
    rest = F.substring(name, F.length(head) + 1, F.length(name))
    return F.coalesce(_names(name), F.when(head != "", F.concat(_names(head), rest)), F.concat(F.lit("&"), name))


def unescape(text: Column) -> Column:
    """Character references resolved, once, as browsers do."""
    found = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0))
    parts = F.split(text, REFERENCE, -1)

    def resolved(e: Column) -> Column:
        body = F.substring(e, 2, F.length(e))
        digits = F.regexp_extract(body, "^#[xX]?0*([0-9a-fA-F]*)", 1)
        digits = F.when(digits == "", "0").otherwise(digits)
        return F.when(F.rlike(body, F.lit("^#[xX]")), _numbered(digits, 16)).when(F.startswith(body, F.lit("#")), _numbered(digits, 10)).otherwise(_named(body))

    rest = F.zip_with(found, F.slice(parts, 2, F.size(found)), lambda e, p: F.concat(resolved(e), p))
    whole = F.concat(F.get(parts, F.lit(0)), F.array_join(rest, ""))
    return F.when(F.contains(text, F.lit("&")) & (F.size(found) > 0), whole).otherwise(text)


def paragraphs(html: Column) -> Column:
    """Bodies of paragraphs without tags, entities resolved, space collapsed; an empty one stays empty."""
    found = F.regexp_extract_all(html, F.lit("(?s)<p[^>]*>(.*?)</p>"), F.lit(1))
    return F.transform(found, lambda p: collapse_space(unescape(F.regexp_replace(p, "<[^>]*>", ""))))


def balanced_div(html: Column, opening: str) -> Column:
    """What stands between an opening division and the end that closes it, whatever divisions are nested; empty without
    it. The text is split before divisions, depth is a running sum, and so is the length of what lies inside; if nothing closes
    the division, it reaches to the end."""
    body = F.substring(html, F.instr(html, opening) + len(opening), F.length(html))
    parts = F.split(body, "(?i)(?=</?div\\b)")
    zero = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("size"))

    def step(acc: Column, p: Column) -> Column:
        here = acc["depth"] + F.when(F.rlike(p, F.lit("^(?i)</div\\b")), -1).when(F.rlike(p, F.lit("^(?i)<div\\b")), 1).otherwise(0)
        depth = F.when(acc["depth"] == 0, 0).otherwise(here)
        return F.struct(depth.alias("depth"), (acc["size"] + F.when(depth > 0, F.length(p)).otherwise(0)).alias("size"))

    inside = F.aggregate(parts, zero, step, lambda acc: acc["size"])
    return F.when(F.instr(html, opening) > 0, F.substring(body, F.lit(1), inside)).otherwise("")
