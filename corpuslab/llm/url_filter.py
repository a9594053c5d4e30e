"""URL rules and lists behind a blocked Bloom filter and an exact hash join. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm.common import cut

#: Bits set for a key in its 64-bit block.
HASHES = 4
#: Keys for each block; 16 bits a key, at which about 1 % of absent keys pass.
KEYS_PER_BLOCK = 4
#: The filter is broadcast up to this many blocks (16 bytes each), else joined by shuffle.
BROADCAST_BLOCKS = 2_000_000
#: Keys are broadcast to the possible hits up to this many, else joined by shuffle, each hit key dealt to SALTS tasks.
BROADCAST_KEYS, SALTS = 200_000, 16

RULES_SCHEMA = "host string, path string, verdict string, is_rule boolean"


def split_url(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host and path: host after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; path from
    there up to ``?``, ``#`` or the end. Both are empty for null and where there is no ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    before = F.split(rest, "[?#]", 2)[0]
    slash = F.instr(before, "/")
    host = F.when(slash > 0, F.substring(before, F.lit(1), slash - 1)).otherwise(before)
    path = F.when(slash > 0, F.substring(before, slash, F.length(before))).otherwise("")
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def canonical(host: F.Column, path: F.Column) -> tuple[F.Column, F.Column]:
    """Host and path as lists have them: without user, port and dots at the end of the host, runs of slashes as one, and
    an empty path as ``/``."""
    host = F.rtrim(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", ""), F.lit("."))
    return host, F.when(path == "", "/").otherwise(F.regexp_replace(path, "/+", "/"))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """A few rules as (host, path, verdict), as a table of keys: ``host/path/`` stands for all below it."""
    for h, p, _ in rules:
        if not h or not p.startswith("/") or not p.endswith("/"):
            raise ValueError(f"a host and a path from / to / are needed: {h!r} {p!r}")
    rows = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict"), F.lit(True).alias("is_rule")) for h, p, v in rules]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*rows))) if rows else spark.createDataFrame([], RULES_SCHEMA)


def listed_table(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """A table of URLs to block, with or without scheme, as keys: ``host/path/`` stands for all below it, subdomains
    included, ``host/path`` for that page alone. Nulls and URLs without a host are left out, and so are queries and fragments."""
    full = F.when(F.contains(F.col(url_col), F.lit("://")), F.col(url_col)).otherwise(F.concat(F.lit("://"), F.col(url_col)))
    host, path = canonical(*split_url(full))
    return urls.select(host.alias("host"), path.alias("path"), F.lit("block").alias("verdict"), F.lit(False).alias("is_rule")).where("host <> ''")


def _key(is_rule: F.Column, host: F.Column, path: F.Column) -> F.Column:
    return F.concat(F.when(is_rule, "rule ").otherwise("list "), host, path)


def _mask(key: F.Column) -> F.Column:
    """The bits of a key in its block."""
    h = F.xxhash64(key, F.lit("bits"))
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(h, 6 * i), F.lit(64)).cast("int")) for i in range(HASHES)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def _block(key: F.Column, blocks: int) -> F.Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def bloom_filter(keys: DataFrame, n_keys: int) -> tuple[DataFrame, int]:
    """The filter as rows (block, bits): at most one 64-bit word for ``KEYS_PER_BLOCK`` keys, empty blocks left out."""
    blocks = max(1, -(-n_keys // KEYS_PER_BLOCK))
    key = _key(F.col("is_rule"), F.col("host"), F.col("path"))
    return keys.select(_block(key, blocks).alias("block"), _mask(key).alias("mask")).groupBy("block").agg(F.bit_or("mask").alias("bits")), blocks


def _probes(urls: DataFrame, host: str, path: str, shape: Row) -> DataFrame:
    """(row_id, is_rule, host, path): the pairs of a host's suffixes and a path's prefixes that end in ``/``, no more of
    either than the longest key of the kind has, and where it has keys of single pages, the host and the whole path."""
    labels, steps = F.split(host, "\\."), F.split(path, "/")
    hosts = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(shape["labels"]))), lambda i: F.array_join(F.slice(labels, -i, i), "."))
    paths = F.transform(F.sequence(F.lit(2), F.least(F.size(steps), F.lit(shape["slashes"] + 1))), lambda i: F.concat(F.array_join(F.slice(steps, 1, i - 1), "/"), F.lit("/")))
    usable = urls.where((F.col(host) != "") & F.startswith(path, F.lit("/")))
    keys = usable.select("row_id", F.explode(hosts).alias("host"), paths.alias("paths")).select("row_id", "host", F.explode("paths").alias("path"))
    if shape["pages"]:
        keys = keys.unionByName(usable.where(~F.endswith(path, F.lit("/"))).select("row_id", F.col(host).alias("host"), F.col(path).alias("path")))
    return keys.select("row_id", F.lit(shape["is_rule"]).alias("is_rule"), "host", "path")


def judge_urls(df: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", otherwise: str = "allow") -> DataFrame:
    """One row for each row of ``df``: page_id, host, path, rule, verdict, listed.

    A rule (a row of ``rules``, columns of ``RULES_SCHEMA``, with ``is_rule``) fits its host and all subdomains where the
    URL's path starts with the rule's. The longest rule decides; at equal length the one with the longer host; of rules for
    one host and path with different verdicts ``block``, in general the last in code-point order. Listed keys (rows
    without ``is_rule``, see :func:`listed_table`) fit the canonical host and path. Without a rule, a URL that fits one is
    blocked, and ``otherwise`` holds for the rest. A null or odd URL has an empty host and path, to which no key fits. Ids
    may be null or repeat, and each row is judged; URLs may be of any length; columns other than id and URL (``host``, say)
    are left out. An empty table gives no rows, an empty rule table only ``otherwise``.

    Pairs of a URL's host suffixes and path prefixes that pass the blocked Bloom filter go to an exact hash join; with few
    listed URLs that is nearly none of the rows. A key that a third of the URLs hit is one row of a small broadcast table,
    or with many keys is dealt to several tasks.
    """
    rules = rules.groupBy("host", "path", "is_rule").agg(F.max("verdict").alias("verdict"))
    shapes = rules.groupBy("is_rule").agg(F.count("*").alias("n"), F.max(F.size(F.split("host", "\\."))).alias("labels"), F.max(F.size(F.split("path", "/")) - 1).alias("slashes"), F.count_if(~F.endswith("path", F.lit("/"))).alias("pages")).collect()
    host, path = split_url(df[url_col])
    urls = df.select(df[id_col].alias("page_id"), host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row_id"))
    if not shapes:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"), F.lit(False).alias("listed"))
    own_host, own_path = canonical(F.col("host"), F.col("path"))
    urls = cut(urls.withColumn("own_host", own_host).withColumn("own_path", own_path))
    keys = None
    for shape in shapes:
        one = _probes(urls, "host", "path", shape) if shape["is_rule"] else _probes(urls, "own_host", "own_path", shape)
        keys = one if keys is None else keys.unionByName(one)
    n = sum(x["n"] for x in shapes)
    filter_, blocks = bloom_filter(rules, n)
    filter_ = F.broadcast(filter_) if blocks <= BROADCAST_BLOCKS else filter_
    key = _key(F.col("is_rule"), F.col("host"), F.col("path"))
    probes = keys.withColumn("block", _block(key, blocks)).withColumn("mask", _mask(key))
    possible = probes.join(filter_, "block").where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask")).select("row_id", "is_rule", "host", "path")
    if n <= BROADCAST_KEYS:
        fits = possible.join(F.broadcast(rules), ["is_rule", "host", "path"])
    else:
        dealt = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        fits = possible.withColumn("salt", F.pmod("row_id", F.lit(SALTS)).cast("int")).join(dealt, ["is_rule", "host", "path", "salt"])
    length = F.struct((F.length("host") + F.length("path")).alias("n"), F.length("host").alias("h"), F.concat("host", "path").alias("rule"), F.col("verdict"))
    best = fits.groupBy("row_id").agg(F.max(F.when(F.col("is_rule"), length)).alias("best"), F.max(~F.col("is_rule")).alias("listed"))
    out = urls.join(best, "row_id", "left")
    listed = F.coalesce("listed", F.lit(False))
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.when(listed, "block").otherwise(otherwise)).alias("verdict"), listed.alias("listed"))
