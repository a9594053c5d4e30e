"""Readers of corpus files: dumps, dialogues, trees of documents, tables of readings, model files."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.functions.presets import HAN
from corpuslab.functions.text import script_runs
from corpuslab.sources.pages import balanced_div, paragraphs
from corpuslab.sources.tensors import parse


def wiki_pages(spark: SparkSession, path: str | list[str], namespace: int = 0) -> DataFrame:
    """(title, text) of a dump's pages in one namespace; compressed files are split by the codec where it can."""
    schema = "title string, ns int, revision struct<text: struct<_VALUE: string>>"
    pages = spark.read.format("xml").option("rowTag", "page").option("ignoreNamespace", "true").schema(schema).load(path)
    return pages.where(F.col("ns") == namespace).select("title", F.col("revision.text._VALUE").alias("text"))


def wiki_runs(spark: SparkSession, path: str | list[str], letters: str = HAN.letters) -> DataFrame:
    """(text, pos, run) of the text bodies of a dump, whatever page they are of: maximal runs of a character class, so that
    markup splits runs too. ``text`` is a digest of the body."""
    bodies = spark.read.format("xml").option("rowTag", "text").option("ignoreNamespace", "true").schema("_VALUE string").load(path)
    return bodies.where("_VALUE is not null").select(F.md5("_VALUE").alias("text"), F.posexplode(script_runs(F.col("_VALUE"), letters)).alias("pos", "run"))


def dialogues(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(dialogue, turn, text) of JSON arrays of turns, one a line; bad lines are skipped, spaces inside turns go."""
    rows = spark.read.text(path).select(F.xxhash64("value").alias("dialogue"), F.from_json("value", "array<string>").alias("turns")).where("turns is not null")
    return rows.select("dialogue", F.posexplode("turns").alias("turn", "text")).where("text is not null").withColumn("text", F.replace("text", F.lit(" "), F.lit("")))


def document_tree(spark: SparkSession, path: str, suffixes: Sequence[str] = ("md", "html")) -> DataFrame:
    """(path, text) of whole files below a folder; files that can't be read are skipped."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{','.join(suffixes)}}}").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    return files.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def json_documents(spark: SparkSession, path: str | list[str], schema: str = "text string") -> DataFrame:
    """Documents of JSON lines, compressed or not; bad rows and files are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("ignoreCorruptFiles", "true").json(path)


def selected_files(spark: SparkSession, deep: Sequence[str], top: Sequence[str]) -> DataFrame:
    """Lines of all files below some folders, and of those that match globs."""
    parts = [spark.read.option("recursiveFileLookup", "true").text(p) for p in deep] + [spark.read.text(p) for p in top]
    return reduce(DataFrame.unionByName, parts).select(F.col("value").alias("line"))


def corpus_batches(spark: SparkSession, path: str | list[str], size: int = 100_000) -> DataFrame:
    """(part, batch, pos, line): lines of corpus files, a partition's in their order and numbered in batches of ``size``;
    a file that is split has several parts, in its order."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    pos = F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.select(F.shiftright("id", 33).alias("part"), F.floor(pos / size).alias("batch"), (pos % size).alias("pos"), "line")


def evaluation_set(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(id, input, gold, syllables, tags, context) of tab-separated rows; # lines, blank lines and the header are
    skipped, the context may be missing."""
    lines = spark.read.text(path).where("value <> '' and not startswith(value, '#') and not startswith(value, 'id\t')")
    f = F.split("value", "\t")
    names = ("id", "input", "gold", "syllables", "tags", "context")
    return lines.select(*[F.get(f, F.lit(i)).alias(n) for i, n in enumerate(names)]).withColumn("syllables", F.col("syllables").try_cast("int")).na.fill("", ["context"])


def json_lines(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


#: A schema of dialogues in an archive: from a parsed member to (unit, dialogue, text).
DialogueShape = Callable[[object], list[tuple[str, int, str]]]


def turns_of_lists(parsed: object) -> list[tuple[str, int, str]]:
    """[[turn, ...], ...]"""
    return [(str(i), k, t) for i, d in enumerate(parsed) for k, t in enumerate(d)]


def turns_of_messages(parsed: object) -> list[tuple[str, int, str]]:
    """{unit: {"messages": [{"message": text}, ...]}} or a list of such objects."""
    units = parsed.items() if isinstance(parsed, dict) else enumerate(parsed)
    return [(str(u), k, m["message"]) for u, d in units for k, m in enumerate(d.get("messages", [])) if "message" in m]


def turns_of_contents(parsed: object) -> list[tuple[str, int, str]]:
    """[{"id": unit, "content": [text, ...]}, ...]"""
    return [(str(d.get("id", i)), k, t) for i, d in enumerate(parsed) for k, t in enumerate(d.get("content", []))]


def archived_dialogues(spark: SparkSession, path: str, member_suffix: str, shape: DialogueShape) -> DataFrame:
    """(member, unit, turn, text) of JSON members of zip archives, one archive a row; broken ones are skipped."""

    def run(batches):
        for pdf in batches:
            rows = []
            for content in pdf["content"]:
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for name in sorted(z.namelist()):
                            if name.endswith(member_suffix):
                                rows += [(name, *x) for x in shape(json.loads(z.read(name)))]
                except (zipfile.BadZipFile, ValueError):
                    continue
            yield pd.DataFrame(rows, columns=["member", "unit", "turn", "text"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "member string, unit string, turn long, text string")


def content_paragraphs(pages: DataFrame, html: str, opening: str) -> DataFrame:
    """Paragraphs of the division that begins with ``opening``, in order."""
    keys = [c for c in pages.columns if c != html]
    return pages.select(*keys, F.posexplode(paragraphs(balanced_div(F.col(html), opening))).alias("pos", "text")).where("text <> ''")


def tagged_sentences(spark: SparkSession, path: str | list[str], lang: str) -> DataFrame:
    """(id, text) of tab-separated id, language, text in one language."""
    rows = spark.read.csv(path, sep="\t", schema="id long, lang string, text string", quote="")
    return rows.where(F.col("lang") == lang).select("id", "text")


def frequency_table(spark: SparkSession, path: str | list[str], most: int = 12) -> DataFrame:
    """(reading, rank, ch, weight): single characters of a UTF-16 table of word, reading and weight, the ``most`` heaviest
    of each reading."""
    from corpuslab.operators.sampling import first_of_each

    rows = spark.read.option("encoding", "UTF-16LE").option("multiLine", "true").csv(path, sep="\t", schema="ch string, reading string, weight long")
    rows = rows.withColumn("ch", F.regexp_replace("ch", "^﻿", "")).where("length(ch) = 1 and reading is not null")
    kept = first_of_each(rows, "reading", [F.desc("weight"), "ch"], most)
    return kept.groupBy("reading").agg(F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("w"), "ch"))).alias("a")).select("reading", F.posexplode("a").alias("rank", "x")).select("reading", "rank", "x.ch", (-F.col("x.w")).alias("weight"))


def arpa_ngrams(spark: SparkSession, path: str | list[str], order: int = 1) -> DataFrame:
    """(ngram, logp, backoff) of one order of an ARPA file. An n-gram's order is its number of words, so no row depends
    on the section headers before it."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where("value rlike '^-?[0-9.]+(e-?[0-9]+)?\t'")
    rows = rows.select(F.get(f, F.lit(1)).alias("ngram"), F.get(f, F.lit(0)).cast("double").alias("logp"), F.get(f, F.lit(2)).cast("double").alias("backoff"))
    return rows.where(F.size(F.split("ngram", " ")) == order)


def write_dictionary(rows: DataFrame, path: str) -> None:
    """Entries (key, jp, value, weight) by number of syllables and initial, the way lookups prune them."""
    rows.withColumn("n", F.size(F.split("key", "'"))).withColumn("initial", F.substring("key", 1, 1)).repartition("n", "initial").write.mode("overwrite").partitionBy("n", "initial").parquet(path)


def look_up(spark: SparkSession, path: str, key: str, prefix: bool = False) -> DataFrame:
    """Entries of a key, or of all keys that begin with it, heaviest first; other partitions aren't read."""
    d = spark.read.parquet(path)
    same: Column = F.startswith("key", F.lit(key)) if prefix else F.col("key") == key
    size = F.col("n") >= key.count("'") + 1 if prefix else F.col("n") == key.count("'") + 1
    return d.where(size & (F.col("initial") == key[:1]) & same).select("key", "jp", "value", "weight").orderBy(F.desc("weight"), "value")


def model_tensors(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, shape, values) of the tensors of model files; a broken file is an error."""

    def run(batches):
        for pdf in batches:
            rows = [(p, n, list(t.shape), t.ravel().tolist()) for p, c in zip(pdf["path"], pdf["content"], strict=True) for n, t in parse(c)[0].items()]
            yield pd.DataFrame(rows, columns=["path", "name", "shape", "values"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, name string, shape array<int>, values array<float>")
