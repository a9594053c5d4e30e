"""Secret scans over an incremental, content-addressed ledger of blobs."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm.common import batch, cut, id_and_text, map_batches

# Base kinds, as the contract of the query gives them.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Kinds that the operator adds: a literal that the text must hold, and the pattern.
ADDED = (
    ("private_key", "-----BEGIN ", re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----")),
    ("jwt", "eyJ", re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}")),
    ("url_login", "://", re.compile(r"(?<![A-Za-z0-9+.-])[a-z][a-z0-9+.-]*+://[^\s/:@]+:[^\s/:@]{6,}@")),
)
BASE = ("assign", "access", "hex")
KINDS = BASE + tuple(x[0] for x in ADDED)

#: Names the patterns, so that a change of any of them is another version, for which blobs are scanned again.
RULES_VERSION = hashlib.sha256("\n".join(f"{p.pattern} {p.flags}" for p in (ASSIGN, ACCESS, HEX, *(x[2] for x in ADDED))).encode()).hexdigest()[:16]

FINDINGS = "blob string, rules string, kinds array<string>, starts array<int>, ends array<int>"
#: Digests of unseen blobs that are broadcast to the texts; of more, the texts of unseen blobs travel, compressed.
BROADCAST_BLOBS = 10_000
#: Digests of texts that a task remembers to have scanned.
REMEMBERED = 100_000


def find_secrets(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of each span in code points, by start, then kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    for k, (_, literal, pattern) in enumerate(ADDED, len(BASE)):
        if literal in text:
            found += [(m.start(), k, m.end()) for m in pattern.finditer(text)]
    return sorted(found)


def _scanner():
    """Scans a batch of (blob, z): z is a text, or one compressed. Copies that a task has met lately are passed over."""
    unpack, done = zstandard.ZstdDecompressor(), set()

    def scan(b: pa.RecordBatch) -> pa.RecordBatch:
        blobs, kinds, starts, ends = [], [], [], []
        for blob, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if blob in done:
                continue
            if len(done) >= REMEMBERED:
                done.clear()
            done.add(blob)
            spans = find_secrets(text if isinstance(text, str) else unpack.decompress(text).decode())
            blobs.append(blob)
            kinds.append([KINDS[k] for _, k, _ in spans])
            starts.append([s for s, _, _ in spans])
            ends.append([e for _, _, e in spans])
        return batch(blob=(blobs, pa.string()), rules=([RULES_VERSION] * len(blobs), pa.string()), kinds=(kinds, pa.list_(pa.string())), starts=(starts, pa.list_(pa.int32())), ends=(ends, pa.list_(pa.int32())))

    return scan


def _compressor():
    z = zstandard.ZstdCompressor(level=1)
    return lambda b: pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("blob"), pa.array([z.compress(t.encode()) for t in b.column("text").to_pylist()], pa.binary())], ["doc_id", "blob", "z"])


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger that :func:`append_to_ledger` has written so far."""
    return spark.read.schema(FINDINGS).parquet(path)


def append_to_ledger(findings: DataFrame, path: str) -> None:
    """Writes findings of one more scan, those of blobs without spans included, for their pair of blob and rules version is
    what later scans look up. ``path`` is on storage that all executors share."""
    findings.write.mode("append").parquet(path)


def scan_blobs(versions: DataFrame, ledger: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Paths (doc_id, blob) of all versions, and the findings (``FINDINGS``) of blobs that the ledger lacks.

    A blob is named by the SHA-256 of its text. ``ledger`` holds earlier findings; pairs of blob and rules version in it
    are not scanned again. Append the findings to it.

    Without a ledger every text is scanned where it lies and none travels; a copy is scanned again only by another task.
    With one, ids and digests are held against it first. If few blobs are unseen their digests go to the texts; else the
    texts of rows that stand for unseen blobs (those with the smallest id) travel once, compressed. All ways give the same
    findings, one row a blob.
    """
    rows = id_and_text(versions, id_col, text_col).withColumn("blob", F.sha2(F.col("text").cast("binary"), 256))
    paths = cut(rows.select("doc_id", "blob"))
    if ledger is None:
        return paths, map_batches(rows.select("blob", "text"), FINDINGS, _scanner).dropDuplicates(["blob"])
    seen = ledger.where(F.col("rules") == RULES_VERSION).select("blob")
    first = cut(paths.groupBy("blob").agg(F.min("doc_id").alias("doc_id")).join(seen, "blob", "left_anti"))
    if first.limit(BROADCAST_BLOBS + 1).count() <= BROADCAST_BLOBS:
        unseen = rows.join(F.broadcast(first.select("blob")), "blob", "left_semi").select("blob", "text")
    else:
        packed = map_batches(rows, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, blob string, z binary", _compressor)
        first = first.select(F.col("blob").alias("_blob"), F.col("doc_id").alias("_id")).hint("shuffle_hash")
        unseen = packed.join(first, packed["doc_id"].eqNullSafe(first["_id"]) & (packed["blob"] == first["_blob"]), "left_semi").select("blob", "z")
    return paths, map_batches(unseen, FINDINGS, _scanner).dropDuplicates(["blob"])


def join_findings(paths: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings of each path: the columns of ``paths`` and kinds, starts, ends, empty where there are none.

    Only blobs with spans take part; a blob that very many paths share is split by adaptive execution, as it is on the
    outer side of the join.
    """
    none = {"kinds": "array<string>", "starts": "array<int>", "ends": "array<int>"}
    some = findings.where("size(starts) > 0").drop("rules")
    out = paths.join(some, "blob", "left")
    return out.select(*paths.columns, *(F.coalesce(c, F.array().cast(t)).alias(c) for c, t in none.items()))


def secret_report(df: DataFrame, ledger: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: doc_id, blob, kinds, starts, ends (code points, ends exclusive).

    A null text is an empty one and has no spans; ids may be null or repeat, and rows with equal texts each get the same
    spans; an empty table gives no rows; texts may be of any length. Columns other than id and text (``blob`` or ``kinds``,
    say) are left out. With a ``ledger``, its findings count for the blobs it has.
    """
    paths, fresh = scan_blobs(df, ledger, id_col, text_col)
    if ledger is not None:
        fresh = fresh.unionByName(ledger.where(F.col("rules") == RULES_VERSION).select(*fresh.columns)).dropDuplicates(["blob"])
    return join_findings(paths, fresh)


def report_of_versions(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As :func:`secret_report`, by two versions of the ledger: the rows whose ids hash to an even number are the history,
    which is scanned first and written; the other rows come later and add what of their blobs it lacks."""
    even = F.pmod(F.xxhash64(df[id_col].cast("string")), F.lit(2)) == 0
    old, ledger = scan_blobs(df.where(even), None, id_col, text_col)
    ledger = cut(ledger)
    new, fresh = scan_blobs(df.where(~even), ledger, id_col, text_col)
    return join_findings(old.unionByName(new), ledger.unionByName(fresh))


def digest_columns(report: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    spans = F.transform(F.arrays_zip("kinds", "starts", "ends"), lambda x: F.struct(x["kinds"].alias("kind"), F.concat_ws(":", x["kinds"], x["starts"].cast("string"), x["ends"].cast("string")).alias("s")))
    base = F.filter(spans, lambda x: x["kind"].isin(*BASE))
    joined = lambda a: F.array_join(F.transform(a, lambda x: x["s"]), ",")
    count = lambda k: F.size(F.filter("kinds", lambda x: x == k)).cast("long")
    return report.select("doc_id", *(count(k).alias(f"n_{k}") for k in BASE), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(spans).alias("spans"), "blob")


def sha256_of_text(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
