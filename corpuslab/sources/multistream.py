"""Pages of a dump that is many bz2 streams one after the other, each with some pages: a partition reads its streams alone.

With the dump's index (lines of offset, page and title) partitions are made of its offsets. Without it they are ranges of
bytes, and a stream belongs to the range that it begins in, found by the signature of its head; it is read to its end, past the
range's. Streams are decompressed and searched for pages a piece at a time, and a page that lies across two pieces waits for
the second one, so memory holds a piece and a page.
"""

from __future__ import annotations

import bz2
import html
import io
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corpuslab.operators.ordered import numbered

#: Bytes that are read and decompressed at a time, and of a range without an index.
PIECE, RANGE = 1 << 20, 64 << 20
#: How a stream begins, by its format: "BZh", a digit, the mark of a block.
HEAD = re.compile(rb"BZh[1-9]1AY&SY")
HEAD_SIZE = 10
PAGE = re.compile(r"<page\b[^>]*>(.*?)</page>", re.DOTALL)
TITLE, SPACE = re.compile(r"<title>(.*?)</title>", re.DOTALL), re.compile(r"<ns>\s*(-?\d+)\s*</ns>")
BODY = re.compile(r"<text\b[^>]*?(?:/>|>(.*?)</text>)", re.DOTALL)


def opened(path: str):
    """A file of a local path or of a URI whose store Arrow knows (hdfs, s3, gs, file)."""
    if "://" in path or path.startswith("file:"):
        fs, inner = pyarrow.fs.FileSystem.from_uri(path)
    else:
        fs, inner = pyarrow.fs.LocalFileSystem(), path
    return fs.open_input_file(inner)


def _stream(f, at: int) -> Iterator[bytes]:
    """The pieces of the stream at an offset; gives back where it ends."""
    f.seek(at)
    own, read = bz2.BZ2Decompressor(), 0
    while not own.eof:
        data = f.read(PIECE)
        if not data:
            raise EOFError(f"the stream at {at} is cut off")
        read += len(data)
        data = own.decompress(data, PIECE)
        while True:
            yield data
            if own.eof or own.needs_input:
                break
            data = own.decompress(b"", PIECE)
    return at + read - len(own.unused_data)


def _next_head(f, at: int, before: int) -> int | None:
    """The offset of the first stream that begins at ``at`` or later, and before ``before``."""
    while at < before:
        f.seek(at)
        data = f.read(PIECE + HEAD_SIZE)
        if found := HEAD.search(data):
            return at + found.start() if at + found.start() < before else None
        if len(data) <= PIECE:
            return None
        at += PIECE
    return None


def pages_of(pieces: Iterator[bytes], namespace: int | None) -> Iterator[tuple[str, int, str]]:
    """(title, ns, text) of the pages in a stream's text, of one namespace or of all. A page without a body has an empty one."""
    held = b""
    for piece in pieces:
        held += piece
        end = held.rfind(b"</page>")
        if end < 0:
            continue
        whole, held = held[: end + 7], held[end + 7 :]
        for page in PAGE.findall(whole.decode("utf-8", "replace")):
            space = SPACE.search(page)
            ns = int(space[1]) if space else 0
            if namespace is None or ns == namespace:
                title, body = TITLE.search(page), BODY.search(page)
                yield html.unescape(title[1]) if title else "", ns, html.unescape((body[1] or "") if body else "")


@dataclass
class Streams(InputPartition):
    """Offsets of streams; or a range of bytes in which streams begin."""

    offsets: tuple[int, ...] = ()
    begin: int = 0
    end: int = 0


class MultistreamReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.index = options["path"], options.get("index")
        self.namespace = int(options["namespace"]) if options.get("namespace", "") != "" else None
        self.streams, self.range = int(options.get("streams", 1)), int(options.get("range", RANGE))

    def partitions(self) -> list[Streams]:
        if self.index is None:
            with opened(self.path) as f:
                size = f.size()
            return [Streams(begin=b, end=min(b + self.range, size)) for b in range(0, size, self.range)] or [Streams()]
        with opened(self.index) as f:
            raw = f.read()
        lines = (bz2.decompress(raw) if raw[:3] == b"BZh" else raw).decode("utf-8", "replace").split("\n")
        offsets = sorted({int(x.split(":", 1)[0]) for x in lines if ":" in x})
        return [Streams(tuple(offsets[i : i + self.streams])) for i in range(0, len(offsets), self.streams)] or [Streams()]

    def read(self, partition: Streams) -> Iterator[tuple[str, int, str]]:
        with opened(self.path) as f:
            for at in partition.offsets:
                yield from pages_of(_stream(f, at), self.namespace)
            at = _next_head(f, partition.begin, partition.end)
            while at is not None:
                end: list[int] = []
                yield from pages_of(_kept(_stream(f, at), end), self.namespace)
                at = _next_head(f, end[0], partition.end)


def _kept(pieces: Iterator[bytes], end: list[int]) -> Iterator[bytes]:
    end.append((yield from pieces))


def written_streams(pages: DataFrame, of: Sequence[Column], order: Sequence[str], each: int = 50) -> DataFrame:
    """(stream, raw): pages as compressed streams of ``each`` pages, numbered from 0 in ``order``; ``of`` are title, namespace and
    text. Put one after the other they are a dump, and the running sum of their sizes its index."""
    title, ns, text = of
    escaped = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = F.concat(F.lit("  <page>\n    <title>"), escaped(title), F.lit("</title>\n    <ns>"), ns.cast("string"), F.lit("</ns>\n    <revision>\n      <text>"), escaped(text), F.lit("</text>\n    </revision>\n  </page>\n"))
    rows = numbered(pages.select(*order, page.alias("_page")), order, "_k")
    groups = rows.groupBy(F.floor((F.col("_k") - 1) / each).alias("stream")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_page"))), lambda x: x["_page"]), "").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bz2.compress(t.encode()) for t in b.column(1).to_pylist()], pa.binary())], names=["stream", "raw"])

    return groups.mapInArrow(run, "stream long, raw binary")


def pages_in_streams(streams: DataFrame, raw: str = "raw", namespace: int | None = 0) -> DataFrame:
    """(title, ns, text) of the pages in compressed streams, one a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for stream in b.column(0):
                found = list(pages_of(_stream(io.BytesIO(stream.as_py()), 0), namespace))
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string()))], names=["title", "ns", "text"])

    return streams.select(raw).mapInArrow(run, "title string, ns int, text string")


class Multistream(DataSource):
    @classmethod
    def name(cls) -> str:
        return "multistream"

    def schema(self) -> str:
        return "title string, ns int, text string"

    def reader(self, schema) -> MultistreamReader:
        return MultistreamReader(dict(self.options))


def multistream_pages(spark: SparkSession, path: str, index: str | None = None, namespace: int | None = 0, streams: int = 1, range_bytes: int = RANGE) -> DataFrame:
    """(title, ns, text) of a dump's pages in one namespace (None: all). A partition has ``streams`` streams of the index, or without
    one a range of bytes. A stream that is cut off or broken is an error."""
    spark.dataSource.register(Multistream)
    own = {"index": index, "namespace": "" if namespace is None else str(namespace), "streams": str(streams), "range": str(range_bytes)}
    return spark.read.format("multistream").options(**{k: v for k, v in own.items() if v is not None}).load(path)
