"""What the operators of this subpackage share: input columns, Arrow mapping, cutting lineage."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpuslab.operators.storage import cut as cut


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """Place of a public vocabulary file: in ``folder``, or where the installed package has it."""
    if folder is not None:
        return str(Path(folder, name))
    import public_tokenizers

    return public_tokenizers.path(name)


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, as ``doc_id`` and ``text``; a null text is the empty text.

    Other columns are pruned from the scan here, so extra columns can't clash with those an operator adds.
    """
    return df.select(df[id_col].alias("doc_id"), F.coalesce(df[text_col], F.lit("")).alias("text"))


def unused(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it, so that no column of ``df`` is called that."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = "_" + name
    return name


@lru_cache(1)
def _blas_threads() -> tuple[Callable[[], int], Callable[[int], None]] | None:
    """How many threads numpy's OpenBLAS uses, told and set; None if it can't be found."""
    with contextlib.suppress(OSError):
        for path in {line.split()[-1] for line in Path("/proc/self/maps").read_text().splitlines() if "openblas" in line}:
            lib = ctypes.CDLL(path)
            for name in ("scipy_openblas_{}_num_threads64_", "openblas_{}_num_threads64_", "scipy_openblas_{}_num_threads", "openblas_{}_num_threads"):
                if hasattr(lib, name.format("set")):
                    return getattr(lib, name.format("get")), getattr(lib, name.format("set"))
    return None


@contextlib.contextmanager
def one_thread() -> Iterator[None]:
    """Linear algebra on one thread. The driver forks to start Spark, and the pool of threads that a library made before
    may never answer after that: an inverse of 125 rows was seen to wait for ever."""
    threads = _blas_threads()
    if threads is None:
        yield
        return
    before = threads[0]()
    threads[1](1)
    try:
        yield
    finally:
        threads[1](before)


def release() -> None:
    """Gives what is freed back to the system: Python workers outlive their tasks, and several wait beside those at work."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(df: DataFrame, schema: str | StructType, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]]]) -> DataFrame:
    """``mapInArrow`` with a function that ``make()`` prepares once for each partition; from a batch it makes one or many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for b in batches:
            if b.num_rows:
                made = one(b)
                for out in [made] if isinstance(made, pa.RecordBatch) else made:
                    if out.num_rows:
                        yield out
        del one
        release()

    return df.mapInArrow(run, schema)


def batch(**columns: tuple[object, pa.DataType]) -> pa.RecordBatch:
    """A record batch from ``name=(values, type)``."""
    arrays = [v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))


def keep_rows(df: DataFrame, text_col: str, make: Callable[[], Callable[[list[str]], list[bool]]]) -> DataFrame:
    """The rows of ``df`` whose text a prepared function keeps (a null one counts as empty), with all their columns and
    without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                yield part.filter(pa.array(one([t or "" for t in part.column(b.schema.get_field_index(text_col)).to_pylist()]), pa.bool_()))
        del one
        release()

    return df.mapInArrow(run, df.schema)


def as_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_col: Column) -> Column:
    """True where crc32 of the id as text leaves 1 when divided by 3; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 3 == 1
