"""Sinks: corpora with their lineage, cases, results, picks that resume, progress."""

from __future__ import annotations

import json
import os
import random
import re
import time
import uuid
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from corpuslab.operators.storage import cut


def write_corpus(lines: DataFrame, path: str, lineage: dict[str, object], text: str = "line") -> None:
    """Lines as text and, beside them, one record of where they come from with their numbers of lines and characters."""
    lines.select(text).write.mode("overwrite").text(path)
    kept = lines.sparkSession.read.text(path).agg(F.count("*").alias("lines"), F.coalesce(F.sum(F.length("value")), F.lit(0)).alias("chars"))
    record = kept.select(F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in lineage.items()], "lines", "chars")).alias("value"))
    record.coalesce(1).write.mode("overwrite").text(f"{path}.source")


def unsafe_rows(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of which a column holds a tab or a line break, which a tab-separated file can't."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.coalesce(F.rlike(F.col(c).cast("string"), F.lit("[\\t\\n\\r]")), F.lit(False))
    return rows.where(bad)


def write_cases(rows: DataFrame, json_path: str, tsv_path: str, columns: Sequence[str], escape: Sequence[str] = ()) -> None:
    """Rows as JSON lines, and some columns tab-separated; line breaks of ``escape`` columns are written as ``\\n``."""
    flat = rows.select(*[F.replace(F.col(c), F.lit("\n"), F.lit("\\n")).alias(c) if c in escape else F.col(c) for c in columns])
    if unsafe_rows(flat, columns).limit(1).count():
        raise ValueError("a field holds a tab or a line break")
    rows.write.mode("overwrite").json(json_path)
    flat.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("value")).write.mode("overwrite").text(tsv_path)


def write_results(rows: DataFrame, path: str) -> None:
    """A table of results with a header; what is missing stays blank."""
    rows.write.mode("overwrite").option("header", "true").option("emptyValue", "").csv(path)


def append_missing(rows: DataFrame, path: str, key: str) -> int:
    """Appends the rows whose key isn't in the Parquet table yet, and says how many: a run that broke off is resumed."""
    spark = rows.sparkSession
    try:
        done = spark.read.parquet(path).select(key)
        rows = rows.join(done, key, "left_anti")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    rows = cut(rows)  # else they would be computed to be counted, and again to be written
    n = rows.count()
    if n:
        rows.write.mode("append").parquet(path)
    return n


def write_batch_once(path: str):
    """For ``foreachBatch``: each batch has a folder of its own, so one that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def write_missing_chunks(rows: DataFrame, chunk: str, path: str, work: Callable[[DataFrame], DataFrame] | None = None, tasks: int | None = None) -> int:
    """Writes the chunks (values of a column; null is one) that ``path`` lacks, in one job, and says how many it wrote.

    A chunk is dealt to one of ``tasks`` tasks (of the session's shuffles), which does ``work`` on it, if any is given (row by row or batch by
    batch, without a shuffle of its own, and the chunk's column stays), and moves its file into place as a whole when it has
    ended. So a chunk's folder stands for the chunk, a run that broke off has those that were ready, and the next one
    works only on the others: they are told by a join with the folders' names. The empty text and null are one chunk, for
    their folders have one name."""
    spark = rows.sparkSession
    before = _chunks(spark, path, rows, chunk)
    missing = rows if before is None else rows.join(before, F.col(chunk).eqNullSafe(F.col("_done")), "left_anti")
    n = 0 if before is None else before.count()
    dealt = missing.repartition(tasks or int(spark.conf.get("spark.sql.shuffle.partitions")), chunk)
    made = work(dealt) if work else dealt
    made.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(chunk).parquet(path)
    after = _chunks(spark, path, rows, chunk)
    return (after.count() if after is not None else 0) - n


def _chunks(spark: SparkSession, path: str, rows: DataFrame, chunk: str) -> DataFrame | None:
    """(_done): the chunks that have a folder with a file; None without any."""
    try:
        found = spark.read.schema(rows.select(chunk).schema).parquet(path).select(F.col(chunk).alias("_done")).distinct()
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return found


class SharedProgress:
    """A JSON object that several writers merge into, in a folder that they share.

    Each state is a file of its own with a number. A writer reads the last, adds its keys, and puts the next number's file in
    place, which must not be there yet; if another writer was first, it reads again. So no key is lost, and a reader sees
    whole states only. The file is put by a hard link (on local and mounted folders) or, for other stores, by a rename that
    doesn't replace, as HDFS has it; ``spark`` is needed for these alone. Old states are deleted but for the last ones.
    """

    KEPT, TRIES = 5, 200

    def __init__(self, path: str, spark: SparkSession | None = None) -> None:
        self.path, self.spark = path.removeprefix("file://").removeprefix("file:"), spark
        if "://" in self.path and spark is None:
            raise ValueError("a store other than a folder is reached through Spark")
        if spark is None or "://" not in self.path:
            Path(self.path).mkdir(parents=True, exist_ok=True)

    def _hadoop(self, name: str = ""):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _numbers(self) -> list[int]:
        if "://" in self.path:
            fs, p = self._hadoop()
            names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        else:
            names = os.listdir(self.path)
        return sorted(int(n[:-5]) for n in names if re.fullmatch(r"[0-9]+\.json", n))

    def _text(self, number: int) -> str:
        if "://" in self.path:
            fs, p = self._hadoop(f"{number}.json")
            stream = fs.open(p)
            try:
                return bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
        return Path(self.path, f"{number}.json").read_text()

    def _put(self, number: int, text: str) -> bool:
        """False if the number is taken."""
        tmp = f".{uuid.uuid4().hex}.tmp"
        if "://" in self.path:
            fs, p = self._hadoop(tmp)
            out = fs.create(p, True)
            out.write(bytearray(text.encode()))
            out.close()
            to = self._hadoop(f"{number}.json")[1]
            done = not fs.exists(to) and fs.rename(p, to)
            if not done:
                fs.delete(p, False)
            return done
        own = Path(self.path, tmp)
        own.write_text(text)
        try:
            os.link(own, Path(self.path, f"{number}.json"))
            return True
        except FileExistsError:
            return False
        finally:
            own.unlink()

    def read(self) -> dict[str, object]:
        """The last state."""
        return self._last()[1]

    def _last(self) -> tuple[int, dict[str, object]]:
        for _ in range(self.TRIES):
            numbers = self._numbers()
            try:
                return (numbers[-1], json.loads(self._text(numbers[-1]))) if numbers else (0, {})
            except FileNotFoundError:  # deleted meanwhile, so there is a later one
                continue
        raise OSError(f"{self.path}: states go faster than they can be read")

    def merge(self, values: dict[str, object]) -> int:
        """Adds keys, replacing those that are there, and gives the number of the state that has them."""
        for attempt in range(self.TRIES):
            number, held = self._last()
            if self._put(number + 1, json.dumps(held | values)):
                # a writer that was slow may have taken a number whose state was deleted; what counts is the last state
                last, now = self._last()
                if last == number + 1 or all(k in now and now[k] == json.loads(json.dumps(v)) for k, v in values.items()):
                    for old in self._numbers()[: -self.KEPT]:
                        self._delete(old)
                    return number + 1
            time.sleep(random.random() * min(0.5, 0.002 * 2**attempt))
        raise OSError(f"{self.path}: no state could be put after {self.TRIES} attempts")

    def _delete(self, number: int) -> None:
        if "://" in self.path:
            fs, p = self._hadoop(f"{number}.json")
            fs.delete(p, False)
        else:
            Path(self.path, f"{number}.json").unlink(missing_ok=True)


class ProgressFile(StreamingQueryListener):
    """Keeps the last progress of each query in a :class:`SharedProgress`; queries of several drivers may share one."""

    def __init__(self, path: str, spark: SparkSession | None = None) -> None:
        self.shared = SharedProgress(path, spark)

    def _put(self, key: str, value: object) -> None:
        self.shared.merge({key: value})

    def onQueryStarted(self, event) -> None:
        self._put(str(event.id), {"state": "started"})

    def onQueryProgress(self, event) -> None:
        self._put(str(event.progress.id), {"state": "running", "batch": event.progress.batchId, "rows": event.progress.numInputRows})

    def onQueryTerminated(self, event) -> None:
        self._put(str(event.id), {"state": "ended"})
