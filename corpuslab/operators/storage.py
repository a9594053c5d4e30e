"""Cutting lineage where it would be computed again, in a folder that survives lost executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the folder of ``spark.checkpoint.dir``.

    Only where the cluster names none is one set here: a temporary folder under a local master, else one beside
    the warehouse, which all executors share. Spark deletes the files once nothing refers to the frame if
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on, which is a setting of the session's start.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        own = tempfile.mkdtemp(prefix="checkpoints-") if sc.master.startswith("local[") or sc.master == "local" else spark.conf.get("spark.sql.warehouse.dir") + "/checkpoints"
        sc.setCheckpointDir(named or own)
    return df.checkpoint(eager=True)
