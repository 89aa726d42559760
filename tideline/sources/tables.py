"""Intermediate tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def settle(df: DataFrame, label: str = "step") -> DataFrame:
    """``df`` written as Parquet under the shared ``spark.checkpoint.dir`` and read back.

    Later plans start from the table, so they stay small and a lost executor
    costs no recomputation. Only where the setting is absent and the master is
    local is a temporary folder made.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        current = context._jsc.sc().getCheckpointDir()
        if not current.isDefined():
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tideline-"))
            current = context._jsc.sc().getCheckpointDir()
        folder = current.get()
    path = f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
