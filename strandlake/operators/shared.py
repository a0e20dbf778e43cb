"""Where results are stored between jobs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; where that is unset, a local master uses one in the warehouse."""
    context = spark.sparkContext
    if not (path := spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()):
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(path)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder; its lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def renewed(df: DataFrame) -> DataFrame:
    """``df`` with new columns of the same names, to be grouped together with a table that it stems from."""
    return df.select(*(F.col(c).alias(f"_{c}_") for c in df.columns)).select(*(F.col(f"_{c}_").alias(c) for c in df.columns))
