"""Shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables, as the cluster names it.

    A folder of our own is made only for a local master; on a cluster a
    machine-local folder would be lost with its executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="tocsin-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tocsin/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    Cuts the lineage and fixes the rows, so that several readers neither
    recompute nor disagree, also after an executor is lost.
    """
    spark = df.sparkSession
    path = new_table_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
