"""Shared scratch tables: the only way this library cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares. Where none is named (tests in local mode) one is made and set."""
    named = spark.conf.get(CONF, None) or spark.sparkContext.getConf().get(CONF, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{CONF} must name a folder that all executors share")
    named = "file://" + tempfile.mkdtemp(prefix="loomline-")
    spark.conf.set(CONF, named)
    return named


def written(df: DataFrame, name: str, rows: int | None = None, rows_a_file: int = 100_000) -> DataFrame:
    """df written as a Parquet table in the shared folder and read again: lost executors cannot lose it.

    rows: about how many rows there are, if that is known; the last stage then has a task and a file for each rows_a_file
    of them, as very many tiny files cost more than their rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomline/{name}-{uuid.uuid4().hex}"
    (df if rows is None else df.coalesce(max(1, -(-rows // rows_a_file)))).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def purge(spark: SparkSession) -> None:
    """Removes every scratch table; call it when no result that reads one is still wanted."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/loomline")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
