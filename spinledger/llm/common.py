"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A session in local mode that names none gets a temporary one, since there the
    driver and the executors are one process; any other session must name it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
    return spark.conf.get("spark.checkpoint.dir")


def materialize(df: DataFrame, name: str, folders: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    What follows no longer depends on the executors that computed the rows. The
    table is deleted when the driver's JVM ends. With ``folders`` each value of that
    column gets a folder of its own, so that a filter on it reads no other.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}/{name}"
    writer = df.write.partitionBy(folders) if folders else df.write
    writer.parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder).getParent()
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(folder)
