"""Tables that cut lineage, in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where all executors are in the driver's process and the session names no shared folder, as in tests.
OWN_SHARED_DIR = "/tmp/checkpoints/causeway"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from the session's settings; without one, a cluster is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = OWN_SHARED_DIR
    return found.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, read as often as wanted, its lineage cut."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop(table: DataFrame) -> None:
    """Remove a table of ``stored`` that nothing reads any more."""
    spark = table.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._scratch_path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
