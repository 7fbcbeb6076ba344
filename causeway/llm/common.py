"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, NullType, ShortType

#: The six bytes that separate words.  ``bytes.split()`` splits at just these.
BLANKS = " \t\n\x0b\f\r"
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
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch path that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, its lineage cut."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def _store(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{os.path.abspath(folder)}")


def put_file(folder: str, name: str, data: bytes) -> None:
    """A file that appears whole or not at all, also when a task is tried again."""
    store, base = _store(folder)
    store.create_dir(base, recursive=True)
    own = f"{base}/.{name}-{os.getpid()}-{os.urandom(4).hex()}"
    with store.open_output_stream(own) as f:
        f.write(data)
    store.move(own, f"{base}/{name}")


def get_file(folder: str, name: str) -> bytes:
    """What ``put_file`` wrote."""
    store, base = _store(folder)
    with store.open_input_stream(f"{base}/{name}") as f:
        return f.read()


def column(name: str) -> Column:
    """A column by its whole name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_column(df: DataFrame, name: str) -> Column:
    return column(name).cast("string")


def id_column(df: DataFrame, name: str) -> Column:
    """A column of ids as ``long``; ids that aren't whole numbers are refused before anything runs."""
    kind = df.select(column(name)).schema[0].dataType
    if not isinstance(kind, (ByteType, ShortType, IntegerType, LongType, NullType)):
        raise TypeError(f"ids must be whole numbers; {name} is {kind.simpleString()}")
    return column(name).cast("long")


def fresh_prefix(df: DataFrame) -> str:
    """A prefix for columns of an operator's own that no column of ``df`` has."""
    out = "__cw_"
    while any(c.lower().startswith(out) for c in df.columns):
        out += "_"
    return out


def map_rows(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[list[tuple]]], schema: str, per_batch: int = 0) -> DataFrame:
    """``mapInArrow`` for a function that yields lists of tuples in the order of ``schema``."""
    spark_schema = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in rows(batches):
            if out:
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return df.mapInArrow(run, spark_schema)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t-\r]+"))


def crc32_of_id(doc_id: Column) -> Column:
    """CRC-32 of the id written in decimal; of the empty string for null."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
