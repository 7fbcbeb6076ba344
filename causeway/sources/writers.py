"""Writers: delimited tables, covariances, knowledge, graphs, folds and simulated data sets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.operators.moments import Covariance
from causeway.operators.tables import ROW
from causeway.plans import graphs


def write_table(df: DataFrame, path: str, delimiter: str = "\t", missing: str = "*") -> None:
    """A delimited table in row order, missing values as ``*``."""
    out = df.orderBy(ROW).drop(ROW) if ROW in df.columns else df
    typed = out.select(*[F.when(~F.isnan(c), F.col(f"`{c}`")).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in out.dtypes])
    typed.write.mode("overwrite").csv(path, sep=delimiter, header=True, nullValue=missing, emptyValue="")


def covariance_text(cov: Covariance) -> str:
    rows = ["\t".join("*" if np.isnan(v) else repr(float(v)) for v in cov.matrix[i, : i + 1]) for i in range(len(cov.names))]
    return "\n".join(["/covariance", str(cov.n), "\t".join(cov.names), *rows]) + "\n"


def knowledge_text(k: graphs.Knowledge) -> str:
    lines = ["/knowledge", "addtemporal"]
    for tier in sorted(set(k.tiers.values())):
        lines.append(f"{tier}{'*' if tier in k.within else ''} " + " ".join(sorted(v for v, t in k.tiers.items() if t == tier)))
    lines += ["", "forbiddirect", *[" ".join(p) for p in sorted(k.forbidden)], "", "requiredirect", *[" ".join(p) for p in sorted(k.required)]]
    return "\n".join(lines) + "\n"


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One small text as a single file in a folder, through Spark's own file systems."""
    spark.createDataFrame([(line,) for line in text.split("\n")], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_graph(spark: SparkSession, g: graphs.Graph, path: str, form: str = "text") -> None:
    """A graph as text, dot, sif, xml or json."""
    write_text(spark, {"text": g.to_text, "dot": g.to_dot, "sif": g.to_sif, "xml": g.to_xml, "json": g.to_json}[form](), path)


def write_edges(edges: DataFrame, path: str) -> None:
    """Numbered edge lines of an edge frame of any size."""
    from causeway.operators.ordering import with_row_number

    left = F.when(F.col("end1") == ">", "<").otherwise(F.col("end1"))
    numbered = with_row_number(edges.withColumn("k", F.monotonically_increasing_id()), "k", start=1)
    numbered.select(F.concat(F.col(ROW).cast("string"), F.lit(". "), "n1", F.lit(" "), left, F.lit("-"), "end2", F.lit(" "), "n2").alias("value")).write.mode("overwrite").text(path)


def write_folds(df: DataFrame, path: str) -> None:
    """A table with a ``fold`` column, a folder for each fold."""
    df.write.mode("overwrite").partitionBy("fold").parquet(path)


def write_simulations(data: DataFrame, path: str) -> None:
    """Simulated rows with a ``dataset_id``, a folder for each."""
    data.write.mode("overwrite").partitionBy("dataset_id").parquet(path)


def text_table(df: DataFrame, rows: int = 50) -> str:
    """The first rows as aligned text."""
    held = [[str(v) for v in r] for r in df.limit(rows).collect()]
    table = [df.columns, *held]
    width = [max(len(r[i]) for r in table) for i in range(len(df.columns))]
    return "\n".join("  ".join(v.rjust(w) for v, w in zip(r, width)) for r in table) + "\n"


def write_report(df: DataFrame, path: str) -> None:
    """A comparison's tables as one CSV folder."""
    df.write.mode("overwrite").csv(path, header=True)
