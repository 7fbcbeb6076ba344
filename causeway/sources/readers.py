"""Readers: delimited, sectioned, covariance, knowledge and graph files, and folders of them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.operators.moments import Covariance
from causeway.operators.ordering import with_row_number
from causeway.operators.tables import ROW
from causeway.plans import graphs

DELIMITERS = {"whitespace": r"\s+", "tab": "\t", "comma": r"\s*,\s*", "colon": r"\s*:\s*"}


@dataclass
class ReadOptions:
    """How a delimited file is written."""

    delimiter: str = "whitespace"
    comment: str = "//"
    missing: str = "*"
    header: bool = True
    quote: str = '"'
    max_categories: int = 4
    variables: dict[str, list[str] | None] = field(default_factory=dict)  # name -> categories, None for continuous


def read_lines(spark: SparkSession, path: str, comment: str = "//") -> DataFrame:
    """``(_row, value)``: lines in file order, without blank ones and comments."""
    lines = spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("k"))
    kept = lines.filter((F.trim("value") != "") & ~F.trim("value").startswith(comment))
    return with_row_number(kept, "k").select(ROW, F.regexp_replace("value", "\r$", "").alias("value"))


def _cells(value: Column, o: ReadOptions) -> Column:
    parts = F.split(F.trim(value), DELIMITERS[o.delimiter])
    return F.transform(parts, lambda x: F.regexp_replace(x, f"^{re.escape(o.quote)}(.*){re.escape(o.quote)}$", "$1"))


def read_table(spark: SparkSession, path: str, options: ReadOptions | None = None) -> DataFrame:
    """A delimited table with a row number; columns typed from one pass over their values.

    A column with a value that is no number is discrete (a string); one of
    whole numbers with at most ``max_categories`` different values is discrete
    (an integer); others are continuous.  The missing marker and ``NaN`` are null.
    """
    o = options or ReadOptions()
    rows = read_lines(spark, path, o.comment).select(ROW, _cells(F.col("value"), o).alias("c"))
    first = rows.orderBy(ROW).limit(1).first()
    if first is None:
        raise ValueError("an empty table")
    names = list(first.c) if o.header else [f"X{i + 1}" for i in range(len(first.c))]
    body = rows.filter(F.col(ROW) > first[ROW]) if o.header else rows
    start = 1 if o.header else 0
    return type_columns(body.select((F.col(ROW) - start).alias(ROW), *[F.col("c")[i].alias(n) for i, n in enumerate(names)]), o)


def type_columns(raw: DataFrame, o: ReadOptions) -> DataFrame:
    """String columns, typed as ``read_table`` says."""
    names = [c for c in raw.columns if c != ROW]
    value = {n: F.when(~F.col(f"`{n}`").isin(o.missing, "NaN", ""), F.col(f"`{n}`")) for n in names}
    number = {n: value[n].try_cast("double") for n in names}
    facts = raw.agg(
        *[f.alias(f"{k}{i}") for i, n in enumerate(names) for k, f in (("text", F.max((value[n].isNotNull() & number[n].isNull()).cast("int"))), ("part", F.max((number[n] != F.floor(number[n])).cast("int"))), ("different", F.approx_count_distinct(number[n])))]
    ).first()
    out = []
    for i, n in enumerate(names):
        if n in o.variables:
            out.append((number[n] if o.variables[n] is None else value[n]).alias(n))
        elif facts[f"text{i}"]:
            out.append(value[n].alias(n))
        elif not facts[f"part{i}"] and facts[f"different{i}"] <= o.max_categories:
            out.append(number[n].cast("int").alias(n))
        else:
            out.append(number[n].alias(n))
    return raw.select(ROW, *out)


def read_continuous(spark: SparkSession, path: str, delimiter: str = "\t", header: bool = True) -> DataFrame:
    """A table of numbers by Spark's own reader, in file order."""
    raw = spark.read.csv(path, sep=delimiter, header=header, nullValue="*", nanValue="NaN")
    typed = raw.select(F.monotonically_increasing_id().alias("k"), *[F.col(f"`{c}`").try_cast("double").alias(c if header else f"X{i + 1}") for i, c in enumerate(raw.columns)])
    return with_row_number(typed, "k").drop("k").select(ROW, *[c for c in typed.columns if c != "k"])


def read_transposed(spark: SparkSession, path: str, o: ReadOptions | None = None) -> DataFrame:
    """A table whose lines are variables: name first, then a value for each case."""
    o = o or ReadOptions()
    lines = read_lines(spark, path, o.comment).select(_cells(F.col("value"), o).alias("c"))
    long = lines.select(F.col("c")[0].alias("name"), F.posexplode(F.slice("c", F.lit(2), F.size("c") - 1)))
    names = [r[0] for r in lines.select(F.col("c")[0]).collect()]
    wide = long.groupBy(F.col("pos").cast("long").alias(ROW)).pivot("name", names).agg(F.first("col"))
    return type_columns(wide, o)


def read_sections(spark: SparkSession, path: str, options: ReadOptions | None = None) -> tuple[DataFrame, graphs.Knowledge]:
    """A file of ``/variables``, ``/data`` and ``/knowledge`` parts."""
    o = options or ReadOptions()
    marks = read_lines(spark, path, o.comment)
    heads = {r.value.strip().lower(): r[ROW] for r in marks.filter(F.trim("value").startswith("/")).collect()}
    place = lambda name: heads.get(f"/{name}")
    ends = sorted(heads.values()) + [2**62]
    after = lambda k: next(e for e in ends if e > k)
    part = lambda k: marks.filter((F.col(ROW) > k) & (F.col(ROW) < after(k)))
    variables = dict(o.variables)
    if place("variables") is not None:
        for r in part(place("variables")).orderBy(ROW).collect():
            name, _, what = r.value.partition(":")
            variables[name.strip()] = None if what.strip().lower() == "continuous" else re.split(r"[\s,]+", what.strip())
    knowledge = parse_knowledge("\n".join(r.value for r in part(place("knowledge")).orderBy(ROW).collect())) if place("knowledge") is not None else graphs.Knowledge()
    data = part(place("data")) if place("data") is not None else marks.filter(~F.trim("value").startswith("/"))
    rows = data.select(ROW, _cells(F.col("value"), o).alias("c"))
    first = rows.orderBy(ROW).limit(1).first()
    names = list(first.c) if o.header else list(variables)
    start = first[ROW] + (1 if o.header else 0)
    body = rows.filter(F.col(ROW) >= start).select((F.col(ROW) - start).alias(ROW), *[F.col("c")[i].alias(n) for i, n in enumerate(names)])
    return type_columns(body, ReadOptions(**{**o.__dict__, "variables": variables})), knowledge


def read_censored(spark: SparkSession, path: str, options: ReadOptions | None = None) -> DataFrame:
    """A table whose column named like ``survival`` and binary one named like ``censor`` become one censored column."""
    df = read_table(spark, path, options)
    time = next(c for c in df.columns if "survival" in c.lower())
    event = next(c for c in df.columns if "censor" in c.lower())
    return df.withColumn(time, F.struct(F.col(f"`{time}`").cast("double").alias("time"), F.col(f"`{event}`").cast("int").alias("event"))).drop(event)


def parse_covariance(text: str) -> Covariance:
    """Sample size, names and a lower triangle; ``*`` is missing."""
    lines = [x.strip() for x in text.splitlines() if x.strip() and not x.strip().startswith("//")]
    if lines[0].lower().startswith("/cov"):
        lines = lines[1:]
    n, names = int(re.split(r"\s+", lines[0])[0]), re.split(r"[\s,]+", lines[1])
    out = np.full((len(names),) * 2, np.nan)
    for i, line in enumerate(lines[2 : 2 + len(names)]):
        for j, v in enumerate(re.split(r"[\s,]+", line)[: i + 1]):
            out[i, j] = out[j, i] = np.nan if v == "*" else float(v)
    return Covariance(names, out, n)


def read_covariance(spark: SparkSession, path: str) -> Covariance:
    return parse_covariance(_whole(spark, path))


def _whole(spark: SparkSession, path: str) -> str:
    """A small file as one string, through Spark's own file systems."""
    return spark.read.text(path, wholetext=True).first()[0]


def parse_knowledge(text: str) -> graphs.Knowledge:
    """``addtemporal`` tiers, ``forbiddirect`` and ``requiredirect`` pairs; a tier marked ``*`` forbids edges within it."""
    out, part = graphs.Knowledge(), ""
    for line in map(str.strip, text.splitlines()):
        if not line or line.startswith("/"):
            continue
        words = line.split()
        if words[0].lower() in ("addtemporal", "forbiddirect", "requiredirect"):
            part = words[0].lower()
        elif part == "addtemporal":
            tier = int(words[0].rstrip("*"))
            if words[0].endswith("*"):
                out.within.add(tier)
            out.tiers.update(dict.fromkeys(words[1:], tier))
        elif part == "forbiddirect":
            out.forbidden.add((words[0], words[1]))
        elif part == "requiredirect":
            out.required.add((words[0], words[1]))
    return out


def read_knowledge(spark: SparkSession, path: str) -> graphs.Knowledge:
    return parse_knowledge(_whole(spark, path))


def read_graph(spark: SparkSession, path: str) -> graphs.Graph:
    """A graph in text, JSON or XML, told by how it begins."""
    text = _whole(spark, path)
    start = text.lstrip()[:1]
    return graphs.from_json(text) if start == "{" else graphs.from_xml(text) if start == "<" else graphs.from_text(text)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """``(ord, n1, n2, end1, end2)`` of numbered edge lines, for graphs of any size."""
    line = r"^\s*(\d+)\.\s+(\S+)\s+([<o-])-([>o-])\s+(\S+)"
    at = lambda k: F.regexp_extract("value", line, k)
    mark = lambda c: F.when(c.isin("<", ">"), ">").when(c == "o", "o").otherwise("-")
    return spark.read.text(path).filter(F.col("value").rlike(line)).select(at(1).cast("int").alias("ord"), at(2).alias("n1"), at(5).alias("n2"), mark(at(3)).alias("end1"), mark(at(4)).alias("end2"))


def read_lag_edges(spark: SparkSession, path: str) -> DataFrame:
    """``(child, parent, lag)`` of lines such as ``Gene2 <-- Gene1:1``."""
    line = r"^\s*(\S+)\s*<--\s*(\S+?):(\d+)"
    return spark.read.text(path).filter(F.col("value").rlike(line)).select(F.regexp_extract("value", line, 1).alias("child"), F.regexp_extract("value", line, 2).alias("parent"), F.regexp_extract("value", line, 3).cast("int").alias("lag"))


def read_data_folder(spark: SparkSession, pattern: str, delimiter: str = "\t") -> DataFrame:
    """All tables of a folder with the same columns, marked by ``dataset_id`` (the file's name)."""
    raw = spark.read.csv(pattern, sep=delimiter, header=True, nullValue="*")
    return raw.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("dataset_id"), *[F.col(f"`{c}`").try_cast("double").alias(c) for c in raw.columns])
