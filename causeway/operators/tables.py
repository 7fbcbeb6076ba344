"""Row, column and set operators on tables whose order matters.

A table is a DataFrame; where order matters it has a dense ``_row`` (see
``ordering.with_row_number``).  Kinds of columns are read from the schema:
doubles are continuous, integers, strings and booleans discrete, structs of
``time`` and ``event`` censored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway.operators.ordering import lagged, with_row_number

ROW = "_row"
#: Categories of a discrete column that the driver takes.
MOST_CATEGORIES = 10_000


def variables(df: DataFrame) -> list[str]:
    """Data columns, without the row number."""
    return [c for c in df.columns if c != ROW]


def kind(df: DataFrame, column: str) -> str:
    """continuous, discrete or censored."""
    t = df.schema[column].dataType
    if isinstance(t, T.StructType) and {"time", "event"} <= set(t.names):
        return "censored"
    return "continuous" if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)) else "discrete"


def of_kind(df: DataFrame, wanted: str) -> DataFrame:
    """Columns of one kind, with the row number where there is one."""
    return df.select(*[c for c in df.columns if c == ROW or kind(df, c) == wanted])


def data_type(df: DataFrame) -> str:
    kinds = {kind(df, c) for c in variables(df)}
    return kinds.pop() if len(kinds) == 1 else "mixed"


def clean_missing(df: DataFrame) -> DataFrame:
    """NaN in continuous and -99 in integer columns become null."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.when(~F.isnan(c), c)
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = F.when(c != -99, c)
        out.append(c.alias(f.name))
    return df.select(*out)


def subset_columns(df: DataFrame, columns: list[str] | list[int]) -> DataFrame:
    """Columns by name or place."""
    names = [variables(df)[c] if isinstance(c, int) else c for c in columns]
    return df.select(*[F.col(f"`{c}`") for c in ([ROW] if ROW in df.columns else []) + names])


def subset_rows(df: DataFrame, rows: list[int]) -> DataFrame:
    """Rows by number, as often and in the order listed; numbered anew."""
    wanted = df.sparkSession.createDataFrame([(i, int(r)) for i, r in enumerate(rows)], "__cw_at long, __cw_row long")
    return wanted.join(df, F.col("__cw_row") == F.col(ROW)).select(*[F.col("__cw_at").alias(ROW) if c == ROW else F.col(f"`{c}`") for c in df.columns])


def remove_rows(df: DataFrame, rows: list[int]) -> DataFrame:
    gone = df.sparkSession.createDataFrame([(int(r),) for r in rows], "__cw_row long")
    return df.join(gone, F.col(ROW) == F.col("__cw_row"), "left_anti")


def remove_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*columns)


def add_column(df: DataFrame, name: str, kind_: str = "continuous") -> DataFrame:
    """A column of missing values."""
    return df.withColumn(name, F.lit(None).cast({"continuous": "double", "discrete": "int", "censored": "struct<time:double,event:int>"}[kind_]))


def change_column(df: DataFrame, old: str, new: str, to: str | None = None) -> DataFrame:
    out = df.withColumnRenamed(old, new)
    return out.withColumn(new, F.col(f"`{new}`").cast(to)) if to else out


def shift_column_down(df: DataFrame, row: int, column: str, by: int) -> DataFrame:
    """From ``row`` on, a column's values move down ``by`` rows; the rows it leaves are missing, and new rows hold what moves past the end."""
    last = df.agg(F.max(ROW)).first()[0] or 0
    more = df.sparkSession.range(last + 1, last + 1 + by).withColumnRenamed("id", ROW)
    longer = df.unionByName(more, allowMissingColumns=True)
    moved = lagged(longer, {"__cw_m": (column, by)})
    return moved.withColumn(column, F.when(F.col(ROW) < row, F.col(f"`{column}`")).when(F.col(ROW) < row + by, F.lit(None)).otherwise(F.col("__cw_m"))).drop("__cw_m")


def permute_rows(df: DataFrame, seed: int) -> DataFrame:
    """Rows in an order drawn from the seed, numbered anew; the draw depends on a row's number alone."""
    return with_row_number(df.withColumn("__cw_u", uniform(seed, F.col(ROW))).withColumnRenamed(ROW, "__cw_old"), "__cw_u", ["__cw_old"], ROW).drop("__cw_u", "__cw_old").select(df.columns)


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the keys alone, however rows are dealt out."""
    h = F.xxhash64(F.lit(seed), *keys)
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(2**53))


def copy_column(column: str, source: DataFrame, target: DataFrame) -> DataFrame:
    """A column of one table in another, by row number."""
    return target.drop(column).join(source.select(ROW, F.col(f"`{column}`")), ROW, "left")


def bind_columns(tables: list[DataFrame]) -> DataFrame:
    """Columns of several tables side by side, by row number."""
    return reduce(lambda a, b: a.join(b, ROW), tables)


def drop_constant_columns(df: DataFrame) -> DataFrame:
    """Without columns of at most one distinct value (missing counts as a value)."""
    cols = variables(df)
    key = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0missing"))
    row = df.agg(*[(F.min(key(c)) != F.max(key(c))).alias(c) for c in cols]).first()
    return df.drop(*[c for c in cols if not row[c]])


def shuffle_columns(df: DataFrame, seed: int) -> DataFrame:
    cols = variables(df)
    order = np.random.default_rng(seed).permutation(len(cols))
    return subset_columns(df, [cols[i] for i in order])


def reorder_columns(df: DataFrame, order: list[str]) -> DataFrame:
    return subset_columns(df, [c for c in order if c in df.columns])


def complete_cases(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows without missing values in the given columns (all by default)."""
    return clean_missing(df).dropna(subset=columns or variables(df))


def codes_to_numbers(df: DataFrame) -> DataFrame:
    """Discrete columns whose categories are all numbers become continuous."""
    strings = [c for c in variables(df) if isinstance(df.schema[c].dataType, T.StringType)]
    ints = [c for c in variables(df) if kind(df, c) == "discrete" and c not in strings]
    bad = df.agg(*[F.max((F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast("double").isNull()).cast("int")).alias(c) for c in strings]).first() if strings else {}
    numeric = ints + [c for c in strings if not bad[c]]
    return df.select(*[F.col(f"`{c}`").cast("double").alias(c) if c in numeric else F.col(f"`{c}`") for c in df.columns])


def categories(df: DataFrame, column: str, most: int = MOST_CATEGORIES) -> list:
    """Distinct non-missing values in ascending order; a column with more than ``most`` is refused, and no more are gathered."""
    found = df.select(F.col(f"`{column}`").alias("v")).dropna().distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} categories")
    return sorted(r.v for r in found)


def index_categories(df: DataFrame, columns: list[str]) -> tuple[DataFrame, dict[str, list]]:
    """Columns as codes 0..m-1 of their sorted categories, and the categories."""
    held = {c: categories(df, c) for c in columns}
    out = df
    for c in columns:
        where = F.array_position(F.array(*[F.lit(v) for v in held[c]]), F.col(f"`{c}`")) if held[c] else F.lit(None)
        out = out.withColumn(c, F.when(where > 0, (where - 1).cast("int")))
    return out, held


def is_binary(df: DataFrame, column: str) -> bool:
    """Whether all known values are 0 or 1."""
    return bool(df.select(F.coalesce(F.min(F.col(f"`{column}`").isin(0, 1).cast("int")), F.lit(0))).first()[0])


def has_missing(df: DataFrame) -> bool:
    cleaned = clean_missing(df)
    return bool(cleaned.select(F.max(F.greatest(F.lit(0), *[F.col(f"`{c}`").isNull().cast("int") for c in variables(df)]))).first()[0])


def between(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Rows strictly between two bounds."""
    return df.filter((F.col(f"`{column}`") > low) & (F.col(f"`{column}`") < high))


def allowed(df: DataFrame, sets: dict[str, list]) -> DataFrame:
    """Rows whose discrete values all lie in the given sets."""
    return df.filter(reduce(lambda a, b: a & b, [F.col(f"`{c}`").isin(v) for c, v in sets.items()], F.lit(True)))


def manipulate(df: DataFrame, evidence: dict[str, object], interventions: dict[str, object]) -> DataFrame:
    """Rows that agree with the evidence, with the manipulated columns set."""
    out = allowed(df, {c: [v] for c, v in evidence.items()})
    for c, v in interventions.items():
        out = out.withColumn(c, F.lit(v).cast(df.schema[c].dataType))
    return out


def expand_cases(df: DataFrame, multiplicity: str) -> DataFrame:
    """Each row as often as a column says."""
    return df.select("*", F.explode(F.array_repeat(F.lit(1), F.col(f"`{multiplicity}`").cast("int"))).alias("__cw_k")).drop("__cw_k", multiplicity)


def split_cases(df: DataFrame, breakpoints: list[int], name: str = "part") -> DataFrame:
    """Row ranges between breakpoints, numbered."""
    part = sum((F.col(ROW) >= b).cast("int") for b in breakpoints) if breakpoints else F.lit(0)
    return df.withColumn(name, part)


def concatenate(tables: list[DataFrame], by_name: bool = True) -> DataFrame:
    """All rows of all tables."""
    return reduce((lambda a, b: a.unionByName(b)) if by_name else (lambda a, b: a.union(b)), tables)


def column_with_most_missing(df: DataFrame) -> str:
    cleaned = clean_missing(df)
    cols = variables(df)
    row = cleaned.agg(*[F.sum(F.col(f"`{c}`").isNull().cast("long")).alias(c) for c in cols]).first()
    return max(cols, key=lambda c: (row[c] or 0, -cols.index(c)))


def top_k(df: DataFrame, column: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(column), *[c for c in df.columns if c != column]).limit(k)


def sum_of_top_k(df: DataFrame, column: str, k: int) -> float:
    return top_k(df, column, k).agg(F.sum(column)).first()[0]


def combinations_of(df: DataFrame, column: str, size: int) -> DataFrame:
    """Combinations of distinct values, as a theta self-join of the value table."""
    values = df.select(F.col(column).alias("v")).distinct()
    out = values.select(F.array("v").alias("combination"))
    for _ in range(size - 1):
        out = out.join(values, F.element_at("combination", -1) < F.col("v")).select(F.concat("combination", F.array("v")).alias("combination"))
    return out


def permutations_of(df: DataFrame, column: str, size: int) -> DataFrame:
    """Ordered selections of ``size`` distinct values, each taken once, as self-joins of the value table."""
    values = df.select(F.col(column).alias("v")).distinct()
    out = values.select(F.array("v").alias("permutation"))
    for _ in range(size - 1):
        out = out.join(values, ~F.array_contains("permutation", F.col("v"))).select(F.concat("permutation", F.array("v")).alias("permutation"))
    return out


def selections_of(df: DataFrame, column: str, size: int, ordered: bool = True) -> DataFrame:
    """Selections of ``size`` distinct values that may repeat; unordered ones ascend."""
    values = df.select(F.col(column).alias("v")).distinct()
    out = values.select(F.array("v").alias("selection"))
    for _ in range(size - 1):
        out = out.join(values, F.lit(True) if ordered else F.element_at("selection", -1) <= F.col("v")).select(F.concat("selection", F.array("v")).alias("selection"))
    return out


def power_set(df: DataFrame, column: str) -> DataFrame:
    """All subsets of the distinct values of a small column, as arrays."""
    values = F.array_sort(F.collect_set(column))
    held = df.agg(values.alias("v"))
    mask = F.explode(F.sequence(F.lit(0).cast("long"), F.pow(F.lit(2.0), F.size("v")).cast("long") - 1))
    return held.select("v", mask.alias("m")).select(F.filter("v", lambda x, i: (F.floor(F.col("m") / F.pow(F.lit(2.0), i)) % 2) == 1).alias("subset"))


def grid(spark, dims: list[int]) -> DataFrame:
    """Every combination of 0..d-1 for each dimension."""
    parts = [spark.range(d).withColumnRenamed("id", f"d{i}") for i, d in enumerate(dims)]
    return reduce(lambda a, b: a.crossJoin(b), parts)
