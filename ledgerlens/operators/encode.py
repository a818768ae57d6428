"""Label encoding with dictionaries numbered in each column's native order, and downcasts.

``StringIndexer`` orders numbers as text (1, 10, 2), so the dictionary is built here: one
melt of all encoded columns to ``(column, num, str)``, one distinct, one range-partitioned
numbering of ``(column, num, str)`` (no single-partition window), and per-column offsets.
Codes are applied with one left join per column on the value's text form; a dictionary of up to
``BROADCAST_LEVELS`` counted levels goes to the rows, which then stay where they lie (the planner does not
know the size of a written dictionary and would shuffle all rows). Null cells, which may be most of a
column, are dealt over many keys that match nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegerType, LongType

from ledgerlens.operators.numbering import global_positions, spread_nulls
from ledgerlens.operators.profile import typed_values

#: Dictionaries of so many levels are sent to every executor.
BROADCAST_LEVELS = 100_000


def build_dictionary(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(column, num, str, code)`` with codes 0..n-1 per column in native value order."""
    distinct = typed_values(df, cols).distinct()
    pos = global_positions(distinct, ["column", "num", "str"], "_pos")
    first = pos.groupBy("column").agg(F.min("_pos").alias("_first"))  # one row per column
    return (pos.join(F.broadcast(first), "column")
               .select("column", "num", "str", (F.col("_pos") - F.col("_first")).cast("int").alias("code")))


def apply_dictionary(df: DataFrame, dictionary: DataFrame, cols: list[str], suffix: str = "") -> DataFrame:
    """Replace each column by its code (null stays null). ``suffix`` keeps the original too."""
    out = df
    sizes = {r["column"]: r["count"] for r in dictionary.groupBy("column").count().collect()}  # one row per column
    for c in cols:
        d = dictionary.where(F.col("column") == c).select(F.col("str").alias("_k"), F.lit(0).alias("_spread"),
                                                          F.col("code").alias("_code"))
        if sizes.get(c, 0) <= BROADCAST_LEVELS:
            d = F.broadcast(d)
        out = (out.withColumn("_k", F.col(c).cast("string")).withColumn("_spread", spread_nulls(["_k"]))
                  .join(d, ["_k", "_spread"], "left")
                  .withColumn(c + suffix if suffix else c, F.col("_code"))
                  .drop("_k", "_spread", "_code"))
    return out


def label_encode(df: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    dictionary = build_dictionary(df, cols)
    return apply_dictionary(df, dictionary, cols), dictionary


def codes_from_category(df: DataFrame, dictionary: DataFrame, col: str, out_col: str | None = None) -> DataFrame:
    out = apply_dictionary(df, dictionary, [col], suffix="" if out_col is None else "__code")
    if out_col is not None:
        out = out.withColumnRenamed(col + "__code", out_col)
    return out


def downcast_types(df: DataFrame) -> DataFrame:
    """double -> float; bigint -> int where a column's smallest and largest value fit (one pass for all
    columns), else the column stays bigint."""
    longs = [f.name for f in df.schema.fields if isinstance(f.dataType, LongType)]
    fits = set()
    if longs:
        ends = df.agg(*[e for i, c in enumerate(longs)
                        for e in (F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"))]).first()  # one row
        fits = {c for i, c in enumerate(longs)
                if ends[f"lo{i}"] is None or (ends[f"lo{i}"] >= -2 ** 31 and ends[f"hi{i}"] < 2 ** 31)}
    sel = []
    for f in df.schema.fields:
        if isinstance(f.dataType, DoubleType):
            sel.append(F.col(f.name).cast(FloatType()).alias(f.name))
        elif f.name in fits:
            sel.append(F.col(f.name).cast(IntegerType()).alias(f.name))
        else:
            sel.append(F.col(f.name))
    return df.select(*sel)
