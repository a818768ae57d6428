"""Scans with declared schemas (no inference pass over the data)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def scan_table(spark: SparkSession, path: str, schema: StructType | str | None = None,
               fmt: str = "csv") -> DataFrame:
    """Read a table with a header row. Declare ``schema`` at scale; inference reads the data twice."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def scan_headerless(spark: SparkSession, path: str, types: list[str] | None = None) -> DataFrame:
    """Read a CSV without header; columns are named by position ``_c0, _c1, ...``."""
    if types is None:
        return spark.read.option("header", False).option("inferSchema", True).csv(path)
    ddl = ", ".join(f"_c{i} {t}" for i, t in enumerate(types))
    return spark.read.option("header", False).schema(ddl).csv(path)


def write_csv(df: DataFrame, path: str, header: bool = True) -> str:
    df.write.mode("overwrite").option("header", header).csv(path)
    return path
