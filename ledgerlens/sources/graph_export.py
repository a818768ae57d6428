"""Bulk-import files for a property-graph store: headerless data CSV + one-line header file."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlens.session import stage_path
from ledgerlens.sources.stages import GRAPH_TYPE_NAMES


def _write(df: DataFrame, header: list[str], folder: str) -> tuple[str, str]:
    data = os.path.join(folder, "data")
    head = os.path.join(folder, "header")
    df.write.mode("overwrite").option("header", False).csv(data)
    spark = df.sparkSession
    spark.createDataFrame([(",".join(header),)], "line string").coalesce(1) \
         .write.mode("overwrite").text(head)
    return data, head


def export_nodes(df: DataFrame, id_col: str, label: str, folder: str | None = None) -> tuple[str, str]:
    """Distinct ids + constant label; header ``<id>:ID,label:LABEL``."""
    spark = df.sparkSession
    folder = folder or stage_path(spark, f"nodes_{label}")
    nodes = df.where(F.col(id_col).isNotNull()).select(id_col).distinct().withColumn("label", F.lit(label))
    return _write(nodes, [f"{id_col}:ID", "label:LABEL"], folder)


def edge_header(df: DataFrame, src: str, dst: str, type_col: str = "type") -> list[str]:
    """``name:type`` per property column, then ``:START_ID``, ``:END_ID`` and ``:TYPE``."""
    props = [(c, t) for c, t in df.dtypes if c not in (src, dst, type_col)]
    return ([f"{c}:{GRAPH_TYPE_NAMES.get(t, 'string')}" for c, t in props]
            + [f"{src}:START_ID", f"{dst}:END_ID", f"{type_col}:TYPE"])


def export_edges(df: DataFrame, src: str, dst: str, rel_type: str = "transaction",
                 folder: str | None = None) -> tuple[str, str]:
    spark = df.sparkSession
    folder = folder or stage_path(spark, "edges")
    props = [c for c in df.columns if c not in (src, dst)]
    out = df.select(*props, src, dst, F.lit(rel_type).alias("type"))
    return _write(out, edge_header(out, src, dst), folder)


def read_export(spark: SparkSession, data: str, head: str) -> DataFrame:
    """Read an export back with the names from its header file (types given as text)."""
    header = spark.read.text(head).first()[0].split(",")
    back = {"int": "bigint", "float": "double"}
    ddl = ", ".join(f"`{h}` {back.get(h.rsplit(':', 1)[-1], 'string')}" for h in header)
    return spark.read.option("header", False).schema(ddl).csv(data)
