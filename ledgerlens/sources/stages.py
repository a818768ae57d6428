"""Written stages under the shared checkpoint folder, imputation datasets, schema catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlens.session import stage_path

# Column data types -> graph-import property types (fixed values of the export format):
# int64 -> int, int32 -> int, float64 -> float, float32 -> float, object -> string
GRAPH_TYPE_NAMES = {"bigint": "int", "int": "int", "smallint": "int", "tinyint": "int",
                    "double": "float", "float": "float", "string": "string"}


def stage_table(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Persist an intermediate as Parquet (overwrite) and continue from the written copy."""
    spark = df.sparkSession
    target = path or stage_path(spark, name)
    df.write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def write_imputations(df: DataFrame, path: str, imputation_col: str = "imputation") -> str:
    """One Parquet dataset, partitioned by the imputation number."""
    df.write.mode("overwrite").partitionBy(imputation_col).parquet(path)
    return path


def scan_imputations(spark: SparkSession, path: str, file_regex: str | None = None) -> DataFrame:
    """All completed datasets as one DataFrame with an ``imputation`` column (partition discovery).

    ``file_regex`` matches whole file names; the filter on the file's name prunes the file list before
    anything is read.
    """
    out = spark.read.parquet(path)
    if file_regex is None:
        return out
    return out.where(F.col("_metadata.file_name").rlike(f"^(?:{file_regex})$"))


def export_target(df: DataFrame, key: str, label: str, path: str | None = None) -> DataFrame:
    """Save the target vector as ``(key, label)`` and read it back."""
    return stage_table(df.select(key, label), "target", path)


def schema_catalog(df: DataFrame, roles: DataFrame | None = None, dictionary: DataFrame | None = None,
                   path: str | None = None) -> DataFrame:
    """``(column, dtype[, role][, levels])`` metadata table, written as Parquet and read back.

    ``roles`` comes from ``classify_columns``, ``dictionary`` from ``build_dictionary``: its
    ``(column, level, code)`` rows are written beside the catalog, and the catalog counts them.
    """
    spark = df.sparkSession
    rows = [(c, t) for c, t in df.dtypes]
    cat = spark.createDataFrame(rows, "column string, dtype string")  # one row per column
    if roles is not None:
        cat = cat.join(roles, "column", "left")
    if dictionary is not None:
        target = path and f"{path}-labels"
        labels = stage_table(dictionary.select("column", F.col("str").alias("level"), "code"), "labels", target)
        counts = labels.groupBy("column").agg(F.count(F.lit(1)).cast("bigint").alias("levels"))
        cat = cat.join(counts, "column", "left")
    return stage_table(cat, "schema_catalog", path)


def catalog_schema(catalog: DataFrame) -> dict[str, str]:
    """Column -> type name of a stored catalog (one row per column)."""
    return {r["column"]: r["dtype"] for r in catalog.select("column", "dtype").collect()}


def scan_with_catalog(spark: SparkSession, path: str, catalog: DataFrame, labels: DataFrame | None = None,
                      unknown: int = -1) -> DataFrame:
    """A typed scan of CSV files with a header row, by a stored catalog: no inference pass.

    Columns come in the file's order. Those that the catalog does not name are left out; those that the file
    lacks follow by name and are null; a cell that does not fit its type is null. With ``labels`` (``column, level,
    code``), the columns that it names are read as codes: null stays null, a level that it does not know is
    ``unknown``.
    """
    types = catalog_schema(catalog)
    header = spark.read.option("header", True).csv(path).columns  # the header row only
    schema = ", ".join(f"`{name.replace('`', '``')}` {types.get(name, 'string')}" for name in header)
    rows = spark.read.option("header", True).option("mode", "PERMISSIVE").schema(schema).csv(path)
    names = [c for c in header if c in types] + sorted(set(types) - set(header))
    rows = rows.select(*[F.col(f"`{c}`") if c in header else F.lit(None).cast(types[c]).alias(c) for c in names])
    if labels is None:
        return rows
    from ledgerlens.operators.encode import apply_dictionary

    coded = [r["column"] for r in labels.select("column").distinct().collect() if r["column"] in types]  # columns
    coded = sorted(coded, key=names.index)
    # Levels are known by the text of their typed value.
    codes = apply_dictionary(rows, labels.withColumnRenamed("level", "str"), coded, suffix="__code")
    return codes.select(*[
        F.when(F.col(f"`{c}`").isNotNull(), F.coalesce(F.col(f"`{c}__code`"), F.lit(unknown))).alias(c) if c in coded
        else F.col(f"`{c}`") for c in names])
