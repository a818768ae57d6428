"""Column profiling in few passes.

Per-column statistics are computed in one aggregation that yields a single row,
then unpivoted to ``(column, value)`` inside Spark. Distinct counts use one melt to
``(column, value)`` + distinct + count (one shuffle), never many ``count_distinct``
in one ``agg`` (that plans an ``Expand`` multiplying rows by the column count).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType

NUMERIC_FLOAT = (DoubleType, FloatType)


def _nan_to_null(df: DataFrame, cols: list[str]) -> list:
    out = []
    for c in cols:
        t = df.schema[c].dataType
        if isinstance(t, NUMERIC_FLOAT):
            out.append(F.when(F.isnan(c), F.lit(None)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return out


def typed_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """Melt to ``(column, num, str)``: ``num`` orders numeric columns natively, ``str`` is the
    text form (used to join back). Nulls and NaN are dropped."""
    parts = []
    for c in cols:
        t = df.schema[c].dataType
        is_num = isinstance(t, NumericType)
        v = F.when(F.isnan(c), F.lit(None)).otherwise(F.col(c)) if isinstance(t, NUMERIC_FLOAT) else F.col(c)
        parts.append(F.struct(F.lit(c).alias("column"),
                              (v.cast("double") if is_num else F.lit(None).cast("double")).alias("num"),
                              v.cast("string").alias("str")))
    melted = df.select(F.explode(F.array(*parts)).alias("_v")).select("_v.*")
    return melted.where(F.col("str").isNotNull())


def _column_frame(spark, cols: list[str]) -> DataFrame:
    # metadata-size: one row per column
    return spark.createDataFrame([(c,) for c in cols], "column string")


def _one_row_to_long(row_df: DataFrame, cols: list[str], value_name: str, value_type: str) -> DataFrame:
    expr = "stack({n}, {args}) as (`column`, `{v}`)".format(
        n=len(cols), v=value_name,
        args=", ".join(f"'{c}', cast(`{c}` as {value_type})" for c in cols))
    return row_df.selectExpr(expr)


def profile_nunique(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Distinct non-null values per column: ``(column, nunique)``."""
    cols = cols or df.columns
    counts = (typed_values(df, cols).select("column", "str").distinct()
              .groupBy("column").agg(F.count(F.lit(1)).cast("bigint").alias("nunique")))
    return (_column_frame(df.sparkSession, cols).join(counts, "column", "left")
            .select("column", F.coalesce("nunique", F.lit(0)).cast("bigint").alias("nunique")))


def profile_is_constant(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """``nunique <= 1`` in one pass: ``min <=> max`` per column (NaN treated as null)."""
    cols = cols or df.columns
    clean = df.select(*_nan_to_null(df, cols))
    aggs = [F.min(c).eqNullSafe(F.max(c)).alias(c) for c in cols]
    return _one_row_to_long(clean.agg(*aggs), cols, "is_constant", "boolean")


def profile_is_boolean(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """``nunique == 2``: min != max and no value outside {min, max} (two passes)."""
    cols = cols or df.columns
    clean = df.select(*_nan_to_null(df, cols))
    stats = clean.agg(*[F.min(c).alias(f"mn{i}") for i, c in enumerate(cols)],
                      *[F.max(c).alias(f"mx{i}") for i, c in enumerate(cols)]).first()  # one row
    checks = []
    for i, c in enumerate(cols):
        mn, mx = stats[f"mn{i}"], stats[f"mx{i}"]
        if mn is None or mn == mx:
            checks.append(F.lit(False).alias(c))
            continue
        outside = F.sum(F.when(F.col(c).isNotNull() & ~F.col(c).isin(mn, mx), 1).otherwise(0))
        checks.append((F.coalesce(outside, F.lit(0)) == 0).alias(c))
    return _one_row_to_long(clean.agg(*checks), cols, "is_boolean", "boolean")


def null_fraction(df: DataFrame, cols: list[str] | None = None, mean_label: str | None = "__mean__") -> DataFrame:
    """Share of nulls per column (NaN counts as null) plus an overall mean line."""
    cols = cols or df.columns
    clean = df.select(*_nan_to_null(df, cols))
    row = clean.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols])
    out = _one_row_to_long(row, cols, "null_fraction", "double")
    if mean_label:
        mean = out.agg(F.avg("null_fraction").alias("null_fraction")).select(
            F.lit(mean_label).alias("column"), "null_fraction")
        out = out.unionByName(mean)
    return out


def nullity_correlation(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Pearson correlation of null indicators for every column pair ``a < b``.

    Columns that are never or always null are excluded. The k x k matrix is aggregated
    distributedly (``ml.stat.Correlation``); only the matrix (columns^2) reaches the driver.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation

    cols = cols or df.columns
    nf = {r["column"]: r["null_fraction"] for r in null_fraction(df, cols, None).collect()}  # per column
    keep = sorted(c for c in cols if 0.0 < (nf.get(c) or 0.0) < 1.0)
    spark = df.sparkSession
    if len(keep) < 2:
        return spark.createDataFrame([], "col_a string, col_b string, corr double")
    clean = df.select(*_nan_to_null(df, keep))
    ind = clean.select(*[F.col(c).isNull().cast("double").alias(c) for c in keep])
    vec = VectorAssembler(inputCols=keep, outputCol="_v").transform(ind).select("_v")
    m = Correlation.corr(vec, "_v").first()[0].toArray()
    rows = [(keep[i], keep[j], float(m[i, j])) for i in range(len(keep)) for j in range(i + 1, len(keep))]
    return spark.createDataFrame(rows, "col_a string, col_b string, corr double")


def level_counts(df: DataFrame, cols: list[str], total_label: str | None = "__total__") -> DataFrame:
    """Number of levels per categorical column, plus a total line."""
    out = profile_nunique(df, cols).withColumnRenamed("nunique", "levels")
    if total_label:
        out = out.unionByName(out.agg(F.sum("levels").cast("bigint").alias("levels"))
                              .select(F.lit(total_label).alias("column"), "levels"))
    return out


def mean_mode_stats(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """``(column, kind, mean, mode)``: mean of numeric columns, most frequent value of categorical
    columns (ties -> smallest value in the column's own order). ``mode`` is text."""
    spark = df.sparkSession
    parts = []
    if numeric:
        row = df.select(*_nan_to_null(df, numeric)).agg(*[F.avg(c).alias(c) for c in numeric])
        parts.append(_one_row_to_long(row, numeric, "mean", "double")
                     .select("column", F.lit("mean").alias("kind"), "mean",
                             F.lit(None).cast("string").alias("mode")))
    if categorical:
        counts = typed_values(df, categorical).groupBy("column", "num", "str").agg(
            F.count(F.lit(1)).alias("n"))
        best = counts.groupBy("column").agg(
            F.min(F.struct((-F.col("n")).alias("neg"), "num", "str")).alias("b"))
        parts.append(best.select("column", F.lit("mode").alias("kind"),
                                 F.lit(None).cast("double").alias("mean"), F.col("b.str").alias("mode")))
    if not parts:
        return spark.createDataFrame([], "column string, kind string, mean double, mode string")
    return reduce(DataFrame.unionByName, parts)


def moments(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per-column mean and population standard deviation: ``(column, mean, std)``."""
    clean = df.select(*_nan_to_null(df, cols))
    row = clean.agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)],
                    *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(cols)])
    expr = "stack({n}, {args}) as (`column`, `mean`, `std`)".format(
        n=len(cols), args=", ".join(f"'{c}', cast(m_{i} as double), cast(s_{i} as double)"
                                    for i, c in enumerate(cols)))
    return row.selectExpr(expr)


def sort_by_stat(stats: DataFrame, stat_col: str, ascending: bool = False) -> DataFrame:
    """Order a per-column statistics table (one row per column) and number the rows.

    The input is metadata-sized (bounded by the column count), so a global window is fine.
    """
    from pyspark.sql import Window
    order = F.col(stat_col).asc() if ascending else F.col(stat_col).desc()
    w = Window.orderBy(order, F.col("column"))
    return stats.withColumn("position", F.row_number().over(w) - 1)


def classify_columns(profile: DataFrame, categorical: list[str], deleted: list[str] | None = None,
                     target: str | None = None) -> DataFrame:
    """Role per column: ``boolean`` (2 levels), ``categorical`` (listed, not boolean, not deleted),
    ``numeric`` (the rest), ``target``. Input is a ``(column, is_boolean)`` or ``(column, nunique)``
    profile; the first needs no shuffle of the values."""
    deleted = list(deleted or [])
    cat = F.col("column").isin(categorical) if categorical else F.lit(False)
    dele = F.col("column").isin(deleted) if deleted else F.lit(False)
    is_bool = F.col("is_boolean") if "is_boolean" in profile.columns else F.col("nunique") == 2
    role = (F.when(F.col("column") == F.lit(target), F.lit("target")) if target else F.when(F.lit(False), None))
    role = (role.when(is_bool, F.lit("boolean"))
                .when(cat & ~dele, F.lit("categorical"))
                .otherwise(F.lit("numeric")))
    return profile.where(~dele).select("column", role.alias("role"))


def drop_constant_columns(df: DataFrame, cols: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Drop columns with at most one distinct non-null value; returns the dropped names too."""
    const = [r["column"] for r in profile_is_constant(df, cols).collect() if r["is_constant"]]  # per column
    return df.drop(*const), const
