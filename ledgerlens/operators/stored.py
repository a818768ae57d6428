"""Fitted PCA and embedding models as written tables that are applied to other rows.

A stored model is a Parquet table with one row for each loading or level: it outlives the session that made
it, is read by any reader, and is applied by native expressions and joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerlens.operators.embed import learn_embedding
from ledgerlens.operators.encode import apply_dictionary, build_dictionary
from ledgerlens.operators.numbering import spread_nulls
from ledgerlens.operators.reduce import pca_by_variance, standardize
from ledgerlens.session import cut_lineage
from ledgerlens.sources.stages import stage_table


def store_pca(df: DataFrame, id_col: str, cols: list[str], threshold: float = 0.95, path: str | None = None) -> DataFrame:
    """Fit ``pca_by_variance`` and write it: ``(component, column, loading, mean, std, variance_ratio)``, a row for
    each kept component and column. Loadings have their signs fixed."""
    _, stats = standardize(df.select(id_col, *cols), cols)
    _, loadings, ratios = pca_by_variance(df, id_col, cols, threshold)
    rows = [(k, c, float(loadings[i, k]), stats[c][0], stats[c][1], float(ratios[k]))
            for k in range(loadings.shape[1]) for i, c in enumerate(cols)]
    schema = "component int, column string, loading double, mean double, std double, variance_ratio double"
    return stage_table(df.sparkSession.createDataFrame(rows, schema), "pca", path)


def apply_pca(df: DataFrame, id_col: str, stored: DataFrame, prefix: str = "pca_") -> DataFrame:
    """``(id, pca_0, ..)`` of rows, by the scaling and loadings of a stored model. A row with a null in a column
    of the model has null components."""
    parts: dict[int, list] = {}
    for r in stored.orderBy("component", "column").collect():  # components x columns
        scaled = (F.col(r["column"]).cast("double") - F.lit(r["mean"] or 0.0)) / F.lit(r["std"] or 1.0)
        parts.setdefault(r["component"], []).append(scaled * F.lit(r["loading"]))
    return df.select(id_col, *[sum(terms[1:], terms[0]).alias(f"{prefix}{k}") for k, terms in sorted(parts.items())])


def store_embedding(df: DataFrame, cols: list[str], label: str, path: str | None = None, **settings) -> DataFrame:
    """Learn embeddings of raw category columns and write them with their levels: ``(column, level, code, vec)``.
    The null level, where a column has one, has a null ``level`` and ``code``."""
    dictionary = cut_lineage(build_dictionary(df, cols))
    coded = cut_lineage(apply_dictionary(df.select(*cols, label), dictionary, cols))
    vectors = learn_embedding(coded, cols, label, **settings)
    levels = dictionary.select("column", F.col("str").alias("level"), "code")
    return stage_table(vectors.join(levels, ["column", "code"], "left").select("column", "level", "code", "vec"),
                       "embedding", path)


def apply_stored_embedding(df: DataFrame, stored: DataFrame, cols: list[str]) -> DataFrame:
    """Each raw category column of ``df`` replaced by ``{col}_0 ..``. Null has its own vector if the model saw nulls;
    unknown levels, and nulls that the model did not see, get zeros. No row is dropped."""
    out = df
    for c in cols:
        own = stored.where(F.col("column") == c)
        size = own.select(F.max(F.size("vec"))).first()[0] or 0  # one number
        null = own.where("level is null").select("vec").limit(1).collect()
        zeros = F.array(*[F.lit(0.0)] * size).cast("array<float>")
        null = F.lit(list(null[0]["vec"])).cast("array<float>") if null else zeros
        table = own.where("level is not null").select(F.col("level").alias("_level"), F.lit(0).alias("_spread"),
                                                      F.col("vec").alias("_vec"))
        joined = (out.withColumn("_level", F.col(c).cast("string")).withColumn("_spread", spread_nulls(["_level"]))
                     .join(table, ["_level", "_spread"], "left"))
        vec = F.when(F.col("_level").isNull(), null).otherwise(F.coalesce("_vec", zeros))
        rest = [x for x in out.columns if x != c]
        out = joined.withColumn("_v", vec).select(*rest, *[F.col("_v")[i].cast("double").alias(f"{c}_{i}") for i in range(size)])
    return out
