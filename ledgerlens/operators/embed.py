"""Supervised category embeddings.

``learn_embedding`` fits a factorization machine (the model of ``FMClassifier``) on the one-hot levels of
the categorical columns against the binary target; the latent factor row of each level is its
vector, reduced to ``embedding_dim`` numbers. Each training step is a distributed job over packed codes.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from ledgerlens.session import cut_lineage

#: Rows of a training task, and the number of rows up to which one task takes all.
TASK_ROWS = 500_000
SMALL_ROWS = 20_000


def embedding_dim_expr(nunique_col: str = "nunique"):
    """``max(min((nunique + 1) // 2, 16), 2)``."""
    return F.greatest(F.least(F.floor((F.col(nunique_col) + 1) / 2), F.lit(16)), F.lit(2)).cast("int")


def embedding_dim(nunique: DataFrame) -> DataFrame:
    return nunique.select("column", "nunique", embedding_dim_expr().alias("embedding_dim"))


def learn_embedding(df: DataFrame, cols: list[str], label: str, max_iter: int = 100, seed: int = 0,
                    step_size: float = 0.05) -> DataFrame:
    """``(column, code, vec array<float>)`` for every level code of every column.

    ``cols`` must hold integer codes 0..n-1 (see ``label_encode``). Null is a level of its own, returned
    with a null code where a column has any; no row is left out. The model learns factors of the largest
    ``embedding_dim`` for all columns; each column's block is then reduced to its own size by SVD, which
    keeps the inner products as well as that many numbers can. The driver holds levels x factor size
    numbers, as Spark's model does.

    The codes and the label are written once; everything else is read from there.
    """
    import numpy as np

    from ledgerlens.operators.profile import profile_nunique

    spark = df.sparkSession
    names = [f"c{i}" for i in range(len(cols))]
    data = cut_lineage(df.select(*[F.col(c).cast("int").alias(n) for c, n in zip(cols, names)],
                                 F.col(label).cast("double").alias("_y")))
    dims = {r["column"]: int(r["embedding_dim"])
            for r in embedding_dim(profile_nunique(data, names)).collect()}  # one row per column
    ends = data.agg(*[F.max(n).alias(f"m_{n}") for n in names], *[F.min(n).alias(f"l_{n}") for n in names],
                    *[F.max(F.col(n).isNull()).alias(f"n_{n}") for n in names], F.count(F.lit(1)).alias("rows"),
                    F.count(F.when(F.col("_y").isin(0.0, 1.0), 1)).alias("known")).first()
    if ends["rows"] == 0 or ends["known"] < ends["rows"]:
        raise ValueError("embeddings need rows, each with a label of 0 or 1")
    if any((ends[f"l_{n}"] or 0) < 0 for n in names):
        raise ValueError("codes must not be negative")
    levels = [int(ends[f"m_{n}"] if ends[f"m_{n}"] is not None else -1) + 1 for n in names]
    widths = [n + int(ends[f"n_{c}"]) for c, n in zip(names, levels)]
    starts = [sum(widths[:i]) for i in range(len(widths))]
    blocks = _packed(data, names, levels, starts, ends["rows"]).persist(StorageLevel.MEMORY_AND_DISK)
    factors = _fit_factors(blocks, len(cols), sum(widths), max(dims.values()), ends["rows"], max_iter, seed, step_size)
    blocks.unpersist()
    rows = []
    for c, name, n, width, offset in zip(cols, names, levels, widths, starts):
        u, size, _ = np.linalg.svd(factors[offset:offset + width], full_matrices=False)
        vecs = np.zeros((width, dims[name]))
        k = min(dims[name], len(size))
        vecs[:, :k] = u[:, :k] * size[:k]
        rows += [(c, code if code < n else None, vec) for code, vec in enumerate(vecs.tolist())]
    return spark.createDataFrame(rows, "column string, code int, vec array<float>")


def _packed(data: DataFrame, names: list[str], levels: list[int], starts: list[int], rows: int) -> DataFrame:
    """``(codes, y)``: batches of rows as bytes, the codes of all columns numbered through, even over the tasks."""
    import numpy as np
    import pyarrow as pa

    def pack(batches):
        for b in batches:
            if not b.num_rows:
                continue
            codes = [b.column(i).fill_null(n).to_numpy(zero_copy_only=False).astype(np.int32) + s
                     for i, (n, s) in enumerate(zip(levels, starts))]
            y = b.column(len(names)).to_numpy(zero_copy_only=False).astype(np.int8)
            yield pa.RecordBatch.from_arrays([pa.array([np.stack(codes).astype(np.int32).tobytes()], pa.binary()),
                                              pa.array([y.tobytes()], pa.binary())], ["codes", "y"])

    tasks = max(data.sparkSession.sparkContext.defaultParallelism, rows // TASK_ROWS) if rows > SMALL_ROWS else 1
    return data.repartition(tasks).mapInArrow(pack, "codes binary, y binary")


def _fit_factors(blocks: DataFrame, n_cols: int, n_levels: int, k: int, rows: int, max_iter: int, seed: int,
                 step_size: float, tol: float = 1e-6):
    """The factors (levels x ``k``) of a factorization machine with linear terms and intercept on one-hot rows, by the
    logistic loss over all rows and AdamW from the start that ``FMClassifier`` draws, as it would fit them.

    Each step is a job: the tasks go through their packed rows and give sums, which are added by coefficient. On one-hot
    rows, the gradient of a level's factors is a sum over the rows that have it."""
    import numpy as np
    import pyarrow as pa

    def gradient(w):
        v, lin, bias = w[:n_levels * k].reshape(n_levels, k), w[n_levels * k:-1], w[-1]
        half = 0.5 * (v * v).sum(1)

        def run(batches):
            mass, drawn, total = np.zeros(n_levels), np.zeros((k, n_levels)), 0.0
            for b in batches:
                for blob, labels in zip(b.column(0), b.column(1)):
                    y = np.frombuffer(labels.as_buffer(), np.int8)
                    codes = np.frombuffer(blob.as_buffer(), np.int32).reshape(n_cols, len(y)).astype(np.int64)
                    raw, sums = np.full(len(y), bias), np.zeros((len(y), k))
                    for c in codes:
                        raw += (lin - half)[c]
                        sums += v.take(c, 0)
                    raw += 0.5 * (sums * sums).sum(1)
                    off = 1.0 / (1.0 + np.exp(-np.clip(raw, -700, 700))) - y
                    total += off.sum()
                    sums = np.ascontiguousarray((sums * off[:, None]).T)
                    for c in codes:
                        mass += np.bincount(c, off, n_levels)
                        for f in range(k):
                            drawn[f] += np.bincount(c, sums[f], n_levels)
            g = np.concatenate([(drawn.T - v * mass[:, None]).ravel(), mass, [total]])
            at = np.flatnonzero(g)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(g[at])], ["i", "g"])

        summed = blocks.mapInArrow(run, "i int, g double").groupBy("i").agg(F.sum("g").alias("g")).toPandas()
        out = np.zeros(len(w))
        out[summed["i"].to_numpy()] = summed["g"].to_numpy()
        return out / rows

    w = _start(blocks.sparkSession, n_levels, k, seed)
    m, s = np.zeros(len(w)), np.zeros(len(w))
    for step in range(1, max_iter + 1):
        g = gradient(w)
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        new = w - step_size * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)
        done = np.linalg.norm(new - w) < tol * max(np.linalg.norm(new), 1.0)
        w = new
        if done:
            break
    return w[:n_levels * k].reshape(n_levels, k)


def _start(spark, n_levels: int, k: int, seed: int):
    """The coefficients that ``FMClassifier`` starts from."""
    import numpy as np
    from pyspark.ml.classification import FMClassifier
    from pyspark.ml.linalg import Vectors

    two = spark.createDataFrame([(Vectors.sparse(n_levels, []), 0.0), (Vectors.sparse(n_levels, []), 1.0)], ["x", "y"])
    model = FMClassifier(featuresCol="x", labelCol="y", factorSize=k, maxIter=0, seed=seed).fit(two)
    return np.concatenate([model.factors.toArray().ravel(), model.linear.toArray(), [model.intercept]])


def join_embedding(df: DataFrame, embeddings: DataFrame, col: str, dim: int | None = None,
                   prefix: str | None = None) -> DataFrame:
    """Replace code column ``col`` by ``{col}_0..{col}_{dim-1}`` (inner join on the code; a null code
    matches the null level)."""
    prefix = prefix or col
    tab = embeddings.where(F.col("column") == col).select(F.col("code").alias("_code"), F.col("vec").alias("_vec"))
    if dim is None:
        dim = tab.select(F.max(F.size("_vec"))).first()[0] or 0
    out = df.join(tab, df[col].eqNullSafe(tab["_code"]), "inner")
    return out.select(*[c for c in df.columns if c != col],
                      *[F.col("_vec")[i].cast("double").alias(f"{prefix}_{i}") for i in range(dim)])


def apply_embedding(df: DataFrame, embeddings: DataFrame, cols: list[str]) -> DataFrame:
    out = df
    for c in cols:
        out = join_embedding(out, embeddings, c)
    return out
