"""Global ordinal numbering without a single-partition window.

``dense_rank() over (order by k)`` plans ``Exchange SinglePartition``. Here the
distinct keys are range-partitioned and sorted, each row takes
``monotonically_increasing_id`` (partition id in the high bits, position in the
low 33 bits), the result is checkpointed so ids are stable, and per-partition
row counts (one row per partition, bounded by the partition count) give the
offsets.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ledgerlens.session import cut_lineage

_LOW_BITS = 33


def _partition_count(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return num_partitions
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def global_positions(df: DataFrame, order_cols: list[str], out_col: str = "position",
                     num_partitions: int | None = None) -> DataFrame:
    """Attach the 0-based position of every row in ``order_cols`` order.

    ``order_cols`` must identify rows uniquely (add a key as tie-break).
    """
    return positions_with_total(df, order_cols, out_col, num_partitions)[0]


def positions_with_total(df: DataFrame, order_cols: list[str], out_col: str = "position",
                         num_partitions: int | None = None) -> tuple[DataFrame, int]:
    """``global_positions`` plus the row total (known from the offsets)."""
    n = _partition_count(df, num_partitions)
    ranged = (df.repartitionByRange(n, *order_cols)
                .sortWithinPartitions(*order_cols)
                .withColumn("_mid", F.monotonically_increasing_id()))
    ranged = cut_lineage(ranged)
    pid = F.shiftright("_mid", _LOW_BITS)
    counts = ranged.groupBy(pid.alias("_pid")).count().collect()  # one row per partition
    offsets, run = [], 0
    for row in sorted(counts, key=lambda r: r["_pid"]):
        offsets.append((int(row["_pid"]), run))
        run += int(row["count"])
    spark = df.sparkSession
    off_df = spark.createDataFrame(offsets or [(0, 0)], "_pid long, _off long")
    local = F.col("_mid").bitwiseAND(F.lit((1 << _LOW_BITS) - 1))
    out = (ranged.withColumn("_pid", pid)
                 .join(F.broadcast(off_df), "_pid")  # one row per partition
                 .withColumn(out_col, F.col("_off") + local)
                 .drop("_pid", "_off", "_mid"))
    return out, run


def group_number(df: DataFrame, keys: list[str], out_col: str = "group",
                 num_partitions: int | None = None) -> DataFrame:
    """Dense 0-based number of each key tuple in sorted key order (pandas ``ngroup``).

    Rows with a null in any key keep a null number; they are dealt over many join keys.
    """
    distinct = df.select(*keys).where(F.lit(True) if not keys else
                                      _all_not_null(keys)).distinct()
    numbered = global_positions(distinct, keys, out_col, num_partitions).withColumn("_spread", F.lit(0))
    return df.withColumn("_spread", spread_nulls(keys)).join(numbered, on=[*keys, "_spread"], how="left").drop("_spread")


def spread_nulls(keys: list[str], ways: int = 1000):
    """0 for rows whose keys are all set; else one of ``ways`` numbers by row position, so that rows that
    can match nothing do not meet in one task of a join."""
    return F.when(_all_not_null(keys), F.lit(0)).otherwise(
        F.pmod(F.monotonically_increasing_id(), F.lit(ways)).cast("int") + 1)


def _all_not_null(cols: list[str]):
    cond = F.col(cols[0]).isNotNull()
    for c in cols[1:]:
        cond = cond & F.col(c).isNotNull()
    return cond


def ordered_split(df: DataFrame, order_cols: list[str], validation_share: float = 0.33,
                  out_col: str = "split", num_partitions: int | None = None) -> DataFrame:
    """First part ``train``, last ``ceil(share * n)`` rows ``validation``; no shuffling of order."""
    pos, n = positions_with_total(df, order_cols, "_pos", num_partitions)
    n_val = math.ceil(validation_share * n)
    return (pos.withColumn(out_col, F.when(F.col("_pos") >= F.lit(n - n_val), F.lit("validation"))
                                     .otherwise(F.lit("train")))
               .drop("_pos"))


def prefix_sums(df: DataFrame, order_cols: list, sum_cols: list[str], num_partitions: int | None = None,
                suffix: str = "_cum") -> DataFrame:
    """Inclusive running sums of ``sum_cols`` in ``order_cols`` order, without a global window.

    Range-partition + sort, running sums inside each partition (Arrow batches), one row of
    totals per partition to the driver, broadcast offsets. ``order_cols`` must be unique.
    """
    from pyspark import TaskContext

    n = _partition_count(df, num_partitions)
    ranged = df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
    from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

    schema = StructType(list(ranged.schema.fields)
                        + [StructField(f"{c}{suffix}", DoubleType()) for c in sum_cols]
                        + [StructField("_pid", IntegerType())])

    def run(batches):
        pid = TaskContext.get().partitionId()
        carry = {c: 0.0 for c in sum_cols}
        for b in batches:
            for c in sum_cols:
                cs = b[c].astype("float64").cumsum() + carry[c]
                if len(cs):
                    carry[c] = float(cs.iloc[-1])
                b[f"{c}{suffix}"] = cs
            b["_pid"] = pid
            yield b

    local = cut_lineage(ranged.mapInPandas(run, schema))
    totals = local.groupBy("_pid").agg(*[F.sum(c).alias(c) for c in sum_cols]).collect()  # per partition
    rows, run_tot = [], {c: 0.0 for c in sum_cols}
    for r in sorted(totals, key=lambda r: r["_pid"]):
        rows.append((int(r["_pid"]), *[run_tot[c] for c in sum_cols]))
        for c in sum_cols:
            run_tot[c] += float(r[c] or 0.0)
    spark = df.sparkSession
    off_schema = "_pid int, " + ", ".join(f"`_off_{c}` double" for c in sum_cols)
    off = spark.createDataFrame(rows or [(0, *[0.0] * len(sum_cols))], off_schema)
    out = local.join(F.broadcast(off), "_pid")  # one row per partition
    for c in sum_cols:
        out = out.withColumn(f"{c}{suffix}", F.col(f"{c}{suffix}") + F.col(f"_off_{c}"))
    return out.drop("_pid", *[f"_off_{c}" for c in sum_cols])
