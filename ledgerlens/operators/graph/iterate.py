"""Shared helpers for iterative graph algorithms."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from ledgerlens.session import cut_lineage

# Keys with fewer rows than this are never worth a plan of their own.
HUB_ROWS = 1_000


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def keyed(df: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """Checkpoint, hash-partition by ``key`` and cache, so joins on ``key`` do not move these rows.

    A lost executor's share of the cache is read again from the checkpoint. The caller unpersists.
    """
    return cut_lineage(df).repartition(n or partitions(df), key).persist(StorageLevel.MEMORY_AND_DISK)


def hub_cutoff(rows: int, parts: int) -> int:
    """Rows above which a key is a hub: more than a quarter of an even partition. Fewer than
    ``4 * parts`` keys can have as many, whatever the data, which bounds what hubs broadcast."""
    return max(HUB_ROWS, rows // (4 * parts))


def join_split(rows: DataFrame, values: DataFrame, hubs: DataFrame | None, key: str) -> DataFrame:
    """Inner join of ``rows`` with ``values`` (one row per ``key``). Rows of the keys in ``hubs`` meet their
    broadcast values where they lie; only the others are shuffled by ``key``."""
    if hubs is None:
        return rows.join(values, key)
    few = F.broadcast(values.join(F.broadcast(hubs), key, "left_semi"))
    return (rows.join(few, key)
                .unionByName(rows.join(F.broadcast(hubs), key, "left_anti").join(values, key)))


class EdgeLayout:
    """Edges cached in the layout that a join on ``key`` needs, each step of an iteration reading them in place.

    Edges of a hub are dealt evenly over all partitions and meet the hub's broadcast value; the
    others lie hash-partitioned by ``key``. The caller unpersists."""

    def __init__(self, edges: DataFrame, key: str, n: int):
        edges = cut_lineage(edges)
        self.key = key
        hubs = cut_lineage(edges.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
                                .where(F.col("_n") > hub_cutoff(edges.count(), n)).select(key))
        self.hubs, self.heavy, light = None, None, edges
        if not hubs.isEmpty():
            self.hubs = hubs
            self.heavy = (edges.join(F.broadcast(hubs), key, "left_semi")
                               .repartition(n).persist(StorageLevel.MEMORY_AND_DISK))
            light = edges.join(F.broadcast(hubs), key, "left_anti")
        self.light = light.repartition(n, key).persist(StorageLevel.MEMORY_AND_DISK)

    def join(self, values: DataFrame) -> DataFrame:
        """The edges with the columns of ``values`` (one row per ``key``)."""
        out = self.light.join(values, self.key)
        if self.hubs is None:
            return out
        few = F.broadcast(values.join(F.broadcast(self.hubs), self.key, "left_semi"))
        return out.unionByName(self.heavy.join(few, self.key))

    def unpersist(self) -> None:
        for df in (self.light, self.heavy):
            if df is not None:
                df.unpersist()
