"""Exact dedup by skew-safe combining.

1. *Local*: the partial aggregate of every map task keeps one row per distinct content.
2. *Salted*: groups of ``(digest, salt, text)``; the salt is the map partition modulo ``salts``, so a
   content that fills a third of the table reaches ``salts`` reducers with one row per map task.
3. *Global*: the salt winners of a digest are combined, at most ``salts`` rows per content.

The text is part of the key at every stage, so equal digests of different texts never merge. Only the
digest goes back to the documents; texts are compared again there if two contents share a digest.

Defined results: null text counts as empty; a null ``doc_id`` is smaller than any other; rows that
repeat the winning ``doc_id`` with the same text are one document and share its flag; an empty table
gives an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from ledgerlens.session import cut_lineage

SALTS = 16

Digest = Callable[[Column], Column]


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _winners(rows: DataFrame, salts: int, carried: str | None = None, order: str | None = None) -> DataFrame:
    """One row per distinct ``(_digest, _text)`` of rows ``(_id, _digest, _text[, carried[, order]])``: the
    largest ``carried``, or that of the largest ``order`` where ``carried`` has no order."""
    first = [F.max("_id").alias("_id"), F.count(F.lit(1)).alias("_size")]
    again = [F.max("_id").alias("_id"), F.sum("_size").alias("_size")]
    if order:
        best = [F.max_by(carried, order).alias(carried), F.max(order).alias(order)]
        first, again = best + first, best + again
    elif carried:
        best = F.max(carried).alias(carried)
        first, again = [best] + first, [best] + again
    salted = (rows.withColumn("_salt", F.spark_partition_id() % salts)
                  .groupBy("_digest", "_salt", "_text").agg(*first))
    return salted.groupBy("_digest", "_text").agg(*again)


def exact_groups(docs: DataFrame, digest: Digest = sha256, salts: int = SALTS) -> DataFrame:
    """Per document: ``doc_id, keep_id, group_size, kept, text_sha256`` (hex of the digest)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").alias("_id"), text.alias("_text")).withColumn(
        "_digest", digest(F.col("_text")))
    contents = _winners(rows, salts)
    # Per digest: its number of contents; the text is kept only where that is over one.
    by_digest = contents.groupBy("_digest").agg(
        F.count(F.lit(1)).alias("_n"), F.max("_id").alias("keep_id"), F.max("_size").alias("group_size"))
    by_digest = cut_lineage(by_digest)
    clear = by_digest.where("_n = 1").drop("_n")
    shared = by_digest.where("_n > 1").select("_digest")
    parts = rows.select("_id", "_digest").join(clear, "_digest")
    if not shared.isEmpty():
        both = (rows.join(shared, "_digest", "left_semi")
                    .join(contents.join(shared, "_digest", "left_semi").select(
                        "_digest", "_text", F.col("_id").alias("keep_id"),
                        F.col("_size").alias("group_size")), ["_digest", "_text"]))
        parts = parts.unionByName(both.select("_id", "_digest", "keep_id", "group_size"))
    return parts.select(
        F.col("_id").alias("doc_id"), "keep_id", "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"))


def _ordered(kind: DataType) -> bool:
    """Have values of this type an order? (Maps and variants have none, nor what holds them.)"""
    if isinstance(kind, StructType):
        return all(_ordered(f.dataType) for f in kind.fields)
    return _ordered(kind.elementType) if isinstance(kind, ArrayType) else not isinstance(kind, (MapType, VariantType))


def drop_copies(docs: DataFrame, digest: Digest = sha256, salts: int = SALTS) -> DataFrame:
    """One row of ``docs`` per distinct text: that with the largest ``doc_id``, columns unchanged.

    Rows that also share the ``doc_id`` collapse to the one whose other columns are largest; columns without
    an order, such as maps, are compared as JSON text.
    """
    others = [c for c in docs.columns if c not in ("text", "doc_id")]
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").alias("_id"), text.alias("_text"),
        F.struct(F.col("doc_id").alias("i"), F.col("text").isNull().alias("n"),
                 *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)]).alias("_row"))
    order = None
    if not all(_ordered(docs.schema[c].dataType) for c in others):
        order = "_order"
        rows = rows.withColumn(order, F.struct("_row.i", "_row.n", *[
            F.col(f"_row.c{k}") if _ordered(docs.schema[c].dataType) else F.to_json(F.struct(f"_row.c{k}")).alias(f"c{k}")
            for k, c in enumerate(others)]))
    kept = _winners(rows.withColumn("_digest", digest(F.col("_text"))), salts, "_row", order)
    place = {c: f"c{k}" for k, c in enumerate(others)}
    return kept.select(*[
        F.when(~F.col("_row.n"), F.col("_text")).alias(c) if c == "text"
        else F.col("_row.i").alias(c) if c == "doc_id"
        else F.col(f"_row.{place[c]}").alias(c) for c in docs.columns])
