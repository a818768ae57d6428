"""Scalar column expressions and column-name metadata helpers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F


def node_id(prefix: str, col: str | Column) -> Column:
    """``prefix`` + the value as text; null stays null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.concat(F.lit(prefix), c.cast("string"))


def edge_target(class_from: str = "class_from", class_to: str = "class_to", positive: int = 1) -> Column:
    """1 when either endpoint has the positive class, else 0 (unknown counts as 0)."""
    hit = (F.col(class_from) == positive) | (F.col(class_to) == positive)
    return F.when(F.coalesce(hit, F.lit(False)), F.lit(1)).otherwise(F.lit(0))


def recode_sentinel(col: str, sentinel: str = "unknown", value: int = 3) -> Column:
    """Replace a string sentinel by a number and cast the column to bigint."""
    return (F.when(F.col(col) == sentinel, F.lit(str(value))).otherwise(F.col(col))
             .cast("bigint"))


def scale_time_unit(col: str | Column, unit_seconds: int = 86400) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c / F.lit(float(unit_seconds))


def md5_unit(*parts: Column | str) -> Column:
    """Deterministic uniform value in [0, 1) from ``md5(p1|p2|...)`` (same in DuckDB)."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    h = F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(float(2 ** 32))


def blank_by_rule(df: DataFrame, id_col: str, cols: list[str], start_index: int = 0) -> DataFrame:
    """Null cell j of a row when ``(id * 7 + j * 3) % 11 = 0`` (fixture null injection)."""
    out = df
    for j, c in enumerate(cols, start=start_index):
        hit = (F.col(id_col) * 7 + F.lit(j * 3)) % 11 == 0
        out = out.withColumn(c, F.when(hit, F.lit(None)).otherwise(F.col(c)))
    return out


def select_by_regex(df: DataFrame, patterns: list[str] | str, keep: list[str] | None = None) -> DataFrame:
    """Keep columns whose name matches a pattern at its start (``re.match``)."""
    pats = [patterns] if isinstance(patterns, str) else list(patterns)
    rx = re.compile("|".join(f"(?:{p})" for p in pats))
    chosen = [c for c in df.columns if rx.match(c)]
    extra = [c for c in (keep or []) if c not in chosen]
    return df.select(*extra, *chosen)


def affix_columns(df: DataFrame, prefix: str = "", suffix: str = "",
                  exclude: list[str] | None = None) -> DataFrame:
    skip = set(exclude or [])
    return df.select(*[F.col(c).alias(c if c in skip else f"{prefix}{c}{suffix}") for c in df.columns])


def constant_tag(df: DataFrame, name: str, value) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def drop_columns_lenient(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop named columns; names that do not exist are ignored."""
    return df.drop(*names)
