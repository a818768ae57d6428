"""Column-level helpers built only from ``pyspark.sql.functions`` (JVM side, codegen-friendly)."""

from ledgerlens.functions.scalar import (  # noqa: F401
    node_id, edge_target, recode_sentinel, scale_time_unit, md5_unit, select_by_regex,
    affix_columns, constant_tag, drop_columns_lenient, blank_by_rule,
)
