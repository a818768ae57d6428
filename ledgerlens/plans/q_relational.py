"""Registered relational queries: sources/sinks, projections, joins, profiles, encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions.scalar import (
    affix_columns, constant_tag, drop_columns_lenient, edge_target, recode_sentinel, select_by_regex,
)
from ledgerlens.operators import profile as pf
from ledgerlens.operators.encode import (
    build_dictionary,
    apply_dictionary, build_dictionary, codes_from_category, downcast_types, label_encode,
)
from ledgerlens.operators.embed import apply_embedding, embedding_dim, join_embedding
from ledgerlens.operators.impute import ampute, initial_impute
from ledgerlens.operators.numbering import ordered_split
from ledgerlens.operators.reduce import apply_scaler, standardize, store_scaler
from ledgerlens.plans import fixtures as fx
from ledgerlens.plans.q_graph import signed_transactions
from ledgerlens.plans.registry import register
from ledgerlens.session import stage_path
from ledgerlens.sources.graph_export import export_edges, export_nodes, read_export
from ledgerlens.sources.stages import (
    export_target, scan_imputations, scan_with_catalog, schema_catalog, stage_table,
    write_imputations,
)
from ledgerlens.sources.tables import scan_headerless, scan_table, write_csv

W = fx.WIDE_SQL
ALL_WIDE = ["tx_id", "l_quantity", "l_discount", "o_orderpriority", "p_brand", "p_size", "c_mktsegment",
            "l_extendedprice", "l_tax", "o_totalprice", "o_orderstatus", "p_type", "l_returnflag",
            "l_linestatus", "const_one", "is_fraud"]


def _union(selects: list[str]) -> str:
    return "\nUNION ALL ".join(selects)


# ------------------------------------------------------------------ scans / stages / sinks
@register("scan_table", sql="SELECT * FROM customer")
def q_scan_table(spark, d):
    src = fx.table(spark, d, "customer")
    path = write_csv(src, stage_path(spark, "customer_csv"), header=True)
    return scan_table(spark, path, schema=src.schema)


@register("scan_headerless", sql="""
SELECT p_partkey AS _c0, p_name AS _c1, p_brand AS _c2, p_type AS _c3, p_size AS _c4, p_retailprice AS _c5
FROM part""")
def q_scan_headerless(spark, d):
    src = fx.table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size",
                                            "p_retailprice")
    path = write_csv(src, stage_path(spark, "part_csv"), header=False)
    return scan_headerless(spark, path, ["bigint", "string", "string", "string", "int", "double"])


@register("stage_table", sql="SELECT * FROM orders")
def q_stage_table(spark, d):
    return stage_table(fx.table(spark, d, "orders"), "orders")


AMPUTE_COLS = ["c_acctbal", "c_mktsegment", "c_nationkey"]


@register("scan_imputations", sql="SELECT c_custkey, " + ", ".join(
    fx.ampute_sql("c_custkey", c, "s") for c in AMPUTE_COLS) +
    ", CAST(s AS INTEGER) AS imputation FROM customer, range(3) t(s)")
def q_scan_imputations(spark, d):
    from functools import reduce
    base = fx.table(spark, d, "customer").select("c_custkey", *AMPUTE_COLS)
    parts = [ampute(base, "c_custkey", AMPUTE_COLS, 0.25, seed=m).withColumn("imputation", F.lit(m))
             for m in range(3)]
    path = write_imputations(reduce(lambda a, b: a.unionByName(b), parts), stage_path(spark, "imputed"))
    return scan_imputations(spark, path)


@register("ampute", sql="SELECT c_custkey, " + ", ".join(
    fx.ampute_sql("c_custkey", c, "7") for c in AMPUTE_COLS) + " FROM customer")
def q_ampute(spark, d):
    base = fx.table(spark, d, "customer").select("c_custkey", *AMPUTE_COLS)
    return ampute(base, "c_custkey", AMPUTE_COLS, 0.25, seed=7)


@register("export_target", sql="WITH " + fx.DOCS_SQL + " SELECT doc_id, label FROM docs")
def q_export_target(spark, d):
    return export_target(fx.labelled_documents(spark, d), "doc_id", "label")


@register("schema_catalog", sql="""
SELECT column_name AS "column",
       CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string'
                      WHEN 'INTEGER' THEN 'int' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(data_type) END
       AS dtype
FROM information_schema.columns WHERE table_name = 'orders'""")
def q_schema_catalog(spark, d):
    return schema_catalog(fx.table(spark, d, "orders"))


@register("scan_catalog", sql="SELECT * FROM orders")
def q_scan_catalog(spark, d):
    """Orders as CSV, read through their stored catalog."""
    src = fx.table(spark, d, "orders")
    path = write_csv(src, stage_path(spark, "orders_csv"))
    return scan_with_catalog(spark, path, schema_catalog(src, path=stage_path(spark, "orders_catalog")))


@register("scan_catalog_codes", sql="""
SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS p_brand,
       CAST(dense_rank() OVER (ORDER BY p_size) - 1 AS INTEGER) AS p_size FROM part""")
def q_scan_catalog_codes(spark, d):
    """Parts as CSV, brand and size read as the codes of the stored dictionaries."""
    src = fx.table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    path, at = write_csv(src, stage_path(spark, "part_csv")), stage_path(spark, "part_catalog")
    catalog = schema_catalog(src, dictionary=build_dictionary(src, ["p_brand", "p_size"]), path=at)
    return scan_with_catalog(spark, path, catalog, spark.read.parquet(f"{at}-labels"))


@register("export_nodes", sql="WITH " + fx.SIG_SQL + """
SELECT DISTINCT start_node_id AS "start_node_id:ID", 'account' AS "label:LABEL" FROM sig""")
def q_export_nodes(spark, d):
    data, head = export_nodes(signed_transactions(spark, d), "start_node_id", "account")
    return read_export(spark, data, head)


@register("export_edges", sql="WITH " + fx.SIG_SQL + """
SELECT tx_id AS "tx_id:int", l_quantity AS "l_quantity:float", l_returnflag AS "l_returnflag:string",
       start_node_id AS "start_node_id:START_ID", end_node_id AS "end_node_id:END_ID",
       'transaction' AS "type:TYPE"
FROM sig""")
def q_export_edges(spark, d):
    sig = signed_transactions(spark, d).select("tx_id", "l_quantity", "l_returnflag", "start_node_id",
                                               "end_node_id")
    data, head = export_edges(sig, "start_node_id", "end_node_id")
    return read_export(spark, data, head)


# ------------------------------------------------------------------ projections / scalar
@register("recode_sentinel", sql="WITH " + fx.LEDGER_NODES_SQL + """
SELECT txId, CAST(CASE WHEN class = 'unknown' THEN '3' ELSE class END AS BIGINT) AS class FROM nodes""")
def q_recode_sentinel(spark, d):
    return fx.ledger_nodes(spark, d).select("txId", recode_sentinel("class").alias("class"))


@register("constant_tag", sql="WITH " + fx.LEDGER_NODES_SQL + " SELECT txId, 'node' AS label FROM nodes")
def q_constant_tag(spark, d):
    return constant_tag(fx.ledger_nodes(spark, d).select("txId"), "label", "node")


@register("scale_time_unit", sql="""
SELECT event_id, round((epoch_us(ts) - 1704067200000000) / 1e6 / 86400, 6) AS t_days FROM events""")
def q_scale_time_unit(spark, d):
    ev = fx.table(spark, d, "events")
    # timestamp_ntz arithmetic: no session time zone involved
    origin = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    secs = F.timestamp_diff("MICROSECOND", origin, F.col("ts")) / F.lit(1e6)
    from ledgerlens.functions.scalar import scale_time_unit
    return ev.select("event_id", F.round(scale_time_unit(secs), 6).alias("t_days"))


@register("downcast_types", sql="""
SELECT TRY_CAST(o_orderkey AS INTEGER) AS o_orderkey, TRY_CAST(o_custkey AS INTEGER) AS o_custkey,
       o_orderstatus, CAST(o_totalprice AS FLOAT) AS o_totalprice, o_orderdate, o_orderpriority
FROM orders""")
def q_downcast_types(spark, d):
    return downcast_types(fx.table(spark, d, "orders"))


@register("select_by_regex", sql="WITH " + fx.TX_SQL + """
SELECT tx_id, l_extendedprice, l_tax, o_totalprice FROM tx""")
def q_select_by_regex(spark, d):
    return select_by_regex(fx.transactions(spark, d), ["l_ext", "l_tax", "o_total"], keep=["tx_id"])


@register("affix_columns", sql="""
SELECT c_custkey AS c_custkey_from, c_name AS c_name_from, c_nationkey AS c_nationkey_from,
       c_acctbal AS c_acctbal_from, c_mktsegment AS c_mktsegment_from FROM customer""")
def q_affix_columns(spark, d):
    return affix_columns(fx.table(spark, d, "customer"), suffix="_from")


@register("drop_signatures", sql="WITH " + fx.SIG_SQL + " SELECT * EXCLUDE (start_node_id, end_node_id) FROM sig")
def q_drop_signatures(spark, d):
    from ledgerlens.operators.graph.metrics import drop_signatures
    return drop_signatures(signed_transactions(spark, d), ["start_node_id", "end_node_id"])


@register("drop_columns_lenient", sql="WITH " + W + " SELECT * EXCLUDE (o_totalprice) FROM wide")
def q_drop_columns_lenient(spark, d):
    return drop_columns_lenient(fx.wide_transactions(spark, d), ["o_totalprice", "no_such_column"])


@register("drop_constant_columns", sql="WITH " + W + " SELECT * EXCLUDE (const_one) FROM wide")
def q_drop_constant_columns(spark, d):
    return pf.drop_constant_columns(fx.wide_transactions(spark, d))[0]


# ------------------------------------------------------------------ joins
@register("join_transaction_identity", sql="""
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def q_join_transaction_identity(spark, d):
    return fx.table(spark, d, "documents").join(fx.table(spark, d, "labels"), "doc_id", "inner")


@register("join_classes_features", sql="""
SELECT l.doc_id AS txId, l.toxic AS class, d.doc_id AS _c0, d.n_chars AS _c1
FROM labels l JOIN documents d ON l.doc_id = d.doc_id""")
def q_join_classes_features(spark, d):
    classes = fx.table(spark, d, "labels").select(F.col("doc_id").alias("txId"), F.col("toxic").alias("class"))
    feats = fx.table(spark, d, "documents").select(F.col("doc_id").alias("_c0"), F.col("n_chars").alias("_c1"))
    return classes.join(feats, classes["txId"] == feats["_c0"], "inner")


def ledger_endpoints(spark, d):
    nodes = fx.ledger_nodes(spark, d).withColumn("class", recode_sentinel("class"))
    edges = fx.ledger_edges(spark, d)
    nf = affix_columns(nodes, suffix="_from")
    nt = affix_columns(nodes, suffix="_to")
    return (edges.join(nf, edges["txId1"] == nf["txId_from"], "inner")
                 .join(nt, F.col("txId2") == nt["txId_to"], "inner"))


ENDPOINTS_SQL = "WITH " + fx.LEDGER_NODES_SQL + ", " + fx.LEDGER_EDGES_SQL + """,
rn AS (SELECT txId, CAST(CASE WHEN class = 'unknown' THEN '3' ELSE class END AS BIGINT) AS class,
              f_price, f_cust FROM nodes),
ends AS (
  SELECT e.txId1, e.txId2, a.txId AS txId_from, a.class AS class_from, a.f_price AS f_price_from,
         a.f_cust AS f_cust_from, b.txId AS txId_to, b.class AS class_to, b.f_price AS f_price_to,
         b.f_cust AS f_cust_to
  FROM edges e JOIN rn a ON e.txId1 = a.txId JOIN rn b ON e.txId2 = b.txId)"""


@register("join_edge_endpoints", sql=ENDPOINTS_SQL + " SELECT * FROM ends")
def q_join_edge_endpoints(spark, d):
    return ledger_endpoints(spark, d)


@register("edge_target", sql=ENDPOINTS_SQL + """
SELECT txId1, txId2, CASE WHEN class_from = 1 OR class_to = 1 THEN 1 ELSE 0 END AS target FROM ends""")
def q_edge_target(spark, d):
    return ledger_endpoints(spark, d).select("txId1", "txId2", edge_target().alias("target"))


def edge_training_set(spark, d):
    e = ledger_endpoints(spark, d)
    return e.withColumn("target", edge_target()).drop("txId1", "txId2", "class_from", "class_to")


@register("edge_training_set", sql=ENDPOINTS_SQL + """
SELECT txId_from, f_price_from, f_cust_from, txId_to, f_price_to, f_cust_to,
       CASE WHEN class_from = 1 OR class_to = 1 THEN 1 ELSE 0 END AS target FROM ends""")
def q_edge_training_set(spark, d):
    return edge_training_set(spark, d)


# ------------------------------------------------------------------ profiles
@register("profile_nunique", sql="WITH " + W + " " + _union(
    [f"SELECT '{c}' AS \"column\", CAST(count(DISTINCT {c}) AS BIGINT) AS nunique FROM wide" for c in ALL_WIDE]))
def q_profile_nunique(spark, d):
    return pf.profile_nunique(fx.wide_transactions(spark, d))


@register("profile_is_constant", sql="WITH " + W + " " + _union(
    [f"SELECT '{c}' AS \"column\", min({c}) IS NOT DISTINCT FROM max({c}) AS is_constant FROM wide"
     for c in ALL_WIDE]))
def q_profile_is_constant(spark, d):
    return pf.profile_is_constant(fx.wide_transactions(spark, d))


@register("profile_is_boolean", sql="WITH " + W + " " + _union(
    [f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) = 2 AS is_boolean FROM wide" for c in ALL_WIDE]))
def q_profile_is_boolean(spark, d):
    return pf.profile_is_boolean(fx.wide_transactions(spark, d))


NF_SQL = "WITH " + W + ", nf AS (" + _union(
    [f"SELECT '{c}' AS \"column\", avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS null_fraction FROM wide"
     for c in ALL_WIDE]) + ")"


@register("null_fraction", sql=NF_SQL + """
SELECT "column", round(null_fraction, 6) AS null_fraction FROM nf
UNION ALL SELECT '__mean__', round(avg(null_fraction), 6) FROM nf""")
def q_null_fraction(spark, d):
    return pf.null_fraction(fx.wide_transactions(spark, d)).select(
        "column", F.round("null_fraction", 6).alias("null_fraction"))


@register("sort_by_stat", sql=NF_SQL + """
SELECT "column", round(null_fraction, 6) AS null_fraction,
       row_number() OVER (ORDER BY null_fraction DESC, "column") - 1 AS position FROM nf""")
def q_sort_by_stat(spark, d):
    nf = pf.null_fraction(fx.wide_transactions(spark, d), mean_label=None)
    return pf.sort_by_stat(nf, "null_fraction").select(
        "column", F.round("null_fraction", 6).alias("null_fraction"), "position")


_NULLY = sorted(fx.WIDE_NULL_COLUMNS)


@register("nullity_correlation", sql="WITH " + W + " " + _union(
    [f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr(CAST({a} IS NULL AS DOUBLE), "
     f"CAST({b} IS NULL AS DOUBLE)), 6) AS corr FROM wide"
     for i, a in enumerate(_NULLY) for b in _NULLY[i + 1:]]))
def q_nullity_correlation(spark, d):
    out = pf.nullity_correlation(fx.wide_transactions(spark, d))
    return out.select("col_a", "col_b", F.round("corr", 6).alias("corr"))


@register("level_counts", sql="WITH " + W + ", lc AS (" + _union(
    [f"SELECT '{c}' AS \"column\", CAST(count(DISTINCT {c}) AS BIGINT) AS levels FROM wide"
     for c in fx.WIDE_CATEGORICAL]) + """)
SELECT * FROM lc UNION ALL SELECT '__total__', CAST(sum(levels) AS BIGINT) FROM lc""")
def q_level_counts(spark, d):
    return pf.level_counts(fx.wide_transactions(spark, d), fx.WIDE_CATEGORICAL)


def _mode_sql(c: str) -> str:
    return (f"(SELECT CAST({c} AS VARCHAR) FROM wide WHERE {c} IS NOT NULL GROUP BY {c} "
            f"ORDER BY count(*) DESC, {c} LIMIT 1)")


@register("mean_mode_stats", sql="WITH " + W + " " + _union(
    [f"SELECT '{c}' AS \"column\", 'mean' AS kind, round(avg({c}), 6) AS mean, CAST(NULL AS VARCHAR) AS mode "
     f"FROM wide" for c in fx.WIDE_NUMERIC] +
    [f"SELECT '{c}', 'mode', CAST(NULL AS DOUBLE), {_mode_sql(c)}" for c in fx.WIDE_CATEGORICAL]))
def q_mean_mode_stats(spark, d):
    out = pf.mean_mode_stats(fx.wide_transactions(spark, d), fx.WIDE_NUMERIC, fx.WIDE_CATEGORICAL)
    return out.withColumn("mean", F.round("mean", 6))


@register("moments", sql="WITH " + W + " " + _union(
    [f"SELECT '{c}' AS \"column\", round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std FROM wide"
     for c in fx.WIDE_NUMERIC]))
def q_moments(spark, d):
    out = pf.moments(fx.wide_transactions(spark, d), fx.WIDE_NUMERIC)
    return out.select("column", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


WIDE_DELETED = ["const_one", "tx_id"]


@register("classify_columns", sql="WITH " + W + ", nu AS (" + _union(
    [f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS nunique FROM wide" for c in ALL_WIDE]) + """)
SELECT "column", CASE WHEN "column" = 'is_fraud' THEN 'target' WHEN nunique = 2 THEN 'boolean'
                      WHEN "column" IN (""" + ", ".join(f"'{c}'" for c in fx.WIDE_CATEGORICAL) + """)
                      THEN 'categorical' ELSE 'numeric' END AS role
FROM nu WHERE "column" NOT IN ('const_one', 'tx_id')""")
def q_classify_columns(spark, d):
    wide = fx.wide_transactions(spark, d)
    return pf.classify_columns(pf.profile_is_boolean(wide), fx.WIDE_CATEGORICAL, WIDE_DELETED, "is_fraud")


ROLE_CATS = [c for c in fx.WIDE_CATEGORICAL if c not in WIDE_DELETED]


@register("schema_catalog_roles", sql="WITH " + W + ", nu AS (" + _union(
    [f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS nunique FROM wide" for c in ALL_WIDE]) + """)
SELECT "column", CASE WHEN "column" = 'is_fraud' THEN 'target' WHEN nunique = 2 THEN 'boolean'
                      WHEN "column" IN (""" + ", ".join(f"'{c}'" for c in fx.WIDE_CATEGORICAL) + """)
                      THEN 'categorical' WHEN "column" NOT IN ('const_one', 'tx_id') THEN 'numeric' END AS role,
       CASE WHEN "column" IN (""" + ", ".join(f"'{c}'" for c in ROLE_CATS) + """) THEN nunique END AS levels
FROM nu""")
def q_schema_catalog_roles(spark, d):
    wide = fx.wide_transactions(spark, d)
    roles = pf.classify_columns(pf.profile_is_boolean(wide), fx.WIDE_CATEGORICAL, WIDE_DELETED, "is_fraud")
    return schema_catalog(wide, roles, build_dictionary(wide, ROLE_CATS)).select("column", "role", "levels")


# ------------------------------------------------------------------ encoding / imputation / scaling
PART_CATS = ["p_brand", "p_type", "p_size"]


@register("label_encode", sql="""
SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS p_brand,
       dense_rank() OVER (ORDER BY p_type) - 1 AS p_type, dense_rank() OVER (ORDER BY p_size) - 1 AS p_size
FROM part""")
def q_label_encode(spark, d):
    part = fx.table(spark, d, "part").select("p_partkey", *PART_CATS)
    return label_encode(part, PART_CATS)[0]


@register("codes_from_category", sql="WITH " + fx.TX_SQL + """,
dict AS (SELECT o_orderpriority AS v, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS code
         FROM (SELECT DISTINCT o_orderpriority FROM orders))
SELECT tx_id, o_orderpriority, CAST(code AS INTEGER) AS o_orderpriority_code
FROM tx LEFT JOIN dict ON o_orderpriority = v""")
def q_codes_from_category(spark, d):
    dictionary = build_dictionary(fx.table(spark, d, "orders"), ["o_orderpriority"])
    tx = fx.transactions(spark, d).select("tx_id", "o_orderpriority")
    return codes_from_category(tx, dictionary, "o_orderpriority", "o_orderpriority_code")


IMP_NUM = ["l_quantity", "l_discount"]
IMP_CAT = ["o_orderpriority", "p_brand", "p_size", "c_mktsegment"]


@register("initial_impute", sql="WITH " + W + " SELECT tx_id, " + ", ".join(
    [f"round(coalesce({c}, (SELECT avg({c}) FROM wide)), 6) AS {c}" for c in IMP_NUM] +
    [f"coalesce({c}, (SELECT {c} FROM wide WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} "
     f"LIMIT 1)) AS {c}" for c in IMP_CAT]) + " FROM wide")
def q_initial_impute(spark, d):
    wide = fx.wide_transactions(spark, d).select("tx_id", *IMP_NUM, *IMP_CAT)
    out = initial_impute(wide, IMP_NUM, IMP_CAT)
    return out.select("tx_id", *[F.round(c, 6).alias(c) for c in IMP_NUM], *IMP_CAT)


STANDARDIZE_SQL ="WITH " + W + " SELECT tx_id, " + ", ".join(
    f"round(({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1), 6) AS {c}"
    for c in fx.WIDE_NUMERIC) + " FROM wide"


@register("scaler_store", sql=STANDARDIZE_SQL)
def q_scaler_store(spark, d):
    """Fitted, written, read back and applied."""
    wide = fx.wide_transactions(spark, d).select("tx_id", *fx.WIDE_NUMERIC)
    out = apply_scaler(wide, store_scaler(spark, standardize(wide, fx.WIDE_NUMERIC)[1]))
    return out.select("tx_id", *[F.round(c, 6).alias(c) for c in fx.WIDE_NUMERIC])


@register("standardize", sql=STANDARDIZE_SQL)
def q_standardize(spark, d):
    wide = fx.wide_transactions(spark, d).select("tx_id", *fx.WIDE_NUMERIC)
    out, _ = standardize(wide, fx.WIDE_NUMERIC)
    return out.select("tx_id", *[F.round(c, 6).alias(c) for c in fx.WIDE_NUMERIC])


@register("embedding_dim", sql=_union(
    [f"SELECT '{c}' AS \"column\", CAST(count(DISTINCT {c}) AS BIGINT) AS nunique, "
     f"CAST(greatest(least((count(DISTINCT {c}) + 1) // 2, 16), 2) AS INTEGER) AS embedding_dim FROM part"
     for c in PART_CATS]))
def q_embedding_dim(spark, d):
    return embedding_dim(pf.profile_nunique(fx.table(spark, d, "part"), PART_CATS))


def _fixture_embeddings(spark, d, cols):
    """Code -> vector table taken from the ``embeddings`` table (vec_id as the code)."""
    from functools import reduce
    emb = fx.table(spark, d, "embeddings")
    parts = [emb.select(F.lit(c).alias("column"), F.col("vec_id").cast("int").alias("code"),
                        F.col("embedding").alias("vec")) for c in cols]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _emb_sql(cols, dim=64):
    codes = ", ".join(f"dense_rank() OVER (ORDER BY {c}) - 1 AS {c}" for c in cols)
    sel = ", ".join(f"CAST(e{k}.embedding[{i + 1}] AS DOUBLE) AS {c}_{i}"
                    for k, c in enumerate(cols) for i in range(dim))
    joins = " ".join(f"JOIN embeddings e{k} ON e{k}.vec_id = p.{c}" for k, c in enumerate(cols))
    return f"WITH p AS (SELECT p_partkey, {codes} FROM part) SELECT p_partkey, {sel} FROM p {joins}"


@register("join_embedding", sql=_emb_sql(["p_brand"]))
def q_join_embedding(spark, d):
    part = fx.table(spark, d, "part").select("p_partkey", "p_brand")
    coded, _ = label_encode(part, ["p_brand"])
    return join_embedding(coded, _fixture_embeddings(spark, d, ["p_brand"]), "p_brand")


@register("apply_embedding", sql=_emb_sql(["p_brand", "p_type"]))
def q_apply_embedding(spark, d):
    part = fx.table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    coded, _ = label_encode(part, ["p_brand", "p_type"])
    return apply_embedding(coded, _fixture_embeddings(spark, d, ["p_brand", "p_type"]), ["p_brand", "p_type"])


# ------------------------------------------------------------------ split / concat / assemble
SPLIT_SQL = "WITH " + fx.DOCS_SQL + """,
pos AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS p, count(*) OVER () AS n FROM docs)
SELECT doc_id, n_chars, CASE WHEN p >= n - ceil(0.33 * n) THEN 'validation' ELSE 'train' END AS split FROM pos"""


@register("ordered_split", sql=SPLIT_SQL)
def q_ordered_split(spark, d):
    docs = fx.labelled_documents(spark, d).select("doc_id", "n_chars")
    return ordered_split(docs, ["doc_id"])


@register("concat_rows", sql=SPLIT_SQL)
def q_concat_rows(spark, d):
    docs = fx.labelled_documents(spark, d).select("doc_id", "n_chars")
    s = ordered_split(docs, ["doc_id"])
    train = s.where(F.col("split") == "train")
    val = s.where(F.col("split") == "validation")
    return train.unionByName(val)


@register("assemble_features", sql="WITH " + fx.DOCS_SQL + """,
lc AS (SELECT doc_id, dense_rank() OVER (ORDER BY lang) - 1 AS lang FROM documents)
SELECT docs.doc_id, docs.n_chars, lc.lang, docs.label,
       [CAST(docs.n_chars AS DOUBLE), CAST(lc.lang AS DOUBLE)] AS features
FROM docs JOIN lc ON docs.doc_id = lc.doc_id""")
def q_assemble_features(spark, d):
    from ledgerlens.operators.model.train import assemble_features
    docs = fx.labelled_documents(spark, d)
    block_a = docs.select("doc_id", "n_chars", "label")
    coded, _ = label_encode(fx.table(spark, d, "documents").select("doc_id", "lang"), ["lang"])
    out = assemble_features([block_a, coded], "doc_id", ["n_chars", "lang"])
    from pyspark.ml.functions import vector_to_array
    return out.select("doc_id", "n_chars", "lang", "label", vector_to_array("features").alias("features"))
