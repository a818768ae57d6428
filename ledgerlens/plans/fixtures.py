"""Map the driver's tables onto the input contracts of the modelled workloads.

* transactions: ``lineitem JOIN orders``; row key ``tx_id = l_orderkey * 8 + l_linenumber``;
  account key ``o_custkey`` (stands in for the card columns), device key ``l_partkey``
  (stands in for the device columns).
* supplier graph: account ``s_suppkey``, device ``s_nationkey``; its one-mode projection
  is a set of disjoint cliques (suppliers of one nation), which gives exact oracles for
  every graph metric.
* order chains (ledger): each order links to the next order of the same customer by
  ``(o_orderdate, o_orderkey)``; node class from ``o_orderstatus``.
* classifier rows: ``documents JOIN labels``; target ``toxic``.

Each ``*_sql`` constant is the DuckDB text of the same derivation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- transactions
TX_COLUMNS = ["tx_id", "o_custkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
              "l_discount", "l_tax", "l_returnflag", "l_linestatus", "o_orderstatus",
              "o_totalprice", "o_orderpriority"]


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders")
    return (li.join(o, li["l_orderkey"] == o["o_orderkey"])
              .select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("tx_id"),
                      *TX_COLUMNS[1:]))


TX_SQL = """tx AS (
  SELECT l_orderkey * 8 + l_linenumber AS tx_id, o_custkey, l_partkey, l_suppkey, l_quantity,
         l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, o_orderstatus,
         o_totalprice, o_orderpriority
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

SIG_SQL = TX_SQL + """,
sig AS (
  SELECT tx.*, 'a' || CAST(dense_rank() OVER (ORDER BY o_custkey) - 1 AS VARCHAR) AS start_node_id,
         'v' || CAST(dense_rank() OVER (ORDER BY l_partkey) - 1 AS VARCHAR) AS end_node_id
  FROM tx)"""

PROJ_SQL = SIG_SQL + """,
cells AS (SELECT start_node_id AS account, end_node_id AS device, count(*) AS n
          FROM sig GROUP BY 1, 2),
proj AS (SELECT x.account AS "start", y.account AS "end", CAST(sum(x.n * y.n) AS BIGINT) AS strength
         FROM cells x JOIN cells y ON x.device = y.device AND x.account < y.account
         GROUP BY 1, 2)"""


# ---------------------------------------------------------------- supplier cliques
def supplier_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("tx_id"), "s_suppkey", "s_nationkey", "s_acctbal")


SUPP_SIG_SQL = """sig AS (
  SELECT s_suppkey AS tx_id, s_suppkey, s_nationkey, s_acctbal,
         'a' || CAST(dense_rank() OVER (ORDER BY s_suppkey) - 1 AS VARCHAR) AS start_node_id,
         'v' || CAST(dense_rank() OVER (ORDER BY s_nationkey) - 1 AS VARCHAR) AS end_node_id
  FROM supplier)"""


# ---------------------------------------------------------------- order chains (ledger)
def ledger_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger nodes: ``txId``, ``class`` ('1', '2' or 'unknown' as text) and numeric features."""
    o = table(spark, sf_dir, "orders")
    cls = (F.when(F.col("o_orderstatus") == "F", F.lit("1"))
             .when(F.col("o_orderstatus") == "O", F.lit("2")).otherwise(F.lit("unknown")))
    return o.select(F.col("o_orderkey").alias("txId"), cls.alias("class"),
                    F.col("o_totalprice").alias("f_price"), F.col("o_custkey").alias("f_cust"))


def ledger_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order -> next order of the same customer.

    Positions come from one range-partitioned sort over ``(o_custkey, o_orderdate,
    o_orderkey)``; the successor is the row at position + 1 when it has the same
    customer. No window is partitioned by customer, so a customer holding a large share
    of all orders does not land in one task.
    """
    from ledgerlens.operators.numbering import global_positions

    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    pos = global_positions(o, ["o_custkey", "o_orderdate", "o_orderkey"], "_p")
    a = pos.select(F.col("o_orderkey").alias("txId1"), F.col("o_custkey").alias("_c1"), "_p")
    b = pos.select(F.col("o_orderkey").alias("txId2"), F.col("o_custkey").alias("_c2"),
                   (F.col("_p") - 1).alias("_p"))
    return a.join(b, "_p").where(F.col("_c1") == F.col("_c2")).select("txId1", "txId2")


LEDGER_NODES_SQL = """nodes AS (
  SELECT o_orderkey AS txId,
         CASE WHEN o_orderstatus = 'F' THEN '1' WHEN o_orderstatus = 'O' THEN '2' ELSE 'unknown' END AS class,
         o_totalprice AS f_price, o_custkey AS f_cust
  FROM orders)"""

LEDGER_EDGES_SQL = """chain AS (
  SELECT o_orderkey AS txId1,
         lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS txId2
  FROM orders),
edges AS (SELECT txId1, txId2 FROM chain WHERE txId2 IS NOT NULL)"""

CHAIN_POS_SQL = """chainpos AS (
  SELECT o_orderkey AS id, o_custkey AS cust,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i,
         count(*) OVER (PARTITION BY o_custkey) AS L,
         min(o_orderkey) OVER (PARTITION BY o_custkey) AS comp
  FROM orders)"""


# ---------------------------------------------------------------- classifier rows
def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return d.join(lab, "doc_id")


DOCS_SQL = """docs AS (
  SELECT d.doc_id, d.n_chars, d.lang, d.source, l.toxic AS label
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


# ---------------------------------------------------------------- wide card-like table
# Columns blanked by the fixture null rule, in rule order j = 0, 1, ...
WIDE_NULL_COLUMNS = ["l_quantity", "l_discount", "o_orderpriority", "p_brand", "p_size", "c_mktsegment"]
WIDE_CATEGORICAL = ["o_orderstatus", "o_orderpriority", "p_brand", "p_type", "p_size", "c_mktsegment",
                    "l_returnflag", "l_linestatus"]
WIDE_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "o_totalprice"]


def wide_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with part and customer attributes, a constant column, a 0/1 target
    (``l_returnflag = 'R'``) and nulls injected by the fixture rule."""
    from ledgerlens.functions.scalar import blank_by_rule

    tx = transactions(spark, sf_dir)
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    w = (tx.join(p, tx["l_partkey"] == p["p_partkey"]).join(c, tx["o_custkey"] == c["c_custkey"])
           .select("tx_id", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "o_totalprice",
                   "o_orderstatus", "o_orderpriority", "p_brand", "p_type", "p_size", "c_mktsegment",
                   "l_returnflag", "l_linestatus", F.lit(1).alias("const_one"),
                   (F.col("l_returnflag") == "R").cast("int").alias("is_fraud")))
    return blank_by_rule(w, "tx_id", WIDE_NULL_COLUMNS)


def _blank_sql(col: str, j: int) -> str:
    return f"CASE WHEN (tx_id * 7 + {j * 3}) % 11 = 0 THEN NULL ELSE {col} END AS {col}"


WIDE_SQL = TX_SQL + """,
wide0 AS (
  SELECT tx_id, l_quantity, l_extendedprice, l_discount, l_tax, o_totalprice, o_orderstatus,
         o_orderpriority, p_brand, p_type, p_size, c_mktsegment, l_returnflag, l_linestatus,
         1 AS const_one, CAST(l_returnflag = 'R' AS INTEGER) AS is_fraud
  FROM tx JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey),
wide AS (
  SELECT tx_id, """ + ", ".join(_blank_sql(c, j) for j, c in enumerate(WIDE_NULL_COLUMNS)) + """,
         l_extendedprice, l_tax, o_totalprice, o_orderstatus, p_type, l_returnflag, l_linestatus,
         const_one, is_fraud
  FROM wide0)"""


def md5_unit_sql(*parts: str) -> str:
    """DuckDB text of ``functions.scalar.md5_unit`` (parts are SQL expressions)."""
    cat = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(CAST(('0x' || substr(md5({cat}), 1, 8)) AS BIGINT) / 4294967296.0)"


def ampute_sql(id_col: str, col: str, seed_expr: str, share: float = 0.25) -> str:
    return (f"CASE WHEN {md5_unit_sql(id_col, repr(col), seed_expr)} < {share} "
            f"THEN NULL ELSE {col} END AS {col}")


# ---------------------------------------------------------------- supplier graphs
def supplier_signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.operators.graph.build import entity_signature
    return entity_signature(supplier_rows(spark, sf_dir), ["s_suppkey"], ["s_nationkey"])


def supplier_ledger_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("txId"), F.col("s_acctbal").alias("f_bal"))


def supplier_ledger_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of suppliers of one nation (``txId1 < txId2``): the one-mode projection of
    supplier -> nation (salted for nations holding many suppliers)."""
    from ledgerlens.operators.graph.project import one_mode_projection
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    proj = one_mode_projection(s, account="s_suppkey", device="s_nationkey")
    return proj.select(F.col("start").alias("txId1"), F.col("end").alias("txId2"))


SUPP_LEDGER_SQL = """lnodes AS (SELECT s_suppkey AS id FROM supplier),
ledges AS (SELECT a.s_suppkey AS txId1, b.s_suppkey AS txId2 FROM supplier a JOIN supplier b
           ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey),
ladj AS (SELECT txId1 AS src, txId2 AS dst FROM ledges UNION ALL SELECT txId2, txId1 FROM ledges)"""
