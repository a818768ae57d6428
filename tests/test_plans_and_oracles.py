"""Plan shape checks and a sample of registered queries against their DuckDB oracles."""

import duckdb
import pytest

from tests.conftest import SF0001

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_plan_has_no_cartesian_or_python(spark):
    import __spark_entry__ as ent
    plan = _plan(ent.entry(spark))
    assert "CartesianProduct" not in plan
    assert "BatchEvalPython" not in plan


@pytest.mark.parametrize("name", ["entity_signature", "one_mode_projection", "degree", "label_encode",
                                  "profile_nunique", "null_fraction", "roc_auc", "stratified_folds",
                                  "edge_training_set", "connected_components", "betweenness", "louvain",
                                  "mean_mode_stats", "initial_impute"])
def test_query_matches_oracle(spark, name):
    import __spark_entry__ as ent
    from tools.oracle_check import digest
    df = ent.queries()[name](spark, SF0001)
    rows = [tuple(r) for r in df.collect()]
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF0001}/{t}.parquet'")
    res = con.execute(ent.oracle_sql()[name])
    ocols = [c[0] for c in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows) == digest(ocols, orows)
