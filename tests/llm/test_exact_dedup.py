import hashlib
import random

from pyspark.sql import functions as F

from ledgerlens.llm import exact_dedup
from tests.llm.util import CLASHING, ODD_TEXTS, docs


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of():
    random.seed(3)
    rows = [(i, random.choice(ODD_TEXTS + ["copy"] * 20)) for i in range(400)]
    return rows + [(5, "copy"), (5, "copy"), (None, "copy"), (None, "only null ids"), (None, "only null ids")]


def test_groups_equal_brute_force(spark):
    rows = rows_of()
    got = exact_dedup.exact_groups(docs(spark, rows, CLASHING).repartition(7)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_equal_digests_of_different_texts_stay_apart(spark):
    rows = rows_of()

    def weak(text):
        return F.substring(F.sha2(text.cast("binary"), 256), 1, 1).cast("binary")

    got = exact_dedup.exact_groups(docs(spark, rows), digest=weak).collect()
    assert sorted([tuple(r)[:4] for r in got], key=repr) == sorted([r[:4] for r in brute(rows)], key=repr)
    kept = {(r.doc_id, r.text or "") for r in exact_dedup.drop_copies(docs(spark, rows), digest=weak).collect()}
    assert kept == {(max((i for i, u in rows if (u or "") == t and i is not None), default=None), t)
                    for t in {u or "" for _, u in rows}}


def test_drop_copies_keeps_rows_whole(spark):
    rows = rows_of()
    df = docs(spark, rows, CLASHING)
    kept = exact_dedup.drop_copies(df)
    assert kept.schema.names == df.schema.names
    got = kept.collect()
    assert len(got) == len({t or "" for _, t in rows})
    have = {tuple(r) for r in df.collect()}
    assert all(tuple(r) in have for r in got)


def test_empty_table(spark):
    df = docs(spark, []).limit(0)
    assert exact_dedup.exact_groups(df).count() == 0
    assert exact_dedup.drop_copies(df).count() == 0


def test_columns_without_an_order_come_along(spark):
    from ledgerlens.llm import exact_dedup
    df = spark.sql("""SELECT * FROM VALUES (1L, 'a', map('k', 1), array(map(1, 2))), (3L, 'a', map('k', 2), null),
                      (3L, 'a', map('k', 9), null), (2L, 'b', null, array()) AS t(doc_id, text, m, n)""")
    got = sorted((r.doc_id, r.text, r.m, r.n) for r in exact_dedup.drop_copies(df).collect())
    assert got == [(2, "b", None, []), (3, "a", {"k": 9}, None)]
