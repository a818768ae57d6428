import corpus_pipeline
from ledgerlens.llm import decontaminate, quality, simhash
from ledgerlens.llm.queries import ORACLES, QUERIES
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_simhash import brute_fingerprint, components
from tests.llm.test_tokens import check_packing
from tests.llm.util import CLASHING, docs

SF = "/root/testdata/sf0.001"


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "simhash", "decontaminate", "packing"]
    assert sorted(QUERIES) == sorted(
        ["op1_quality", "op2_simhash", "op3_lm_score", "op4_exact_dedup", "op5_token_counts", "op6_decontaminate",
         "op7_licenses", "op8_pii", "op9_warc", "op10_packing", "op11_hard_negatives", "op12_prefix_trie",
             "op13_byte_bpe", "pipeline"])
    assert set(ORACLES) <= set(QUERIES)


def test_stages_equal_brute_force(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r.doc_id: r.text for r in df.collect()}
    weights = quality.train(df, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {r.doc_id for r in quality.score(df, weights).collect() if r.score >= 0.3}
    last = {}
    for i in kept:
        last[text[i]] = max(i, last.get(text[i], i))
    kept = set(last.values())
    fp = {i: brute_fingerprint(text[i]) for i in kept}
    group = components(list(fp.values()), simhash.MAX_BITS)
    least = {}
    for i in kept:
        least[group[fp[i]]] = min(i, least.get(group[fp[i]], i))
    kept = set(least.values())
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    kept = {r[0] for r in brute_hits([(i, text[i]) for i in kept], items, decontaminate.WINDOW) if not r[2]}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == kept and kept
    check_packing([(i, text[i]) for i in sorted(kept)], got)


def test_stages_keep_the_columns(spark):
    rows = [(i, t) for i, t in enumerate([None, "", "same", "same", "plain words and more of them", "x " * 3000])]
    rows += [(None, "no id"), (3, "same")]
    df = docs(spark, rows, CLASHING)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, SF)
        assert out.schema.names == df.schema.names
        assert stage(spark, df.limit(0), SF).count() == 0
        df = spark.createDataFrame(out.collect(), df.schema)
    last = corpus_pipeline.STAGES[-1][1]
    assert {r.doc_id for r in last(spark, df, SF).collect()} == {r.doc_id for r in df.collect()}
    assert last(spark, df.limit(0), SF).count() == 0
