import hashlib
import random

from ledgerlens.llm import decontaminate
from tests.llm.util import CLASHING, ODD_TEXTS, alnum_words, docs


def brute(rows, items, n=10):
    windows = {}
    for item, text in items:
        w = alnum_words(text)
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[i:i + k]), set()).add("" if item is None else str(item))
    out = []
    for i, t in rows:
        w, hit, found = alnum_words(t), set(), set()
        for size in {len(x) for x in windows}:
            for p in range(len(w) - size + 1):
                items_ = windows.get(tuple(w[p:p + size]))
                if items_:
                    hit |= set(range(p, p + size))
                    found |= items_
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    return sorted(out, key=repr)


def case():
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(40)] + ["é", "Été"]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randint(4, 40)))) for k in range(12)]
    items += [(3, "three three three"), (None, "null item here"), (20, None), (21, ""), (22, "!!"), (23, "lonely")]
    rows = list(enumerate(ODD_TEXTS))
    for _ in range(150):
        text = " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60)))
        if rng.random() < 0.5:
            w = (rng.choice(items[:14])[1] or "").split()
            a = rng.randint(0, max(0, len(w) - 10))
            text = f"{text} {'; '.join(w[a:a + rng.randint(8, 14)]).upper()} {text[:20]}"
        rows.append((len(rows), text))
    return rows + [(None, "a lonely one"), (4, rows[30][1]), (30, rows[30][1]), (30, rows[30][1])], items


def collected(df):
    return sorted([(r.doc_id, r.n_words, r.n_hit, r.n_items,
                    decontaminate.items_sha256(r.item_ids)) for r in df.collect()], key=repr)


def test_hits_equal_brute_force(spark):
    rows, items = case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = docs(spark, rows, CLASHING)
    assert collected(decontaminate.find_hits(df, bench)) == brute(rows, items)
    # A benchmark above the size bound goes block by block.
    assert collected(decontaminate.find_hits(df, bench, max_broadcast=300)) == brute(rows, items)
    assert collected(decontaminate.find_hits(df, bench, n=3)) == brute(rows, items, 3)


def test_removal(spark):
    rows, items = case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = docs(spark, rows, CLASHING)
    dirty = {r[0] for r in brute(rows, items) if r[2]}
    for limit in (1 << 20, 300):
        kept = decontaminate.remove_documents(df, bench, max_broadcast=limit)
        assert kept.schema.names == df.schema.names
        assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - dirty
        cut = [(r.doc_id, r.text) for r in decontaminate.remove_spans(df, bench, max_broadcast=limit).collect()]
        left = {r[0]: r[2] for r in brute(cut, items)}
        given = {(i, t) for i, t in rows}
        assert all((i, t) in given for i, t in cut if i not in dirty)
        assert sum(left.values()) < sum(r[2] for r in brute(rows, items)) / 10  # a cut may join a new window


def test_empty_tables(spark):
    rows, items = case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.find_hits(docs(spark, []).limit(0), bench).count() == 0
    none = decontaminate.find_hits(docs(spark, rows), bench.limit(0))
    assert {(r.n_hit, r.n_items) for r in none.collect()} == {(0, 0)}
    assert decontaminate.remove_documents(docs(spark, rows), bench.limit(0)).count() == len(rows)


def test_index_is_small_and_blocks_are_bounded_by_it(spark):
    rng = random.Random(3)
    items = [(str(k), " ".join(f"{rng.getrandbits(40):x}" for _ in range(2000))) for k in range(20)]
    index = decontaminate.WindowIndex(items, 10)
    arrays = [index.starts] + [a for w in index.windows.values() for a in (w.hashes, w.places, w.items, w.table)]
    words = sum(len(t.split()) for _, t in items)
    assert sum(a.nbytes for a in arrays) <= decontaminate.WORD_BYTES * words
    assert len(index.text) <= sum(len(t) + 1 for _, t in items)
    bench = spark.createDataFrame(items, "item_id string, text string")
    assert decontaminate._dealt(bench, 1 << 30, 300_000)[1] == -(-(words * 32 + sum(len(t) for _, t in items)) // 300_000)
    rows = [(1, items[3][1][100:900]), (2, "nothing"), (3, items[17][1])]
    df = docs(spark, rows)
    assert collected(decontaminate.find_hits(df, bench, max_bytes=600_000)) == brute(rows, items)
