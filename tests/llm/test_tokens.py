import random
import zlib
from collections import defaultdict

import numpy as np

from ledgerlens.llm import packing, token_counts, tokens
from tests.llm.util import CLASHING, ODD_TEXTS, docs

HARD = ODD_TEXTS + [
    "a<|endoftext|>b <|startoftext|><|endoftext|>", "<|ENDOFTEXT|>", "aaaa" * 300, "=====---====" * 50,
    "İstanbul ǅ ΑΣ Σ ﬁ é é", "it's we'll x'll 12345 x12y", "á ́b ​ c ﻿"]


def noise(n):
    rng = random.Random(4)
    alphabet = "abcdeéÉ'slt <|> ́İ 1٣=-_\n\t\r\x0b 日"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 120))) for _ in range(n)]


def library(texts):
    tok = tokens.load_tokenizer(tokens.vocabulary_path())
    return [e.ids for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_counts_equal_the_library(spark):
    texts = HARD + noise(800)
    rows = list(enumerate(texts)) + [(None, "x y"), (3, texts[3])]
    got = token_counts.token_counts(docs(spark, rows, CLASHING)).collect()
    want = [(i, len((t or "").encode()), len(ids), len(ids) > 2048)
            for (i, t), ids in zip(rows, library([t for _, t in rows]))]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_own_cuts_equal_the_library():
    splitter = tokens.Splitter(tokens.vocabulary_path())
    assert splitter._own
    rng = random.Random(9)
    letters = [chr(c) for c in [*range(0x21, 0x7f), *range(0xa1, 0x250)]]
    words = letters + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(20000)]
    tok = splitter.tokenizer
    for w in words:
        want = [p for p, _ in tok.pre_tokenizer.pre_tokenize_str(tok.normalizer.normalize_str(w))]
        assert splitter.pieces(w.encode()) == want, repr(w)


def test_counts_of_given_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs(spark, rows)).collect()}
    assert got == {i: len(x) for (i, _), x in zip(rows, library([t for _, t in rows]))}


def test_one_place_at_a_time_where_a_product_ranks_lower():
    # "a bc" makes "abc" late, but "abc a" joins early: after the first merge it takes the next a.
    merges = [["b", "c"], ["a", "b"], ["ab", "c"], ["abc", "a"], ["a", "bc"]]
    vocab = {t: i for i, t in enumerate(["a", "b", "c", "bc", "ab", "abc", "abca"])}
    merger = token_counts.RankMerger({"model": {"vocab": vocab, "merges": merges}})
    assert not merger.together[4]
    assert merger.counts([merger.symbols("abcabc"), [], merger.symbols("a")]).tolist() == [2, 0, 1]


def check_packing(rows, got):
    ids = [np.array(x + [1], dtype="<u4") for x in library([t for _, t in rows])]
    by_doc = defaultdict(list)
    for (i, _), x in zip(rows, ids):
        by_doc[i].append(x)
    pieces, fill = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        fill[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(by_doc)
    for i, own in pieces.items():
        if len(by_doc[i]) == 1:
            x, at = by_doc[i][0], 0
            for r in sorted(own, key=lambda r: r.start):
                assert r.start == at and r.length > 0 and r.doc_tokens == len(x)
                assert r.ids_crc32 == zlib.crc32(x[at:at + r.length].tobytes())
                at += r.length
            assert at == len(x)
        else:
            assert sum(r.length for r in own) == sum(map(len, by_doc[i]))
    padding = 0
    for own in fill.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0


def test_packing_holds_every_id_once(spark):
    rows = list(enumerate(HARD + noise(300))) + [(None, "x y"), (3, "again")]
    check_packing(rows, packing.pack(docs(spark, rows, CLASHING)).collect())
    check_packing(rows, packing.pack(docs(spark, rows).repartition(3), block_tokens=5000).collect())


def test_packing_balances_costs():
    rng = random.Random(2)
    lengths = [rng.randint(1, 1200) for _ in range(800)]
    cost = defaultdict(float)
    for _, _, n, q in packing.assign(lengths):
        cost[q] += packing.LINEAR * n + packing.QUADRATIC * n * n
    full = [cost[q] for q, c in enumerate(packing.capacities(sum(lengths))) if c == 2048]
    naive = defaultdict(float)
    at = 0
    for n in lengths:  # documents one after the other
        while n:
            q, room = divmod(at, 2048)
            k = min(n, 2048 - room)
            naive[q] += packing.LINEAR * k + packing.QUADRATIC * k * k
            at, n = at + k, n - k
    assert np.std(full) < np.std(list(naive.values()))


def test_empty_table(spark):
    df = docs(spark, []).limit(0)
    assert token_counts.token_counts(df).count() == 0
    assert packing.pack(df).count() == 0
