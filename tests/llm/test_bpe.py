"""Byte-level BPE against the library: whole texts, odd vocabularies, appends and edits, round trips."""
import base64
import random

import pytest
import regex

from ledgerlens.llm import bpe
from tests.llm.util import CLASHING, ODD_TEXTS, docs

tiktoken = pytest.importorskip("tiktoken")
LETTERS = "aabbcde  \n\t'’sSéß漢字0123!?-_."


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(bpe.ranks_path())


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=bpe.default_pattern(), mergeable_ranks=vocabulary.ranks, special_tokens={})


def some_texts(n, seed=3):
    rng = random.Random(seed)
    out = list(ODD_TEXTS) + ["don't  stop\n\n now", "   x", "x   ", "a" * 3000, "   x", "<|endoftext|>"]
    for _ in range(n):
        s = "".join(rng.choice(LETTERS) for _ in range(rng.choice([1, 4, 30, 200])))
        out.append(s.replace(" ", "") if rng.random() < 0.3 else s)
    return out


def test_encode_and_decode_equal_the_library(spark, library):
    texts = some_texts(300)
    rows = [(None if k == 5 else k // 2, t) for k, t in enumerate(texts)]  # repeated and null ids
    df = docs(spark, rows, CLASHING)
    got = bpe.decode(bpe.encode(df)).collect()
    want = sorted((str(i), library.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows)
    assert sorted((str(r.doc_id), r.ids, bytes(r.bytes)) for r in got) == want


def test_query_digests(spark, library, tmp_path):
    import hashlib

    from ledgerlens.llm.queries import op13_byte_bpe
    rows = list(enumerate(some_texts(40)))
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op13_byte_bpe(spark, str(tmp_path)).collect()}
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        sha = [hashlib.sha256(x).hexdigest() for x in (" ".join(map(str, ids)).encode(), (t or "").encode())]
        assert got[i] == (len(ids), *sha)


def test_every_code_point_is_cut_as_the_library_cuts_it(library):
    encoder = bpe.Encoder(bpe.ranks_path(), bpe.default_pattern())
    for block in range(0, 0x110000, 64):
        text = "".join(f"a{chr(c)}1 {chr(c)}{chr(c)} " for c in range(block, block + 64) if not 0xD800 <= c < 0xE000)
        assert encoder.encode(text).tolist() == library.encode_ordinary(text), hex(block)


@pytest.mark.parametrize("seed", range(6))
def test_vocabularies_whose_ranks_are_in_any_order(seed, tmp_path):
    """Also tokens that merging never makes and tokens ranked below their parts."""
    rng = random.Random(seed)
    single = [bytes([b]) for b in range(256)]
    longer = {bytes(rng.choice(b"abc") for _ in range(rng.choice([2, 2, 3, 3, 4, 5]))) for _ in range(40)}
    tokens = single + sorted(longer)
    rng.shuffle(tokens)
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    own = bpe.Vocabulary(str(path))
    whole = tiktoken.Encoding("t", pat_str=r"[\s\S]+", mergeable_ranks=own.ranks, special_tokens={})
    for _ in range(300):
        text = "".join(rng.choice("abc") for _ in range(rng.randint(1, 60)))
        assert own.encode_piece(text.encode()) == whole.encode_ordinary(text), text


def test_every_prefix_entry_is_the_prefix_encodings_last_token(vocabulary):
    data = "Überraschungen unhappiness".encode()
    table = []
    vocabulary.extend(table, data)
    assert table == [vocabulary.merged(data[:k])[-1] for k in range(1, len(data) + 1)]


def test_edits_and_appends_equal_a_fresh_encoding(vocabulary, library):
    rng, pattern = random.Random(7), regex.compile(bpe.default_pattern())
    for text in some_texts(250, 11):
        t = bpe.PrefixText(vocabulary, pattern, text or "")
        for _ in range(4):
            a = rng.randint(0, len(t.text))
            b = min(len(t.text), a + rng.choice([0, 0, 1, 3, 20]))
            if rng.random() < 0.2:
                a = b = len(t.text)
            t.replace(a, b, "".join(rng.choice(LETTERS) for _ in range(rng.choice([0, 1, 1, 4]))))
            fresh = bpe.PrefixText(vocabulary, pattern, t.text)
            assert (t.ids(), t.ends, t.last) == (library.encode_ordinary(t.text), fresh.ends, fresh.last)


def test_an_edit_works_near_its_place_only(vocabulary):
    pattern = regex.compile(bpe.default_pattern())
    for text in ("abcdefghij" * 3000, "some words here " * 3000):
        t = bpe.PrefixText(vocabulary, pattern, text)
        whole = t.worked
        t.replace(15000, 15002, "zz")
        assert 0 < t.worked - whole < 5 * vocabulary.longest
        t.append("more")
        assert t.worked - whole < 10 * vocabulary.longest


def test_stored_tables_and_edits(spark, library):
    texts = [None, "", "hello world", "ünïcode tëxt " * 50, "x" * 500]
    stored = bpe.tables(docs(spark, list(enumerate(texts))))
    edits = spark.createDataFrame(
        [(0, None, None, "new"), (2, 0, 5, "Bye"), (2, 6, 11, None), (3, 3, 9, "Z"), (3, 100, 100, "?"), (9, 0, 0, "no"),
         (4, 900, 1000, "!")], "doc_id long, start int, end int, new string")
    got = {r.doc_id: r for r in bpe.edit(stored, edits).collect()}
    three = texts[3][:100] + "?" + texts[3][100:]
    want = {0: "new", 1: "", 2: "Bye ", 3: three[:3] + "Z" + three[9:], 4: "x" * 500 + "!"}
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.ids == library.encode_ordinary(r.text) for r in got.values())


def test_empty_table(spark):
    assert bpe.decode(bpe.encode(docs(spark, []))).collect() == []
    assert bpe.tables(docs(spark, [])).collect() == []
