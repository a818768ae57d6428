import base64
import hashlib
import random

import pytest

from ledgerlens.llm import warc

SCHEMA = "page_id long, url string, html string, score string, archive string"


def rows_of():
    rng = random.Random(1)
    bodies = ["", None, "<p>é</p>", "a\r\n\r\nb", "URL 0.0.0.0 2000 text/html 5\nxxxxx\n", "x" * 50000, "WARC/1.1\r\n\r\n"]
    rows = [(i, f"http://h/{i} ü\n", rng.choice(bodies) if i % 2 else f"own {i}", "s", "a") for i in range(200)]
    return rows + [(None, None, "own 4", None, None), (4, "http://again", "own 4", None, None)]


def brute(rows, least=0):
    first = {}
    for i, _, h, *_ in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h, *_ in rows:
        raw = (h or "").encode()
        f = first.get(h or "")
        again = len(raw) >= least and f is not None and f != i
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(),
                    "revisit" if again else "response", f if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 5])
def test_pages_come_back(spark, monkeypatch, least):
    df = spark.createDataFrame(rows_of(), SCHEMA).repartition(4)
    got = warc.pages_through_warc(df, least).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows_of(), least)


def test_archives_are_files_of_both_versions(spark, tmp_path):
    df = spark.createDataFrame(rows_of(), SCHEMA).repartition(4)
    arc = warc.write_arc(df, str(tmp_path / "arc"))
    bodies = [b"".join(warc.members(r.content)) for r in arc.collect()]
    assert {b.split(b"\n")[1][:1] for b in bodies} == {b"1", b"2"}
    out = warc.convert(arc, str(tmp_path / "warc"))
    n = warc.export_files(out, (tmp_path / "files").as_uri())
    files = sorted((tmp_path / "files").iterdir())
    assert n == len(files) == out.count()
    ids, dates, responses, referred = [], set(), set(), set()
    for f in files:
        for fields, block in warc.read_warc(f.read_bytes()):
            ids.append(fields["warc-record-id"])
            dates.add(fields["warc-date"])
            if fields["warc-type"] == "response":
                responses.add(ids[-1])
            if fields["warc-type"] == "revisit":
                referred.add(fields["warc-refers-to"])
            if "warc-block-digest" in fields:
                assert fields["warc-block-digest"] == "sha1:" + warc.base32_sha1(block)
    assert len(ids) == len(set(ids)) == len(rows_of()) + len(files)
    assert referred and referred <= responses
    assert dates == {"2000-01-01T00:00:00Z"}


def test_arc_versions_and_declared_lengths():
    for version, fields in ((1, 5), (2, 10)):
        body = b"HTTP/1.0 200 OK\r\nA: b\r\n\r\npay\n\nload"
        head = warc.arc_start(version, "f.arc", "19970101")
        data = head + warc.arc_record(version, "http://x/", "199701011200", "text/html", body) + b"\n\n"
        assert len(data[len(head):].split(b"\n")[0].split(b" ")) == fields
        for content in (data, warc.member(data), warc.member(head) + warc.member(data[len(head):])):
            r, = warc.read_arc(content)
            assert (r["url"], r["body"], r["offset"]) == ("http://x/", body, len(head))
            assert warc.split_http(r["body"]) == ({"a": "b"}, b"HTTP/1.0 200 OK\r\nA: b\r\n\r\n", b"pay\n\nload")
    assert warc.iso("199701011200") == "1997-01-01T12:00:00Z" and warc.iso("1997") == "1997-01-01T00:00:00Z"


def test_broken_arc_raises():
    head = warc.arc_start(1, "f.arc", "19970101")
    for bad in (b"http://x/ 0.0.0.0 1997 text/html 99\nshort", b"no version block 3\nabc\n",
                head + b"http://x/ 0.0.0.0 1997 text/html 200 - - 0 f 3\nabc\n", head + b"http://x/ a b c\n"):
        with pytest.raises(warc.ArcError):
            list(warc.read_arc(bad if bad.startswith((b"file", b"no")) else head + bad))


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert warc.pages_through_warc(df).count() == 0
