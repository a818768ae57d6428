import hashlib
import random
import re

from ledgerlens.llm import pii
from tests.llm.util import CLASHING, ODD_TEXTS, docs

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(s):
    return [int(c) for c in s if c in "0123456789"]


def luhn(d):
    odd, even = d[-1::-2], d[-2::-2]
    return (sum(odd) + sum(sum(divmod(2 * x, 10)) for x in even)) % 10 == 0


def brute(text):
    t = text or ""
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t)
            if 16 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    out += [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= len(digits(m.group())) <= 15]
    return out


def noise(n):
    rng = random.Random(11)
    alphabet = "ab@@..-+_%0123456789 ()é😀\n"
    cards = ["4111 1111 1111 1111", "5500-0000-0000-0004", "4111111111111111", "41111111111111112"]
    out = []
    for _ in range(n):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80)))
        if rng.random() < 0.4:
            t = t[:10] + rng.choice(cards + ["10.0.255.1", "1.2.3.4.5.6.7.8", "256.1.1.1.1", "a@b.c@d.e", "a@b@c.de",
                                             "+1 (415) 555-1234", "+1 2", "+123456789012345678"]) + t[10:]
        out.append(t)
    return out


def test_base_spans_equal_the_patterns():
    anchors = pii.automaton()
    for t in ODD_TEXTS + noise(20000):
        assert [s for s in pii.find(t, anchors) if s[0] in pii.BASE_KINDS] == brute(t), repr(t)


def test_scan(spark):
    rows = list(enumerate(ODD_TEXTS + noise(300))) + [(None, "a@b.cd"), (1, "x")]
    got = pii.scan(docs(spark, rows, CLASHING)).collect()
    want = []
    for i, t in rows:
        b = brute(t)
        kinds = [s[0] for s in b]
        want.append((i, *[kinds.count(k) for k in pii.BASE_KINDS],
                     hashlib.sha256(pii.joined(b).encode()).hexdigest()))
    assert sorted([tuple(r)[:6] for r in got], key=repr) == sorted(want, key=repr)
    for r in got:
        assert len(list(filter(None, r.spans.split(",")))) >= r.n_email + r.n_ip + r.n_card + r.n_phone


def test_cued_spans():
    anchors = pii.automaton()

    def found(text):
        return [(k, text[a:b]) for k, a, b in pii.find(text, anchors)]

    assert ("iban", "GB82 WEST 1234 5698 7654 32") in found("IBAN: GB82 WEST 1234 5698 7654 32.")
    assert not any(k == "iban" for k, _ in found("IBAN: GB83 WEST 1234 5698 7654 32."))
    assert ("account", "12345678") in found("Account no. 12345678 is closed")
    assert ("ssn", "078-05-1120") in found("SSN 078-05-1120")
    assert ("login", "bob:secret") in found("ftp://bob:secret@host/x")
    assert found("no number on account of that; subaccount 12345678") == []


def test_redaction():
    anchors = pii.automaton()
    assert pii.redact("mail a@b.cd, ip 1.2.3.4!", anchors) == "mail [email], ip [ip]!"
    assert pii.redact(None, anchors) is None


def test_empty_table(spark):
    assert pii.scan(docs(spark, []).limit(0)).count() == 0
