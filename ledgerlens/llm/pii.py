"""Personal data by anchor expansion.

One Aho-Corasick pass over the text finds anchors: at-signs, plus signs, digits, schemes and cue
words. Small deterministic parsers expand each anchor to its left and right and validate the result:

* ``email``: local part left of an at-sign, dotted domain right of it;
* ``ip``: four dotted numbers of at most 255;
* ``card``: 16 to 19 digits, single blanks or hyphens between them, passing the Luhn check;
* ``phone``: a plus sign and 8 to 15 digits with the usual punctuation;
* ``iban`` (cue word): country, check digits and account, passing the mod-97 check;
* ``account`` (cue word): 6 to 17 digits after a word for a bank account;
* ``ssn`` (cue word): ddd-dd-dddd after a word for a social security number;
* ``login``: the user part of ``scheme://user[:password]@host``.

Within a kind, spans are leftmost and do not overlap; an expansion that fails validation is dropped
and its characters are not tried again. Spans are in code points, the end exclusive. Text is read
whole, and each parser moves on from where it stopped, so a text costs its length.

Defined results: null and empty texts have no spans; a null ``doc_id`` stays null; repeated rows are
scanned separately; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame

from ledgerlens.llm.text import map_rows

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = BASE_KINDS + ("iban", "account", "ssn", "login")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_NUMBER = re.compile(r"[0-9]")
_SPACED = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_AFTER_CUE = re.compile(r"(?:\s*(?:number|no|nr|num|id|code|is)\b\.?)?[\s:#=.]{0,4}", re.I)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"[0-9](?:[ -]?[0-9]){5,16}(?![0-9])")
_SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_USER = re.compile(r"[A-Za-z0-9._%+~-]+(?::[^\s/@:]*)?@(?=[A-Za-z0-9])")

_CUES = {
    "iban": ("iban",),
    "account": ("account", "acct", "konto", "cuenta", "compte"),
    "ssn": ("ssn", "social security"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(account: str) -> bool:
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def automaton():
    """Anchors -> kind of anchor."""
    import ahocorasick
    a = ahocorasick.Automaton()
    a.add_word("@", "@")
    a.add_word("+", "+")
    a.add_word("://", "://")
    for d in "0123456789":
        a.add_word(d, "0")
    for kind, words in _CUES.items():
        for w in words:
            for form in {w, w.title(), w.capitalize(), w.upper()}:
                a.add_word(form, (kind, len(form)))
    a.make_automaton()
    return a


def find(text: str | None, anchors) -> list[tuple[str, int, int]]:
    """Spans ``(kind, start, end)``, by kind as listed in ``KINDS``, then start."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if not text:
        return []
    free = dict.fromkeys(KINDS, 0)  # where the next span of a kind may begin
    dotted = spaced = 0             # ends of the digit chains that were read
    for at, tag in anchors.iter(text):
        if tag == "0":
            if at >= dotted:
                dotted = _ips(text, at, out["ip"])
            if at >= spaced:
                spaced = _card(text, at, out["card"])
        elif tag == "@":
            domain = _DOMAIN.match(text, at + 1)
            if domain:
                start = at
                while start > free["email"] and text[start - 1] in _LOCAL:
                    start -= 1
                if start < at:
                    out["email"].append((start, domain.end()))
                    free["email"] = domain.end()
        elif tag == "+":
            m = _PHONE.match(text, at)
            if m and 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                out["phone"].append(m.span())
        elif tag == "://":
            m = _USER.match(text, at + 1)
            if m and at + 1 >= free["login"]:
                out["login"].append((m.start(), m.end() - 1))
                free["login"] = m.end()
        else:
            _cued(text, at + 1, *tag, out, free)
    return [(k, a, b) for k in KINDS for a, b in out[k]]


def _ips(text: str, at: int, found: list) -> int:
    """Fours of a chain of dotted numbers; returns the chain's end."""
    chain = _DOTTED.match(text, at)
    numbers, start = chain.group().split("."), chain.start()
    for k in range(0, len(numbers), 4):
        four = numbers[k:k + 4]
        end = start + sum(map(len, four)) + len(four) - 1
        if len(four) == 4 and all(len(n.lstrip("0")) <= 3 and int(n.lstrip("0") or "0") <= 255 for n in four):
            found.append((start, end))
        start = end + 1
    return chain.end()


def _card(text: str, at: int, found: list) -> int:
    chain = _SPACED.match(text, at)
    if not chain:
        return at + 1
    digits = chain.group().replace(" ", "").replace("-", "")
    if 16 <= len(digits) <= 19 and luhn(digits):
        found.append(chain.span())
    return chain.end()


def _cued(text: str, at: int, kind: str, length: int, out: dict, free: dict) -> None:
    if text[at:at + 1].isalpha() or text[max(0, at - length - 1):at - length].isalpha():  # part of a word
        return
    found = out[kind]
    at = _AFTER_CUE.match(text, at).end()
    m = {"iban": _IBAN, "account": _ACCOUNT, "ssn": _SSN}[kind].match(text, at)
    if m and m.start() >= free[kind] and (kind != "iban" or mod97(m.group().replace(" ", ""))):
        found.append(m.span())
        free[kind] = m.end()


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id``, one count per base kind, ``base_sha256`` and all ``spans`` as text."""
    id_type = dict(docs.dtypes)["doc_id"]

    def rows(columns, anchors):
        out = []
        for i, t in zip(*columns):
            spans = find(t, anchors)
            base = [s for s in spans if s[0] in BASE_KINDS]
            kinds = [s[0] for s in base]
            out.append((i, *[kinds.count(k) for k in BASE_KINDS],
                        hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
        return out

    return map_rows(docs, rows, f"doc_id {id_type}, n_email long, n_ip long, n_card long, n_phone long, "
                    "base_sha256 string, spans string", ["doc_id", "text"], before=automaton)


def redact(text: str | None, anchors) -> str | None:
    """The text with each span replaced by its kind in square brackets; of overlapping spans the
    leftmost, then the longest."""
    if not text:
        return text
    out, done = [], 0
    for kind, a, b in sorted(find(text, anchors), key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"[{kind}]"]
            done = b
    return "".join(out) + text[done:]
