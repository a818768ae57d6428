"""Pre-tokens of a byte-level BPE vocabulary with word ends (a ``tokenizers`` JSON file).

The vocabulary drops white space, so no token spans a blank: a text's tokens are those of its
blank-separated chunks, in order. Chunks are cut at ASCII white space; any other white space stays
inside a chunk and is left to the library. Distinct chunks are few against all chunks, so each is cut
into pre-tokens once per cache life.

Chunks of ASCII and Latin letters are cut here by the vocabulary's own rule, if it is the one known
below; all other chunks go through the library's normaliser and pre-tokeniser.
"""

from __future__ import annotations

import json
import os
import re
from codecs import charmap_decode

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

DEFAULT_VOCABULARY = "word_bpe_49k.json"
#: Distinct chunks a worker holds; above it the cache starts anew (results do not change).
CACHE_CHUNKS = 200_000

# The rules for which chunks may be cut here.
_NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

# ASCII signs and digits, and the letters of ASCII, Latin-1 and Latin Extended-A: none of them composes
# with another, and each is lowered by itself (but for U+0130, which is left to the library).
_PLAIN = re.compile("[!-~À-ÖØ-öø-įı-ňŊ-ž]+")
_LETTER = "a-zß-öø-ž"
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^{_LETTER}0-9]+")


def _byte_letters() -> str:
    """The letter of each byte: its Latin-1 character if printable, else those from U+0100 on, in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = [b for b in range(256) if b not in printable]
    return "".join(chr(b) if b in printable else chr(256 + other.index(b)) for b in range(256))


_BYTE_LETTERS = _byte_letters()


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def load_tokenizer(path: str):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def chunks(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


class Splitter:
    """Chunks to pre-tokens (text in byte letters) and special tokens (their ids)."""

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in self.spec.get("added_tokens") or []}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self._mark = re.compile(b"|".join(re.escape(s.encode()) for s in self.special) or b"(?!)")
        self._lead = os.path.commonprefix(list(self.special)).encode()  # rarely in a chunk
        steps = (self.spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self._own = (self.spec.get("normalizer") == _NORMALIZER and len(steps) == 2
                     and steps[0].get("pattern") == {"Regex": _PATTERN} and steps[0].get("behavior") == "Removed"
                     and steps[0].get("invert") is True and steps[1].get("type") == "ByteLevel"
                     and not steps[1].get("add_prefix_space") and steps[1].get("use_regex") is False
                     and not any(s[:1].isalpha() for s in self.special))

    def pieces(self, chunk: bytes) -> list[str | int]:
        if self._own and chunk.isalpha():  # ASCII letters only
            return [chunk.lower().decode("ascii")]
        text = chunk.decode("utf-8")
        if self._lead in chunk and self._mark.search(chunk):
            parts = self._cut.split(text)
            return [x for k, p in enumerate(parts) for x in ([self.special[p]] if k % 2 else self._plain(p))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not text:
            return []
        if self._own:
            if text.isascii() and text.isprintable():
                return _PIECE.findall(text.lower())
            if _PLAIN.fullmatch(text):
                own = [text.lower()] if text.isalpha() else _PIECE.findall(text.lower())
                return [charmap_decode(p.encode("utf-8"), "strict", _BYTE_LETTERS)[0] for p in own]
        if self.tokenizer.normalizer:
            text = self.tokenizer.normalizer.normalize_str(text)
        return [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
