"""Small frames and brute-force helpers."""
import zlib

from pyspark.sql import types as T

DOC_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType())])


def docs(spark, rows, extra=()):
    """rows: (doc_id, text); extra: names of further string columns."""
    schema = T.StructType(DOC_SCHEMA.fields + [T.StructField(c, T.StringType()) for c in extra])
    data = [(i, t, None if k % 3 == 0 else "en", f"s{k % 2}", None if t is None else len(t), *["x"] * len(extra))
            for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, schema)


CLASHING = ("_id", "_digest", "_text", "_row", "_fp", "_group", "chunk", "score", "kept", "value", "_salt")


def fold(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def space_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    out, word = [], ""
    for c in low + " ":
        if c == " " or "\x09" <= c <= "\x0d":
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out


def alnum_words(text):
    import re
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


ODD_TEXTS = [None, "", " ", "\n\t", "a", "A b", "é É x", "x" * 5000, "w " * 30000, "tie tie", "tie tie",
             "\x00\x01 nul", "😀 日本 語", "The End. the end!", "a\x1cb\x85c d", "1.2.3.4 +12 (345) 678-9012"]
