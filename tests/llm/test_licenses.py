import random

from ledgerlens.llm import licenses
from tests.llm.util import CLASHING, ODD_TEXTS, alnum_words, docs

NOTICES = {
    "This work is licensed under the GNU General Public License, version 3.": ("gpl", "gpl"),
    "All rights reserved.": ("reserved", "reserved"),
    "Licensed under CC BY-NC 4.0.": ("cc-by", "cc-by,cc-by-nc"),
    "Released under the MIT License.": ("", "mit"),
    "Licensed under the Apache License, Version 2.0.": ("", "apache-2.0"),
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": ("", "mit"),
    "Redistribution and use in source and binary forms, with or without modification, are permitted": ("", "bsd"),
    "Licensed under the GNU Lesser General Public License version 3": ("gpl", "gpl,lgpl"),
}


def brute(text):
    w, out = alnum_words(text), []
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        out += [(i, label) for i in range(len(w)) if w[i:i + len(p)] == p]
    starts = [i for i, _ in out]
    return (len(w), len(out), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({x for _, x in out})))


def test_scan(spark):
    rng = random.Random(3)
    pieces = ["all", "rights", "reserved", "cc", "by", "general public", "license", "the", "mit", "Apache", "é", "of"]
    rows = list(enumerate(ODD_TEXTS))
    rows += [(100 + k, " ".join(rng.choice(pieces) for _ in range(rng.randint(0, 60)))) for k in range(300)]
    first = len(rows)
    words = ["lorem", "ipsum", "under", "the", "license", "version", "work"]
    for k, notice in enumerate(NOTICES):
        pad = " ".join(rng.choice(words) for _ in range(50))
        rows.append((1000 + k, f"{pad}\n{notice}\n{pad}"))
    rows += [(None, "all rights reserved"), (101, rows[50][1]), (101, rows[50][1])]
    got = licenses.scan(docs(spark, rows, CLASHING)).collect()
    assert sorted([tuple(r)[:6] for r in got], key=repr) == sorted([(i, *brute(t)) for i, t in rows], key=repr)
    by_id = {r.doc_id: r for r in got}
    for k, (notice, (base, labels)) in enumerate(NOTICES.items()):
        r = by_id[1000 + k]
        assert (r.base_labels, r.labels) == (base, labels), notice
        assert 0.5 <= r.score <= 1
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) | {""}
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
    assert first


def test_mandatory_phrase_is_needed(spark):
    rows = [(1, "released under the pear license"), (2, "licensed under the apache pie version 2 0"),
            (3, "permission is hereby granted for a charge to any person obtaining a copy of this software")]
    assert {r.labels for r in licenses.scan(docs(spark, rows)).collect()} == {""}


def test_empty_table(spark):
    assert licenses.scan(docs(spark, []).limit(0)).count() == 0


def _best_of_all_offsets(index, words):
    """Labels by verifying every template at every offset."""
    found = {}
    for t, (label, template, _, _) in enumerate(index.templates):
        for offset in range(-len(template), len(words) + 1):
            s = index._verify(words, t, offset)
            if s >= index.min_score:
                found[label] = max(s, found.get(label, 0.0))
    return found


def test_no_place_is_lost_to_the_anchors():
    """Also where a template's rarest words stand elsewhere in the text, more often than in place."""
    import random

    from ledgerlens.llm import licenses
    rng = random.Random(5)
    vocabulary = sorted({w for _, text, _ in licenses.TEMPLATES for w in text.split()})
    weights = {w.encode(): rng.random() * 5 for w in vocabulary}
    index = licenses.Index(licenses.TEMPLATES, weights)
    seen = set()
    for t, (label, text, phrases) in enumerate(licenses.TEMPLATES):
        rare = sorted(set(text.split()), key=lambda w: (-weights[w.encode()], w))[:3]
        needed = {w for p in phrases for w in p.split()}
        cut = [w if w not in rare or w in needed else "x" for w in text.split()]
        for parts in (cut, [w for w in cut if w != "x" or rng.random() < 0.7], text.split()):
            noise = [rng.choice(vocabulary + rare * 9) for _ in range(60)]
            words = [w.encode() for w in noise[:30] + parts + noise[30:] + rare]
            want = _best_of_all_offsets(index, words)
            assert index.match(words) == want
            seen |= set(want)
    assert len(seen) > 10
