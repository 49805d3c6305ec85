import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from casebook.llm import common, licenses as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(k, t.label) for t in L.BASE for k in range(len(words)) if words[k:k + len(t.text.split())] == t.text.split()]
    starts = [k for k, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aZ é9-_\n日"), max_size=6))
def test_words(texts):
    raw = [t.encode() for t in texts]
    block = common.TextBlock(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), np.zeros(len(raw), bool))
    data, starts, ends, before = L._words(block)
    got = [[data[a:b].tobytes().decode() for a, b in zip(starts[lo:hi], ends[lo:hi])] for lo, hi in zip(before, before[1:])]
    assert got == [WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t in texts]


PARTS = ["CC BY-NC 4.0", "cc by", "General Public License", "general, public. license", "All Rights Reserved", "all rights", "reserved",
         "MIT License", "the", "cc", "by", "general public", "Apache License, Version 2.0", "é", "x_y", "GNU Lesser General Public License"]


def test_scan(spark):
    rng = np.random.default_rng(4)
    texts = [None, "", "no words here?", "---", "all rights reserved all rights reserved"]
    texts += [" ".join(rng.choice(PARTS, rng.integers(1, 14))) for _ in range(150)]
    texts += ["filler " * 30000 + "CC BY 4.0", texts[-1], "Cc", "by", "Permission is hereby granted, free of charge, to any person "
              "obtaining a copy of this software and associated documentation files"]
    df = spark.createDataFrame([(k, t, "l") for k, t in enumerate(texts)], "doc_id long, text string, n_words string")
    got = {r.doc_id: r for r in L.license_labels(df).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        r = got[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t), t
        assert 0 <= r.score <= 1 and set(r.base_labels.split(",")) <= {*r.labels.split(","), ""}
        assert r.labels == ",".join(sorted(set(r.labels.split(",")))) and (r.score > 0) == bool(r.labels)
        if t and re.search(r"\bmit license\b", t, re.I):
            assert "mit" in r.labels.split(",")
        if t and re.search(r"lesser general public license", t, re.I):
            assert "lgpl" in r.labels.split(",")
    assert got[len(texts) - 1].labels == "mit" and got[len(texts) - 1].score > 0.99
    assert L.license_labels(df.limit(0)).count() == 0


def brute_places(text):
    """Every (label, start) at which all key phrases of a template stand."""
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    out = set()
    for t in L.TEMPLATES:
        row = t.text.split()
        keys = []
        for key in t.keys:
            key = key.split()
            keys.append((next(k for k in range(len(row)) if row[k:k + len(key)] == key), key))
        for start in range(-len(row), len(words)):
            if all(start + at >= 0 and words[start + at:start + at + len(key)] == key for at, key in keys):
                out.add((t.label, start))
    return out


def test_every_template_against_all_starts(spark):
    rng = np.random.default_rng(8)
    pieces = PARTS + [t.text for t in L.TEMPLATES] + [k for t in L.TEMPLATES for k in t.keys]
    texts = [" ".join(rng.choice(pieces, rng.integers(1, 9))) for _ in range(120)] + [t.text for t in L.TEMPLATES] + [None, ""]
    for k in range(40):  # notices with a word lost or two words changed over
        words = L.TEMPLATES[k % len(L.TEMPLATES)].text.split()
        at = int(rng.integers(0, len(words)))
        texts.append(" ".join(words[:at] + words[at + 1:] if k % 2 else words[at:] + words[:at]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for rare in (0, 1, 2, L.RARE_WORDS):
        got = {r.doc_id: {(p.label, p.word) for p in r.places} for r in L.scan_licenses(df, rare_words=rare).collect()}
        assert got == {k: brute_places(t) for k, t in enumerate(texts)}


def test_rare_words_are_intersected_by_place():
    index = L.Index(L.TEMPLATES, 1000, {})
    t = next(k for k, x in enumerate(L.TEMPLATES) if x.label == "mit" and len(x.text.split()) > 10)
    key = L.TEMPLATES[t].keys[0].split()
    known = {w: k for k, w in enumerate(index.vocabulary)}
    scattered = [known[w] for w in key[::-1] * 5 + key + key[::-1]]
    at = {v: np.array([k for k, w in enumerate(scattered) if w == v]) for v in set(scattered)}
    assert len(index.starts(t, at, 1)) == 7 and index.starts(t, at, 12).tolist() == [5 * len(key)]
    assert not len(index.starts(t, {v: p for v, p in at.items() if v != known["granted"]}, 12))
