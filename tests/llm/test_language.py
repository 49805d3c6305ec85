import random
import zlib

import numpy as np

from casebook.llm import common, language as L


def block(texts):
    raw = [t.encode() for t in texts]
    return common.TextBlock(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), np.zeros(len(raw), bool))


def test_features_do_not_cross_texts():
    texts = ["a", "Éa ß", "", "xyz abc", "a", "..."]
    together = L.features(block(texts))
    for k, t in enumerate(texts):
        assert np.allclose(together[k], L.features(block([t]))[0])
    assert np.array_equal(together[0], together[4]) and not together[2].any()
    assert np.allclose(L.features(block(["ÉA SS"]))[0], L.features(block(["éa ss"]))[0])
    assert L.has_letters(block(["1 2", "日", "", "é", "a", "×"])).tolist() == [False, True, False, True, True, False]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = L.predict_languages(docs.withColumn("score", docs.lang)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    right = sum(r.lang_pred == r.lang for r in held) / len(held)
    print("held-out accuracy", right)
    assert right > 0.97


def test_edges(spark):
    en, de = "the and of this with from " * 3, "der und die nicht für über "
    rows = [(k, (en, de)[k % 2], ("en", "de")[k % 2]) for k in range(40)]
    rows += [(100, None, "en"), (101, "", "xx"), (102, "123 ...", None), (103, de * 20000, None), (None, en, "en"), (0, en, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS lang_pred")
    got = {(r.doc_id, r.lang_pred, r.held_out) for r in L.predict_languages(df).collect()}
    held = lambda d: zlib.crc32(str(d).encode()) % 4 == 2
    want = {(100, "und"), (101, "und"), (102, "und"), (103, "de")}
    assert {(d, p, held(d)) for d, p in want} | {(None, "en", False)} <= got
    assert {p for _, p, _ in got} == {"en", "de", "und"}
    assert {p for d, p, _ in got if d is not None and d < 40 and d % 2 == 0} == {"en"}
    assert L.predict_languages(df.limit(0)).count() == 0
    unlabelled = df.withColumn("lang", df.lang.substr(9, 1)).where("lang is null or lang = 'q'")
    assert {r.lang_pred for r in L.predict_languages(unlabelled).collect()} <= {"und"}
    kept = L.drop_unknown(df)
    assert kept.columns == df.columns and kept.count() == len(rows) - 3


def test_every_label_is_learnt(spark):
    langs = [x for group in L.FAMILIES.values() for x in group.split()][:30]
    word = lambda k: "".join(random.Random(k).choices("abcdefghijklmnopqrstuvwxyz", k=8))
    assert len({word(k) for k in range(30)}) == 30
    rows = [(100 * k + j, " ".join([word(k)] * (3 + j)), lang) for k, lang in enumerate(langs) for j in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit_model(df, sample_rows=60)
    assert sorted(x for level in model.languages for x in level.names) == sorted(langs)
    right = {r.doc_id: r.lang_pred for r in L.identify(df, model).collect()}
    assert sum(right[d] == lang for d, _, lang in rows) > 0.97 * len(rows)
    assert sorted(x for level in L.fit_model(df, sample_rows=1).languages for x in level.names) == sorted(langs)


def test_unlabelled_documents_stay(spark):
    rows = [(1, "clean text", None), (2, "日本", None), (3, "12 ...", None), (4, None, None), (5, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS letters")
    kept = L.drop_unknown(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]


def test_texts_without_letters_take_no_place_in_the_sample(spark):
    rows = [(k, "12 ... 3" if k % 9 else "bonjour le monde", "fr") for k in range(900)] + [(1000 + k, "good morning world", "en") for k in range(20)]
    model = L.fit_model(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_per_lang=5)
    assert sorted(x for level in model.languages for x in level.names) == ["en", "fr"]


def plain_winner(level, x):
    """The duels of a level one by one: most wins, then the larger margin."""
    won, margin = dict.fromkeys(level.names, 0), dict.fromkeys(level.names, 0.0)
    pairs = [(a, b) for i, a in enumerate(level.names) for b in level.names[i + 1:]]
    for (a, b), w in zip(pairs, level.weights):
        m = float(np.dot(w[:-1], x) + w[-1])
        won[a if m >= 0 else b] += 1
        margin[a] += m
        margin[b] -= m
    return max(level.names, key=lambda n: (won[n], margin[n]))


def test_predictions_against_plain_duels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.fit_model(docs)
    got = {r.doc_id: r.lang_pred for r in L.predict_languages(docs).collect()}
    assert len(got) == docs.count()
    for r in docs.collect():
        if not any(c.isalpha() for c in r.text or ""):
            assert got[r.doc_id] == L.UNKNOWN
            continue
        x = L.features(block([r.text]))[0]
        family = plain_winner(model.families, x)
        assert got[r.doc_id] == plain_winner(model.languages[model.families.names.index(family)], x)
