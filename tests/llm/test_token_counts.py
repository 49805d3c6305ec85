import pytest
import sentencepiece
from public_tokenizers import path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from casebook.llm import token_counts as C

MODEL, JSON, WORD = path("piece_bpe_32k.model"), path("byte_bpe_50k.json"), path("word_bpe_49k.json")
TEXTS = [None, "", " ", "Hello  world", "hello world", "日本語 テスト 🙂", "a" * 20000, "no " * 30000, "<|endoftext|> <s> </s>",
         "<|ENDOFTEXT|>", "▁x y", "é", "é", "\n\t\r ", "Hello  world"]
ROWS = [(k, t) for k, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, "null id"), (50, None)]


def library_count(model, text):
    if model.endswith(".model"):
        return len(sentencepiece.SentencePieceProcessor(model_file=model).encode(text or ""))
    return len(Tokenizer.from_file(model).encode(text or "", add_special_tokens=False).ids)


def listed(df):
    return sorted((-1 if r[0] is None else r[0], *tuple(r)[1:]) for r in df.collect())


def want(model, rows, limit=C.TOKEN_LIMIT):
    out = []
    for k, t in rows:
        n = library_count(model, t)
        out.append((-1 if k is None else k, len((t or "").encode()), n, n > limit))
    return sorted(out)


@pytest.mark.parametrize("model", [MODEL, JSON, WORD])
def test_equals_the_library(spark, model):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "'x' AS content", "1 AS n_tokens", "2 AS n_bytes")
    got = C.count_tokens(df, model)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert listed(got) == want(model, ROWS)
    assert C.count_tokens(df.limit(0), model).count() == 0


def test_cache_is_joined_and_grows_by_what_it_lacks(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    folder = str(tmp_path / "cache")
    version = C.Tokenizer(MODEL).version()
    cache = C.TokenCache(spark, folder)
    first = C.count_tokens(df.where("doc_id < 6"), MODEL, folder)
    assert listed(first) == want(MODEL, [r for r in ROWS if r[0] is not None and r[0] < 6])
    known = {r["content"]: r["n_tokens"] for r in cache.counts(version).collect()}
    assert len(known) == len({t or "" for k, t in ROWS if k is not None and k < 6})

    # A stored count is taken as it is: a planted one comes back, unencoded.
    planted = spark.createDataFrame([("planted",)], "text string").select(F.sha2("text", 256).alias("content"),
                                                                       F.lit(12345).cast("long").alias("n_tokens"))
    cache.append(planted, version)
    sent = []
    real = C.encode
    monkeypatch.setattr(C, "encode", lambda texts, tokenizer: (sent.extend(r["text"] for r in texts.collect()), real(texts, tokenizer))[1])
    more = ROWS + [(90, "planted")]
    got = C.count_tokens(spark.createDataFrame(more, "doc_id long, text string"), MODEL, folder, limit=5)
    assert (90, 7, 12345, True) in listed(got)
    assert [r for r in listed(got) if r[0] != 90] == want(MODEL, ROWS, 5)
    old = {t or "" for k, t in ROWS if k is not None and k < 6}
    assert sorted(sent) == sorted({t or "" for _, t in ROWS} - old)  # distinct misses only, each once

    # The same rows again: nothing is sent; another tokenizer has counts of its own.
    sent.clear()
    assert listed(C.count_tokens(df, MODEL, folder)) == want(MODEL, ROWS)
    assert sent == []
    assert listed(C.count_tokens(df, JSON, folder)) == want(JSON, ROWS)
    # Rows appended twice, as by two jobs at a time, count once.
    cache.append(cache.counts(version), version)
    assert listed(C.count_tokens(df, MODEL, folder)) == want(MODEL, ROWS)


def test_versions(tmp_path):
    a, b = C.Tokenizer(MODEL), C.Tokenizer(JSON)
    assert a.version() != b.version() and a.version() == C.Tokenizer(MODEL).version()
    with pytest.raises(ValueError):
        C.Tokenizer(str(tmp_path / "x.txt"))


def test_callers_normalising(spark):
    df = spark.createDataFrame([(1, "A  b"), (2, "a b"), (3, None)], "doc_id long, text string")
    got = C.count_tokens(df, MODEL, normalise=lambda t: F.lower(F.regexp_replace(t, r"\s+", " ")))
    assert listed(got) == [(1, 4, library_count(MODEL, "a b"), False), (2, 3, library_count(MODEL, "a b"), False), (3, 0, 0, False)]
