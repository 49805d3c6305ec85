import hashlib
import os

import numpy as np
import sentencepiece
from public_tokenizers import path

import corpus_pipeline as P
from casebook.llm import simhash
from tests_llm_brute import brute_leaks, brute_simhash, brute_spans

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(os.path.join(SF, "documents.parquet")).select("doc_id", "text").collect()
    items = [tuple(r) for r in spark.read.parquet(os.path.join(SF, "benchmark.parquet")).select("item_id", "text").collect()]
    left = [(r.doc_id, r.text) for r in docs if any(c.isalpha() for c in r.text or "")]
    left = [(d, dict(left)[d]) for d, _, c in brute_simhash(left) if d == c]
    leaked = {d for d, _ in brute_leaks(left, items)}
    sp = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    want = set()
    for d, t in left:
        if d not in leaked:
            out, at = "", 0
            for kind, a, b in brute_spans(t):
                if a >= at:
                    out += t[at:a] + f"[{kind}]"
                at = max(at, b)
            ids = sp.encode(out + t[at:], add_bos=True, add_eos=True)
            want.add((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()))
    got = {(r.doc_id, r.n_tokens, r.ids_sha256) for r in P.run(spark, SF).collect()}
    assert got == want and leaked and len(left) < len(docs)


def test_stages_on_awkward_rows(spark):
    rows = [(1, None, None, 7), (2, "", "en", 0), (3, "the and of " * 40, "en", 1), (3, "the and of " * 40, "en", 1),
            (None, "the and of " * 40, None, 1), (None, "zzz yyy xxx www " * 9, "en", 2), (None, "zzz yyy xxx www " * 9, "en", 2),
            (4, "token: abcdefgh12", "de", 17)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long").selectExpr("*", "doc_id AS fp", "1 AS lang_pred")
    for name, stage in P.STAGES[:-1]:
        new = stage(spark, docs, SF)
        assert new.columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0
        docs = spark.createDataFrame(new.collect(), new.schema)
    got = sorted([(r.doc_id, r.text) for r in docs.collect()], key=str)
    assert got == sorted([(3, "the and of " * 40), (4, "[assign]"), (None, "zzz yyy xxx www " * 9)], key=str)
    assert simhash.keep_one(docs).count() == 3
