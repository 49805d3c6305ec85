import hashlib
import struct

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import path

from casebook.llm import sentencepiece_codec as S

MODEL = path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
CODEC = S.Codec(S.model_bytes(MODEL))

CASES = ["", " ", "   ", "a", " a", "a ", "a  b   c", "\n\n\t x", "Hello world, it's 3.14!", "日本語 テスト", "🙂🙂 x",
         "▁x▁▁y", "<s></s><unk><0x0A>", "\x00\x01", "é" * 50, "a" * 5000, "no" + " " * 37 + "yes", " 　x",
         "é", "ﬁ", "Ǆ"]


@pytest.mark.parametrize("text", CASES)
def test_equals_the_library(text):
    ids, spans, decoded = CODEC.encode(text)
    assert ids.tolist() == LIBRARY.encode(text, add_bos=True, add_eos=True)
    assert decoded == LIBRARY.decode(ids.tolist()) == CODEC.decode(ids.tolist())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8")) | st.text(alphabet=" ab▁é日🙂\n"))
def test_equals_the_library_on_any_text(text):
    ids, spans, decoded = CODEC.encode(text)
    assert ids.tolist() == LIBRARY.encode(text, add_bos=True, add_eos=True)
    assert decoded == LIBRARY.decode(ids.tolist())
    raw = text.encode()
    assert b"".join(raw[a:b] for a, b in spans.tolist()) == raw  # the spans tile the text


def charmap(rules: dict[bytes, bytes]) -> bytes:
    """A compiled map with one double-array block of 256 units a node."""
    nodes = {b""}
    for key in rules:
        nodes |= {key[:k] for k in range(1, len(key) + 1)}
    base = {n: 256 * (k + 1) for k, n in enumerate(sorted(nodes))}
    units, strings = [0] * (256 * (len(nodes) + 1)), b""
    place = {b"": 0}
    for n in sorted(nodes, key=len):
        at = place[n]
        label = n[-1] if n else 0
        units[at] = ((at ^ base[n]) << 10) | (0x100 if n in rules else 0) | label
        if n in rules:
            units[base[n]] = 0x80000000 | len(strings)
            strings += rules[n] + b"\0"
        for m in nodes:
            if len(m) == len(n) + 1 and m[:-1] == n:
                place[m] = base[n] ^ m[-1]
    blob = struct.pack(f"<{len(units)}I", *units)
    return struct.pack("<I", len(blob)) + blob + strings


def test_longest_prefix_and_source_alignment():
    codec = S.Codec(S.model_bytes(MODEL))
    codec.map = S.CharMap(charmap({"ﬁ".encode(): b"fi", b"ab": b"x", b"abc": "é".encode(), b"q": b""}))
    plain, source = codec.normalise("abc ab ﬁ qd")
    assert plain == " é x fi d"
    assert source.tolist() == [0, 0, 0, 3, 4, 6, 7, 7, 10, 12, 13]
    ids, spans, decoded = codec.encode("abc ab ﬁ qd")
    assert decoded == "é x fi d"
    raw = "abc ab ﬁ qd".encode()
    for i, (a, b) in zip(ids.tolist()[1:-1], spans.tolist()[1:-1]):
        assert 0 <= a < b <= len(raw)
    assert spans[-1].tolist() == [13, 13]


def test_operator_on_edge_rows(spark):
    texts = [None, "", "same", "same", "long " * 30000, "x▁y"]
    df = spark.createDataFrame([(i, t, "z", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, _text int")
    got = {r.doc_id: r for r in S.digest_documents(df, MODEL).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = LIBRARY.encode(t or "", add_bos=True, add_eos=True)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()
    full = {r.doc_id: r for r in S.encode_documents(df, MODEL).collect()}
    assert full[0].ids == [1, 2] and full[0].decoded == ""
    assert full[5].span_ends[-1] == len("x▁y".encode())
    assert S.digest_documents(df.limit(0), MODEL).count() == 0
