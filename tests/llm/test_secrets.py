import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from casebook.llm import secrets as S

SCANNER = S.Scanner()
SCANNER.prepare()


def brute(text: str) -> list[tuple[str, int, int]]:
    out = []
    for k, rule in enumerate(S.RULES):
        for m in re.finditer(re.sub(r"\(\?i:", "(?ai:", rule.pattern), text, re.A):
            a, b = m.span(rule.group)
            if b - a >= rule.least:
                out.append((m.start(), k, m.end()))
    return [(S.RULES[k].kind, a, b) for a, k, b in sorted(out)]


PART = st.sampled_from(["password", "PassWD", "secret", "token", "api_key", "APIKEY", "=", ":", " ", '"', "'", "AKIA", "AKI",
                        "0123456789abcdef", "deadbeef", "A1B2C3D4E5F6", "hunter2hunter2", "é", "ſ", "\n", "ghp_", "xoxb-", "eyJ",
                        ".", "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN ", "PRIVATE KEY-----", "://", "user", "@", "AIza", "x" * 40])


@settings(max_examples=1500, deadline=None)
@given(st.lists(PART, max_size=14).map("".join))
def test_equals_plain_patterns(text):
    assert SCANNER.spans(text.encode()) == brute(text)


def test_automaton_is_minimal_and_small():
    a = S.compile_patterns(["ab|cb", "ab"], anywhere=False)
    assert a.n_states == 6 and sorted(a.ends) == [(0,), (0, 1)]  # start, after a, after c, two ends, dead
    assert SCANNER.all.n_states < 5000


def test_digests_and_redaction(spark):
    texts = [None, "", "é password: 'abcd1234xyz'", "password: token: abcdefghij", "x" * 100000 + " AKIA" + "Z" * 12,
             "deadbeef" * 4, "deadbeef" * 4]
    df = spark.createDataFrame([(i, t, "c", len(t or "")) for i, t in enumerate(texts)],
                               "doc_id long, text string, secrets string, n_chars long")
    got = {r.doc_id: r for r in S.secret_digests(df).collect()}
    base = {r.kind for r in S.BASE_RULES}
    for i, t in enumerate(texts):
        want = brute(t or "")
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[i].spans == said
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want if k in base).encode()).hexdigest()
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(k == x for k, _, _ in want) for x in ("assign", "access", "hex")]
    clean = {r.doc_id: r for r in S.redact_secrets(df, "text", "n_chars").collect()}
    assert clean[2].text == "é [assign]'" and clean[2].n_chars == 11 and clean[0].text is None and clean[5].text == "[hex]"
    assert clean[1].secrets == "c" and clean[3].text == texts[3]
    assert S.secret_digests(df.limit(0)).count() == 0
