"""DuckDB SQL fragments mirroring the column functions, used to build the
oracle statements in ``__spark_entry__.oracle_sql``.

Only the check needs these; the library itself never builds SQL text.
"""

from __future__ import annotations

from ..functions import constants as K
from ..functions import text as T


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip_ws(x: str) -> str:
    return f"regexp_replace({x}, {q(T.WS_EDGES)}, '', 'g')"


# The character references that the check data holds, the ampersand last
DATA_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", "\u00a0"), ("&copy;", "©"),
                 ("&middot;", "·"), ("&eacute;", "é"), ("&hellip;", "…"), ("&#8217;", "’"), ("&amp;", "&")]
TAG = r"""</?[A-Za-z][^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*>|</?[A-Za-z][^>]*>|<[!?][^>]*>"""
BASE64 = "^((?:=*D=*D=?DD)*)(?:=*(D)=*(D)(?:==|=?(D)=).*|=*)$".replace("D", "[A-Za-z0-9+/]")


def decode_entities(x: str) -> str:
    out = x
    for ent, ch in DATA_ENTITIES:
        out = f"replace({out}, {q(ent)}, {q(ch)})"
    return out


def data_url_bytes(url: str) -> str:
    payload = f"regexp_extract({url}, '[^,]*$')"
    kept = f"replace(regexp_replace({payload}, {q(BASE64)}, {q(chr(92) + '1' + chr(92) + '2' + chr(92) + '3' + chr(92) + '4')}), '=', '')"
    return f"from_base64(rpad({kept}, CAST(ceil(length({kept}) / 4.0) * 4 AS INTEGER), '='))"


def clean_html(x: str) -> str:
    t = f"coalesce({x}, '')"
    for p in T.IMG_PATTERNS:
        t = f"regexp_replace({t}, {q('(?i)' + p)}, '', 'g')"
    t = f"regexp_replace({t}, {q('(?is)' + T.NON_TEXT_BLOCKS)}, '<!>', 'g')"
    nodes = (f"list_filter(list_transform(regexp_split_to_array({t}, {q(TAG)}), "
             f"lambda n: {strip_ws(decode_entities('n'))}), lambda n: n <> '')")
    t = f"array_to_string({nodes}, ' ')"
    t = f"regexp_replace({t}, {q(chr(10) + '[[:space:]' + chr(160) + ']*' + chr(10))}, {q(chr(10) * 2)}, 'g')"
    t = f"regexp_replace({t}, ' +', ' ', 'g')"
    return strip_ws(t)


def _quote_re(s: str) -> str:
    return "".join("\\" + ch if ch in r".^$|?*+()[]{}\/-" else ch for ch in s)


def strip_support_section(x: str, title: str) -> str:
    t = _quote_re(title)
    cut = f"regexp_replace({x}, {q('(?is)-{72}[[:space:]]*' + t + '.*')}, '')"
    cut = f"regexp_replace({cut}, {q('(?is)' + t + '.*')}, '')"
    return f"(CASE WHEN {x} IS NULL OR {x} = '' THEN {x} ELSE {strip_ws(cut)} END)"


def format_entry(ts: str, author: str, content: str) -> str:
    def s(v):
        return f"coalesce(CAST({v} AS VARCHAR), 'None')"
    return f"('[' || {s(ts)} || '] ' || {s(author)} || ': ' || {s(content)})"


def lit_list(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


def rule_condition(x: str, groups) -> str:
    parts = []
    for group in groups:
        hits = []
        for n in group:
            if n.startswith("@"):
                hits.append(f"contains({x}, {q(n[1:])})")
            else:
                hits.append(f"contains(lower({x}), {q(n)})")
        parts.append("(" + " OR ".join(hits) + ")")
    return "(" + " AND ".join(parts) + ")"


def rule_labels(x: str, rules) -> str:
    items = ", ".join(f"CASE WHEN {rule_condition(x, g)} THEN {q(label)} END" for label, g in rules)
    return f"list_filter([{items}], lambda v: v IS NOT NULL)"


def rule_set(x: str, name: str) -> str:
    r = K.RULE_SETS[name]
    labels = rule_labels(f"coalesce({x}, '')", r)
    if name in K.SET_RULE_SETS:
        return f"list_sort(list_distinct({labels}))"
    if name in K.JOINED_RULE_SETS:
        return f"array_to_string({labels}, ', ')"
    return labels


def term_set(x: str, token: str = r"[a-z0-9_]+", stopwords=None) -> str:
    sw = K.SHORT_STOPWORDS if stopwords is None else stopwords
    toks = f"regexp_extract_all(lower(coalesce({x}, '')), {q(token)})"
    return (f"list_sort(list_distinct(list_filter({toks}, lambda t: length(t) > 2 "
            f"AND NOT list_contains({lit_list(sw)}, t))))")


def jaccard(a: str, b: str) -> str:
    return (f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE "
            f"len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b})))::DOUBLE END)")


def head(x: str, n: int, suffix: str = "") -> str:
    return f"(CASE WHEN length({x}) > {n} THEN substring({x}, 1, {n}) || {q(suffix)} ELSE {x} END)"


def tail(x: str, n: int) -> str:
    return f"(CASE WHEN length({x}) > {n} THEN substring({x}, length({x}) - {n} + 1, {n}) ELSE {x} END)"


def keywords(x: str, patterns=None) -> str:
    pats = K.DEFAULT_PATTERNS if patterns is None else patterns
    low = f"lower(coalesce({x}, ''))"
    found = ", ".join(f"regexp_extract_all({low}, {q(p)}, 1)" for p in pats)
    return f"list_sort(list_distinct(flatten([{found}])))"


def redact_image_data(x: str) -> str:
    pat = q(r"(?is)(data:image/[^;]+;base64,)[A-Za-z0-9+/=_-]+")
    return (f"(CASE WHEN contains(lower({x}), 'data:image') "
            f"THEN regexp_replace({x}, {pat}, '\\1REDACTED', 'g') ELSE {x} END)")


def screenshot_items(key: str, x: str) -> str:
    url_ok = (f"(starts_with(u, 'data:image/') AND regexp_matches(regexp_extract(u, '[^,]*$'), "
              f"{q(BASE64)}))")
    return (f"list_transform(regexp_extract_all({x}, {q('(?is)' + T.DATA_URL)}), lambda u, i: "
            f"{{'url': u, 'name': 'screenshot_' || CAST({key} AS VARCHAR) || '_' || printf('%03d', i), "
            f"'ok': {url_ok}}})")


def title_from_path(x: str) -> str:
    name = f"regexp_extract({x}, '[^/]*$')"
    name = f"(CASE WHEN contains({name}, '.') THEN regexp_replace({name}, '\\.[^.]*$', '') ELSE {name} END)"
    name = f"translate({name}, '_-', '  ')"
    name = strip_ws(f"regexp_replace({name}, '[[:space:]]+', ' ', 'g')")
    words = (f"list_transform(string_split({name}, ' '), lambda w: CASE WHEN w = upper(w) AND w <> lower(w) "
             f"THEN w ELSE upper(substring(w, 1, 1)) || lower(substring(w, 2)) END)")
    title = f"array_to_string({words}, ' ')"
    return f"(CASE WHEN {title} = '' THEN {x} ELSE {title} END)"


def article_summary(x: str, max_chars: int = 600, read_chars: int = 1800) -> str:
    t = strip_ws(f"substring(coalesce({x}, ''), 1, {read_chars})")
    first = f"substring({t}, 1, {max_chars})"
    cut = f"(CASE WHEN contains({first}, ' ') THEN regexp_extract({first}, '(?s)^(.*) ', 1) ELSE {first} END)"
    return f"(CASE WHEN length({t}) > {max_chars} THEN {cut} || '...' ELSE {t} END)"


def denoise_lines(x: str, phrases) -> str:
    keep = " AND ".join(f"NOT contains(l, {q(p)})" for p in phrases) or "true"
    lines = f"string_split_regex(coalesce({x}, ''), '\\r\\n|\\r|\\n')"
    prefix = q(r"^\[.*?\]\s*[^:]+:\s*")
    cleaned = (f"list_transform(list_filter({lines}, lambda l: {keep}), "
               f"lambda l: {strip_ws(f"regexp_replace(l, {prefix}, '')")})")
    return strip_ws(f"array_to_string(list_filter({cleaned}, lambda l: l <> ''), chr(10))")


def preview(x: str, n: int) -> str:
    return f"translate(substring({x}, 1, {n}), chr(10) || chr(13), '  ')"


def is_redacted(x: str) -> str:
    return f"coalesce(regexp_matches({x}, {q(T.REDACTED_MARKER)}), false)"


def incident_id_from_name(x: str) -> str:
    name = f"regexp_extract({x}, '[^/]*$')"
    base = f"regexp_replace({name}, '(.)\\.[^.]*$', '\\1')"
    return f"regexp_replace({base}, '^incident_', '')"


def exact_round(x: str, digits: int) -> str:
    s = f"{float(10 ** digits)!r}"
    v = f"CAST({x} AS DOUBLE)"
    p = f"({v} * {s})"
    c = f"({v} * 134217729.0)"
    hi = f"({c} - ({c} - {v}))"
    lo = f"({v} - {hi})"
    e = f"(({hi} * {s} - {p}) + {lo} * {s})"
    fl = f"floor({p})"
    frac = f"({p} - {fl})"
    even = f"(CASE WHEN {fl} % 2.0 = 0.0 THEN {fl} ELSE {fl} + 1.0 END)"
    r = (f"(CASE WHEN {frac} = 0.5 THEN (CASE WHEN {e} > 0 THEN {fl} + 1.0 WHEN {e} < 0 THEN {fl} ELSE {even} END) "
         f"WHEN {frac} > 0.5 THEN {fl} + 1.0 ELSE {fl} END)")
    return f"({r} / {s})"


def tenths_text(x: str) -> str:
    return fmt_fixed(x, 1)


def fmt_fixed(x: str, digits: int) -> str:
    return f"printf('%.{digits}f', {exact_round(x, digits)})"


def shared_terms_ranked(qt: str, tt: str, st: str, k: int = 5) -> str:
    shared = f"list_intersect({qt}, list_distinct(list_concat({tt}, {st})))"
    ordered = f"list_transform(list_sort(list_transform({shared}, lambda t: {{'k': -length(t), 't': t}})), lambda s: s.t)"
    return f"list_slice({ordered}, 1, {k})"


def heuristic_explanation(query: str, context: str, title: str, summary: str, score: str) -> str:
    tok = r"[a-z0-9_\-]+"
    qt = term_set(f"{query} || ' ' || coalesce({context}, '')", tok)
    shared = shared_terms_ranked(qt, term_set(title, tok), term_set(summary, tok))
    low = f"lower(coalesce({summary}, ''))"

    def any_in(words):
        return "(" + " OR ".join(f"contains({low}, {q(w)})" for w in words) + ")"

    return (f"(CASE WHEN len({shared}) > 0 THEN {q(K.MATCH_SENTENCE_PREFIX)} || array_to_string({shared}, ', ') || '. ' "
            f"ELSE {q(K.NO_MATCH_SENTENCE)} END"
            f" || CASE WHEN {any_in(K.PLATFORM_WORDS)} THEN {q(K.PLATFORM_SENTENCE)} ELSE '' END"
            f" || CASE WHEN {any_in(K.SECURITY_WORDS)} THEN {q(K.SECURITY_SENTENCE)} ELSE '' END"
            f" || CASE WHEN {any_in(K.CONFIGURATION_WORDS)} THEN {q(K.CONFIGURATION_SENTENCE)} ELSE '' END"
            f" || 'Relevance score: ' || {tenths_text(score)} || '/10.')")


def relevance_score(x: str) -> str:
    from ..functions import scoring as SC
    r = f"coalesce({x}, '')"
    cands = []
    for p in SC.SCORE_PATTERNS + [SC.ANY_NUMBER]:
        m = f"regexp_extract({r}, {q('(?im)' + p)}, 1)"
        cands.append(f"CASE WHEN {m} <> '' THEN CAST({m} AS DOUBLE) END")
    return f"greatest(0.0, least(10.0, coalesce({', '.join(cands)}, 5.0)))"


def comparison_result(x: str) -> str:
    r = f"lower(regexp_replace(coalesce({x}, ''), '^\\s+|\\s+$', '', 'g'))"
    return (f"(CASE WHEN contains({r}, '1') AND NOT contains({r}, '-1') THEN 1 "
            f"WHEN contains({r}, '-1') THEN -1 ELSE 0 END)")


def keywords_wordwise(x: str, patterns) -> str:
    """Keyword set for patterns of the form ``\\b(a|b|c)\\b`` with Unicode word
    boundaries (RE2's ``\\b`` is ASCII-only): whole Unicode word runs equal to
    one of the alternatives."""
    words = []
    for p in patterns:
        assert p.startswith(r"\b(") and p.endswith(r")\b"), p
        words += p[3:-3].split("|")
    toks = f"regexp_extract_all(lower(coalesce({x}, '')), '[\\p{{L}}\\p{{N}}_]+')"
    return f"list_sort(list_distinct(list_filter({toks}, lambda t: list_contains({lit_list(words)}, t))))"
