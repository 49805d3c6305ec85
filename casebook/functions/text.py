"""Column expressions for text cleaning.

Every function maps Column -> Column using only built-in Spark SQL functions,
so the work stays inside the JVM (whole-stage codegen for the scalar parts,
interpreted higher-order functions for the array parts) and scales with the
number of rows without any shuffle.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


# ---------------------------------------------------------------------------
# FIXED VALUES — <img> removal patterns, applied in this order, case-insensitive.
# The closed form comes first; the unclosed form can then only match when no
# later ">" exists, so it consumes to the end of the text.
# ---------------------------------------------------------------------------
IMG_PATTERNS = [
    r"""<img[^>]*src=["']?data:image/png[^>]*>""",
    r"""<img[^>]*src=["']?[^"']*REDACTED[^>]*>""",
    r"""<img[^>]*src=["']?[^"']*data:image/png[^>]*>""",
    r"""<img[^>]*src=["']?data:image/png[^>]*[^>]""",
    r"""<img[^>]*src=["']?[^"']*REDACTED[^>]*[^>]""",
    r"""<img[^>]*src=["']?[^"']*data:image/png[^>]*[^>]""",
    r"""<img[^>]*src=["']?[^"']{1000,}[^>]*>""",
    r"""<img[^>]*src=["']?[^"']{1000,}[^>]*[^>]""",
]
# Blocks whose inner text never reaches the extracted text.
NON_TEXT_BLOCKS = (r"<!--.*?-->|<!doctype[^>]*>|<script\b.*?</script\s*>"
                   r"|<style\b.*?</style\s*>|<link\b[^>]*>")
# A tag has a letter after "<" or "</", and its quoted attribute values may hold
# ">"; where a quote is never closed, the tag ends at the first ">".  Repeats are
# possessive, so very long tags cost no stack.
TAG = (r"""</?[A-Za-z][^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+>"""
       r"""|</?[A-Za-z][^>]*+>|<[!?][^>]*+>""")
ENTITY = r"&#[0-9]+;?|&#[xX][0-9A-Fa-f]+;?|&[A-Za-z][A-Za-z0-9]*;?"
WS_EDGES = r"^[\s\x{a0}]+|[\s\x{a0}]+$"
# FIXED VALUE — image data URL
DATA_URL = r"data:image/[^;]+;base64,[A-Za-z0-9+/=]+"
# Payloads a lenient base64 decoder takes: "=" in front of a group's third
# character is skipped, a group ended by its padding ends the payload.  Groups
# 1 to 4 together hold the characters that count.
_B64 = "[A-Za-z0-9+/]"
LENIENT_BASE64 = (rf"^((?:=*+{_B64}=*+{_B64}=?+{_B64}{_B64})*+)"
                  rf"(?:=*+({_B64})=*+({_B64})(?:==|=?({_B64})=).*|=*)$")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Python ``str.strip()`` for ASCII whitespace and no-break space."""
    return F.regexp_replace(_col(c), WS_EDGES, "")


def _entity_table() -> Column:
    """name (as written after ``&``) -> text, from the standard table of the
    Python library, and ``#code`` for the codes that stand for Windows-1252."""
    pairs = dict(html5)
    for code in range(0x80, 0xA0):
        pairs[f"#{code}"] = bytes([code]).decode("cp1252", "ignore") or chr(code)
    text = "\x02".join(f"{name}\x01{value}" for name, value in pairs.items())
    return F.str_to_map(F.lit(text), F.lit("\x02"), F.lit("\x01"))


def _decode_entity(token: Column, table: Column) -> Column:
    digits = F.regexp_replace(token, r"^&#[xX]?0*|;$", "")
    code = F.when(digits == "", F.lit(0)).when(F.length(digits) > 7, F.lit(0x110000)).otherwise(
        F.conv(digits, 10, 10).try_cast("int"))
    hex_code = F.when(digits == "", F.lit(0)).when(F.length(digits) > 7, F.lit(0x110000)).otherwise(
        F.conv(digits, 16, 10).try_cast("int"))
    code = F.when(token.rlike("^&#[xX]"), hex_code).otherwise(code)
    void = (code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127)
            | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE))
    numeric = (F.when((code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), F.lit("\ufffd"))
               .when(code.between(0x80, 0x9F), F.element_at(table, F.concat(F.lit("#"), code.cast("string"))))
               .when(void, F.lit(""))
               .otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")))
    named = F.coalesce(F.element_at(table, F.substring(token, 2, 1 << 30)), token)
    return (F.when(token.rlike("^&#[0-9xX]"), numeric)
            .when(token.startswith("&") & (F.length(token) > 1), named).otherwise(token))


def decode_entities(c) -> Column:
    """Numeric and named character references decoded as in HTML 5, each once
    (``&amp;lt;`` is ``&lt;``).  A name without its semicolon counts where the
    standard allows that and the whole run of letters and digits is the name."""
    t, table = _col(c), _entity_table()
    tokens = F.regexp_extract_all(t, F.lit(ENTITY + "|[^&]++|&"), 0)
    decoded = F.array_join(F.transform(tokens, lambda x: _decode_entity(x, table)), "")
    return F.when(t.contains("&"), decoded).otherwise(t)


def clean_html(c) -> Column:
    """Scrub images/script/style, keep text nodes stripped and joined by a
    space, then normalise blank lines and runs of spaces.  null/'' -> ''."""
    t = F.coalesce(_col(c), F.lit(""))
    for p in IMG_PATTERNS:
        t = F.regexp_replace(t, "(?i)" + p, "")
    t = F.regexp_replace(t, "(?is)" + NON_TEXT_BLOCKS, "<!>")
    nodes = F.transform(F.split(t, TAG), lambda x: strip_ws(decode_entities(x)))
    t = F.array_join(F.filter(nodes, lambda x: x != ""), " ")
    t = F.regexp_replace(t, r"\n[\s\x{a0}]*\n", "\n\n")
    t = F.regexp_replace(t, " +", " ")
    return strip_ws(t)


def redact_image_data(c) -> Column:
    """Replace base64 payloads of image data URLs by ``REDACTED``."""
    t = _col(c)
    return F.when(
        F.lower(t).contains("data:image"),
        F.regexp_replace(t, r"(?is)(data:image/[^;]+;base64,)[A-Za-z0-9+/=_-]+", "$1REDACTED"),
    ).otherwise(t)


def data_urls(c) -> Column:
    """P3 helper: every image data URL in order of appearance (case-insensitive)."""
    return F.regexp_extract_all(_col(c), F.lit("(?is)" + DATA_URL), 0)


def data_url_decodes(url) -> Column:
    """True when the URL has a lower-case image header and a payload that
    a lenient base64 decoder takes (see ``LENIENT_BASE64``)."""
    u = _col(url)
    payload = F.substring_index(u, ",", -1)
    return u.startswith("data:image/") & payload.rlike(LENIENT_BASE64)


def data_url_bytes(url) -> Column:
    """K6: the decoded payload of a URL that ``data_url_decodes`` accepts."""
    payload = F.substring_index(_col(url), ",", -1)
    kept = F.replace(F.regexp_replace(payload, LENIENT_BASE64, "$1$2$3$4"), F.lit("="), F.lit(""))
    return F.unbase64(F.rpad(kept, (F.ceil(F.length(kept) / 4) * 4).cast("int"), F.lit("=")))


def strip_support_section(c, title: str | None = None) -> Column:
    """Cut from the 72-dash rule + title (or the bare title) to the end;
    strip.  null / '' are returned unchanged, and so is every text without a title."""
    t = _col(c)
    if title is None:
        return t
    cut = F.regexp_replace(t, r"(?is)-{72}\s*" + _quote(title) + ".*", "")
    cut = F.regexp_replace(cut, "(?is)" + _quote(title) + ".*", "")
    return F.when(t.isNull() | (t == ""), t).otherwise(strip_ws(cut))


def _quote(s: str) -> str:
    out = []
    for ch in s:
        out.append("\\" + ch if ch in r".^$|?*+()[]{}\/-" else ch)
    return "".join(out)


def head(c, n: int, suffix: str = "") -> Column:
    """P6 head cap: first ``n`` characters plus ``suffix`` when longer."""
    t = _col(c)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit(suffix))).otherwise(t)


def tail(c, n: int) -> Column:
    """P6 tail cap: last ``n`` characters when longer."""
    t = _col(c)
    return F.when(F.length(t) > n, F.substring(t, -n, n)).otherwise(t)


def title_from_path(c) -> Column:
    """Basename, drop the last extension, separators to spaces, collapse,
    capitalise each word unless it is all upper case; empty -> the path."""
    p = _col(c)
    name = F.regexp_extract(p, r"[^/]*$", 0)
    name = F.when(name.contains("."), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    name = F.translate(name, "_-", "  ")
    name = strip_ws(F.regexp_replace(name, r"\s+", " "))
    words = F.transform(
        F.split(name, " "),
        lambda w: F.when((w == F.upper(w)) & (w != F.lower(w)), w).otherwise(
            F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))),
    )
    title = F.array_join(words, " ")
    return F.when(title == "", p).otherwise(title)


def article_summary(c, max_chars: int = K.SUMMARY_CHARS,
                    read_chars: int = K.SUMMARY_READ_CHARS) -> Column:
    """First ``read_chars`` stripped; longer than ``max_chars`` -> cut at
    the last space inside the first ``max_chars`` and add ``...``."""
    t = strip_ws(F.substring(F.coalesce(_col(c), F.lit("")), 1, read_chars))
    first = F.substring(t, 1, max_chars)
    cut = F.when(first.contains(" "), F.regexp_extract(first, r"(?s)^(.*) ", 1)).otherwise(first)
    return F.when(F.length(t) > max_chars, F.concat(cut, F.lit("..."))).otherwise(t)


def incident_id_from_name(c) -> Column:
    """File name without extension and without an ``incident_`` prefix."""
    name = F.regexp_extract(_col(c), r"[^/]*$", 0)
    base = F.regexp_replace(name, r"(.)\.[^.]*$", "$1")
    return F.regexp_replace(base, r"^incident_", "")


def digits_only(c) -> Column:
    """P9 (second form): the digits of the file name, in order."""
    return F.regexp_replace(F.regexp_extract(_col(c), r"[^/]*$", 0), r"\D", "")


def first_long_number(c) -> Column:
    """P10 helper: first run of 8+ digits, or null."""
    m = F.regexp_extract(_col(c), r"(\d{8,})", 1)
    return F.when(m == "", F.lit(None)).otherwise(m)


def format_entry(ts, author, content) -> Column:
    """``[timestamp] author: content`` (missing parts print as None)."""
    def s(x):
        return F.coalesce(_col(x).cast("string"), F.lit("None"))
    return F.concat(F.lit("["), s(ts), F.lit("] "), s(author), F.lit(": "), s(content))


def denoise_lines(c, noise_phrases) -> Column:
    """Drop lines holding any noise phrase, strip a leading
    ``[..] author:`` prefix, drop blank lines, rejoin with newlines."""
    lines = F.split(F.coalesce(_col(c), F.lit("")), r"\r\n|\r|\n")

    def keep(line):
        cond = F.lit(True)
        for p in noise_phrases:
            cond = cond & ~line.contains(p)
        return cond

    kept = F.filter(lines, keep)
    cleaned = F.transform(kept, lambda l: strip_ws(F.regexp_replace(l, r"^\[.*?\]\s*[^:]+:\s*", "")))
    return strip_ws(F.array_join(F.filter(cleaned, lambda l: l != ""), "\n"))


def preview(c, n: int) -> Column:
    """First ``n`` characters with CR/LF turned into spaces."""
    return F.translate(F.substring(_col(c), 1, n), "\n\r", "  ")


def keyword_csv(c) -> Column:
    """Split on commas, strip, drop empties."""
    parts = F.transform(F.split(F.coalesce(_col(c), F.lit("")), ","), strip_ws)
    return F.filter(parts, lambda x: x != "")


REDACTED_MARKER = r"(?i)^\s*\*\*\s*REDACTED\s*\*\*\s*$"


def is_redacted(c) -> Column:
    """F-2: whole (stripped) text is the ``** REDACTED **`` marker; null -> false."""
    return F.coalesce(_col(c).rlike(REDACTED_MARKER), F.lit(False))
