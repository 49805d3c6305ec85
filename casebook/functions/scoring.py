"""Scalar scoring columns: reply parsing (P15, P16), token estimate (P13),
cost (P14), and display formatting helpers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------------------
# FIXED VALUES — score reply patterns, tried in this order (case-insensitive,
# multi-line); group 1 is the number.
# ---------------------------------------------------------------------------
SCORE_PATTERNS = [
    r"Score:\s*(\d+(?:\.\d+)?)",
    r"(\d+(?:\.\d+)?)/10",
    r"(\d+(?:\.\d+)?)\s*out\s*of\s*10",
    r"Relevance:\s*(\d+(?:\.\d+)?)",
    r"^(\d+(?:\.\d+)?)\s*$",
]
ANY_NUMBER = r"(\d+(?:\.\d+)?)"
DEFAULT_SCORE = 5.0


def relevance_score(reply) -> Column:
    """First matching pattern, else first number, else 5.0; clamp 0..10."""
    r = F.coalesce(_col(reply), F.lit(""))
    cands = []
    for p in SCORE_PATTERNS + [ANY_NUMBER]:
        m = F.regexp_extract(r, "(?im)" + p, 1)
        cands.append(F.when(m != "", m.cast("double")))
    score = F.coalesce(*cands, F.lit(DEFAULT_SCORE))
    return F.greatest(F.lit(0.0), F.least(F.lit(10.0), score))


def comparison_result(reply) -> Column:
    """1 when the reply holds '1' but not '-1'; -1 when it holds '-1'; else 0."""
    r = F.lower(F.regexp_replace(F.coalesce(_col(reply), F.lit("")), r"^\s+|\s+$", ""))
    return (F.when(r.contains("1") & ~r.contains("-1"), F.lit(1))
            .when(r.contains("-1"), F.lit(-1))
            .otherwise(F.lit(0)))


# Token estimate: a word run or one other non-space character.
TOKEN_ESTIMATE = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def token_count(text) -> Column:
    """P13 (re-aimed): token estimate as the number of word runs plus other
    non-space characters.  An exact BPE tokenizer needs a downloaded
    vocabulary and is not part of the default path."""
    return F.size(F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(TOKEN_ESTIMATE), 0))


def llm_cost(input_tokens, output_tokens, in_rate: float = K.INPUT_COST_PER_1K,
             out_rate: float = K.OUTPUT_COST_PER_1K, per: int = 1000) -> Column:
    """``in/per*in_rate + out/per*out_rate``."""
    return (_col(input_tokens) / F.lit(float(per)) * F.lit(in_rate)
            + _col(output_tokens) / F.lit(float(per)) * F.lit(out_rate))


SPLITTER = 134217729.0  # 2^27 + 1 (Veltkamp split of a double)


def exact_round(x, digits: int) -> Column:
    """Round like Python's ``round(x, digits)``: to the nearest multiple of
    10^-digits of the *exact binary value* of ``x``, halves to even.

    ``p = x * 10^digits`` is rounded by the multiplication; the exact error
    ``e`` of that product is recovered with an error-free product (Veltkamp
    split), so a product that lands exactly on ``.5`` is resolved by the
    sign of ``e``.  Pure double arithmetic, so every engine agrees."""
    v = _col(x).cast("double")
    s = float(10 ** digits)
    p = v * F.lit(s)
    c = v * F.lit(SPLITTER)
    hi = c - (c - v)
    lo = v - hi
    e = (hi * F.lit(s) - p) + lo * F.lit(s)
    fl = F.floor(p).cast("double")
    frac = p - fl
    up = fl + F.lit(1.0)
    even = F.when(F.pmod(fl, F.lit(2.0)) == 0.0, fl).otherwise(up)
    r = (F.when(frac == 0.5, F.when(e > 0, up).when(e < 0, fl).otherwise(even))
         .when(frac > 0.5, up).otherwise(fl))
    return F.when(v.isNull(), F.lit(None).cast("double")).otherwise(r / F.lit(s))


def fmt_fixed(x, digits: int) -> Column:
    """Python's ``f"{x:.{digits}f}"``: correctly rounded, then printed (the
    printed value is the nearest double to a ``digits``-decimal number, so
    the text is exact in every engine)."""
    return F.format_string(f"%.{digits}f", exact_round(x, digits))


def exact_token_count(encoding_name: str = "cl100k_base"):
    """P13 exact mode: an Arrow-batched token counter backed by a BPE
    encoding (the encoding file must be available to the executors; it is
    not shipped here).  Returns a function Column -> Column; an encoding that
    cannot be loaded raises when the first batch runs."""
    import pandas as pd

    @F.pandas_udf("int")
    def _count(texts: pd.Series) -> pd.Series:
        import tiktoken

        enc = tiktoken.get_encoding(encoding_name)
        return texts.fillna("").map(lambda t: len(enc.encode(t))).astype("int32")

    return lambda c: _count(_col(c))
