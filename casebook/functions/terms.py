"""Term extraction and set similarity columns.

All array work uses built-in array functions (``array_except`` /
``array_intersect`` / ``array_union`` are hash-based), so there is no Python
in the hot path and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K

# Token patterns.  "explain" keeps hyphens, "overlap" does not.
EXPLAIN_TOKEN = r"[a-z0-9_\-]+"
OVERLAP_TOKEN = r"[a-z0-9_]+"
# Vectorizer tokens: two or more Unicode letters / digits / underscore.
WORD_TOKEN = r"[\p{L}\p{N}_]{2,}"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lit_array(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def term_set(c, token: str = OVERLAP_TOKEN, stopwords=None) -> Column:
    """Distinct lower-case tokens longer than two characters that are not
    stop words (unordered set semantics; returned sorted)."""
    sw = K.SHORT_STOPWORDS if stopwords is None else stopwords
    toks = F.regexp_extract_all(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit(token), 0)
    toks = F.filter(toks, lambda t: F.length(t) > 2)
    return F.array_sort(F.array_except(toks, _lit_array(sw)))


def jaccard(a_terms, b_terms) -> Column:
    """|A∩B| / |A∪B| on two term sets; either empty -> 0.0."""
    a, b = _col(a_terms), _col(b_terms)
    inter = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        inter.cast("double") / union.cast("double"))


def text_jaccard(a_text, b_text) -> Column:
    return jaccard(term_set(a_text), term_set(b_text))


def shared_terms_ranked(query_terms, title_terms, summary_terms, k: int = 5) -> Column:
    """J11 + O6: query ∩ (title ∪ summary), longest first then alphabetical, first k."""
    shared = F.array_intersect(_col(query_terms), F.array_union(_col(title_terms), _col(summary_terms)))
    ordered = F.array_sort(
        shared,
        lambda x, y: F.when(F.length(x) != F.length(y), F.length(y) - F.length(x)).otherwise(
            F.when(x < y, -1).when(x > y, 1).otherwise(0)),
    )
    return F.slice(ordered, 1, k)


def keywords(c, patterns=None) -> Column:
    """Lower-case text, every pattern's group-1 matches, distinct and sorted."""
    pats = K.DEFAULT_PATTERNS if patterns is None else patterns
    low = F.lower(F.coalesce(_col(c), F.lit("")))
    found = [F.regexp_extract_all(low, F.lit(p), 1) for p in pats]
    return F.array_sort(F.array_distinct(F.flatten(F.array(*found))))


NON_WORD = r"[^\p{L}\p{N}_]+"


def word_tokens(c) -> Column:
    """Vectorizer tokens (lower-case, >=2 word characters), in text order.
    Splitting on non-word runs yields exactly the maximal word runs that
    ``WORD_TOKEN`` matches, and is cheaper than a regex extraction."""
    parts = F.split(F.lower(F.coalesce(_col(c), F.lit(""))), NON_WORD)
    return F.filter(parts, lambda t: F.length(t) >= 2)
