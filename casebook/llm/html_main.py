"""Main text of web pages by equivalence classes of template tokens.

*Tokens.*  A page's template tokens are its containers, written as the path of
open containers with their classes and ids (digits as 0).  For each token of a
host the occurrence vector over the host's pages is summed up as the number of
pages, the number of occurrences, and the sum of a hash of (page, occurrences
in it): equal sums stand for equal vectors, and they add up in partial
aggregates, so a host with a third of all pages is no group in one task.

*Classes.*  Tokens of a host with equal vectors are one equivalence class.  A
class is part of the template if it is on at least two pages, once on each;
such classes nest by their paths.  What lies directly in a container is its
slot.  The host's article slot is the token of a template class that is named
an article best (article or main tag, role, class or id), or else has the most
changing text.  Slots whose text is the same on all their pages, while these
pages have three or more different article texts, hold fixed text of the
template; copies and repeated rows of a page have one article text.

*Extraction.*  From a page, the blocks inside the article slot are kept, less
those in containers that are no article text by tag, role, class or id (menus,
headers and footers of pages, sidebars, notices, adverts, forms, comments,
hidden parts) or hold fixed text.  A page without its host's article slot, or
of a host without one, uses its own best named container, or else all of its
body, less the same containers.

Cases: a null or empty html has an empty text; a null or unreadable url is a
host of its own name (empty); repeated rows each get their row and count as
occurrences; long pages are read whole; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, text_blocks

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)
                        |<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*)>""", re.S | re.X)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_RAW = {t: re.compile(rf"</{t}\s*>|\Z", re.I) for t in ("script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "xmp")}
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")

CONTAINERS = frozenset("""html body div section article main nav header footer aside form ul ol dl menu table thead tbody tfoot
    tr td th figure blockquote details dialog fieldset button select object video audio canvas center""".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre hr address figcaption summary caption legend option head".split())
NO_TEXT_TAGS = frozenset("nav footer aside form button select dialog menu object video audio canvas".split())
NO_TEXT_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar".split())
NO_TEXT_WORDS = frozenset("""ad ads advert adverts advertisement adslot adbox banner sponsor sponsored promo promotion nav navbar
    navigation menu menubar topbar breadcrumb breadcrumbs sidebar footer header masthead comment comments commentlist disqus
    respond replies cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe
    signup login share sharing social related recommended widget toolbar pagination pager copyright skip search form""".split())
ARTICLE_WORDS = ("article", "post", "story", "entry", "content", "main", "text", "body")
FIXED_TEXTS = 3


@dataclass
class Container:
    tag: str
    token: str
    plain: bool  # may hold article text, by itself and all around it
    rank: int  # how well it is named an article; 0: not


def _container(tag: str, attributes: str, inside: list[Container]) -> Container:
    values = {}
    for m in _ATTRIBUTE.finditer(attributes):
        values.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    said = f"{values.get('class', '')} {values.get('id', '')}"
    words = {w.lower() for w in _WORDS.findall(said)}
    role = values.get("role", "").lower()
    around = inside[-1] if inside else None
    in_article = any(c.rank >= 3 for c in inside)
    no_text = (tag in NO_TEXT_TAGS or role in NO_TEXT_ROLES or bool(words & NO_TEXT_WORDS) or "hidden" in values
               or values.get("aria-hidden") == "true" or "display:none" in values.get("style", "").replace(" ", "")
               or tag == "header" and not in_article)
    if tag in ("html", "body"):
        no_text = False
    rank = 0
    if not no_text:
        named = [k for k, w in enumerate(ARTICLE_WORDS) if w in words]
        rank = (5 if values.get("itemprop") == "articleBody" else 4 if tag == "article" else 3 if tag == "main" or role in ("main", "article")
                else 2 if named and named[0] < 4 else 1 if named and tag not in ("html", "body") else 0)
    # an article that starts inside an unclosed advert is an article all the same
    plain = not no_text and (around is None or around.plain or tag in ("article", "main"))
    token = f"{around.token if around else ''}/{tag}" + "".join(f".{re.sub(r'[0-9]+', '0', x)}" for x in sorted(said.split()))
    return Container(tag, token, plain, rank if plain else 0)


def read_page(page: str):
    """(text, open containers) of every block of the page, in order."""
    stack: list[Container] = []
    held: list[str] = []

    def flush():
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        return text

    at, blocks = 0, []
    while at < len(page):
        m = _TOKEN.search(page, at)
        held.append(page[at:m.start()] if m else page[at:])
        if not m:
            break
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                held.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in _RAW and not closing:
            end = _RAW[tag].search(page, at)
            at = end.end()
            continue
        if tag == "br":
            held.append(" ")
        if tag not in BLOCKS:
            continue
        if text := flush():
            blocks.append((text, tuple(stack)))
        if tag not in CONTAINERS:
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
        elif tag in ("html", "body"):
            if not any(c.tag == tag for c in stack):
                stack.append(_container(tag, "", stack))
        else:
            stack.append(_container(tag, m[3], stack))
            blocks.append(("", tuple(stack)))  # an empty text marks the container's start
    if text := flush():
        blocks.append((text, tuple(stack)))
    return blocks


def _slots(page: str) -> list[tuple]:
    """(token, occurrences, characters directly in it, hash of this text, rank)
    of every container token of a page."""
    count, chars, texts, rank, plain = Counter(), Counter(), {}, {}, {}
    for text, stack in read_page(page):
        if not stack:
            continue
        token = stack[-1].token
        if not text:
            count[token] += 1
            rank[token] = max(rank.get(token, 0), stack[-1].rank)
            plain[token] = stack[-1].plain
        else:
            texts.setdefault(token, hashlib.blake2b(digest_size=8)).update(text.encode("utf-8", "replace") + b"\n")
        for c in {c.token for c in stack}:
            chars[c] += len(text)
    return [(t, n, chars[t], int.from_bytes(texts[t].digest(), "little", signed=True) if t in texts else 0, rank[t], plain[t])
            for t, n in count.items()]


def main_text(page: str, article: str | None, fixed: frozenset) -> str:
    """The page's main text, given its host's article token and the tokens of
    containers with fixed text."""
    blocks = [(t, s) for t, s in read_page(page) if t]
    kept = [(t, s) for t, s in blocks if not s or s[-1].plain]
    has = article is not None and any(c.token == article for _, s in kept for c in s)
    if not has:
        best = max((c.rank for _, s in kept for c in s), default=0)
        if best >= 3 or best and sum(len(t) for t, s in kept if any(c.rank == best for c in s)) * 2 > sum(len(t) for t, _ in kept):
            kept = [(t, s) for t, s in kept if any(c.rank == best for c in s)]
        return "\n".join(t for t, s in kept if not any(c.token in fixed for c in s))
    out = []
    for t, s in kept:
        k = next((k for k, c in enumerate(s) if c.token == article), None)
        if k is not None and not any(c.token in fixed for c in s[k + 1:]):
            out.append(t)
    return "\n".join(out)


def host_of(url) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def templates(pages: DataFrame) -> DataFrame:
    """(host, article, fixed) of each host with a template, from (page, host,
    html); fixed are the slots with one text on three rows or more."""
    def run(batches):
        for batch in batches:
            for lo, _, block in text_blocks(batch.column(2)):
                rows = [(lo + k, *x) for k, text in enumerate(block.texts()) for x in _slots(text)]
                at = pa.array([r[0] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), *[pa.array(c, t) for c, t in zip(
                        list(zip(*[r[1:] for r in rows])) or [[]] * 6,
                        (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()))]],
                    names=["page", "host", "token", "n", "chars", "text_hash", "rank", "plain"])

    tokens = pages.select("page", "host", "html").mapInArrow(
        run, "page bigint, host string, token string, n bigint, chars bigint, text_hash bigint, rank int, plain boolean")
    vectors = tokens.groupBy("host", "token").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("n").alias("occurrences"),
        F.sum(F.xxhash64("page", "n").cast("decimal(38,0)")).alias("vector"), F.sum("chars").alias("chars"),
        (F.min("text_hash") == F.max("text_hash")).alias("same"), F.max("text_hash").alias("text_hash"),
        F.max("rank").alias("rank"), F.max("plain").alias("plain"))
    once = (F.col("pages") >= 2) & (F.col("occurrences") == F.col("pages")) & F.col("plain")
    classes = vectors.where(once).groupBy("host", "pages", "vector").agg(
        # the class's best named token; of equal ones that with more text, then the outer one
        F.max(F.struct("rank", "chars", (-F.length("token")).alias("short"), "token")).alias("best"),
        F.collect_set(F.when(F.col("same") & (F.col("text_hash") != 0) & (F.col("pages") >= FIXED_TEXTS), F.col("token"))).alias("fixed"))
    return classes.groupBy("host").agg(
        F.max(F.struct(F.col("best.rank"), F.when(F.col("best.rank") > 0, F.col("best.chars")).otherwise(0).alias("chars"),
                       F.col("best.token"))).alias("best"),
        F.flatten(F.collect_list("fixed")).alias("fixed")).select(
        "host", F.when(F.col("best.rank") > 0, F.col("best.token")).alias("article"), "fixed")


def fixed_slots(pages: DataFrame, known: DataFrame) -> DataFrame:
    """(host, fixed): of the slots in ``known`` (host, article, fixed), those
    on pages with ``FIXED_TEXTS`` different article texts or more."""
    asked = pages.select("host", "html").join(known.where(F.size("fixed") > 0), "host").select("host", "html", "article", "fixed")

    def run(batches):
        for batch in batches:
            for lo, hi, block in text_blocks(batch.column(1)):
                hosts, articles, fixed = (batch.column(k).slice(lo, hi - lo).to_pylist() for k in (0, 2, 3))
                rows = []
                for text, host, article, of in zip(block.texts(), hosts, articles, fixed):
                    if on := {s[-1].token for t, s in read_page(text) if t and s}.intersection(of):
                        digest = hashlib.blake2b(main_text(text, article, frozenset()).encode("utf-8", "replace"), digest_size=16).digest()
                        rows += [(host, token, digest) for token in on]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(
                    list(zip(*rows)) or [[]] * 3, (pa.string(), pa.string(), pa.binary()))], names=["host", "token", "article_text"])

    found = asked.mapInArrow(run, "host string, token string, article_text binary").distinct()
    return (found.groupBy("host", "token").agg(F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= FIXED_TEXTS)
            .groupBy("host").agg(F.collect_list("token").alias("fixed")))


def extract_main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    rows = df.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"),
                     F.col(f"`{html_col}`").cast("string").alias("html")).withColumn("host", host_of("url"))
    known = staged(templates(rows.select(F.xxhash64("page_id", "url").alias("page"), "host", "html")), "templates")
    known = known.select("host", "article").join(fixed_slots(rows, known), "host", "left")
    with_template = rows.join(known, "host", "left").select("page_id", "url", "html", "article", "fixed")
    kind = rows.schema["page_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for lo, hi, block in text_blocks(batch.column(2)):
                article, fixed = batch.column(3).slice(lo, hi - lo).to_pylist(), batch.column(4).slice(lo, hi - lo).to_pylist()
                texts = [main_text(t, a, frozenset(f or ())) for t, a, f in zip(block.texts(), article, fixed)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return with_template.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
