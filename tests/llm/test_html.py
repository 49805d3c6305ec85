from html.parser import HTMLParser

from casebook.llm import html_main as H


class Article(HTMLParser):
    """The blocks of the article element of the test pages."""

    BREAKS = {"p", "h1", "h2", "h3", "article"}

    def __init__(self):
        super().__init__()
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in self.BREAKS:
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        if tag in self.BREAKS:
            self.blocks.append("")
        self.inside &= tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data

    @classmethod
    def text(cls, page):
        p = cls()
        p.feed(page)
        p.close()
        return "\n".join(x for x in (" ".join(b.split()) for b in p.blocks) if x)


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in H.extract_main_text(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.page_id].text == Article.text(r.html) and got[r.page_id].n_chars == len(got[r.page_id].text)


def page(k, body, top=""):
    return (f"<html><head><title>t{k}</title><style>p{{}}</style></head><body>{top}<header><h1>Site</h1></header>"
            f"<nav><ul><li>Home<li>News</ul></nav>{body}<form><p>Mail?</p><input></form><footer>&copy; me</footer></body></html>")


def test_slots_and_clutter(spark):
    rows = []
    for k in range(6):
        body = (f"<div class='cookie-notice'>We use cookies</div><div id=wrap><div class=x7><h2>Title {k} &amp; more</h2><p>One&nbsp;two \n "
                f"<b>three</b> {k}<p>if a < 5 and b > {k} then<ul><li>item {k}</ul><script>var x='</p>';</script><!-- no --><div class=q>Read on</div>"
                f"<blockquote>said &#233; {k}</blockquote><div class='comments'><article class=comment>first!</article></div></div>"
                f"<div class='side sidebar'>links {k}</div></div><div class=AdBox>buy {k}</div>")
        rows.append((k, f"https://a.example.com/{k}", page(k, body)))
    for k in range(4):
        rows.append((10 + k, f"http://b.example.org/{k}", page(k, f"<main><p>Same story</p><p>Part {k}<br>next<div hidden>x</div>"
                                                             f"<section class='related'>r</section></main>", "<div class=ad>Ad")))
    rows += [(20, None, None), (21, "nonsense", ""), (22, None, "plain &lt;text&gt; only"), (23, "http://c.example/1", "<p>a<p>b<!-- c"),
             (24, "http://d.example/", "<div class=ad>x<article>in <i>here</i></article>y</div>"), (10, "http://b.example.org/0", rows[6][2]),
             (25, "http://e.example/", "<article><p>" + "long " * 50000 + "</article>")]
    df = spark.createDataFrame([(*r, "h", 3) for r in rows], "page_id long, url string, html string, host string, text int")
    got = {(r.page_id, r.url): r for r in H.extract_main_text(df).collect()}
    for k in range(6):
        assert got[k, f"https://a.example.com/{k}"].text == f"Title {k} & more\nOne two three {k}\nif a < 5 and b > {k} then\nitem {k}\nsaid é {k}"
    for k in range(4):
        assert got[10 + k, f"http://b.example.org/{k}"].text == f"Same story\nPart {k} next"
    assert [got[k].text for k in ((20, None), (21, "nonsense"), (22, None), (23, "http://c.example/1"), (24, "http://d.example/"))] == [
        "", "", "plain <text> only", "a\nb", "in here"]
    assert got[25, "http://e.example/"].n_chars == 250000 - 1
    assert H.extract_main_text(df).count() == len(rows) and H.extract_main_text(df.limit(0)).count() == 0


def test_copies_do_not_make_article_text_fixed(spark):
    rows = [(k, f"http://a.example/{k}", page(0, "<article><section><p>One story<table><tr><td>cell</table></section></article>")) for k in range(4)]
    rows += [(10, "http://b.example/1", page(0, "<div id=c><p>Only text</div>"))] * 3
    for k in range(6):  # three articles, and three copies of a fourth with containers of its own
        body = f"Story {k}" if k < 3 else "Quoting<blockquote>said often</blockquote><ul><li>point</ul>"
        rows.append((20 + k, f"http://c.example/{k}", page(k, f"<article><p>{body}<div class=q>Read on</div></article>")))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = H.extract_main_text(df).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == len(rows)
    assert {text[k] for k in range(4)} == {"One story\ncell"} and text[10] == "Only text"
    assert [text[20 + k] for k in range(6)] == ["Story 0", "Story 1", "Story 2"] + ["Quoting\nsaid often\npoint"] * 3
