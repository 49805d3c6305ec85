import pytest
from pyspark.sql import functions as F

from casebook.functions import text as T
from conftest import one


@pytest.mark.parametrize("html,expected", [
    (None, ""),
    ("", ""),
    ("<p>Hello <b>world</b></p>", "Hello world"),
    ("<div><p>a</p><p>b</p></div>", "a b"),
    ("<script>var x = 1;</script><style>p{}</style>text", "text"),
    ("<!-- hidden -->shown", "shown"),
    ("Fish &amp; chips &lt;3", "Fish & chips <3"),
    ('before<img src="data:image/png;base64,AAAA">after', "beforeafter"),
    ('keep <img src="data:image/png;base64,AAAA" no closing', "keep"),
    ('x <img src="' + "A" * 1200 + '"> y', "x y"),
    ("<pre>line1\nline2</pre>", "line1\nline2"),
    ("<p>Grüße aus München</p>", "Grüße aus München"),
    ("if a < 5 and b > 3 then", "if a < 5 and b > 3 then"),
    ('<a title="1 > 0">x</a>', "x"),
    ('<a title="open>x</a>', "x"),
    ("it&#8217;s caf&eacute;&hellip;", "it’s café…"),
    ("a&nbsp;b &#x20AC; &#128; &#0; &#xD800; &#99999999999; &bogus; AT&T &amp;lt; &copy 1",
     "a\u00a0b € € \ufffd \ufffd \ufffd &bogus; AT&T &lt; © 1"),
    ("<b " + "a='1>' " * 20000 + ">long tag</b>", "long tag"),
])
def test_clean_html(spark, html, expected):
    assert one(spark, T.clean_html(F.col("x")), html) == expected


def test_clean_html_idempotent(spark):
    html = "<p>a &amp; b</p><script>z</script><div>c</div>"
    once = one(spark, T.clean_html(F.col("x")), html)
    assert one(spark, T.clean_html(F.col("x")), once) == once


@pytest.mark.parametrize("text,expected", [
    ("no image here", "no image here"),
    ("a data:image/png;base64,QUJD b", "a data:image/png;base64,REDACTED b"),
    ("DATA:IMAGE/PNG;base64,QUJD", "DATA:IMAGE/PNG;base64,REDACTED"),
    (None, None),
])
def test_redact_image_data(spark, text, expected):
    got = one(spark, T.redact_image_data(F.col("x")), text)
    assert got == expected
    if got is not None:
        assert one(spark, T.redact_image_data(F.col("x")), got) == got


def test_extract_screenshots(spark):
    from casebook.operators.screenshots import extract_screenshots, screenshot_images

    text = ("one data:image/png;base64,QUJD two data:image/png;base64,QUJD "
            "bad data:image/gif;base64,QUJ up DATA:IMAGE/PNG;base64,QUJD jpg data:image/jpeg;base64,QUJDRA==")
    df = spark.createDataFrame([(7, text)], "id long, t string")
    r = extract_screenshots(df, "id", "t").first()
    # the repeated URL keeps the first name; the invalid and upper-case ones stay
    assert r["processed_text"] == ("one [SCREENSHOT: screenshot_7_001] two [SCREENSHOT: screenshot_7_001] "
                                   "bad data:image/gif;base64,QUJ up DATA:IMAGE/PNG;base64,QUJD "
                                   "jpg [SCREENSHOT: screenshot_7_005]")
    assert r["screenshot_count"] == 3
    imgs = {x["image_no"]: x for x in screenshot_images(df, "id", "t").collect()}
    assert sorted(imgs) == [1, 2, 5]
    assert imgs[1]["extension"] == "png" and bytes(imgs[1]["image"]) == b"ABC"
    assert imgs[5]["extension"] == "jpg"


@pytest.mark.parametrize("payload", ["QUJD", "QUJD=", "QUJDRA==QUJD", "QUJDRA=", "QU=JDR=", "=Q=UJDRA==", "=", "QUJDR", "QUJ",
                                     "QQ=", "QQ=QUJD", "QUJD" * 200000])
def test_data_urls_decode_like_the_standard_library(spark, payload):
    import base64
    import binascii

    try:
        expected = base64.b64decode(payload)
    except binascii.Error:
        expected = None
    url = "data:image/png;base64," + payload
    got = one(spark, F.when(T.data_url_decodes(F.col("x")), T.data_url_bytes(F.col("x"))), url)
    assert (None if got is None else bytes(got)) == expected


@pytest.mark.parametrize("text,expected", [
    ("** REDACTED **", True), ("**redacted**", True), ("  **  REDACTED  ** ", True),
    ("summary ** REDACTED ** inside", False), (None, False),
])
def test_is_redacted(spark, text, expected):
    assert one(spark, T.is_redacted(F.col("x")), text) is expected


TITLE = "ADDITIONAL INFORMATION FROM THE HELP DESK"


def test_strip_support_section(spark):
    assert one(spark, T.strip_support_section(F.col("x")), TITLE) == TITLE  # no title given: nothing is cut
    t = "keep this\n" + "-" * 72 + "\nADDITIONAL INFORMATION FROM THE HELP DESK\nsecret tail"
    assert one(spark, T.strip_support_section(F.col("x"), TITLE), t) == "keep this"
    assert one(spark, T.strip_support_section(F.col("x"), TITLE), "a additional information from the help desk b") == "a"
    assert one(spark, T.strip_support_section(F.col("x"), TITLE), "") == ""
    assert one(spark, T.strip_support_section(F.col("x"), TITLE), "  plain  ") == "plain"


@pytest.mark.parametrize("path,expected", [
    ("kb/mde_device-control.md", "Mde Device Control"),
    ("docs/MDE_onboarding.txt", "MDE Onboarding"),
    ("a/b/", "a/b/"),
    ("noext", "Noext"),
])
def test_title_from_path(spark, path, expected):
    assert one(spark, T.title_from_path(F.col("x")), path) == expected


def test_article_summary(spark):
    long = "word " * 200
    s = one(spark, T.article_summary(F.col("x")), long)
    assert s.endswith("...") and len(s) <= 603 and not s[:-3].endswith(" ")
    assert one(spark, T.article_summary(F.col("x")), "  short text  ") == "short text"
    assert one(spark, T.article_summary(F.col("x")), "x" * 700) == "x" * 600 + "..."


def test_caps_and_ids(spark):
    assert one(spark, T.head(F.col("x"), 3, "..."), "abcdef") == "abc..."
    assert one(spark, T.tail(F.col("x"), 3), "abcdef") == "def"
    assert one(spark, T.incident_id_from_name(F.col("x")), "dir/incident_12345.csv") == "12345"
    assert one(spark, T.first_long_number(F.col("x")), "ticket 1234567 and 123456789") == "123456789"
    assert one(spark, T.preview(F.col("x"), 5), "a\nb\rcdef") == "a b c"
    assert one(spark, T.format_entry(F.lit("t"), F.lit(None).cast("string"), F.col("x")), "hi") == "[t] None: hi"


def test_denoise_lines(spark):
    text = "[1] bob: hello\nTransferred from X\n\n  [2] al: bye  "
    # the prefix pattern runs on the unstripped line, so an indented prefix stays
    assert one(spark, T.denoise_lines(F.col("x"), ["Transferred from"]), text) == "hello\n[2] al: bye"


def test_keyword_csv(spark):
    assert one(spark, F.array_join(T.keyword_csv(F.col("x")), "|"), " a, b ,,c ") == "a|b|c"
