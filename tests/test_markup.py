import pytest
from pyspark.sql import functions as F

from mailquill.functions.markup import decode_entities, page_text, sibling_div, visible_text
from mailquill.operators.explode import explode_alerts
from mailquill.schema import MAIL_SCHEMA


def parsed(spark, body):
    mail = spark.createDataFrame([("m", "s", "", "", 1.0, body)], MAIL_SCHEMA)
    rows = explode_alerts(mail).orderBy("position").collect()
    return [(row.title, row.link, row.summary) for row in rows]


TITLE = '<h3><a href="u" class="gse_alrt_title">T</a></h3>'


@pytest.mark.parametrize(
    "body, expected",
    [
        ("", []),
        ("<h3></h3><h3 style='x'></h3>", []),
        ("<h3>no anchor</h3><h3><a href='u'>other</a></h3>", []),
        (TITLE, [("T", "u", "")]),
        ('<h3><a href="u" class="big  gse_alrt_title x">T</a></h3>', [("T", "u", "")]),
        ('<h3><a class="gse_alrt_titles" href="u">T</a></h3>', []),
        ("<h3><a class=gse_alrt_title href=u>T</a></h3>", [("T", "u", "")]),
        ("<h3><a class='gse_alrt_title' data-x='a>b' href='u?a=1&amp;b=2'>T</a></h3>", [("T", "u?a=1&b=2", "")]),
        ("<h3><a data-x=\"class='gse_alrt_title'\" href='u'>T</a></h3>", []),
        ("<h3><a class='gse_alrt_title'>T</a></h3>", []),
        ("<h3><a class='gse_alrt_title' href=''>T</a></h3>", []),
        ("<h3><a class='gse_alrt_title' href='u'> \n </a></h3>", []),
        ("<h3><a data-href='no' class='gse_alrt_title' href='u'>T</a></h3>", [("T", "u", "")]),
        ("<h3><a href='first' class='gse_alrt_title' href='last'>T</a></h3>", [("T", "last", "")]),
        ("<H3><A HREF='u' CLASS='gse_alrt_title'>T</A></H3><DIV CLASS='gse_alrt_sni'>S</DIV>", [("T", "u", "S")]),
        (
            "<h3><span>[HTML]</span> <a href='x'>skip</a><a href='u' class='gse_alrt_title'>\n  A <b>bold</b> T\n</a></h3>",
            [("AboldT", "u", "")],
        ),
        (
            TITLE + "<div>authors</div><div class='gse_alrt_sni'> one type of <br>catalyst, CO<sub>2</sub> x </div>",
            [("T", "u", "one type ofcatalyst, CO2x")],
        ),
        (TITLE + "<div class='gse_alrt_sni'>a <div>b</div> c</div><p>no</p>", [("T", "u", "abc")]),
        (TITLE + "<div><div class='gse_alrt_sni'>nested</div></div>", [("T", "u", "")]),
        ("<div>" + TITLE + "</div><div class='gse_alrt_sni'>of the parent</div>", [("T", "u", "")]),
        (
            TITLE + "<h3><a href='v' class='gse_alrt_title'>V</a></h3><div class='gse_alrt_sni'>S</div>",
            [("T", "u", ""), ("V", "v", "S")],
        ),
        (TITLE + "<div class='gse_alrt_sni'>one</div><div class='gse_alrt_sni'>two</div>", [("T", "u", "one")]),
        ("<!-- " + TITLE + " --><style>h3{}</style><script>var a='<h3>';</script>" + TITLE, [("T", "u", "")]),
        (TITLE + "<div class='gse_alrt_sni'>a <!-- x --> b &lt; c &amp;lt; d&nbsp;</div>", [("T", "u", "ab < c &lt; d")]),
        (TITLE + "<div class='gse_alrt_sni'>p < 0.05 and 3>2</div>", [("T", "u", "p < 0.05 and 3>2")]),
        (TITLE + "<div class='gse_alrt_sni'>line one\n  line two</div>", [("T", "u", "line one\n  line two")]),
        ("<h3><a href='u' class='gse_alrt_title'>open", [("open", "u", "")]),
        ("<!-- open" + TITLE, []),
        ("<h3><a href='u' class='gse_alrt_title'>a\0b</a></h3>\0<div class='gse_alrt_sni'>c\0</div>", [("a\ufffdb", "u", "c\ufffd")]),
        (TITLE + "<scripted>" + TITLE, [("T", "u", ""), ("T", "u", "")]),
        ("<h3x><a href='u' class='gse_alrt_title'>T</a></h3x>", []),
    ],
)
def test_alert_mail(spark, body, expected):
    assert parsed(spark, body) == expected


def test_position_is_number_of_heading(spark):
    mail = spark.createDataFrame([("m", "s", "", "", 5.0, "<h3></h3>" + TITLE + TITLE)], MAIL_SCHEMA)
    rows = explode_alerts(mail).collect()
    assert sorted((row.email_id, row.email_date, row.position) for row in rows) == [("m", 5.0, 1), ("m", 5.0, 2)]


def test_mail_without_body(spark):
    mail = spark.createDataFrame([("m", "s", "", "", None, None)], MAIL_SCHEMA)
    assert explode_alerts(mail).collect() == []


@pytest.mark.parametrize(
    "text, expected",
    [
        ("plain", "plain"),
        ("&", "&"),
        ("a && b &", "a && b &"),
        ("&amp;&lt;&gt;&quot;&apos;&#39;", "&<>\"''"),
        ("&amp;lt; &amp;amp; &amp;#65;", "&lt; &amp; &#65;"),
        ("&#65;&#x42;&#X43; &eacute;&hellip;&middot;&copy;", "ABC é…·©"),
        ("&#150;&#x80;", "–€"),
        ("&#0; &#xD800; &#1114112; &#x1F600;", "� � � \U0001f600"),
        ("&#38;amp; &AMP;lt; &amp;hellip; &#38;lt; &eacute;", "&amp; &lt; &hellip; &lt; é"),
        ("&#38;amp;", "&amp;"),
        ("&unknown; &copy &eacute;", "&unknown; © é"),
        ("&amp z &copy w &#65 &#x42 &unknown w", "& z © w A B &unknown w"),
        ("&#0000000000065;&#x00000000000042; &#99999999999999999999; &#xfffffffffffffffffff;", "AB � �"),
        ("&NotEqualTilde;", "≂̸"),
        (None, None),
    ],
)
def test_entities(spark, text, expected):
    frame = spark.createDataFrame([(text,)], "t string")
    assert frame.select(decode_entities(F.col("t"))).first()[0] == expected


def test_blank_ends(spark):
    frame = spark.createDataFrame([("<i>  a b　\x1f</i> <b> </b>c",)], "t string")
    assert frame.select(visible_text(F.col("t"), " ")).first()[0] == "a b c"


def test_long_input_stays_linear(spark):
    body = "<div class='gse_alrt_sni'>" + "word < " * 20000 + " " * 50000 + "<a b=c " + "d=e " * 300 + "></div>"
    frame = spark.createDataFrame([(body,)], "t string")
    text = frame.select(visible_text(sibling_div(F.col("t"), "gse_alrt_sni"), "")).first()[0]
    assert text == ("word < " * 20000).strip()


HOSTILE = 100000


@pytest.mark.parametrize(
    "body",
    [
        f"<h3><a href='u' class='gse_alrt_title' x{'=y' * HOSTILE}>T</a></h3>",
        f"<h3><a {'a=b ' * HOSTILE} href='u' class='gse_alrt_title'>T</a></h3>",
        TITLE + f"<div {'a=b ' * HOSTILE} class='gse_alrt_sni'>S</div>",
        TITLE + f"<div class='gse_alrt_sni'>{'<div>a</div>' * HOSTILE}</div>",
        TITLE + f"<div class='gse_alrt_sni'>{'<a ' * HOSTILE}</div>",
        TITLE + f"<div class='gse_alrt_sni'>{'&eacute; ' * HOSTILE}</div>",
        TITLE + "<!--" * HOSTILE,
        TITLE + "<script>" * HOSTILE,
        TITLE + "<style " * HOSTILE,
    ],
    ids=["equals", "attributes", "div attributes", "nested", "open tags", "entities", "comments", "scripts", "styles"],
)
def test_hostile_mail_neither_overflows_nor_stalls(spark, body):
    assert [title for title, _, _ in parsed(spark, body)] == ["T"]


def test_hostile_page(spark):
    pages = ["<article " * HOSTILE, "<article>" * HOSTILE + "x", "<body>" * HOSTILE + "x", "<p " + "a=b " * HOSTILE + ">x"]
    frame = spark.createDataFrame([(page,) for page in pages], "t string")
    assert [row[0] for row in frame.select(page_text(F.col("t"))).collect()] == [None, "x", "x", "x"]


@pytest.mark.parametrize(
    "page, expected",
    [
        ("<body><nav>menu</nav><article><h1>A</h1>\n<p>b &amp; c</article>foot</body>", "A b & c"),
        ("<head><title>t</title></head><body><article> </article><p>only body</p></body>", "only body"),
        ("<p>bare <b>text</b>", "bare text"),
        ("<body><script>x()</script><!-- c --></body>", None),
        ("", None),
        (None, None),
    ],
)
def test_page_text(spark, page, expected):
    frame = spark.createDataFrame([(page,)], "t string")
    assert frame.select(page_text(F.col("t"))).first()[0] == expected
