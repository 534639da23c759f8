import random
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest

from plumbline.llm.html import UNSEEN, VOID, extract_pages, page_text

CASES = [
    ("<p>a<p>b", "a\n\nb"),
    ("<div>a</div><div>b</div>c", "a\nb\nc"),
    ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("x <b> y</b>  z\n w", "x y z w"),
    ("<ul><li>one<li>two <ul><li>deep</ul><li>three</ul>", "-  one\n-  two\n   -  deep\n-  three"),
    ("<ol start=3><li>c<li value=9>i<li>j</ol>", "3. c\n9. i\n10. j"),
    ("<table><tr><th>name<th>n<tr><td>long name<td>1<tr><td>x<td>22</table>", "name       n\nlong name  1\nx          22"),
    ("<table><caption>C</caption><tbody><tr><td colspan=2>ab<td>c</tr><tr><td>1<td>2<td>3", "C\nab     c\n1   2  3"),
    ("<pre>a\n  b\n\nc</pre>d", "a\n  b\n\nc\n\nd"),
    ("<script>var t='</p>';</script>a<style>p{}</style><noscript>n</noscript><template><p>t</template>b", "ab"),
    ("<p hidden>x</p><p style='DISPLAY : none'>y</p><p style=\"visibility:hidden\">z</p>w", "w"),
    ("<style>.ad, #i {display:none} p b{display:none}</style><p class='x ad'>1</p><p id=i>2</p><p><b>3</b>", "3"),
    ("<!-- c --><!DOCTYPE html><?php x ?>a &amp; b &lt;&eacute;&#x41; &nbsp;c", "a & b <éA \xa0c"),
    ("1 < 2 and <3 <a href='x>y'>z</a>", "1 < 2 and <3 z"),
    ("<dl><dt>t<dd>d1<dd>d2</dl>", "t\n  d1\n  d2"),
    ("<h1>T</h1>body</p>rest", "T\n\nbody\n\nrest"),
    ("</div></table>a</td>b<td>c", "abc"),
    ("<head><title>T</title><p>x", "x"),
    ("<a <b>c", "c"),
    ("<p", ""), ("<!--", ""), ("<", "<"), ("", ""), (None, ""), ("plain", "plain"),
    ("<table><tr><td>a<table><tr><td>b<td>c</table><td>d</table>e", "a     d\nb  c\n\ne"),
]


@pytest.mark.parametrize("page,text", CASES)
def test_layout(page, text):
    assert page_text(page) == text


class Plain(HTMLParser):
    """All text outside unseen elements, for pages that hide nothing else."""

    def __init__(self):
        super().__init__()
        self.out, self.off = [], []

    def handle_starttag(self, tag, attrs):
        if tag in UNSEEN and tag not in VOID:
            self.off.append(tag)

    def handle_endtag(self, tag):
        if self.off and self.off[-1] == tag:
            self.off.pop()

    def handle_data(self, data):
        if not self.off:
            self.out.append(data)


def squeezed(s):
    return "".join(s.split())


def test_no_word_is_lost():
    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist():
        p = Plain()
        p.feed(page)
        p.close()
        got = page_text(page)
        assert sorted(squeezed(got.replace("-  ", ""))) == sorted(squeezed("".join(p.out))) or "<li" in page and squeezed("".join(p.out)).replace("-", "") == squeezed(got).replace("-", "")


def test_depth_and_noise(spark):
    r = random.Random(1)
    assert page_text("<div>" * 50_000 + "x") == "x"
    assert page_text("<table><tr><td>" * 200 + "x") == "x"
    bits = ["<p>", "</p>", "<table>", "<tr>", "<td>", "</table>", "<li>", "<ul>", "</ul>", "<", ">", "&", "a", " ", "\n", "<b", "'", '"', "<!--", "-->", "<style>", "</", "<pre>"]
    for _ in range(500):
        page_text("".join(r.choices(bits, k=30)))
    df = spark.createDataFrame([(1, "<p>x", "t"), (None, None, "t"), (1, "<p>x", "t")], "page_id long, html string, text string")
    assert sorted(map(tuple, extract_pages(df).collect()), key=str) == [(1, "x"), (1, "x"), (None, "")]
    assert extract_pages(df.limit(0)).collect() == []


SHOWN = [
    ("<style>@media print{.nav{display:none}}@media (max-width:600px){.nav{display:none}}</style><p class=nav>menu", "menu"),
    ("<style>@media screen and (min-width: 40em){.x{display:none}}@supports (display:grid){.y{display:none}}</style><p class=x>a<p class=y>b<p>c", "c"),
    ("<style media=print>p{display:none}</style><p>a", "a"),
    ("<style>.x{display:none}.x{display:block}.y{display:block}.y{display:none}</style><p class=x>a<p class=y>b", "a"),
    ("<style>#i{display:none}.x{display:block}.z{display:none!important}</style><p class=x id=i>a<p class=z style='display:block'>b<p style='display:none;display:block'>c", "c"),
    ("<style>p{display:none}@media print{</style>a<p>b", "a"),
    ("<div style='visibility:hidden'>a<b style='visibility:visible'>b</b></div>", "b"),
    ("x <math><mi>a</mi><mo>=</mo><mn>2</mn><annotation>tex</annotation></math> y", "x a=2 y"),
    ("<svg><title>t</title><desc>d</desc><defs><text>n</text></defs><text x=1>one</text><text>two</text></svg>", "one two"),
    ("<textarea>a &amp;\n  b</textarea>", "a &\n  b"),
    ("pick <select><option>a<option selected>b<option>c</select> now", "pick b now"),
    ("<select><option disabled>a<option>b</select>", "b"),
]


@pytest.mark.parametrize("page,text", SHOWN)
def test_what_is_shown(page, text):
    assert page_text(page) == text


def test_hidden_elements_are_these_alone():
    hidden = "head title script style template noscript iframe object audio video canvas datalist noembed noframes".split()
    for name in [*hidden, *"div p span section nav article math textarea button label summary b td".split()]:
        assert page_text(f"<{name}>word</{name}>") == ("" if name in hidden else "word"), name


def test_cells_that_span_rows():
    page = "<table><tr><th rowspan=2>a<th>b<th colspan=2>c</tr><tr><td>d<td rowspan=0>e<td>f</tr><tr><td>g<td>h<td>i</tr><tbody><tr><td>j<td>k<td rowspan=9>l<tr><td>m</table>"
    assert page_text(page) == "a  b  c\n   d  e  f\ng  h     i\nj  k  l\nm"
    assert page_text("<table><tr><td rowspan=99999>x<td>y<tr><tr><td>z</table>") == "x  y\n   z"


def test_selectors_of_one_element():
    css = "<style>p.a{display:none} .a.b{display:block} #k.c{display:none} *.d{visibility:hidden} p.a#z{display:block!important} q.a{display:none} div .e{display:none}</style>"
    page = css + "<p class=a>one<p class='b a'>two<p id=k>three<p id=k class=c>four<p class=d>five<p class=a id=z>six<div class=a>seven</div><div><i class=e>eight</i></div>"
    # the fourth names an element by id and class, the second has two classes against a name and a class
    assert page_text(page).split() == ["two", "three", "six", "seven", "eight"]
    assert page_text("<style>.a{display:none!important}.b.c{display:block}</style><p class='a b c' style='display:block'>no</p><p class=a style='display:block!important'>yes</p>") == "yes"
