import html
import re

import pytest

from throughdoor.llm.html import extracted, main_text
from throughdoor.llm.queries import QUERIES


def article(source):
    inside = re.search(r"<article>(.*?)</article>", source, re.S).group(1)
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split())
              for b in re.split(r"</?(?:p|h1)>", inside)]
    return "\n".join(b for b in blocks if b)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_the_pages_templates(spark, sf):
    folder = f"/root/testdata/{sf}"
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = QUERIES["op5_html"](spark, folder).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r["text"] == article(pages[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"])
        assert r["url"] == pages[r["page_id"]]["url"]


CASES = {
    "": "", "plain text, here": "plain text, here", "<p>a<p>b": "a\nb",
    '<div><div class="sidebar">x</div><div id=content><p>Hello, world &amp; all</p><p>more\n text&nbsp;here</p></div>'
    '<div class="comments"><p>bad comment, long, long</p></div></div>': "Hello, world & all\nmore text here",
    "<html><body><header>Site</header><main><h1>T</h1><section><p>One, two, three.</p></section><section><p>Four, five,"
    " six and seven.</p></section></main><form><p>sub, it</p></form><aside>x</aside></body>":
        "T\nOne, two, three.\nFour, five, six and seven.",
    '<script>var a="<p>x</p>"</script>': "", "<a " * 2000 + ">x</a>": "", "<div>" * 3000 + "deep text": "deep text",
    "<ul><li><a href=x>m</a></ul><table><tr><td>A<td>B</table>": "A\nB",
    '<article><p>x</p><div class="cookie-notice">c</div><pre>a  b\n c</pre><ul><li>i1<li>i2</ul></article>': "x\na b c\ni1\ni2",
    "<div class=ad><p>Buy, buy, buy this long thing now</p></div><div><p>Short.</p></div>": "Short.",
    "<div><p>text &#228;&#x1F600;&bogus; <b>bold</b>er</p><div style='display:none'>no</div><p hidden>no</p></div>":
        "text ä😀&bogus; bolder",
}


@pytest.mark.parametrize("source", list(CASES))
def test_cases(source):
    if source.startswith("<a <a"):
        assert isinstance(main_text(source), str)
    else:
        assert main_text(source) == CASES[source]


def test_long_pages_are_whole_and_nulls_are_empty(spark):
    long = "<body><nav>m</nav><div>" + "".join(f"<p>Paragraph {i}, with words.</p>" for i in range(20000)) + "</div>"
    rows = [(1, "u", long, "t"), (2, None, None, "t"), (None, "u", "", "t"), (1, "u", "<p>x</p>", "t"), (1, "u", "<p>x</p>", "t")]
    got = extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted(r["n_chars"] for r in got)[:4] == [0, 0, 1, 1]
    assert max(got, key=lambda r: r["n_chars"])["text"].count("\n") == 19999
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert extracted(empty).count() == 0


PARAGRAPHS = [f"Paragraph {i} of the text, with some words, and a few commas, in it." for i in range(12)]
CELLS = "".join(f"<tr><td>cell {i}</td><td>{i * 7}</td></tr>" for i in range(120))
CELL_TEXT = [x for i in range(120) for x in (f"cell {i}", str(i * 7))]


@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_text_around_a_long_table_or_section_is_kept(tag):
    table = (f"<h1>Title</h1><p>{PARAGRAPHS[0]}</p><table><thead><tr><th>name</th><th>n</th></tr></thead><tbody>{CELLS}"
             f"</tbody></table><p>{PARAGRAPHS[1]}</p>")
    sections = ("<h1>Title</h1><section>" + "".join(f"<p>{p} {p} {p} {p}</p>" for p in PARAGRAPHS)
                + "</section><section><h4>Note</h4><p>Short one.</p></section><dl><dt>term</dt><dd>meaning</dd></dl>")
    around = "<html><body><nav><a href=x>menu</a></nav>" + "<{0}>%s</{0}>".format(tag) + "<footer>foot</footer></body></html>"
    assert main_text(around % table).split("\n") == ["Title", PARAGRAPHS[0], "name", "n", *CELL_TEXT, PARAGRAPHS[1]]
    assert main_text(around % sections).split("\n") == [
        "Title", *[f"{p} {p} {p} {p}" for p in PARAGRAPHS], "Note", "Short one.", "term", "meaning"]


def test_a_list_of_links_beside_the_text_is_not_kept():
    page = ("<body><div><a href=a>One link of many</a> <a href=b>another link of many</a></div><div><h2>Head</h2>"
            + "".join(f"<p>{p}</p>" for p in PARAGRAPHS) + "</div></body>")
    assert main_text(page).split("\n") == ["Head", *PARAGRAPHS]


NOISE = ('<div class="nav"><a href=x>Home</a></div>%s<div class="comments-area">' + "<p>A reader says much, and more. </p>" * 90
         + '</div><form id="login"><p>Your name, please</p></form><div class="site-footer"><p>Contact, imprint</p></div>')


@pytest.mark.parametrize("wrapper", [
    '<form id="aspnetForm">%s</form>', '<div class="content-sidebar-wrap">%s</div>', '<div role="form">%s</div>',
    '<div class="layout has-sidebar">%s</div>', '<div class="post with-comments">%s</div>', '<div class="no-ads">%s</div>',
    '<form><div class="has-sidebar"><div class="no-ads">%s</div></div></form>'])
@pytest.mark.parametrize("headline", ["", "<h1>Title</h1>"])
def test_wrappers_with_odd_names_keep_the_article(wrapper, headline):
    body = headline + "".join(f"<p>{p}</p>" for p in PARAGRAPHS[:3])
    want = ["Title"] * bool(headline) + PARAGRAPHS[:3]
    assert main_text("<html><body>" + NOISE % (wrapper % body) + "</body></html>").split("\n") == want


def test_forms_and_odd_names_without_the_article_go():
    assert main_text("<body><form><label>Name</label><input name=a><button>Go</button></form></body>") == ""
    page = "<body><h1>Title</h1><p>Short.</p><form><p>" + PARAGRAPHS[0] + "</p></form><div class='ad-slot'><p>" + PARAGRAPHS[1]
    assert main_text(page) == "Title\nShort."
