"""Pages against written-out layouts, and their words against a plain parser."""

import time
from html.parser import HTMLParser

from tonewatch.llm import html_text
from tonewatch.llm.html_text import visible_text


def test_implied_ends_and_spacing():
    assert visible_text("<title>no</title><p>a <b>b<p>c<br>d") == "a b\n\nc\nd"
    assert visible_text("x<div>y</div>z") == "x\ny\nz"
    assert visible_text("<h1>t</h1>text") == "t\n\ntext"


def test_lists():
    assert visible_text("<ul><li>one<li>two<ul><li>in</ul></ul>") == "- one\n- two\n  - in"
    assert visible_text("<ol start=3><li>x<li>y</ol>") == "3. x\n4. y"
    assert visible_text("<dl><dt>t<dd>d</dl>") == "t\n  d"


def test_table_cells_are_aligned():
    page = "<table><tr><th>name<th>qty<tr><td>apples<td>3<tr><td colspan=2>all of it<tr><td rowspan=2>r<td>1<tr><td>2"
    assert visible_text(page).split("\n") == [
        "name    qty", "apples  3", "all of it", "r       1", "        2",
    ]


def test_what_is_not_shown():
    hidden = (
        "<head><style>p{}</style></head><script>var a='</p>';</script><p hidden>n</p><p style='Display : None'>n</p>"
        "<template>n</template><!-- n --><input type=hidden value=n><details><summary>s</summary>n</details>"
    )
    assert visible_text(hidden + "yes") == "s\nyes"
    assert visible_text("<details open><summary>s</summary>n</details>") == "s\nn"
    assert visible_text("<body hidden>n") == ""


def test_preserved_and_escaped():
    assert visible_text("<pre>a\n   b</pre>") == "a\n   b"
    assert visible_text("&lt;b&gt; &amp;amp; 1 < 2") == "<b> &amp; 1 < 2"
    assert visible_text("<textarea>a <b> c</textarea>") == "a <b> c"


def test_broken_pages_end_in_time():
    start = time.time()
    for page in ("<div>" * 50_000 + "x", "<a \"" * 50_000, "<" * 100_000, "<!--" * 50_000, "</p>" * 20_000, "<table>" * 9000):
        visible_text(page)
    assert time.time() - start < 30
    assert visible_text("<div>" * 500 + "x") == "x"
    assert visible_text("a<b c='") == "a"
    assert visible_text(None) == visible_text("") == visible_text("<") .strip("<") == ""


class _Plain(HTMLParser):
    """All text outside of elements that are not shown."""

    def __init__(self):
        super().__init__()
        self.hidden, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("title", "script", "style")
        if tag not in ("b", "a"):
            self.words.append(" ")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("title", "script", "style")
        if tag not in ("b", "a"):
            self.words.append(" ")

    def handle_data(self, data):
        if not self.hidden:
            self.words.append(data)


def test_words_of_all_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    for row in pages.collect():
        plain = _Plain()
        plain.feed(row["html"])
        plain.close()
        assert [w for w in found[row["page_id"]].split() if w != "-"] == [
            w for w in "".join(plain.words).split() if w != "-"
        ]


def test_nulls_and_empty_tables(spark):
    pages = spark.createDataFrame(
        [(1, None, None, "clash"), (None, "u", "<p>x", "clash"), (1, None, None, "clash")],
        "page_id long, url string, html string, text string",
    )
    rows = sorted((r["page_id"] or 0, r["url"], r["text"]) for r in html_text.extract(pages).collect())
    assert rows == [(0, "u", "x"), (1, None, ""), (1, None, "")]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_elements_below_many_open_ones_keep_their_rules():
    page = (
        "<p hidden>n</p><div style='display:none'>n<p>n</div><details><summary>s</summary>n</details>"
        "<ul><li>a<li>b</ul><table><tr><td>long<td>x<tr><td>y<td>z</table><pre>1\n   2</pre>"
    )
    plain = visible_text(page)
    for tag in ("span", "a name=x", "font", "div"):
        for number in (150, 3000):
            assert visible_text(f"<{tag}>" * number + page) == plain


def test_spans_take_what_their_cells_take():
    import tracemalloc

    page = "<table>" + "<tr>" + "<td colspan=1000 rowspan=1000>a" * 5 + ("<tr>" + "<td colspan=1000 rowspan=1000>b" * 3) * 4 + "</table>"
    tracemalloc.start()
    text = visible_text(page)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert text.split() == ["a"] * 5 + ["b"] * 12 and peak < 5 << 20
    spanned = "<table><tr><td rowspan=2>one<td>x<tr><td>y<tr><td>z<td>w</table>"
    assert visible_text(spanned) == "one  x\n     y\nz    w"


def test_output_is_linear_in_input():
    wide = "<table><tr><td>" + "x" * 20_000 + "<td>end" + "<tr><td>a<td>b" * 500 + "</table>"
    many = "<table><tr>" + f"<td>{'y' * 100}" * 100 + "<tr><td colspan=99><td>z" * 500 + "</table>"
    for page in (wide, many):
        assert len(visible_text(page)) < 20 * len(page)


def test_what_is_shown():
    assert visible_text("<dialog>no</dialog><dialog open>yes</dialog>") == "yes"
    assert visible_text("<input value=a><input type=checkbox value=on><input type=Password value=s><input type=submit value=Go>") == "a Go"
    assert visible_text("<p style='--x:display:none'>yes</p><p style='color:red; Display : none'>no</p>") == "yes"
    assert visible_text("<ol><li>a<li value=7>b<li>c</ol>") == "1. a\n7. b\n8. c"
    assert visible_text("<ol reversed><li>a<li>b</ol><ol reversed start=9><li>a<li>b</ol>").split() == "2. a 1. b 9. a 8. b".split()
