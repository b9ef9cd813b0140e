"""Article text of literal pages."""

import time

import pytest

from tidemark.operators import pages
from tidemark.operators.pages import main_text, page_articles

PAGES = [
    ("<div class='post big'><p>one</p><div><p>two <b>bold</b></p></div><p>three</p></div><p>four</p>", "one two bold three"),
    ("<article><article><p>inner</p></article><p>outer</p></article>", "inner outer"),
    ("<main>loose<h2>head</h2>loose<p>a<br>b</p></main>", "head a b"),
    ("<section itemprop='articleBody'><p>x &amp; y &copy;</p></section>", "x & y ©"),
    ("<p>before</p><span class=content><h1>t</h1><p>in</p></span><article><p>later</p></article>", "t in"),
    ("<p>one<p>two</b></p><script>var t='<p>no</p>'</script><style>p{}</style>", "one two"),
    ("<article><script>no</script></article><p>not in it</p>", ""),
    ("<div>nothing</div>", ""), ("", ""), (None, None), ("<div class='postal'><p>no container</p></div>", "no container"),
]


PAGES += [
    ("<p class='post'>a<b>b</b></p><p>c</p>", "ab"), ("<article><p>one<article><p>two</article>three</article><p>four", "one twothree"),
    ("<div><p>x</div><main><div><h2>y</div>z</main>w", "y"), ("<article><p>a<script>s<p>t</script>b</p></article>", "ab"),
    ("</p></article>loose<p>in</p></p>", "in"), ("<main><p>1</p></main><main><p>2</p></main>", "1")]


@pytest.mark.parametrize("html,text", PAGES)
def test_main_text(html, text):
    assert main_text(html) == text


def test_page_articles(spark):
    rows = spark.createDataFrame([(1, "u", "<title> A  b </title><article><p>" + "x" * 30 + "</p></article>"), (2, "v", None)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["title"], r["content"]) for r in page_articles(rows, 10).collect()}
    assert got[1] == ("A b", "x" * 10 + "...") and got[2][1] is None


def test_many_open_elements_take_time_in_proportion():
    """Elements that are never closed, and end tags that match none of them."""
    def seconds(n):
        started = time.perf_counter()
        assert main_text("<article><p>" + "<b>x</i>" * n) == "x" * n
        return time.perf_counter() - started

    seconds(2000)
    assert seconds(64_000) < 40 * seconds(4_000)


def test_batches_are_bounded_and_whole(spark, monkeypatch):
    monkeypatch.setattr(pages, "BATCH_BYTES", 100)
    import pyarrow as pa

    rows = pa.record_batch([pa.array(range(50)), pa.array([f"<p>{'w' * (i % 7) * 10}</p>" if i % 9 else None for i in range(50)])], names=["page_id", "html"])
    out = list(pages._main_texts(iter([rows, rows.slice(0, 0)])))
    assert len(out) > 5 and [x for b in out for x in b.column("page_id").to_pylist()] == list(range(50))
    assert [x for b in out for x in b.column("content").to_pylist()] == ["w" * (i % 7) * 10 if i % 9 else None for i in range(50)]
