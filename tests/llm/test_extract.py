import re

import pytest

from spanloom.llm import blocks, extract, train_blocks


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("", []),
        ("<p>a<p>b", ["a", "b"]),
        ("a < b & c &lt; d", ["a < b & c < d"]),
        ("<div>x</div", ["x"]),
        ("<a href='>'>q</a> z", ["q z"]),
        ("<head><title>t</title><p>text here", ["text here"]),
        ("<!-- unclosed", []),
        ("<script>x", []),
        ("<div><div><div><div><template><p>no</p></template>yes", ["yes"]),
        ("<p>a<noscript>b</noscript>c", ["a", "c"]),
        ("<p>a</p><textarea>draft <b>x</textarea><iframe>old</iframe><p>b<object>o</object>", ["a", "b"]),
        ("<form><select><option>one<option>two</select></form><p>a<video>v</video>", ["a"]),
        ("<p>a&nbsp;&nbsp;b&#233;&copy</p>", ["a bé©"]),
        ("<p>f<b>oo</b>\n bar<br>baz</p>", ["foo bar baz"]),
    ],
)
def test_blocks(page, texts):
    assert [b.text for b in blocks.blocks(page)] == texts


def test_held_out_accuracy():
    assert train_blocks.accuracy(blocks.fitted(), train_blocks.sample(200, 99)) > 0.985


def test_layouts_that_were_not_fitted():
    assert train_blocks.accuracy(blocks.fitted(), train_blocks.sample(200, 98, train_blocks.HELD_OUT)) > 0.93


PROSE = "The mill stood by the river for a hundred years, and nobody in the village could say who had built it. "
BOILERPLATE = ('<ul class="menu"><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/c">Contact</a></li></ul>', '<div class="footer">&copy; 2024 Example. All rights reserved.</div>')


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        (PROSE + PROSE, [(PROSE + PROSE).strip()]),
        (f"<body><h1>Mill</h1><p>{PROSE}</p><p>{PROSE}</p></body>", ["Mill", PROSE.strip(), PROSE.strip()]),
        (f"<body>{BOILERPLATE[0]}<div><h1>Mill</h1><p>{PROSE}</p><p>{PROSE}</p></div>{BOILERPLATE[1]}</body>", ["Mill", PROSE.strip(), PROSE.strip()]),
        (f"<body>{BOILERPLATE[0]}<main><p>{PROSE}</p><p>{PROSE}</p></main>{BOILERPLATE[1]}</body>", [PROSE.strip(), PROSE.strip()]),
    ],
)
def test_plain_pages(page, texts):
    assert blocks.main_texts([page]) == ["\n".join(texts)]


def test_article_element_is_not_what_decides(spark):
    """The given pages with nameless containers instead of the article element keep their texts."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    renamed = [p.replace("<article>", "<div>").replace("</article>", "</div>") for p in pages]
    same = [a == b for a, b in zip(blocks.main_texts(pages), blocks.main_texts(renamed), strict=True)]
    assert sum(same) >= 0.9 * len(same)


def test_training_learns():
    made = train_blocks.fit(train_blocks.sample(150, 5), 4)
    assert train_blocks.accuracy(made, train_blocks.sample(60, 6)) > 0.85


def test_batches_do_not_matter():
    pages = [page for page, _ in train_blocks.sample(12, 3)]
    fitted = blocks.fitted()
    together = fitted.scores([fitted.gates(p) for p in pages])
    for page, score in zip(pages, together, strict=True):
        assert abs(fitted.scores([fitted.gates(page)])[0] - score).max() < 1e-4


def test_pages(spark):
    got = {r.page_id: r.text for r in extract.op3_html_extraction(spark, "/root/testdata/sf0.01").collect()}
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    wrong = 0
    for p in pages:
        inner = re.search("<article>(.*?)</article>", p.html, re.S)[1]
        wrong += got[p.page_id] != "\n".join(b.text for b in blocks.blocks(inner))
    assert len(got) == len(pages) and wrong <= len(pages) // 100


def test_odd_pages(spark):
    rows = [(1, None, "u", "t"), (2, "", "u", "t"), (2, "", "u", "t"), (None, "<article><p>" + "long text here. " * 20_000 + "</article>", None, "t")]
    df = spark.createDataFrame(rows, "page_id long, html string, url string, text string").drop("text")
    got = sorted(((r.page_id, len(r.text)) for r in extract.extracted(df).collect()), key=repr)
    assert got == [(1, 0), (2, 0), (2, 0), (None, 319_999)]
    assert extract.extracted(df.limit(0)).collect() == []


def test_clashing_names(spark):
    """A column of the new one's name is replaced, others stay whatever they are called."""
    page = "<article><p>" + PROSE * 3 + "</p></article>"
    df = spark.createDataFrame([(1, "old", page, 2, 3, 4), (2, None, None, 5, 6, 7)], "page_id long, text string, html string, c0 long, main_text long, URL long")
    out = extract.extracted(df)
    assert out.columns == ["page_id", "c0", "main_text", "URL", "text"]
    got = {r.page_id: tuple(r)[1:] for r in out.collect()}
    assert got == {1: (2, 3, 4, (PROSE * 3).strip()), 2: (5, 6, 7, "")}
    doubled = df.select("page_id", "html", "c0", df.URL.alias("c0"))
    assert sorted(tuple(r) for r in extract.extracted(doubled).collect())[1] == (2, 5, 7, "")


def test_hidden_by_style():
    assert blocks.element_tokens("div", ' style="visibility : hidden"') == ("t:div", "c:hidden")
