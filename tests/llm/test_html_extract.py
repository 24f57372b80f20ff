import html
import re
import time

import numpy as np
import pytest

from feescope.llm import html_extract as x


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet("/root/testdata/sf0.01/pages.parquet")


@pytest.fixture(scope="module")
def trees(pages):
    return x.train(pages)


def test_all_pages_of_the_table(pages, trees):
    """Brute force for this table: its articles are free of other parts."""
    for r in x.main_texts(pages, trees).join(pages.select("page_id", "html"), "page_id").collect():
        inside = r.html[r.html.index("<article>") : r.html.index("</article>")]
        text = re.sub(r"</?(p|h1|br|article)\b[^>]*>", " ", re.sub(r"</?b>", "", inside))
        assert r.text == " ".join(html.unescape(text).split()) and r.n_chars == len(r.text)


WORDS = "the river runs by an old house, and people walk there in the evening. "
PARTS = {
    "menu": '<div class="main-menu"><ul><li><a href=/>MENU</a></li><li><a href=/b>MENU</a></li></ul></div>',
    "header": '<header class="site-header"><div>HEADER</div></header>',
    "aside": f"<aside><h3>SIDE</h3><p>SIDE {WORDS}</p></aside>",
    "notice": '<div class="cookie-notice"><p>NOTICE we use cookies on this site.</p><button>OK</button></div>',
    "ad": f'<div class="advert">AD {WORDS}</div>',
    "form": '<form><label>FORM</label><input name=q><textarea>FORM</textarea><button>FORM</button></form>',
    "comments": f'<section class="comments"><h3>COMMENTS</h3><div class="comment"><b>COMMENTS</b> {WORDS * 2}</div></section>',
    "footer": "<footer>FOOTER &copy; 2024</footer>",
    "script": '<script>var a = "<p>SCRIPT</p>";</script><style>p {}</style><noscript>SCRIPT</noscript>',
}


@pytest.mark.parametrize("wrap", ["<article>{}</article>", '<div class="post-content">{}</div>', "<main><article>{}</article></main>"])
def test_other_parts_go(trees, wrap):
    body = f"<h1>Title of it</h1><p>{WORDS * 3}</p><p>Some <b>bold</b> and <a href=x>linked</a> words, {WORDS}</p>" + f"<p>{WORDS * 4}</p>" * 3
    want = " ".join(re.sub(r"</?(b|a)\b[^>]*>", "", body).replace("<", " <").split())
    want = " ".join(re.sub(r"<[^>]*>", " ", want).split())
    parts = {k: v for k, v in PARTS.items()}
    source = f"<html><head><title>T</title></head><body>{parts['script']}{parts['notice']}{parts['header']}{parts['menu']}{parts['ad']}"
    source += wrap.format(body) + "".join(parts[k] for k in ("comments", "aside", "form", "footer")) + "</body></html>"
    assert x.extract([source], trees) == [want]


def test_broken_and_empty(docs, spark, trees):
    rows = [
        (1, "u", None), (2, "u", ""), (3, None, "<"), (4, "u", "<!-- open"), (5, "u", "<p>a<p>b</div></p></html>"), (None, "u", "<script>x"),
        (6, "u", "<div>" * 3000 + "deep"), (7, "u", "a &amp; b &#233; &nbsp;c"), (7, "u", "a &amp; b &#233; &nbsp;c"), (8, "u", "<p>" + "word " * 200_000),
    ]
    given = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = x.main_texts(given, trees).collect()
    assert len(found) == len(rows) and all(r.n_chars == len(r.text) for r in found)
    assert all(r.text == "" for r in found if r.page_id in (1, 2, 4))
    assert x.main_texts(given.limit(0), trees).count() == 0
    assert x.train(given.limit(0), layouts=30) is not None


def test_decoding_has_no_contradictions():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n = int(rng.integers(1, 12))
        parent = np.array([-1, *(int(rng.integers(i)) for i in range(1, n))])
        depth = np.zeros(n, int)
        for i in range(1, n):
            depth[i] = depth[parent[i]] + 1
        odds, weight = rng.normal(size=n), rng.integers(1, 5, n).astype(float)
        kept = x.decode(odds, weight, parent, depth)
        assert all(kept[parent[i]] or not kept[i] for i in range(1, n))
        best = max(
            sum((odds * weight)[i] for i in range(n) if m >> i & 1)
            for m in range(1 << n) if all(parent[i] < 0 or m >> parent[i] & 1 or not m >> i & 1 for i in range(n))
        )
        assert (odds * weight)[kept].sum() == pytest.approx(max(best, 0))


def test_trees_learn():
    rng = np.random.default_rng(4)
    data = rng.normal(size=(2000, 5))
    y = ((data[:, 0] > 0.3) ^ (data[:, 1] < -0.2)).astype(float)
    trees = x.boost(data, y)
    assert ((trees(data) > 0) == y).mean() > 0.97


def all_text(source):
    page = x.Page(source)
    return page.text([True] * len(page.parent))


@pytest.mark.parametrize(
    "source, want",
    [
        ("<html><head><meta charset=x><title>T</title><body><p>one two</p></body></html>", "one two"),
        ("<head><title>T</title><link rel=x><p>one</p><p>two", "one two"),
        ("<head><title>T</title>one <b>two</b>", "one two"),
        ("<head><script>var a = '<body><p>no';</script><style>p {}</style>\n</head><body>one two", "one two"),
        ("<head><svg><title>no</title></svg><div>one two</div>", "one two"),
        ("<div><button>no</div><p>one two</p>", "one two"),
        ("<div><button>no<p>one</p><p>two</p></div><button>no</button>", "one two"),
        ("<ul><li><button>no<li>one<li>two</ul>", "one two"),
        ("<div><button><div>no</div></button>one two</div>", "one two"),
        ("<div><select><option>no<option>no</select>one two</div>", "one two"),
        ("<div><select><option>no<option>no</div>one two", "one two"),
        ("<div><svg><title/><g><text>no</text></g><svg></svg>no</svg>one two</div>", "one two"),
        ("<div><svg><path d=x><text>no</text></div><p>one two", "one two"),
        ("<video src=x><source src=y><p>one</p><audio>no<object>no</object></audio> two", "one two"),
    ],
)
def test_silent_elements_without_end_tag(source, want):
    assert all_text(source) == want


def test_article_of_a_page_without_head_end_or_button_end(trees):
    body = "".join(f"<p>{WORDS * 3}</p>" for _ in range(4))
    want = " ".join([WORDS.strip()] * 12)
    for head, first in (("<head><title>T</title>", ""), ("<head><title>T</title></head>", "<div class=share><button>NO</div>")):
        assert x.extract([f"<html>{head}<body>{first}<article>{body}</article></body></html>"], trees) == [want]


@pytest.mark.parametrize(
    "source",
    ["<b>" * 200_000, "<h1>" * 200_000, "<a x " * 200_000, "<b>" * 99_000 + "<h1>" * 99_000 + "</b>" * 99_000, "<button>" * 99_000, "<svg>" * 99_000 + "</svg>",
     "<b>" * 99_000 + "</i>" * 99_000, "<p><b>" * 99_000, "<!--" * 250_000, '<a "' * 250_000, "<td>" * 99_000 + "<tr>" * 99_000, "<" * 10**6],
)
def test_a_megabyte_of_broken_markup_takes_seconds(source):
    start = time.process_time()
    x.Page(f"<p>first</p>{source}")
    assert time.process_time() - start < 20
