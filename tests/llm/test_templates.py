"""Main text by templates: odd pages, hosts whose furniture has no telling name, copies, long and deep pages."""

import random
import time

import pytest

from coffer.llm import templates

PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize("page, text", [
    ('<body class="single has-sidebar"><p>a</p></body>', "a"),
    ("<article><p>one</p><p title=it's>two</p><p>three</p><p>it's four</p></article>", "one\ntwo\nthree\nit's four"),
    ("<body><article><p>teaser</p></article><main><h1>T</h1><p>the long real article text</p></main></body>", "T\nthe long real article text"),
    ('<body><div class="legal-analysis"><p>x</p></div><div class="search-history">y</div><p class="notice-bar">n</p></body>', "x\ny"),
    ("<article><p>a <math><mi>x</mi></math></p><noscript><p>b</p></noscript></article>", "a x\nb"),
    ("<article><header><h1>T</h1><p>by me</p></header><p>a</p></article>", "T\na"),
    ('<body><header><h1>Shop</h1></header><div class="site-header"><h1>Shop</h1></div><p>a</p><div/><p>b</p></body>', "a\nb"),
    ("<article><p>a<svg/>b</p><p>5 < 6 and <b>7</b></p></article>", "ab\n5 < 6 and 7"), ("<article>x <", "x <"), ("<article><p>a</p><!-- open", "a"),
    ('<main><article class="post no-sidebar"><p>a</p></article><article class="comment"><p>reader</p></article></main>', "a")])
def test_odd_pages(page, text):
    assert templates.extract(page, None) == text


def test_reading_takes_time_in_proportion_to_length():
    for part in ("<a ", '<a x="', "<!--", "<b><hr>", "<div>", "<script>", "<article>"):
        start = time.time()
        templates.extract(part * 40_000, None)
        templates.extract(part * 40_000 + ">", None)
        assert time.time() - start < 20, part
    assert templates.extract("<div>" * 50_000 + "deep", None) == "deep"


def _layout(rnd, kind, title, paragraphs, menu):
    """(page, text) of an article in one of several layouts."""
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    text = "\n".join([title, *paragraphs])
    ad = f"<div class='ad-slot'>buy {rnd.random()}</div>"
    if kind == "article":
        return f"<body><nav>{menu}</nav>{ad}<article><header><h1>{title}</h1></header>{body}</article><footer>f</footer></body>", text
    if kind == "main":
        return f"<body><div id=top-menu>{menu}</div><main><h1>{title}</h1>{body}{ad}</main><div class='site-footer'>f</div></body>", text
    if kind == "named":
        return f"<body><div class=x8><a>{menu}</a></div><div class='post-content'><h1>{title}</h1>{body}</div><div class=x9>All rights {menu}</div></body>", text
    return f"<body><div class=x8><ul><li>Home<li>{menu}</ul></div><div class=x7><h1>{title}</h1>{body}</div><div class=x9>All rights {menu}</div></body>", text


def test_layouts_against_the_written_articles(spark):
    """Four layouts, the last with generated class names only: its menu and notice are told by the template."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choices("abcdefgh", k=5))
    rows, want = [], {}
    for host, kind in enumerate(["article", "main", "named", "plain"]):
        for k in range(9):
            page_id = host * 100 + k
            title, ps = " ".join(word() for _ in range(4)), [" ".join(word() for _ in range(rnd.randint(3, 40))) for _ in range(rnd.randint(1, 6))]
            page, want[page_id] = _layout(rnd, kind, title, ps, f"Shop{host}")
            rows.append((page_id, f"https://h{host}.example/{k}", page))
    got = {r.page_id: r.text for r in templates.main_text(spark.createDataFrame(rows, PAGES).repartition(3)).collect()}
    assert got == want


def test_copies_do_not_become_the_template(spark):
    page = "<body><div class=x7><p>the same article on many pages</p><p>second</p></div></body>"
    other = "<body><div class=x7><p>another article {} with more text in it</p></div></body>"
    rows = [(i, f"http://copies/{i}", page) for i in range(20)] + [(100 + i, f"http://copies/o{i}", other.format(i)) for i in range(4)]
    got = {r.page_id: r.text for r in templates.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(got[i] == "the same article on many pages\nsecond" for i in range(20)) and got[101] == "another article 1 with more text in it"


def test_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "u", "<p>a</p>", "x", "y"), (1, "u", "<p>a</p>", "x", "y"), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, PAGES + ", host string, region string")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in templates.main_text(df).collect()) == [(0, "", 0), (1, "a", 1), (1, "a", 1)]
