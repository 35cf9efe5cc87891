import itertools
import random
import time

import pytest

from veilspark.llm.html_extract import blocks_of, content_costs, extract, main_text, min_cut

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy now.</div>
<article><h1>Title &amp; more</h1><p>First  <b>bold</b>\n line &eacute;.<p>Second<br>half<div class="share-box">Share</div><p>Third &lt;ok&gt;.</p></article>
<aside>Related</aside><section id="comments"><p>A reader said so.</p></section><form><label>Mail</label></form><footer>&copy; 2024</footer></body></html>"""


def test_page():
    assert main_text(PAGE) == "Title & more\n\nFirst bold line é.\n\nSecond half\n\nThird <ok>."


def test_page_without_article():
    body = "".join(f"<p>{'A sentence of some length that says a thing or two about it. ' * 3}{i}.</p>" for i in range(4))
    text = main_text(f"<body><div class='menu'><a href='/'>x</a></div><div><h2>Head</h2>{body}</div><ul><li><a href='/q'>Other page</a></li></ul><div id=footer>end</div></body>")
    assert text.split("\n\n")[0] == "Head" and len(text.split("\n\n")) == 5


def test_short_blocks_of_the_article_stay():
    assert main_text("<article><h1>A</h1><p>B</p><p>C.</p></article>") == "A\n\nB\n\nC."


LONG = "A sentence of some length that says a thing or two about what it is for. " * 3


def by_sign(costs, edges):
    """The classifier alone, without the graph."""
    return [c > 0 for c in costs]


SOUP = f"<body><div class=top><a href=/>Home</a> <a href=/n>News</a></div><div><h2>A title</h2><p>{LONG}</p><p>Yes.</p><p>{LONG}</p><p>No</p><p>{LONG}</p></div><div><div><a href=/x>More on this</a></div></div></body>"
LINES = f"<main><p>{LONG}</p><ul><li>one</li><li>two</li></ul><div>Or</div><p>{LONG}</p></main><div>Not this</div>"


@pytest.mark.parametrize(("page", "has", "lacks"), [(SOUP, ["Yes.", "No", "A title"], ["Home", "More on"]), (LINES, ["one", "two", "Or"], ["Not this"]), ("<article><p>Of.</p></article>", ["Of."], [])])
def test_the_cut_corrects_the_classifier(page, has, lacks):
    text, alone = main_text(page), main_text(page, by_sign)
    assert all(x in text.split("\n\n") for x in has) and not any(x in text for x in lacks)
    assert any(x not in alone.split("\n\n") for x in has)  # the classifier by itself loses some


def test_the_cut_drops_what_the_classifier_would_keep():
    links = "<div><a href=/a>A link to elsewhere</a></div>" * 3
    page = f"<body>{links}<div>Some words that stand among links, and little else do they.</div>{links}</body>"
    assert main_text(page, by_sign) and main_text(page) == ""


def test_the_cut_matters_on_the_table(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    assert sum(main_text(h) != main_text(h, by_sign) for h in pages if h) > len(pages) / 4


def test_attributes_go_by_their_names():
    page = f'<article><p title="a hidden gem">{LONG}</p><p aria-hidden="false">{LONG}</p><p data-id="comment-1">{LONG}</p><p hidden>{LONG}</p><p style="display: none">{LONG}</p></article>'
    assert len(main_text(page).split("\n\n")) == 3
    assert len(blocks_of('<div class="a" id=\'x\' title="> <p>"><p>One</p></div>')[0]) == 1


def test_names_are_graded():
    for name in ("related", "notice", "header", "widget", "reply"):
        assert LONG.strip() in main_text(f"<article><p>{LONG}</p><p class={name}>{LONG}</p><p>{LONG}</p></article>").split("\n\n")[1:]
    for name in ("notice", "cookie-notice", "sidebar", "comments", "reply"):
        assert main_text(f"<article><p>{LONG}</p></article><div class={name}><div>Some short words of it.</div></div>") == " ".join(LONG.split())
    assert "Reader" not in main_text(f"<article><p>{LONG}</p><section class=comments>{f'<div><p>Reader: {LONG}</p></div>' * 12}</section></article>")


@pytest.mark.parametrize("piece", ["<p ", "<p '", '<p "a=\'', "<div>", "<b>", "<script>", "<!--", "<td>x", "</i><b>", "<a href=x>y</a>. <p>", "&amp;<", "<div></section>", "<button>", "<p a=\"", "<p a='<p b=\""])
def test_long_broken_pages_take_linear_time(piece):
    page = piece * (1_000_000 // len(piece))
    start = time.perf_counter()
    main_text(page)
    assert time.perf_counter() - start < 15


def test_costs_are_graded():
    assert all(abs(c) < 15 for c in content_costs(blocks_of(PAGE)[0]))


ONE = " ".join(LONG.split())


@pytest.mark.parametrize("k", [1, 12])
@pytest.mark.parametrize(
    "page",
    [
        "<body><form id=f>{}</form></body>",
        "<body><form id=f><article>{}</article></form></body>",
        "<form id=f><main>{}</main></form>",
        '<div class="layout sidebar-right">{}</div>',
        '<div class="layout sidebar-right"><article>{}</article><div class=sidebar><p>Some other words.</p></div></div>',
        '<div class="page has-navigation nav">{}</div>',
        '<div class="form-group menu-open"><div>{}</div></div>',
        '<form><div class="nav-page"><nav><a href=/>x</a></nav><article>{}</article></div></form>',
        "<article><script>x</script x>{}</article>",
        "<article><!-->{}<!--- x --!></article>",
        "<article>{}<button><b>Go</b></button></article>",
        "<article><div data-x=it's>{}</div></article>",
        "<article>{}</article><section class=comments>" + f"<p>{LONG}</p>" * 20 + "</section>",
        "<main>{}</main><div id=comments>" + f"<article class=comment><p>{LONG}</p></article>" * 20 + "</div>",
    ],
)
def test_layouts_are_no_regions(page, k):
    assert main_text(page.replace("{}", f"<p>{LONG}</p>" * k)) == "\n\n".join([ONE] * k)


def test_attributes_end_where_html_says():
    assert main_text(f"<article><p data-x=it's>{LONG}</p><p>Don't.</p></article>") == f"{ONE}\n\nDon't."
    assert main_text(f'<article><p title="x>{LONG}</p><p>B.</p></article>') == f"{ONE}\n\nB."
    assert main_text(f'<article><p a = "1>2" b=>{LONG}</p></article>') == ONE


def test_formulas_and_lists_of_links_are_an_articles_text():
    page = f"<article><p>{LONG}</p><p>The <math><mi>x</mi><mo>+</mo><mn>1</mn><annotation>tex</annotation></math>.</p><ul><li><a href=/a>One of them</a></li></ul><p>{LONG}</p></article>"
    assert main_text(page) == f"{ONE}\n\nThe x+1.\n\nOne of them\n\n{ONE}"


@pytest.mark.parametrize("wrap", ["<form id=f>{}</form>", '<div class="layout has-sidebar">{}</div>'])
def test_wrapped_pages_of_the_table(spark, wrap):
    """The table's pages within a layout of a region's name have the same text."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    for page in filter(None, pages):
        if page.count("<body") == page.count("</body>") == 1:
            start = page.index(">", page.index("<body")) + 1
            assert main_text(page[:start] + wrap.replace("{}", page[start : page.index("</body>")]) + "</body></html>") == main_text(page)


def test_broken_markup():
    assert main_text("<main>plain < text & more") == "plain < text & more"
    assert main_text("<article><p>open <b>never <i>closed") == "open never closed"
    assert main_text("<script>alert(1)") == "" and main_text("") == "" and main_text("<p>   </p>") == ""


def test_min_cut_is_least():
    rng = random.Random(3)
    for _ in range(500):
        n = rng.randint(1, 7)
        costs = [rng.uniform(-1, 1) for _ in range(n)]
        edges = {(i, j): rng.uniform(0, 0.8) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5}
        cost = lambda x: sum(max(0, -c) if k else max(0, c) for k, c in zip(x, costs, strict=True)) + sum(w for (i, j), w in edges.items() if x[i] != x[j])  # noqa: B023, E731
        assert abs(cost(min_cut(costs, edges)) - min(map(cost, itertools.product([False, True], repeat=n)))) < 1e-9


def test_table(spark):
    rows = [(1, "u", PAGE, "x", 1), (1, "u", PAGE, "x", 1), (None, None, None, "x", 2), (2**60 + 1, "v", "", "x", 3), (4, "w", "<p>" + "word " * 200_000 + "</p>", "x", 4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    out = {r.page_id: r for r in extract(pages).collect()}
    assert out[1].text == main_text(PAGE) and out[1].n_chars == len(out[1].text)
    assert out[None].text == "" and out[2**60 + 1].n_chars == 0 and out[4].n_chars == 999_999
    assert extract(pages).count() == 5 and extract(pages.limit(0)).count() == 0


def test_whole_table_by_its_known_markup(spark):
    """The pages' articles hold headings and paragraphs alone, so their text is known from the markup."""
    import html
    import re

    from veilspark.llm.html_extract import op1_html

    sf = "/root/testdata/sf0.001"
    got = {r.page_id: r.text for r in op1_html(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inside = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1].replace("<br>", " ")
        blocks = (" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1|footer)[^>]*>", inside))
        assert got[r.page_id] == "\n\n".join(x for x in blocks if x)
