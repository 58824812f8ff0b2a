import pytest
from awkward import CLASHING
from pyspark.sql import functions as F

from tallyloom.llm.pages import extract, main_text
from tallyloom.sources.tables import table

ARTICLE = "<article><h1>Title &amp; more</h1><p>First  paragraph\nwith <b>bold</b> text.<p>Oh.</p>{}<p>Last &eacute;</p></article>"
WANTED = "Title & more\nFirst paragraph with bold text.\nOh.\nLast é"
AROUND = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
    "<body><nav><ul><li><a href=/>Home</a></li></ul></nav><!-- <p>no</p> --><div class='ad'>Buy this now, it is cheap.</div>"
    "<aside>About us</aside>{}<div id=comments><p>I disagree with all of it.</p></div><footer>&copy; us</footer></body></html>"
)


@pytest.mark.parametrize(
    "inside",
    ["", '<div class="advert-box">Buy</div>', "<form><input><button>Go</button></form>", "<aside>x<p>y</aside>",
     "<script>if (a < b) { c('<p>') }</script>", '<section class="comment-list"><p>Nice!</section>',
     "<!-- c --><p> </p>", '<div style="display: none">secret</div>', "<template><p>t</p></template>"],
)
def test_the_article_and_nothing_else(inside):
    assert main_text(AROUND.format(ARTICLE.format(inside))) == WANTED


def test_without_an_article_the_dense_lines_stay():
    body = "".join(f"<p>{'A sentence of the story goes on here. ' * 5}</p>" for _ in range(6))
    page = AROUND.format(f"<div class='content'>{body}</div>" + "<a>x</a><br>" * 3)
    assert main_text(page).count("A sentence") == 30
    assert "Home" not in main_text(page) and "disagree" not in main_text(page)


@pytest.mark.parametrize("html", ["", "<", "<p", "</p></div>", "<!-- open", "<script>x", "<div class='ad'>only", "<p></p>"])
def test_nothing_to_find(html):
    assert main_text(html) in ("", "<", "<p")


@pytest.mark.parametrize(
    "before, after",
    [("", "<aside><article><p>A teaser</p></article></aside>"),
     ("<aside><article>Another teaser</article></aside>", ""),
     ("", "<div id='readerComments'><article><p>I do not agree</p></article></div>"),
     ("<div class='page has-sidebar'>", "</div>"), ("<div class='ad'>", ""), ("<div class='content-with-sidebar'>", "")],
)
def test_other_articles_and_open_wrappers(before, after):
    assert main_text(AROUND.format(before + ARTICLE.format("") + after)) == WANTED


def test_unclosed_tags_and_long_pages():
    assert main_text("<html><head><title>t<body><article><p>a<b>b<p>c") in ("ab\nc", "")
    many = "<b>" * 20_000 + "<p>x</p>" * 20_000
    assert main_text(f"<article>{many}</article>") == "\n".join(["x"] * 20_000)


def test_pages_of_the_table(spark):
    pages = table(spark, "/root/testdata/sf0.001", "pages")
    html = {r.page_id: r.html for r in pages.collect()}
    for r in extract(pages).collect():
        assert r.n_chars == len(r.text) > 0
        inner = html[r.page_id].split("<article>")[1].split("</article>")[0]
        assert r.text.replace("\n", " ").split()[0] in inner.replace("&amp;", "&")
        assert "<" not in r.text and "&amp;" not in r.text


def test_awkward_rows(spark):
    rows = [(1, "u", None), (None, None, ""), (2, "u", AROUND.format(ARTICLE.format(""))), (2, "u", AROUND.format(ARTICLE.format("")))]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    df = df.withColumns({n: F.lit("mine") for n in [*CLASHING, "text", "n_chars"]})
    got = sorted(((r.page_id or 0, r.text, r.n_chars) for r in extract(df).collect()))
    assert got == [(0, "", 0), (1, "", 0), (2, WANTED, len(WANTED)), (2, WANTED, len(WANTED))]
    assert extract(df.filter("false")).count() == 0


def paragraphs(*sizes):
    words = "abcdefghi "
    return [(f"{i} " + words * n)[:n].strip() for i, n in enumerate(sizes)]


def plain_page(texts, tag="p"):
    body = "".join(f"<{tag}>{t}</{tag}>" for t in texts)
    return f"<html><body><nav><a>Home</a></nav><div>{body}</div><footer>us</footer></body></html>"


@pytest.mark.parametrize(
    "sizes",
    [(80, 120, 90, 100, 30_000, 110, 95, 130, 70, 100), (*[60] * 10, *[800] * 6, *[40] * 8), (*[400] * 10, *[35] * 6),
     (*[35] * 6, *[400] * 10), (2000,), (20, 20), (5000, *[30] * 4, 5000)],
)
def test_no_line_of_the_article_is_lost(sizes):
    texts = paragraphs(*sizes)
    assert main_text(plain_page(texts)).split("\n") == texts
    assert main_text(plain_page(texts, "li")).split("\n") == texts


STORY = "".join(f"<p>{t}</p>" for t in paragraphs(300, 400, 500, 350))
WHOLE = "\n".join(paragraphs(300, 400, 500, 350))


@pytest.mark.parametrize(
    "page",
    ["<div>{}</div><article><h3>Teaser</h3><p>Read this too, it is new.</p></article>",
     "<article><p>Read this too.</p></article><div>{}</div><article><p>And this one.</p></article>",
     "<main><div>{}</div><article><p>Teaser in main.</p></article></main>",
     "<main><article>{}</article><article><p>Teaser beside it.</p></article></main>",
     "<article>{}<article><p>A reader replied.</p></article></article>",
     "<ul><li><a href=/>Start page</a></li><li><a href=/>All the news</a></li><li><a href=/>Weather and traffic</a></li>"
     "<li><a href=/>Sports</a></li></ul><div>{}</div><ul>" + "<li><a href=/>More to read here</a></li>" * 5 + "</ul>"],
)
def test_the_story_and_not_what_stands_beside_it(page):
    assert main_text(f"<html><body>{page.format(STORY)}</body></html>") == WHOLE


def test_all_articles_of_a_list_of_articles():
    articles = "".join(f"<article><p>{t}</p></article>" for t in paragraphs(300, 400, 500))
    assert main_text(f"<body><main>{articles}</main></body>") == "\n".join(paragraphs(300, 400, 500))


@pytest.mark.parametrize(
    "kept",
    ['<section id="related-work"><h2>Related work</h2><p>Others did it.</p></section>', '<h2 id="search-methods">Search methods</h2>',
     '<p class="notice-period">Three months.</p>', "<p>As <math><mi>x</mi><mo>=</mo><mn>2</mn></math> says.</p>",
     '<div id="comments-on-method"><p>It is sound.</p></div>', '<section id="search"><h2>Search</h2><p>Breadth first.</p></section>',
     '<h3 id="menu">Menu</h3><p>Soup and fish.</p>'],
)
@pytest.mark.parametrize("page", ["<article>{}{}</article>", "<div>{}{}</div>"])
def test_titles_that_sound_like_surroundings_stay(kept, page):
    if 'class="notice-period"' in kept and "article" not in page:
        return  # outside an article any word of a class counts
    text = main_text(f"<body>{page.format(STORY, kept)}</body>")
    left = text.removeprefix(WHOLE)
    assert left and " ".join(left.split()) == " ".join(" ".join(__import__("re").sub("<[^>]*>", " ", kept).split()).replace("x = 2", "x=2").split())


@pytest.mark.parametrize(
    "gone",
    ['<section id="comments"><h2>Comments</h2><p>I agree.</p></section>', '<div class="reader-comments">No!</div>',
     '<div class="share-buttons">Share</div>', '<div id="related"><h2>Related</h2><p>More</p></div>', "<noscript>Switch it on</noscript>",
     '<div class="cookie-notice">We use them</div>', '<p class="sidebarBox">Box</p>', "<textarea>write here</textarea>"],
)
def test_surroundings_inside_go(gone):
    assert main_text(f"<body><article>{STORY}{gone}</article></body>") == WHOLE


def stretch_by_hand(lengths):
    """Every window looked at on its own."""
    def middle(values):
        values = sorted(v for v in values if v)
        half = len(values) // 2
        return values[half] if len(values) % 2 else (values[half - 1] + values[half]) / 2

    weights = [min(n, 4 * middle(lengths)) for n in lengths]
    windows = {}
    for start in range(-2, len(lengths)):
        windows[start] = sum(weights[i] for i in (start, start + 1, start + 2) if 0 <= i < len(lengths))
    good = [s for s, n in windows.items() if n >= 0.05 * middle(windows.values())]
    inside = [i for i in range(len(lengths)) if lengths[i] and any(s <= i <= s + 2 for s in (good[0], good[-1])) or
              lengths[i] and good[0] <= i <= good[-1] + 2]
    return min(inside), max(inside) + 1


def test_windows_by_hand_on_the_table(spark):
    """Surge and dive of every page, its boxes left aside, against windows summed one by one."""
    from tallyloom.llm.pages import lines_of, stretch

    pages = table(spark, "/root/testdata/sf0.01", "pages").collect()
    texts = {r.page_id: r.text for r in extract(spark.createDataFrame(pages)).collect()}
    for r in pages:
        lines, kinds = lines_of(r.html)
        lengths = [0 if line.chrome else max(0, len(line.text) - line.linked) for line in lines]
        first, last = stretch(lengths)
        assert (first, last) == stretch_by_hand(lengths)
        assert texts[r.page_id].split("\n") == [x.text for x in lines[first:last] if not x.chrome]
        assert kinds == ["article"]


def test_stretch_of_any_lengths():
    import random

    from tallyloom.llm.pages import stretch

    dice = random.Random(4)
    for _ in range(500):
        lengths = [dice.choice([0, 0, 5, 30, 200, 3000]) for _ in range(dice.randrange(1, 30))]
        if any(lengths):
            assert stretch(lengths) == stretch_by_hand(lengths)
