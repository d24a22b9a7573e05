from __future__ import annotations

import pytest

from tallybird.llm.html_text import best_run, extract_text, main_text

PARAGRAPH = "Words that make up a paragraph of the article, one after the other."
PAGES = {
    "article among the rest": (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site name</header>"
        "<nav><ul><li><a href=/>Home</a></li></ul></nav><div class='ad banner'>Buy this thing now, it is very cheap</div>"
        f"<article><h1>Head</h1><p>{PARAGRAPH}</p><aside>see also this and that</aside><p>End.</p>"
        "<form><label>Mail</label><input></form><div class=comments><p>I think this is a long reader comment.</p></div>"
        "</article><footer>&copy; me</footer></body></html>",
        f"Head {PARAGRAPH} End.",
    ),
    "no semantic tags": (
        f"<body><div id='top-menu'><a>One</a> <a>Two</a></div><div id=content><h2>Head</h2><p>{PARAGRAPH}"
        f"<p>{PARAGRAPH}<ul><li>item</ul></div><div class='cookie-notice'>We use cookies on this site</div></body>",
        f"Head {PARAGRAPH} {PARAGRAPH} item",
    ),
    "references and white space": (
        "<article><p>a &amp; b &lt;c&gt; &eacute;&#233;&nbsp;d\n\n  e<b>f</b>g<br>h</p></article>",
        "a & b <c> éé d efg h",
    ),
    "scripts hold no markup": (
        f"<article><script>var x = '<p>no</p></article>';</script><p>{PARAGRAPH}</p><style>a>b</style></article>",
        PARAGRAPH,
    ),
    "left open and cut off": (f"<html><body><article><h1>Head<p><b>{PARAGRAPH}<br><p>{PARAGRAPH[:30]}", f"Head {PARAGRAPH} {PARAGRAPH[:30].strip()}"),
    "straight in the body": (f"<body><nav>a b c</nav><h1>Head</h1><p>{PARAGRAPH}</p><p>End.</p><footer>f</footer></body>", f"Head {PARAGRAPH} End."),
    "quotes and signs": ('<article><p title="a > b">1 < 2 and 3 > 2</p></article>', "1 < 2 and 3 > 2"),
    "hidden": (f"<article><p>{PARAGRAPH}</p><p hidden>no</p><div style='display: none'>no</div></article>", PARAGRAPH),
    "an article is not dropped for its class": (
        f"<article class='post comments-open'><p>{PARAGRAPH}</p></article>", PARAGRAPH,
    ),
    "nor for another": (f"<main id=search><article class='hentry has-share'><p>{PARAGRAPH}</p></article></main>", PARAGRAPH),
    "compound names": (
        f"<article><div id='search-algorithms'><p>{PARAGRAPH}</p></div><div class='notice-board'>Board.</div>"
        "<div class='post-comments'>no</div><div class='SideBar'>no</div></article>",
        f"{PARAGRAPH} Board.",
    ),
    "formulas, buttons and labels": (
        "<article><p>Solve <math><mi>x</mi> = <mn>2</mn></math> now</p><button>Go on</button><label>Here</label>"
        "<form><label>no</label><button>no</button></form></article>",
        "Solve x = 2 now Go onHere",
    ),
    "nothing": ("<nav>a b</nav>", ""),
    "plain": ("just text", "just text"),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    page, wanted = PAGES[name]
    assert main_text(page, {}) == wanted


def test_best_run():
    assert best_run([-1, 2, -1, 3, -5, 4]) == (1, 4)
    assert best_run([-1, -2]) == (0, 0) and best_run([]) == (0, 0)


def test_pages_with_nulls_repeats_and_clashing_names(spark):
    rows = [(1, "u", PAGES["hidden"][0], "x"), (1, "u", PAGES["hidden"][0], "x"), (None, None, None, None), (2, "v", "", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = extract_text(pages)
    assert found.columns == ["page_id", "url", "text"]
    texts = sorted(((r["page_id"], r["text"]) for r in found.collect()), key=repr)
    assert texts == sorted([(1, PARAGRAPH), (1, PARAGRAPH), (None, ""), (2, "")], key=repr)
    assert extract_text(pages.limit(0)).collect() == []


def test_long_page_is_read_whole(spark):
    page = "<article>" + f"<p>{PARAGRAPH}</p>" * 20000 + "</article>"
    pages = spark.createDataFrame([(1, page)], "page_id long, html string")
    assert extract_text(pages).first()["text"] == " ".join([PARAGRAPH] * 20000)


def test_unclosed_quotes_take_linear_time():
    assert main_text("word " + "<p a='" * 20000, {}) == "word"


def test_doubtful_names_follow_the_learned_weight():
    page = f"<article><p>{PARAGRAPH}</p><div class='notice-top'>Perhaps.</div></article>"
    assert main_text(page, {}) == f"{PARAGRAPH} Perhaps."
    assert main_text(page, {"div ?": 1.0}) == f"{PARAGRAPH} Perhaps."
    assert main_text(page, {"div ?": -1.0}) == PARAGRAPH


def test_deep_nesting_takes_linear_time():
    deep = 50_000
    page = "<div>" * deep + f"<p>{PARAGRAPH}" + "<b>x</b></i>" * 2000 + "</div>" * deep
    assert main_text(page, {}).startswith(PARAGRAPH)
    page = "<article>" + "<b>" * deep + "<div>a</div></em>" * 2000 + "</article>"
    assert main_text(page, {}) == " ".join(["a"] * 2000)
