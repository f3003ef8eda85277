import html as H
import re
import time

import numpy as np

from paddock.llm import html

LONG = "This paragraph is long enough to count as content for sure, and it goes on for a while. " * 3


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{body}</body></html>"


def test_generated_pages(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    got = {r["page_id"]: r for r in html.op7_html_extraction(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(H.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r["page_id"]]["text"] == "\n\n".join(b for b in blocks if b)
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"]) and got[r["page_id"]]["url"] == r["url"]


def test_boilerplate_goes_and_short_paragraphs_stay():
    noise = ("<header>Site name and slogan</header><nav><ul><li><a>Home</a></li></ul></nav><div class='cookie-notice'>" + LONG + "</div>"
             "<aside>" + LONG + "</aside><div id='sidebar'>" + LONG + "</div><form>" + LONG + "</form><div class=\"ad\">" + LONG + "</div>")
    article = f"<article><header><h1>Title &amp; more</h1></header><p>{LONG}<p>Short.</p><ul><li>one<li>two</ul><p>{LONG}</p></article>"
    after = f"<section class='comments'><p>{LONG}</p></section><footer>{LONG}</footer>"
    want = "\n\n".join(["Title & more", LONG.strip(), "Short.", "one", "two", LONG.strip()])
    assert html.main_text(page(noise + article + after)) == want
    assert html.main_text(page(noise + article.replace("</article>", f"<div class=comments>{LONG}</div></article>") + after)) == want
    # without any section element the regions decide
    plain = re.sub(r"</?(article|header)>", "", article)
    assert html.main_text(page(noise + f"<div>{plain}</div>" + after)).endswith(LONG.strip())
    assert "Short." in html.main_text(page(noise + f"<div>{plain}</div>" + after))


def test_white_space_and_references():
    assert html.main_text(page("<article><p>a&nbsp;&nbsp;b\n\t c &lt;i&gt; &#233; &eacute <b>d</b>e<br>f</p></article>")) == "a b c <i> é é de f"
    assert html.main_text(page("<main><p>x<script>no</script>y<!-- no --><![if x]>z<![endif]></p></main>")) == "xyz"


def test_odd_input():
    assert html.main_text(None) == html.main_text("") == html.main_text("<p></p>") == html.main_text("<nav>only</nav>") == ""
    assert html.main_text("no markup at all") == "no markup at all"
    assert html.main_text("<p>unclosed <b>bold<p>next") == "unclosed bold\n\nnext"
    assert html.main_text("</div></p><p>a</p></article>") == "a"
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    assert html.main_text(deep) == "deep"


def test_edge_rows(spark):
    rows = [(1, None, None, "x"), (2, "u", "", "x"), (3, "u", "<p>" + "long words " * 100000 + "</p>", "x"), (3, "u", "<p>a</p>", "x"), (None, "u", "<p>b</p>", "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = html.extract_main_text(pages).collect()
    assert len(got) == 5 and sorted(len(r["text"]) for r in got) == [0, 0, 1, 1, 1099999]
    assert html.extract_main_text(pages.limit(0)).count() == 0


def test_smoothing_matches_the_formula():
    rng = np.random.default_rng(0)
    for n in (2, 5, 30):
        r = rng.exponential(20, n)
        smooth = np.array([sum(r[j] * np.exp(-0.5 * ((i - j) / 1.5) ** 2) for j in range(n) if abs(i - j) <= 5) for i in range(n)])
        smooth /= sum(np.exp(-0.5 * (k / 1.5) ** 2) for k in range(-5, 6))
        assert (html.regions(r) == (smooth >= min(smooth.std(), smooth.mean()))).all()


def test_a_marked_wrapper_does_not_swallow_the_content():
    for name in ("layout has-sidebar", "no-sidebar", "post-with-comments", "content sidebar-left", "widget"):
        assert html.main_text(page(f"<div class='{name}'><article><p>{LONG}</p></article><div class=sidebar>links</div></div>")) == LONG.strip()
        assert html.main_text(page(f"<main><div class='{name}'><article><p>{LONG}</p></article></div></main>")) == LONG.strip()
        assert html.main_text(page(f"<div id='{name}'><p>{LONG}</p><div class=share>Share</div></div>")) == LONG.strip()
    assert html.main_text(page(f"<article><p>{LONG * 3}</p><div class=related><article><p>{LONG}</p></article></div></article>")) == (LONG * 3).strip()


def test_implied_end_tags():
    for head in ("<head><title>t</title><body>", "<head><title>t</title><meta charset=utf-8>", "<head><title>t</title></head><body>"):
        assert html.main_text(f"<html>{head}<p>{LONG}</p><p>Short.") == LONG.strip() + "\n\nShort."
    assert html.main_text("<html><head><title>t</title>plain text") == "plain text"
    assert html.main_text(f"<table><tr><td class=nav>Menu<td><p>{LONG}</p></table>") == LONG.strip()
    assert html.main_text(f"<table><tr><td class=nav><p>Menu</td><td>{LONG}<tr><td>next</table>").endswith(LONG.strip() + "\n\nnext")
    assert html.main_text(f"<ul><li class=share>Share<li>{LONG}<ul><li>inner</ul><li>last</ul>") == LONG.strip() + "\n\ninner\n\nlast"
    assert html.main_text(f"<dl><dt class=social>Share<dd>{LONG}</dl>") == LONG.strip()
    assert html.main_text(f"<p class=notice>Notice<div>{LONG}</div>") == LONG.strip()


def test_all_sections_with_content_are_kept():
    one, two = LONG.strip(), (LONG * 2).strip()
    want = "\n\n".join([two, "Short.", one])
    assert html.main_text(page(f"<nav>menu</nav><article><p>{two}</p></article><article><p>Short.</p><p>{one}</p></article>")) == want
    assert html.main_text(page(f"<main><article><p>{two}</p><article><p>Short.</p></article><p>{one}</p></article></main>")) == want
    lead = page(f"<div>before</div><main><h1>Title</h1><p>Lead.</p><article><p>{two}</p></article></main>")
    assert html.main_text(lead) == "\n\n".join(["Title", "Lead.", two])
    outside = page(f"<article><p>{one}</p></article><div><p>{two}</p><p>{two}</p></div>")
    assert html.main_text(outside) == "\n\n".join([one, two, two])


def test_titles_and_last_lines_without_a_section():
    four = f"<p>{LONG}</p>" * 4
    body = f"<nav>Menu</nav><h1>The Title</h1><p>By A. Writer</p>{four}<p>Short end.</p><p>Fin.</p><div class=footer>foot</div>"
    want = "\n\n".join(["The Title", "By A. Writer", *[LONG.strip()] * 4, "Short end.", "Fin."])
    assert html.main_text(page(body)) == want
    assert html.main_text(page(f"<div class=content>{four}</div><ul><li><a href=/>Home</a><li><a href=/a>About us</a></ul>")) == "\n\n".join([LONG.strip()] * 4)
    story = f"<h1>Story title</h1><p>Lead</p><article><p>{LONG}</p></article>"
    assert html.main_text(page(story)) == "\n\n".join(["Story title", "Lead", LONG.strip()])
    # a heading of the site, with a menu between, is none of the text; nor is a second one
    assert html.main_text(page(f"<h1>Site</h1><nav>Menu</nav><article><p>{LONG}</p></article>")) == LONG.strip()
    assert html.main_text(page(f"<h1>Site</h1><article><h1>Own</h1><p>{LONG}</p></article>")) == "Own\n\n" + LONG.strip()


def test_comments_go_whatever_their_size():
    for name in ("comment-list", "comments", "post replies"):
        assert html.main_text(page(f"<article><p>{LONG}</p><div class='{name}'><p>{LONG * 9}</p></div></article>")) == LONG.strip()
        assert html.main_text(page(f"<div><p>{LONG}</p></div><div class='{name}'><p>{LONG * 9}</p></div>")) == LONG.strip()
    assert html.main_text(page(f"<div class=discussion><p>{LONG}</p></div>")) == LONG.strip()


def test_nesting_costs_linear_time():
    n = 100_000
    for deep in ("<b>" * n + "<p>x" * 2000, "<span>" * n + "</i>x" * 2000, "<b>" + "<i>" * n + "<div>" + "</b>x" * 2000,
                 "<li>" + "<b>" * n + "<li>x" * 2000, "".join(f"<x{k}>" for k in range(n)) + "<p>x" * 2000):
        start = time.process_time()
        assert "x" in html.main_text(deep)
        assert time.process_time() - start < 5
