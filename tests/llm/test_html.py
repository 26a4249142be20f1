"""Main text: pages by hand, odd markup, and the density formula on a tiny tree."""

import math

import pytest

from quernel.llm import html_density as h

BODY = "Words of the story that go on for a while, with commas and more of them."
PAGE = f"""<!doctype html><html><head><title>T</title><style>p{{margin:0}}</style><script>var a="</p><article>";</script></head><body>
<header><a href=/>Home</a> Site name</header><nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav>
<div class="cookie-notice">We use cookies, do you agree? Please agree, it is a long notice with text.</div>
STORYHERE
<div id="comments"><p>First! {BODY}</p><p>Second {BODY}</p></div><aside>Related: <a href=3>x</a></aside>
<form><label>Mail</label><input name=q><button>Go</button></form><footer>&copy; all</footer></body></html>"""
STORY = f"<h1>Head &amp; line</h1><p>{BODY}<p>Two&nbsp;  &#228;\n<b>bold</b> te<i>xt</i><br>more {BODY}</p><ul><li>item one, {BODY}<li>item two, {BODY}</ul>"
WANT = f"Head & line\n{BODY}\nTwo ä bold text more {BODY}\nitem one, {BODY}\nitem two, {BODY}"


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", "<div class=wrap><div id=content>{}</div></div>", "<table><tr><td><a href=1>m</a></td><td>{}</td></tr></table>"])
def test_story_without_the_rest(wrap):
    got = h.extract(PAGE.replace("STORYHERE", wrap.format(STORY)))
    assert got == WANT


def test_link_lists_within_the_frame_go():
    links = "<div>" + "".join(f"<a href={i}>Link number {i}</a> " for i in range(30)) + "</div>"
    assert h.extract(f"<body><div>{links}<div>{STORY}</div></div></body>") == WANT


@pytest.mark.parametrize("page", [None, "", "   ", "<html></html>", "<p></p>", "<script>x</script>", "<", "<<<>>>&;", "</p></div>"])
def test_nothing_to_extract(page):
    assert h.extract(page) in ("", "<", "<<<>>>&;", "<<>>&;", "<<>&;")


def test_broken_and_extreme_pages():
    assert h.extract("<body><article><p>cut off in the mid") == "cut off in the mid"
    deep = "<div>" * 5000 + "deep text" + "</div>" * 5000
    assert h.extract(f"<body>{deep}</body>") == "deep text"
    long = "word " * 200_000
    assert h.extract(f"<article><p>{long}</p></article>") == long.strip()
    assert h.extract("<article><p title='a>b'>x</p><!-- <p>no</p> --><p>y</article>") == "x\ny"


def test_density_formula():
    dom = h.parse("<body><p>abcdef<a>gh</a></p></body>")
    density, sums, chars, linked = h.densities(dom, [False] * len(dom.name))
    body = dom.name.index("body")
    assert (chars[body], linked[body]) == (8, 2)
    base = math.log(8 * 2 / 6 + 2 * 8 / 8 + math.e)
    assert density[body] == pytest.approx(8 / 2 * math.log(8 * 2 / (2 * 1)) / math.log(base))
    assert sums[body] == pytest.approx(density[dom.name.index("p")])


def test_table(spark):
    rows = [(1, "u", PAGE.replace("STORYHERE", f"<article>{STORY}</article>"), 5), (1, "u", PAGE.replace("STORYHERE", f"<article>{STORY}</article>"), 5), (2, None, None, 6), (None, "v", "", 7)]
    got = h.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "", 0), (1, WANT, len(WANT)), (1, WANT, len(WANT)), (2, "", 0)]
    assert h.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


ARTICLE = "".join(f"<p>Paragraph {i} of the article, with enough words to be text.</p>" for i in range(4))
BODY = "\n".join(f"Paragraph {i} of the article, with enough words to be text." for i in range(4))


def test_a_word_of_a_class_alone_removes_nothing_from_an_article():
    for more, text in (
        ('<div class="search"><p>How the search went on.</p></div>', "How the search went on."),
        ('<p class="comment">A comment by the author.</p>', "A comment by the author."),
        ('<h2 id="related">Related work</h2>', "Related work"),
        ('<ul><li class="menu">Soup and fish on the menu</li></ul>', "Soup and fish on the menu"),
        ('<p>On <span class="notice">this</span> day.</p>', "On this day."),
    ):
        assert h.extract(f"<body><article>{ARTICLE}{more}</article></body>") == f"{BODY}\n{text}"
    assert h.extract(f'<body><div class="search sidebar">{ARTICLE}</div></body>') == BODY
    assert h.extract(f'<body class="nav"><div id="widget"><main>{ARTICLE}</main></div></body>') == BODY


def test_noise_within_and_around_an_article():
    for noise in (
        '<div class="ad">Buy things now.</div>', '<p class="advert">Buy things now.</p>', '<aside>More on this</aside>', '<div class="cookie-notice"><p>We use cookies here.</p></div>',
        '<section id="comments"><h3>Comments</h3><div class="comment"><p>First!</p></div><div class="comment"><p>I disagree.</p></div></section>',
        '<div><div class="comment"><p>First!</p></div><div class="comment"><p>I disagree.</p></div></div>',
        '<div class="search"><form><input name="q">Find</form></div>', '<div class="related"><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></div>',
        '<p class="share"><a href="/x">Send this</a></p>', "<div hidden>Nothing to see</div>",
    ):
        assert h.extract(f"<body><article>{ARTICLE}{noise}</article></body>") == BODY, noise
        assert h.extract(f"<body><article>{ARTICLE}</article>{noise}</body>") == BODY, noise


def test_depth_and_stray_tags_take_linear_time():
    import time

    def seconds(page):
        began = time.process_time()
        h.extract(page)
        return time.process_time() - began

    deep = lambda n: "<article>" + "<div class=x><b>" * n + "text" + "</i></div>" * n
    stray = lambda n: "<b><table><tr><td>" + "<div>" * n + "</b></p></span>" * n
    for page in (deep, stray):
        assert seconds(page(40_000)) < 12 * max(0.05, seconds(page(8_000)))
