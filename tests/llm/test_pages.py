"""Main text of labelled pages: names of classes, forms, entities, depth."""

import time

import pytest

from promolens.llm import html

TITLE = "How the old mill was moved"
PARAGRAPHS = [
    "The mill stood by the river for two hundred years, and nobody in the village thought that it would ever be moved.",
    "Then the road was widened, a bridge was planned, and the council, after long talks, decided to take it down stone by stone.",
    "Each of the stones got a number & a place; the wheel alone took three days, four carts and most of the volunteers.",
    "Today it grinds again, half a mile downstream, on Sundays and for school classes.",
]
BODY = f"<h1>{TITLE}</h1>" + "".join(f"<p>{p.replace('&', '&amp;')}</p>" for p in PARAGRAPHS)
TEXT = "\n\n".join([TITLE, *PARAGRAPHS])
NOISE = {
    "menu": "<ul class='nav-menu'>" + "".join(f"<li><a href='/{k}'>Topic {k}</a></li>" for k in range(12)) + "</ul>",
    "sidebar": "<div id='sidebar-left'><h3>Most read</h3><p>A neighbour's dog, a parade, and the price of bread, all in one place this week.</p></div>",
    "comments": "<div id='post-comments'>" + "".join(f"<div class='comment-body'><p>Reader {k} says that, all in all, the mill was nicer where it stood before, and so on.</p></div>" for k in range(30)) + "</div>",
    "cookie": "<div class='cookie-notice'><p>We use cookies, and you may accept them, or not.</p><button>OK</button></div>",
    "newsletter": "<form class='newsletter-signup'><label>Your mail</label><p>Get the news each week, for nothing, in your inbox.</p><input name='m'></form>",
    "footer": "<footer><p>All rights reserved, the publisher, some street, some town.</p></footer>",
    "related": "<section class='related-posts'>" + "".join(f"<p><a href='/{k}'>Another story, about something else, number {k}</a></p>" for k in range(5)) + "</section>",
    "advert": "<div class='ad-slot-2'><p>Buy two, get three, only this week, in all our shops.</p></div>",
}
CONTAINERS = [
    "content has-sidebar", "overflow-hidden", "elementor-widget-container", "no-comments post", "single-post share-enabled", "col ads-free", "entry-content", "post with-comments",
    "layout--sidebar-right", "page-with-sidebar", "td-post-content tagdiv-type share", "widget", "menu-page", "modal-open-target", "c-article__body u-hidden-print", "promo-enabled story",
    "newsletter-template-default", "no-sidebar", "is-subscribed", "site-main has-navigation", "hidden-xs-print", "article-social-wrapper", "post-related-enabled",
]


def page(container, noise):
    before = "".join(NOISE[x] for x in noise if x in ("menu", "cookie", "advert"))
    after = "".join(NOISE[x] for x in noise if x not in ("menu", "cookie", "advert"))
    return f"<html><head><title>t</title></head><body class='home no-sidebar'>{before}<div {container}>{BODY}</div>{after}</body></html>"


@pytest.mark.parametrize("name", CONTAINERS)
@pytest.mark.parametrize("kind", ["class", "id"])
def test_names_of_containers_keep_the_article(name, kind):
    noise = ["menu", "cookie", "sidebar", "comments", "newsletter", "footer", "related", "advert"]
    for some in ([], noise, noise[:3], ["comments"]):
        assert html.main_text(page(f'{kind}="{name}"', some)) == TEXT


def test_containers_without_a_heading():
    for name in CONTAINERS:
        source = f"<body>{NOISE['menu']}<div class='{name}'>{BODY.replace('h1', 'h2')}</div>{NOISE['footer']}</body>"
        assert html.main_text(source) == TEXT


@pytest.mark.parametrize("noise", sorted(NOISE))
def test_noise_is_left_out(noise):
    assert html.main_text(page("class='story'", [noise])) == TEXT
    inside = f"<body><article>{BODY}{NOISE[noise]}</article></body>"
    assert html.main_text(inside) == TEXT


def test_form_around_the_whole_page():
    form = f"<body><form action='/x'><input type='hidden' name='s'>{NOISE['menu']}<div>{BODY}</div><select><option>Pick one</select>{NOISE['footer']}</form></body>"
    assert html.main_text(form) == TEXT
    assert html.main_text(f"<body><div>{BODY}</div><form><p>Write to us, we answer soon.</p><textarea>x</textarea></form></body>") == TEXT


def test_suspicions():
    strong = "sidebar sidebar-left post-comments comment comments-area cookie-banner nav main-navigation footer-widgets2 ad ad-slot-3 related-posts newsletter-box breadcrumb".split()
    none = "has-sidebar no-comments overflow-hidden with-nav content story entry".split()
    faint = "share-enabled ads-free elementor-widget-container widget sidebar-active-story".split()
    assert {x for x in strong if html.suspicion(x) != html.STRONG} <= {"footer-widgets2"}
    assert all(html.suspicion(x) == html.NONE for x in none) and all(html.suspicion(x) == html.FAINT for x in faint)


def test_references_are_decoded_in_each_piece():
    assert html.main_text("<div><p>A&<b>amp;</b> and &lt;b&gt; &#x41;</p></div>") == "A&amp; and <b> A"


@pytest.mark.parametrize("make", [
    lambda n: "<td>" + "<b>" * n + "<li>x</li>" * n,
    lambda n: "<b>" * n + "<hr>y" * n,
    lambda n: "<div class='sidebar x'>" * n + "text, " * n,
    lambda n: "<table><tr>" + "<td>z<dl>" * n + "<dd>q" * n,
    lambda n: "<p>some text, here" * n + "</a>" * n,
    lambda n: "<a>" * n + "<p>k</p>" * n,
])
def test_deep_pages_take_linear_time(make):
    """About 1 MB each; the time of a tenth of it, tenfold, with room for a slow machine."""
    n = 1_000_000 // len(make(1))
    times = []
    for k in (n // 10, n):
        source = make(k)
        began = time.process_time()
        html.main_text(source)
        times.append(time.process_time() - began)
    assert times[1] < 30 * max(times[0], 0.05)


def test_words_of_labelled_pages():
    """Precision and recall over all containers and pairs of noise, by words."""
    hit = given = wanted = 0
    for name in CONTAINERS:
        for x in NOISE:
            for y in NOISE:
                got, want = html.main_text(page(f"class='{name}'", [x, y])).split(), TEXT.split()
                given, wanted = given + len(got), wanted + len(want)
                hit += len(want) if got[: len(want)] == want or got == want else len(set(got) & set(want))
    assert hit / given > 0.98 and hit / wanted > 0.99
