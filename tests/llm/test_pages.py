"""Pages with planted parts that are no article text, and markup that never closes."""

import random
import time

import pytest

from graphloom.llm import html_text

PARAGRAPH = "<p>The council of the town has decided to build a new library in the old market hall, and the work is to begin in the spring of the next year.</p>"
NOTICE = "Subscribe now to get all of our news and offers in your inbox every single morning of the week, and never miss one again."
NAMED = ("footer-content", "cookie-content", "modal-body", "modal-content", "newsletter-body", "nav-content", "advert-text", "popup-content", "widget-content", "notice-text", "promo-content", "reply-content", "comments", "sidebar")


@pytest.mark.parametrize("around", ["article", "main", "div", "section"])
def test_holders_inside_a_text_are_left_out_and_the_text_is_kept(around):
    for holder in ("aside", "nav", "form", "footer", "button", "div hidden", "div style='display: none'", "div aria-hidden=true", *(f"div class='{n}'" for n in NAMED)):
        page = f"<html><body><{around}>{PARAGRAPH * 3}<{holder}>{NOTICE}</{holder.split()[0]}>{PARAGRAPH}</{around}></body></html>"
        text = html_text.main_text(page)
        assert text.count("council") == 4 and "Subscribe" not in text, holder


def test_an_article_that_is_a_teaser_does_not_hide_the_text():
    assert html_text.main_text(f"<body><div>{PARAGRAPH * 9}</div><article><p>{NOTICE}</p></article></body>").count("council") == 9


@pytest.mark.parametrize("wrapper", ["form action=x", "fieldset", "div class='left-side'", "div id=modal", "div class='page-overlay'"])
def test_what_wraps_a_whole_page_is_no_reason_to_drop_it(wrapper):
    assert html_text.main_text(f"<body><{wrapper}>{PARAGRAPH * 6}</{wrapper.split()[0]}></body>").count("council") == 6


def test_readers_comments_go_even_where_they_are_most_of_the_page():
    assert html_text.main_text(f"<body><article>{PARAGRAPH}<div class=comments>{('<p>' + NOTICE + '</p>') * 30}</div></article></body>").count("Subscribe") == 0


@pytest.mark.parametrize("attributes", ['title="a hidden gem of the town"', 'class="col hidden wide"', 'data-x="display:none"', "title='x > hidden'"])
def test_only_attributes_hide_and_not_their_values(attributes):
    assert html_text.main_text(f"<body><article>{PARAGRAPH}{PARAGRAPH.replace('<p', '<p ' + attributes)}</article></body>").count("council") == 2


@pytest.mark.parametrize("page", ["<div>" * 90_000 + "</p>" * 90_000, "<center>" * 90_000 + "</li>" * 90_000, "<li><ul>" + "<center>" * 90_000 + "<li>" * 90_000, "<p>x" * 200_000, "<form>" * 90_000 + "x" + "</form>" * 90_000, "<a href='" * 90_000, '<p title="' * 90_000])
def test_a_megabyte_of_unclosed_markup_takes_seconds(page):
    began = time.perf_counter()
    html_text.main_text(page)
    assert time.perf_counter() - began < 20


def test_random_markup_never_raises():
    rng = random.Random(1)
    tags = "article main div p li ul ol table tr td th form aside nav footer header h1 h2 a br span button script style section svg select option dl dt dd pre".split()
    for _ in range(10_000):
        pieces = [f"<{rng.choice(tags)}>", f"</{rng.choice(tags)}>", "text of a few words ", PARAGRAPH, NOTICE, "&amp;", "<!--", "-->", "<", '"', "\x00"]
        html_text.main_text("".join(rng.choice([*pieces, f"<{rng.choice(tags)} class='{rng.choice(['comments', 'content', 'ad', 'side', 'x'])}'>"]) for _ in range(rng.randint(1, 40))))
