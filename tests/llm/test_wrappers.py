"""Main text of pages whose wrappers have unlikely names, and of lists of links inside the article."""

import pytest

from pagewell.llm.extraction import main_text

TEXT = [f"Paragraph {i}, with commas, and a sentence that is long enough to count as prose." for i in range(6)]
BODY = "".join(f"<p>{t}</p>" for t in TEXT)
SIDE = "<div class='sidebar'><p>Side text, with commas, long enough to be taken for prose.</p></div>"
NAMES = ["content has-sidebar", "no-sidebar", "with-comments", "page-header-fixed", "social-science", "legal", "widget"]


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("kind", ["class", "id"])
@pytest.mark.parametrize("inner", [BODY, f"<article>{BODY}</article>", f"<main>{BODY}</main>", f"<div>{BODY}</div>"])
def test_wrapper_of_the_article_is_kept(name, kind, inner):
    page = f"<html><body><nav><a href=/>Home</a></nav><div {kind}='{name}'>{inner}{SIDE}</div><footer>us</footer></body>"
    assert main_text(page).split("\n") == TEXT


@pytest.mark.parametrize("form", ["<form id=aspnet>{}</form>", "<div role=form>{}</div>", "<form class=page-header-fixed>{}</form>"])
def test_form_around_the_page_is_kept(form):
    page = form.format(f"<input name=q><label>Find</label><div>{BODY}</div>{SIDE}")
    assert main_text(f"<body>{page}</body>").split("\n") == TEXT
    small = "<form><p>Leave your mail, please, and we will write to you every week.</p></form>"
    assert main_text(f"<body><div>{BODY}{small}</div></body>").split("\n") == TEXT


def test_small_article_in_a_wrapper():
    long = "".join(f"<p>{t}</p>" for t in TEXT * 3)
    page = f"<body><div class=with-comments><article>{BODY}</article></div><div class=x><div>{long}</div></div></body>"
    assert main_text(page).split("\n") == TEXT


def test_blocks_that_are_all_called_alike():
    page = "<body><div>" + "".join(f"<div class='builder-widget'><p>{t}</p></div>" for t in TEXT) + "</div></body>"
    assert main_text(page).split("\n") == TEXT


def test_threads_and_cards_stay_out():
    says = "<p>I think, you know, that this comment is long, with commas, and more words.</p>" * 20
    cards = "<div class=related>" + "<article><p>Another story, short, teased here.</p></article>" * 3 + "</div>"
    assert main_text(f"<body><div><div>{BODY}</div><div id=comments>{says}</div></div></body>").split("\n") == TEXT
    assert main_text(f"<body><article>{BODY}</article><div class='reactions'>{says}</div></body>").split("\n") == TEXT
    assert main_text(f"<body><div>{BODY}</div>{cards}</body>").split("\n") == TEXT


@pytest.mark.parametrize("tag", ["article", "div", "body"])
def test_lists_of_links_inside_the_article_are_kept(tag):
    refs = "<ul><li><a href=/a>First reference</a></li><li><a href=/b>Second reference</a></li></ul>"
    table = "<table><tr><td><a href=/c>Linked cell</a></td></tr></table>"
    want = [*TEXT, "First reference", "Second reference", "Linked cell"]
    assert main_text(f"<{tag}>{BODY}{refs}{table}</{tag}>").split("\n") == want
