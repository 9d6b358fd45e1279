"""Main text of pages whose markup does not end, or not where it should."""

import time

import pytest

from pagewell.llm.extraction import main_text

TEXT = [f"Paragraph {i}, with commas, and a sentence that is long enough to count as prose." for i in range(6)]
BODY = "".join(f"<p>{t}</p>" for t in TEXT)


@pytest.mark.parametrize(
    "tail",
    ["<!-- note <p>left</p></article>", "<a href='x' class='y", "</article", "<!doctype x", "<?php echo 1", "<![CDATA[ x ", "<![ x"],
)
def test_markup_without_an_end_is_no_text(tail):
    assert main_text(f"<article>{BODY}{tail}").split("\n") == TEXT


@pytest.mark.parametrize(
    "inner",
    ["<!-->", "<!--->", "<!-- a --!>", "<![if x]>", "<![ x ]>", "<![CDATA[ a > b ]]>", "<?xml version='1'?>", "<!x>"],
)
def test_odd_declarations_hide_no_text(inner):
    assert main_text(f"<article>{inner}{BODY}</article>").split("\n") == TEXT


def test_unbalanced_quotes():
    side = "<div class=\"sidebar\"\"x\"><p>Side text, with commas, long enough to be prose.</p></div>"
    assert main_text(f"<body><div class='a\"><div>{BODY}</div>{side}</div></body>").split("\n") == TEXT
    assert main_text(f"<body><div>{BODY}{side}</div></body>").split("\n") == TEXT


def test_comment_marks_in_scripts():
    assert main_text(f"<article><script><!-- if (a < b) x();</script>{BODY}</article>").split("\n") == TEXT


def test_lead_paragraph_ahead_of_the_article():
    lead = "A lead, which stands ahead of the article in the same container, and is part of what it says."
    after = "A note that follows the article, in the same container, and that is not a part of the article."
    page = f"<div><p>{lead}</p>\n<article>{BODY}</article><p>{after}</p></div>"
    assert main_text(page).split("\n") == [lead, *TEXT]


@pytest.mark.parametrize("piece", ["<!--", "<a ", "<a b='", "</", "<!", "<?", "<![", "<![CDATA[", "<script", "<p", "<", "&", "<a b=\"<!--"])
def test_time_is_linear(piece):
    start = time.monotonic()
    main_text(BODY + piece * (2_000_000 // len(piece)))
    assert time.monotonic() - start < 20
