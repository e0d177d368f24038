"""Pages whose markup once hid the whole article."""

import pytest

from wayfield.llm import html_extract

BODY = "The house on the hill is old and it was built by the people of the town for their children and all of the others. " * 2
TEXT = BODY.strip()


@pytest.mark.parametrize(
    "page",
    [
        "<body><select><option>A<option>B</select><article><p>{}</p></article></body>",
        "<body><select><option>A<option>B</select><div><p>{}</p></div></body>",
        "<body><svg><path><div><p>{}</p></div></body>",
        "<body><audio src=x><article><p>{}</p></article></body>",
        "<body><form action=x><input><div><p>{}</p></div></body>",
        "<body><form action=x><input type=hidden><article><p>{}</p></article><button>Go</button></form></body>",
        "<body><form action=x><div><p>{}</p></div><label>Name</label></form></body>",
        "<body><div class='has-sidebar'><article><p>{}</p></article></div></body>",
        "<body><div class='no-sidebar'><main><p>{}</p></main><div class='menu'><p>" + BODY + "</p></div></div></body>",
        "<html><head><title>T</title><article><p>{}</p></article></html>",
    ],
)
def test_article_is_kept(page):
    assert html_extract.extract(page.format(BODY)) == TEXT


def test_what_stays_out():
    comments = f"<div id='comments'><article class='comment-body'><p>{BODY}</p></article></div>"
    teaser = f"<div class='related'><article><p>{BODY}</p></article></div>"
    assert html_extract.extract(f"<article><p>{BODY}x</p></article>{comments}{teaser}") == f"{BODY}x"
    assert html_extract.extract(f"<article><p>{BODY}x</p><form><label>Name</label><input><p>Sign up</p></form></article>") == f"{BODY}x"
