"""Pages whose text is split into sibling blocks, with and without an article."""

import pytest

from tarnlake.llm import op8_html

SHELL = "<body><header><a href=/>Site</a></header><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav>{}<footer><a href=i>Imprint</a></footer></body>"
LINKS = "<div class=more>" + "".join(f"<div><a href=x{i}>Read on {i}</a></div>" for i in range(12)) + "</div>"


def paragraphs(name, n, words):
    return [f"{name}{i} " + "some words of running text " * words + "end." for i in range(n)]


def html(texts):
    return "".join(f"<p>{t}</p>" for t in texts)


@pytest.mark.parametrize("words", [8, 7, 4])
@pytest.mark.parametrize("outer", ["<div id=content>{}</div>", "<article>{}</article>", "<main>{}</main>"])
def test_sibling_wrappers_are_all_kept(outer, words):
    one, two = paragraphs("a", 10, 8), paragraphs("b", 10, words)
    page = SHELL.format(outer.format(f"<h1>Title</h1><div class=p1>{html(one)}</div><h2>Part</h2><div class=p2>{html(two)}</div>" + LINKS))
    assert op8_html.main_text(page) == "\n".join(["Title", *one, "Part", *two])


def test_loose_text_between_wrappers_is_kept():
    one, two = paragraphs("a", 10, 8), paragraphs("b", 6, 8)
    page = SHELL.format(f"<div><div>{html(one)}</div>Loose <b>bold</b> words <a href=x>here</a>.<p>Short.</p><div>{html(two)}</div></div>")
    assert op8_html.main_text(page) == "\n".join([*one, "Loose bold words here.", "Short.", *two])


def test_short_text_of_an_article_is_kept():
    one = paragraphs("a", 10, 8)
    page = SHELL.format(f"<article><div class=lead>Short lead.</div><div>{html(one)}</div><section><h2>Note</h2><p>Few words.</p></section>{LINKS}</article>")
    assert op8_html.main_text(page) == "\n".join(["Short lead.", *one, "Note", "Few words."])
