"""The density decides: against a plain form of the method, with wrong densities, without telling tags, and on broken pages."""

import math
import random
import re
import time

import pyarrow.parquet as pq
import pytest

from tarnlake.llm import op8_html as op

PAGES = [x for x in pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist() if x]


def plain_density(node, body):
    """The method's formula for one node, by walking all that is below it."""

    def walk(x, link):
        for c in x.children:
            if isinstance(c, str):
                n = len(" ".join(c.split()))
                yield n, n * link, 0, 0
            else:
                yield 0, 0, 1, int(c.tag == "a")
                yield from walk(c, link or c.tag == "a")

    def counts(x):
        return [sum(col) for col in zip((0, 0, 0, 0), *walk(x, x.tag == "a"))]

    c, lc, t, lt = counts(node)
    bc, blc, _, _ = counts(body)
    if not c:
        return 0.0
    base = math.log(c / max(1, c - lc) * lc + blc / max(1, bc) * c + math.e)
    ratio = c / max(1, lc) * max(1, t) / max(1, lt)
    return c / max(1, t) * math.log(ratio) / math.log(base + 1e-9) if ratio > 1 else 0.0


def test_densities_equal_a_plain_walk():
    page = "<body><p>Some words</p><div>A <a href=x>link <b>of</b> words</a> and more text<ul><li><a>one</a><li>two words</ul></div><p>End<br>of it</body>"
    root = op.parse(page)
    body = root.children[0]
    nodes = op.measure(body)
    for node in nodes:
        assert node.density == pytest.approx(plain_density(node, body), abs=1e-6), node.tag
        assert node.total == pytest.approx(sum(plain_density(c, body) for c in node.children if isinstance(c, op.Node)) if node.tag in op.CONTAINER else 0, abs=1e-6)


def test_wrong_densities_change_the_text(monkeypatch):
    right = [op.main_text(x) for x in PAGES]
    measure, rng = op.measure, random.Random(1)

    def wrong(body):
        nodes = measure(body)
        for node in nodes:
            node.density, node.total = rng.random(), rng.random()
        return nodes

    untold = [re.sub(r"<(/?)(nav|article)\b", r"<\1div", x) for x in PAGES]  # menu and article are divs like any other
    assert [op.main_text(x) for x in untold] == right
    monkeypatch.setattr(op, "measure", wrong)
    assert sum(op.main_text(x) != y for x, y in zip(untold, right)) > len(PAGES) / 2


def test_a_container_of_any_name_gives_the_same_text():
    for tag in ("div", "section", "main"):
        for x in PAGES:
            y = x.replace("<article>", f"<{tag}>").replace("</article>", f"</{tag}>")
            assert op.main_text(x) == op.main_text(y)


def test_no_word_part_cuts_the_text():
    texts = [f"Paragraph {i} with words enough to be read as running text of an article." for i in range(6)]
    marks = ["class=related-work", "class=social-science", "id=notice-period", "class='post no-sidebar'", "class=share-price", "class=advert-history"]
    page = "<body><div>" + "".join(f"<p {m}>{t}</p>" for m, t in zip(marks, texts)) + "<h2 id=social>Social</h2><p>End of it.</p></div></body>"
    assert op.main_text(page) == "\n".join([*texts, "Social", "End of it."])


@pytest.mark.parametrize("mark", ["class=ad", "class='box cookie-notice'", "id=sidebar", "class=top-banner", "class=comments", "id=comment-list", "class='share-buttons'", "role=navigation"])
def test_whole_names_of_boilerplate_are_cut(mark):
    text = "Running text of the article, with words enough to stand for itself, and some more."
    assert op.main_text(f"<body><div><p>{text}</p><div {mark}><p>{text} Not.</p></div><p>{text}</p></div></body>") == f"{text}\n{text}"


@pytest.mark.parametrize("page", ['<a "' * 250_000, "<div class=share>" * 100_000 + "x", "<b><div>" + "<span>" * 100_000 + "</b>" * 100_000, "<span>" * 100_000 + "<p>" * 100_000, '<a ">"' * 100_000, "<header>" * 100_000 + "x", "<ul><li>" * 100_000 + "x", "<" * 1_000_000, "<div><p>words of it " * 50_000])
def test_broken_and_deep_pages_take_linear_time(page):
    began = time.time()
    op.main_text(page)
    assert time.time() - began < 30
