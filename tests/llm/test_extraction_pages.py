import random
import time

import pytest

from itemscope.llm import extraction

PARAGRAPHS = [f"This is paragraph number {i}, and it says some things about the world." for i in range(5)]
ARTICLE = "<article>" + "".join(f"<p>{p}</p>" for p in PARAGRAPHS) + "</article>"
TEXT = "\n".join(PARAGRAPHS)


@pytest.mark.parametrize("page", [
    "<html><head><title>t</title><meta name=x><body>" + ARTICLE,
    "<html><head><title>t</title>" + ARTICLE,
    "<html><head></head><body>" + ARTICLE.replace("<p>", '<p title="abc>', 1),
    "<html><body>" + ARTICLE.replace("<p>", "<p data-x=\"<b>y</b>\" id='a>b'>", 1),
    "<body>" + ARTICLE + '<div class="user-feedback"><p>I liked this so much, it was great for me.</p></div>',
    "<body>" + ARTICLE + "<!-- <p>never ended",
])
def test_no_page_is_lost(page):
    assert extraction.main_text(page) == TEXT


@pytest.mark.parametrize("page", [
    "<a " * 350_000, '<a "' * 250_000, '<a "' * 250_000 + ">", "<" * 1_000_000, "<!-- " * 200_000,
    '<div class="main">some words of text. ' * 25_000, "<b>" * 100_000 + "<div></div>" * 50_000,
    "<i>" * 100_000 + "</u>" * 100_000, "".join(f"<div>some short text {i}</div>" for i in range(30_000))],
    ids=["tags", "quotes", "end", "signs", "comments", "nested", "inline", "unopened", "blocks"])
def test_hostile_pages_end(page):
    began = time.process_time()
    extraction.main_text(page)
    assert time.process_time() - began < 10


def test_cut_of_many_undecided_blocks_ends():
    rng = random.Random(3)
    costs = [rng.uniform(-1, 1) for _ in range(20_000)]
    edges = [(i, i + 1, 1.0) for i in range(len(costs) - 1)] + [(i, i + 7, 0.3) for i in range(len(costs) - 7)]
    began = time.process_time()
    labels = extraction.minimum_cut(costs, edges)
    assert time.process_time() - began < 20

    def cost(labels):
        return sum(max(0, -c) if x else max(0, c) for c, x in zip(costs, labels)) + sum(
            w for i, j, w in edges if labels[i] != labels[j])
    least = cost(labels)
    for _ in range(200):    # no flip of a run makes it cheaper
        i, n = rng.randrange(len(costs)), rng.randrange(1, 30)
        assert least <= cost([not x if i <= k < i + n else x for k, x in enumerate(labels)]) + 1e-6
