"""Pages that nest deep."""

import time

import pytest

from echolith.llm import htmltext


@pytest.mark.parametrize("page", [lambda n: "<div>x" * n, lambda n: "<div>" * n + "x</section>" * n])
def test_deep_pages_take_time_of_the_order_of_their_length(page):
    took = []
    for n in (3_000, 30_000):
        began = time.process_time()
        assert len(htmltext.blocks(page(n))) == n
        took.append(time.process_time() - began)
    assert took[1] < 40 * took[0] + 0.5  # 100 times if it grew with the square
