"""Provider batching: results equal one call for each text, whatever limits bite."""

from __future__ import annotations

import math
import random

import pytest

from skyloom.plans import batching, providers


class Counting(batching.Limited):
    def __init__(self, *limits):
        super().__init__(*limits)
        self.calls = []

    def embed(self, texts):
        self.calls.append(len(texts))
        return super().embed(texts)


def alone(text, limits):
    while True:
        try:
            return batching.ordered(batching.Limited(*limits).embed([text]), 1, 2)[0]
        except batching.TooLong:
            text = text[: len(text) // 2]


@pytest.mark.parametrize("limits", [(8, 500, 2000), (3, 10, 15), (8, 7, 7), (1, 50, 50)])
def test_results_equal_one_call_a_text(limits):
    rng = random.Random(limits[1])
    texts = [rng.choice("éa𝒳") * rng.choice((0, 1, 5, 40, 499, 501, 3000)) for _ in range(90)]
    upstream = Counting(*limits)
    assert batching.embedded(texts, upstream.embed, 2, limits[0]) == [alone(t, limits) for t in texts]
    assert max(upstream.calls) <= limits[0]
    assert batching.embedded([], upstream.embed, 2, 8) == []


def test_one_long_text_costs_its_batch_little():
    upstream = Counting(8, 100, 10_000)
    batching.embedded(["x" * 10] * 7 + ["y" * 150], upstream.embed, 2, 8)
    assert upstream.calls == [8, 4, 4, 2, 2, 1, 1, 1]


def test_refused_to_the_end():
    with pytest.raises(batching.TooLong):
        batching.embedded(["abcdef"], batching.Limited(8, 0, 0).embed, 2, 8)


@pytest.mark.parametrize("reply", [[], [[1.0, 2.0]], [(0, [1.0, 2.0]), (0, [1.0, 2.0])], [(0, [1.0, 2.0]), (2, [1.0, 2.0])], [[1.0], [2.0]], [[1.0, math.nan], [1.0, 2.0]]])
def test_replies_that_do_not_fit(reply):
    with pytest.raises(batching.BadReply):
        batching.ordered(reply, 2, 2)


def test_order_is_restored():
    assert batching.ordered([(1, [3.0, 4.0]), (0, [1.0, 2.0])], 2, 2) == [[1.0, 2.0], [3.0, 4.0]] == batching.ordered([[1, 2], [3, 4]], 2, 2)


def test_column(spark):
    df = spark.createDataFrame([(0, "a" * 700), (1, None), (2, "b")], "i int, text string")
    assert {r.i: list(r.vector) for r in providers.embed(df, batching.Limited()).collect()} == {0: [350.0, 97.0], 1: [0.0, -1.0], 2: [1.0, 98.0]}
