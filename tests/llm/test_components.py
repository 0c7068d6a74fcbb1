"""Connected components: rounds of stars and the finish of a small table give the same."""

import random

from paidup.llm import components as module
from paidup.workspace import Workspace


def plain(links):
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    return {x: top(x) for link in links for x in link}


def cases():
    rng = random.Random(8)
    yield [(i, i + 1) for i in range(300)] + [(-5, 7), (-5, -5), (7, -5)]
    yield [(rng.randrange(400), rng.randrange(400)) for _ in range(250)]
    yield [(9, i) for i in range(10, 200)] + [(1000, 1001)]


def found(spark, links):
    rows = module.components(Workspace(spark), spark.createDataFrame(links, "a long, b long")).collect()
    assert len(rows) == len({r.node for r in rows})
    return {r.node: r.component for r in rows}


def test_few_links_are_finished_without_rounds(spark, monkeypatch):
    def no_rounds(edges):
        raise AssertionError("a round of stars for a few links")

    monkeypatch.setattr(module, "_star", no_rounds)
    for links in cases():
        want = plain([x for x in links if x[0] != x[1]])
        assert found(spark, links) == want


def test_rounds_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(module, "FEW", 60)
    for links in list(cases())[1:]:
        assert found(spark, links) == plain([x for x in links if x[0] != x[1]])
