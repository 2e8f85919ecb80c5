"""Connected components of chains, hubs and random links, in few rounds."""

import numpy as np
import pytest

from factloom.llm import common


def plain(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {(x, find(x)) for x in root}


@pytest.mark.parametrize("hot_rows", [64, 3])
def test_components_equal_union_find(spark, monkeypatch, hot_rows):
    rng = np.random.default_rng(2)
    chain = (rng.permutation(2000) + 10_000).tolist()  # neighbours have random numbers
    edges = list(zip(chain[:-1], chain[1:], strict=True)) + [(5000, 5000 + i) for i in range(1, 700)] + rng.integers(0, 400, (300, 2)).tolist() + [(3, 3), (7, 8), (8, 7)]
    rounds, write = [], common.checkpointed
    monkeypatch.setattr(common, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(common, "checkpointed", lambda df: rounds.append(1) or write(df))
    got = common.components(spark.createDataFrame([list(map(int, e)) for e in edges], "a long, b long"))
    linked = [(a, b) for a, b in edges if a != b]
    assert {(r.id, r.component) for r in got.collect()} == plain(linked) and len(rounds) < 40
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0
