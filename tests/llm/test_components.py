from __future__ import annotations

import random

from wearlog.llm.components import components


def test_components_match_union_find(spark):
    rng = random.Random(13)
    links = [(i, i + 1) for i in range(100, 164)]  # a chain
    links += [(500, 600 + i) for i in range(30)]  # a star
    links += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    links += [(7, 7), (None, 8), (9, None), (100, 101)]
    group: dict[int, int] = {}

    def root(x: int) -> int:
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            low, high = sorted((root(a), root(b)))
            group[high] = low
    found = components(spark.createDataFrame(links, "a long, b long"))
    assert {(r.node, r.component) for r in found.collect()} == {(x, root(x)) for x in list(group)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
