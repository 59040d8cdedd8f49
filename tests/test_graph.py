import random

import pytest

from quarrymill.operators.graph import connected_components
from quarrymill.storage import drop_stored, stored


@pytest.mark.parametrize("in_a_task", [0, 7, 500_000])
def test_chains_stars_and_nulls(spark, in_a_task):
    links = [(k, k + 1) for k in range(60)] + [(200, k) for k in range(201, 260)] + [(100, 101), (5, 5), (None, 3), (101, 100)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long"), in_a_task=in_a_task).collect()}
    assert got == {k: 0 for k in range(61)} | {k: 200 for k in range(200, 260)} | {100: 100, 101: 100}


@pytest.mark.parametrize("in_a_task", [20, 500_000])
def test_random_links_of_texts(spark, in_a_task):
    rng = random.Random(2)
    links = [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(220)]
    label = {x: x for link in links for x in link}
    for _ in range(300):
        for x, y in links:
            label[x] = label[y] = min(label[x], label[y])
    alone = {x for x in label if all(a == b for a, b in links if x in (a, b))}
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "p string, q string"), "p", "q", in_a_task).collect()}
    assert got == {x: c for x, c in label.items() if x not in alone}


def test_no_links(spark):
    for in_a_task in (0, 10):
        assert connected_components(spark.createDataFrame([], "a long, b long"), in_a_task=in_a_task).collect() == []


def test_stored_tables_can_be_dropped(spark):
    kept = stored(spark.range(3), "three")
    assert kept.count() == 3
    assert drop_stored(spark) >= 1
    assert drop_stored(spark) == 0
