"""Components of links: chains, stars, loops, nulls, repeats and no links at all."""

import random

import pytest

from talkmill.llm.shared import connected_components, union_find

EDGES = "u long, v long"


def found(spark, edges):
    return {r.node: r.component for r in connected_components(spark.createDataFrame(edges, EDGES), "stars").collect()}


def test_components_equal_union_find(spark):
    draw = random.Random(7)
    chain = [(k, k + 1) for k in range(100, 140)]
    star = [(500, k) for k in range(501, 540)]
    loose = [(draw.randrange(1000, 1200), draw.randrange(1000, 1200)) for _ in range(90)]
    edges = chain + star + loose
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    at = {x: k for k, x in enumerate(nodes)}
    root = union_find(len(nodes), [(at[u], at[v]) for u, v in edges if u != v])
    assert found(spark, edges) == {x: nodes[root[at[x]]] for x in nodes}


def test_stars_are_done_at_once(spark):
    assert found(spark, [(2, 1), (1, 3), (3, 1), (-5, 4)]) == {1: 1, 2: 1, 3: 1, -5: -5, 4: -5}


def test_loops_nulls_and_no_links(spark):
    assert found(spark, [(1, 1), (None, 2), (3, None), (5, 4), (5, 4)]) == {4: 4, 5: 4}
    assert found(spark, []) == {}


def test_too_few_rounds(spark):
    with pytest.raises(RuntimeError):
        connected_components(spark.createDataFrame([(k, k + 1) for k in range(64)], EDGES), "stars", max_rounds=1)
