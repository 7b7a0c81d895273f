"""Searches from many starts against one search at a time."""

import random

import pytest

from ledgerline.operators import graph_many


def plain(edges, labels, start, depth, budget):
    near = {}
    for a, b, _ in edges:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    level, front = {start: 0}, [start]
    for k in range(1, depth + 1):
        found = sorted({n for f in front for n in near.get(f, ()) if labels is None or n in labels} - set(level))[: budget - len(level)]
        level |= dict.fromkeys(found, k)
        front = found
    return level


@pytest.fixture(scope="module")
def network():
    rng = random.Random(3)
    names = [f"n{k:02d}" for k in range(60)]
    edges = [(rng.choice(names), rng.choice(names), rng.choice(("x", "y"))) for _ in range(120)] + [("hub", n, "z") for n in names] + [("n01", "n01", "x"), (None, "n02", "x"), ("n03", None, "x"), ("apart", "apart", "x")]
    return edges + [(b, a, r) for a, b, r in edges[:30]]


@pytest.mark.parametrize(("depth", "budget", "named"), [(2, 12, False), (3, 40, True), (1, 3, False), (4, 200, True)])
def test_many_searches(spark, network, depth, budget, named, monkeypatch):
    monkeypatch.setattr(graph_many, "MOST", max(budget, 12))
    labels = {n for k, (a, b, _) in enumerate(network) for n in (a, b) if n and k % 5} if named else None
    own = spark.createDataFrame([(n, n.upper(), 1) for n in labels for _ in range(2)], "node string, label string, level int") if named else None
    made = graph_many.Graph(spark.createDataFrame(network, "a string, b string, relationship string"), own)
    starts = ["n05", "n17", "hub", "apart", "unknown", "n05"]
    seen = made.search(spark.createDataFrame([(s,) for s in [*starts, None]], "node string"), depth, budget)
    got, links = {}, {}
    for r in made.named(seen).collect():
        got.setdefault(r["source"], {})[r["node"]] = r["level"]
        assert not named or r["label"] == (r["node"].upper() if r["node"] in labels else None)
    for r in made.between(seen).collect():
        assert (r["a"], r["b"], r["relationship"]) not in links.setdefault(r["source"], set())
        links[r["source"]].add((r["a"], r["b"], r["relationship"]))
    for s in set(starts):
        want = plain(network, labels, s, depth, budget)
        assert got[s] == want and len(want) <= budget
        assert links.get(s, set()) == {(min(a, b), max(a, b), r) for a, b, r in network if a in want and b in want and a != b}


def test_search_of_nothing(spark):
    made = graph_many.Graph(spark.createDataFrame([], "a string, b string, relationship string"))
    assert [tuple(r) for r in made.search(spark.createDataFrame([("a",)], "node string")).collect()] == [("a", "a", 0)]
    assert made.search(spark.createDataFrame([], "node string")).count() == 0


def test_a_search_writes_what_it_reaches(spark):
    """Not all edges: of many that lie elsewhere a bitmap lets few pass, and none is written twice."""
    edges = [("a", "b", "x"), ("b", "c", "x"), ("c", "d", "x")] + [(f"u{k}", f"v{k}", "y") for k in range(3000)]
    made = graph_many.Graph(spark.createDataFrame(edges, "a string, b string, relationship string"))
    seen = made.search(spark.createDataFrame([("a",)], "node string"), 2, 10)
    assert {(r["a"], r["b"]) for r in made.between(seen).collect()} == {("a", "b"), ("b", "c")}
    assert {r["node"]: r["level"] for r in seen.collect()} == {"a": 0, "b": 1, "c": 2}
    assert spark.read.option("recursiveFileLookup", "true").schema("x int").parquet(made.root).count() < 100
