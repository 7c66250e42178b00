"""Betweenness against brute force over all shortest paths of small random graphs."""

import itertools
import random
from collections import defaultdict

from weftmark.operators import centrality
from weftmark.operators.graph import Graph


def paths(near, a, b):
    """All shortest paths from a to b."""
    front = [[a]]
    while front:
        done = [p for p in front if p[-1] == b]
        if done:
            return done
        seen = {p[-1] for p in front}
        front = [p + [x] for p in front for x in near[p[-1]] if x not in p and x not in seen]
    return []


def expected(links):
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    n = len(near)
    nodes, pairs = dict.fromkeys(near, 0.0), {tuple(sorted(x)): 0.0 for x in links}
    for a, b in itertools.permutations(near, 2):
        ways = paths(near, a, b)
        for way in ways:
            for x in way[1:-1]:
                nodes[x] += 1 / len(ways) / max((n - 1) * (n - 2), 1)
            for x in zip(way, way[1:]):
                pairs[tuple(sorted(x))] += 1 / len(ways) / (n * (n - 1))
    return nodes, pairs


def test_betweenness_against_brute_force(spark):
    draw = random.Random(2)
    given = {"r": [("a", "b"), ("b", "c"), ("c", "d"), ("a", "d"), ("d", "e"), ("f", "g")], "s": [("x", "y")]}
    given["t"] = sorted({tuple(sorted(draw.sample("abcdefghij", 2))) for _ in range(16)})
    rows = [(repo, a, b, None) for repo, links in given.items() for a, b in links] + [("r", "b", "a", 1), ("r", "a", "a", 1), ("r", "a", None, 1)]
    links = spark.createDataFrame(rows, "repo string, source string, target string, id int")
    nodes, pairs = centrality.betweenness(Graph(links, links), 100)
    got_nodes, got_pairs = {(r.repo, r.id): r.betweenness for r in nodes.collect()}, {(r.repo, r.lo, r.hi): r.betweenness for r in pairs.collect()}
    for repo, own in given.items():
        by_node, by_pair = expected(own)
        assert {k[1]: round(v, 6) for k, v in got_nodes.items() if k[0] == repo} == {k: round(v, 6) for k, v in by_node.items()}
        assert {k[1:]: round(v, 6) for k, v in got_pairs.items() if k[0] == repo} == {k: round(v, 6) for k, v in by_pair.items()}


def test_few_sources_and_no_links(spark):
    ring = spark.createDataFrame([("r", f"n{i}", f"n{(i + 1) % 12}") for i in range(12)], "repo string, source string, target string")
    some = centrality.betweenness(Graph(ring, ring), 3)[0].collect()
    assert len(some) == 12 and abs(sum(r.betweenness for r in some) - 12 * 25 / 110) < 0.01
    none = centrality.betweenness(Graph(ring.limit(0), ring.limit(0)))
    assert none[0].count() == none[1].count() == 0
