"""Detected communities, questions, layers and walk heat against brute force on small graphs."""

import random
import statistics
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from weftmark.functions import text as T
from weftmark.operators import communities, graph, retrieval, traversal
from weftmark.operators.graph import Graph
from weftmark.plans import insight_queries

NODES = "repo string, id string, label string, file_type string, source_file string, source_location string, community int"
LINKS = "repo string, source string, target string, relation string, confidence string, confidence_score double, source_file string, weight double, valid_from timestamp, valid_until timestamp, decay_weight double"


def node(i, repo="r", community=None, label=None):
    return (repo, i, label, "code", f"src/{i}.py", "L1", community)


def link(a, b, relation="uses", repo="r"):
    return (repo, a, b, relation, "EXTRACTED", 1.0, "s.py", 1.0, datetime(2026, 1, 1), None, 0.5)


@pytest.fixture(scope="module")
def cliques(spark):
    """Three groups of five, all linked within, one link from each to the next; a loose node, a loop and a lost end."""
    ids = [f"{g}{n}" for g in "abc" for n in range(5)]
    links = [link(x, y) for x in ids for y in ids if x[0] == y[0] and x < y] + [link("a0", "b0"), link("b1", "c1"), link("a1", "a1"), link("a2", "nowhere"), link(None, "a0")]
    return Graph(spark.createDataFrame([node(i) for i in [*ids, "loose"]], NODES), spark.createDataFrame(links + links[:3], LINKS))


def test_cliques_are_communities(cliques):
    rows = communities.detect(cliques).collect()
    assert {(r.id, r.community, r.n_members) for r in rows} == {(f"{g}{n}", f"{g}0", 5) for g in "abc" for n in range(5)} | {("loose", "loose", 1)}


def test_modularity_equals_its_definition(spark, cliques):
    ends = {tuple(sorted((r.source, r.target))) for r in cliques.links.collect() if r.source and r.target and r.target != "nowhere" and r.source != r.target}
    degree = {}
    for pair in ends:
        for i in pair:
            degree[i] = degree.get(i, 0) + 1
    two_m = 2 * len(ends)
    expected = sum(((tuple(sorted((x, y))) in ends and x != y) - degree[x] * degree[y] / two_m) / two_m for x in degree for y in degree if x[0] == y[0])
    got = communities.modularity(cliques, communities.detect(cliques)).collect()
    assert len(got) == 1 and abs(got[0].modularity - expected) < 1e-12


def test_large_communities_are_divided(spark):
    """Of a repo that is one chain of linked groups no community above a quarter of it stays whole where it can be divided."""
    ids = [f"{g}{n}" for g in "abcdef" for n in range(4)]
    links = [link(x, y) for x in ids for y in ids if x[0] == y[0] and x < y] + [link(f"{g}0", f"{h}1") for g, h in zip("abcde", "bcdef")]
    g = Graph(spark.createDataFrame([node(i) for i in ids], NODES), spark.createDataFrame(links, LINKS))
    rows = communities.detect(g).collect()
    assert len(rows) == len(ids) == len({r.id for r in rows}) and max(r.n_members for r in rows) <= 10
    assert all(r.community == min(x.id for x in rows if x.community == r.community) for r in rows)


def test_no_two_communities_are_left_to_merge(spark):
    """Of a long chain every two linked communities together would have less modularity than apart."""
    n = 600
    ends = [(f"n{i:04}", f"n{i + 1:04}") for i in range(n - 1)]
    edges = spark.createDataFrame([("r", a, b, 1) for x, y in ends for a, b in ((x, y), (y, x))], "scope string, id string, other string, w bigint")
    label = {r.id: r.label for r in communities.partition(edges).collect()}
    assert len(label) == n
    total, between = {}, {}
    for x, y in ends:
        for i in (x, y):
            total[label[i]] = total.get(label[i], 0) + 1
        if label[x] != label[y]:
            pair = frozenset((label[x], label[y]))
            between[pair] = between.get(pair, 0) + 1
    assert between and all(w * 2 * len(ends) <= total[a] * total[b] for (a, b), w in between.items())


def test_empty_and_linkless(spark):
    none = Graph(spark.createDataFrame([], NODES), spark.createDataFrame([], LINKS))
    assert communities.detect(none).count() == 0 and retrieval.hub_paths(none).count() == 0 and traversal.layers(none.links, ["uses"]).count() == 0
    lone = Graph(spark.createDataFrame([node("x")], NODES), none.links)
    assert [tuple(r) for r in communities.detect(lone).collect()] == [("r", "x", "x", 1)]
    assert retrieval.question_tokens(none, spark.createDataFrame([], "repo string, source_file string, file_text string")).count() == 0


def test_both_ways_to_settle_a_repo_give_the_same(spark):
    """Repos settled within a task and by joins over the cluster: random graphs with groups, bridges and repeated links."""
    draw = random.Random(8)
    rows = set()
    for repo in ("p", "q é"):
        ids = [f"{draw.choice('abcdé')}{i}" for i in range(40)]
        for _ in range(120):
            x, y = draw.choice(ids), draw.choice(ids)
            if x != y and (x[0] == y[0] or draw.random() < 0.2):
                rows |= {(repo, x, y, 1), (repo, y, x, 1)}
    edges = spark.createDataFrame(sorted(rows), "scope string, id string, other string, w bigint")
    results = [sorted(map(tuple, communities.partition(edges, small).collect())) for small in (200_000, 0)]
    assert results[0] == results[1] and len({(s, label) for s, _, label in results[0]}) < len(results[0]) / 2
    assert communities.partition(edges.limit(0)).count() == 0


def test_matched_communities_and_drift(spark):
    rows = []
    for no, parts in ((1, {1: "abcd", 2: "efg", 3: "hij"}), (2, {1: "abcd", 7: "efg", 8: "hi", 9: "jkl"})):
        rows += [("r", no, i, datetime(2026, 1, no), c) for c, ids in parts.items() for i in ids]
    rows += [("r", 2, "z", datetime(2026, 1, 2), None), ("r", 2, None, datetime(2026, 1, 2), 1)]
    nodes = spark.createDataFrame(rows, "repo string, snapshot_no int, id string, loaded_at timestamp, community int")
    log = spark.createDataFrame([("r", 1), ("r", 2), ("s", 1)], "repo string, snapshot_no int")
    assert {(r.old_community, r.new_community, r.n_shared) for r in communities.matched(nodes, log).collect()} == {(1, 1, 4), (2, 7, 3)}
    links = spark.createDataFrame([link("a", "b", "tests"), link("a", "e", "tests"), link("a", "h", "tests"), link("a", "k", "tests"), link("a", "z", "tests"), link("a", "c", "uses")], LINKS)
    drift = {r.target: r.drift for r in communities.link_drift(links, nodes, log, ["tests"]).collect()}
    assert drift == {"b": "stable", "e": "community-renamed", "h": "community-resharded", "k": "orphaned", "z": "orphaned"}


def test_question_tokens(spark):
    nodes = [node("s", label="Schema"), node("t", label="tree"), node("u"), node("v"), node("far")]
    links = [link("s", "t", "uses"), link("s", "t", "calls"), link("t", "u"), link("u", "v"), link("v", "far"), link("s", "gone")]
    g = Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame(links, LINKS))
    files = spark.createDataFrame([("r", "a", "one two three"), ("r", "a", "one two three"), ("r", "b", None), ("r", "c", "")], "repo string, source_file string, file_text string")
    lines = [f"NODE {label} src=src/{i}.py loc=L1" for i, label in (("s", "Schema"), ("t", "tree"), ("u", "u"), ("v", "v"))] + ["EDGE Schema --calls--> tree", "EDGE tree --uses--> u", "EDGE u --uses--> v"]
    got = retrieval.question_tokens(g, files, ["the schema", "no such word"]).collect()
    assert [(r.question, r.query_tokens, r.corpus_tokens) for r in got] == [("the schema", len("\n".join(lines)) // 4, 4)]


def test_hub_path_is_the_first_shortest(spark):
    ends = [("h", x) for x in "abcd"] + [("k", x) for x in "efg"] + [("b", "e"), ("a", "g"), ("c", "k")]
    g = Graph(spark.createDataFrame([node(i, label=i) for i in "habcdkefg"], NODES), spark.createDataFrame([link(x, y) for x, y in ends], LINKS))
    assert [tuple(r) for r in retrieval.hub_paths(g).collect()] == [("r", "h", "k", "h > c > k", 2)]
    assert [tuple(r)[3:] for r in retrieval.hub_paths(g, 1).collect()] == [(None, None)]


def test_hub_path_of_any_length(spark):
    chain = ["h", *(f"m{i}" for i in range(8)), "k"]
    ends = [*zip(chain, chain[1:]), *(("h", x) for x in "abcd"), *(("k", x) for x in "efg")]
    apart = [("h", x) for x in "abc"] + [("k", x) for x in "ef"]
    nodes = [node(i, label=i) for i in sorted({i for e in ends for i in e})] + [node(i, "s", label=i) for i in "habckef"]
    g = Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame([link(x, y) for x, y in ends] + [link(x, y, repo="s") for x, y in apart], LINKS))
    assert sorted(tuple(r) for r in retrieval.hub_paths(g).collect()) == [("r", "h", "k", " > ".join(chain), 9), ("s", "h", "k", None, None)]


def test_layers(spark):
    links = spark.createDataFrame([link("a", "b"), link("b", "c"), link("a", "c"), link("c", "x"), link("x", "y"), link("y", "x"), link("y", "z"), link("a", "q", "other"), link("b", None)], LINKS)
    assert {r.id: r.layer for r in traversal.layers(links, ["uses"]).collect()} == {"a": 0, "b": 1, "c": 2, "x": None, "y": None, "z": None}


@pytest.mark.parametrize("counts", [[3], [1, 2, 5], [1, 1, 2, 2, 3, 3, 4, 5, 6, 9, 12, 30], list(range(1, 25))])
def test_walk_heat_equals_exclusive_tenths(spark, tmp_path, counts):
    walks = [("r", f"a{n:02}", "b", 1) for n, c in enumerate(counts) for _ in range(c)]
    spark.createDataFrame(walks, "repo string, from_id string, to_id string, snapshot_no int").write.parquet(str(tmp_path / "agent_edges.parquet"))
    spark.createDataFrame([link(f"a{n:02}", "b") for n in range(len(counts))] + [link("new", "b")], LINKS).write.parquet(str(tmp_path / "graph_links.parquet"))
    tenths = statistics.quantiles(counts, n=10) if len(counts) >= 10 else [min(counts)] + [0] * 7 + [max(counts)]
    kind = lambda c: "hot" if c >= tenths[8] else "cold" if c <= tenths[0] else "warm"
    got = {r.lo: r.heat for r in insight_queries.link_heat(spark, str(tmp_path)).collect()}
    assert got == {f"a{n:02}": kind(c) for n, c in enumerate(counts)} | {"b": "never"}


def test_kept_links(cliques):
    kept = graph.kept_links(cliques)
    assert kept.where(F.col("target") == "nowhere").count() == 0 and kept.where("source = 'a1' and target = 'a1'").count() == 1


def test_text_forms(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.cypher_text(F.lit("a\\b'c"))) == "a\\\\b\\'c" and one(T.markdown_text(F.lit("`a<b>`"))) == "'a&lt;b&gt;'"
    assert [one(T.sentence_count(F.lit(t))) for t in ("", " \n", "One", "One. Two!\n\nThree?  ", "v1.2 is out. ")] == [0, 0, 1, 3, 1]
    assert one(T.tech_tag(F.lit("a/b.PY"))) == "python" and one(T.tech_tag(F.lit("py"))) is None and one(T.tech_tag(F.lit(None).cast("string"))) is None
    assert len(one(T.element_id(F.lit("")))) == 16 and one(T.element_id(F.lit(None).cast("string"))) is None


def test_concept_links(spark):
    nodes = [("r", "code", None, "code", None, None, None), ("r", "idea", None, "document", None, None, None), ("r", "plain", None, None, None, None, None)]
    row = lambda a, b, relation, confidence, score: ("r", a, b, relation, confidence, score, "s", 1.0, None, None, None)
    links = [row("idea", "code", "implemented_by", "INFERRED", 0.4), row("idea", "code", "implements", "EXTRACTED", None), row("idea", "plain", "implements", "INFERRED", 0.2), row("plain", "idea", "implements", "INFERRED", 0.9), row("code", "lost", "implements", "EXTRACTED", 1.0), row("code", "idea", "uses", "EXTRACTED", 1.0)]
    got = graph.concept_links(Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame(links, LINKS)))
    assert {tuple(r) for r in got.collect()} == {("r", "code", "idea", 2, 3, 0.4), ("r", "plain", "idea", 2, 2, 0.9)}
