"""Look-ups, texts of a part of the graph, citations and merged fields on a small graph with nulls, ties and repeats."""

from datetime import datetime

import pytest

from weftmark.operators import history, lookups
from weftmark.operators.graph import Graph
from weftmark.sources import files
from pyspark.sql import functions as F

NODE = "repo string, id string, label string, file_type string, source_file string, source_location string, community int, loaded_at timestamp, extra int"
LINK = "repo string, source string, target string, relation string, confidence string, valid_until timestamp, degree int"


@pytest.fixture(scope="module")
def graph(spark):
    day = datetime(2026, 1, 2)
    nodes = [("r", "a", "Schema Merge", "code", "s/a.py", "L1", 0, day, 1), ("r", "b", "schema", "code", None, None, None, day, 1), ("r", "c", None, "document", "c.md", None, 1, None, 1), ("r", "SCHEMA", "x", None, "", None, 1, day, 1), ("s", "q", "none", "code", "q.py", None, 0, day, 1)]
    links = [("r", "a", "b", "uses", "EXTRACTED", None, 1), ("r", "a", "b", "uses", "EXTRACTED", None, 1), ("r", "b", "a", None, "INFERRED", None, 1), ("r", "a", "c", "cites", "INFERRED", None, 1), ("r", "a", None, "uses", None, None, 1), ("r", "a", "ghost", "uses", None, None, 1)]
    return Graph(spark.createDataFrame(nodes, NODE), spark.createDataFrame(links, LINK))


def test_matches_and_cards(spark, graph):
    assert {r.id for r in lookups.matching_nodes(graph.nodes, "Schema").collect()} == {"a", "b", "SCHEMA"}
    assert [(r.repo, r.id) for r in lookups.first_match(graph.nodes, "schema").collect()] == [("r", "SCHEMA")]
    held = spark.createDataFrame([("r", "s/a.py", datetime(2026, 1, 3)), ("r", "s/a.py", None)], "repo string, source_file string, modified_at timestamp")
    card = lookups.node_card(graph, held, "merge").collect()
    assert [(r.id, r.degree, r.state) for r in card] == [("a", 3, "stale")]
    assert lookups.node_card(graph, held, "nothing of this").count() == 0


def test_neighbours(spark, graph):
    seeds = spark.createDataFrame([("r", "a"), ("s", "a")], "repo string, id string")
    got = {(r.other, r.relation, r.n_links) for r in lookups.neighbours(graph, seeds).collect()}
    assert got == {("b", "uses", 2), ("b", None, 1), ("c", "cites", 1)}
    assert {r.other for r in lookups.neighbours(graph, seeds, "USE").collect()} == {"b"}


def test_filters(spark):
    rows = spark.createDataFrame([("p", "2026-01-01"), ("p", "2026-02-01"), ("q", "2026-01-15"), (None, None)], "peer_id string, at string")
    assert lookups.filtered(rows, "at").count() == 4
    assert [r.at for r in lookups.filtered(rows, "at", "p", "2026-01-02", "2026-02-01").collect()] == ["2026-02-01"]
    edges = spark.createDataFrame([("r", 1, "a", "b", "x", None), ("r", 1, "a", "b", "x", None), ("r", 1, "c", "a", "x", None), ("r", 1, "c", None, "x", None), ("s", 1, "a", "b", "x", None)], "repo string, snapshot_no int, from_id string, to_id string, relation string, ts timestamp")
    assert lookups.at_nodes(edges, spark.createDataFrame([("r", "a"), ("r", "b")], "repo string, id string")).count() == 2


def test_texts(spark, graph):
    members = graph.nodes.where("repo = 'r'").select("repo", "id")
    full = lookups.graph_text(graph, members, 2000, 3).first()
    assert full.text.split("\n") == [
        "NODE Schema Merge [src=s/a.py loc=L1 community=0]", "NODE schema [src= loc= community=]", "NODE c [src=c.md loc= community=1]", "NODE x [src= loc= community=1]",
        "EDGE Schema Merge --uses [EXTRACTED]--> schema", "EDGE Schema Merge --cites [INFERRED]--> c", "EDGE schema -- [INFERRED]--> Schema Merge",
    ] and not full.cut
    short = lookups.graph_text(graph, members, 10, 1).first()
    assert short.cut and short.text == "NODE a label=Schema Merge comm" + "\n... (truncated to ~10 token budget)"
    assert lookups.graph_text(graph, members.limit(0)).count() == 0


def test_estimates_and_targets(spark, graph):
    seeds = spark.createDataFrame([("r", "a")], "repo string, id string")
    e = lookups.estimates(graph, seeds).first()
    assert (e.n_nodes, e.n_links, e.tokens_1, e.tokens_2, e.tokens_3) == (2, 1, 100, 430, 295)
    assert [(r.rank, r.id, r.degree) for r in lookups.targets(graph, seeds).orderBy("rank").collect()] == [(1, "b", 1), (2, "c", 1), (3, "SCHEMA", 0)]


def test_citations(spark, graph):
    notes = spark.createDataFrame([("r", "b", "The schema is fine. The merge is not! Nothing else.", 1), ("r", "b", "The schema is fine. The merge is not! Nothing else.", 2), ("r", None, "A schema.", 1), ("s", "q", "Merge schema. None.", 1), ("r", "a", None, 1), ("r", "a", " ", 1)], "repo string, id string, body string, no_more int")
    got = {(r.repo, r.id, r.no): r.kept for r in lookups.cited_sentences(notes, graph.nodes).collect()}
    assert got == {("r", "b", 0): True, ("r", "b", 1): False, ("r", "b", 2): True, ("r", None, 0): False, ("s", "q", 0): True, ("s", "q", 1): True}


def test_merged_fields_and_ignored_files(spark):
    rows = [("r", 1, "a", "x", None, datetime(2026, 1, 1)), ("r", 2, "a", None, "code", datetime(2026, 1, 2)), ("r", 2, "a", "y", None, None), ("r", 2, None, "z", None, None)]
    got = history.merged_fields(spark.createDataFrame(rows, "repo string, snapshot_no int, id string, label string, file_type string, loaded_at timestamp"), ["label", "file_type"]).collect()
    assert [tuple(r) for r in got] == [("r", "a", "x", "code", 2)]
    paths = spark.createDataFrame([("vendor/a.py",), ("x/vendor/b.py",), ("x/y.min.js",), ("src/gen/a.py",), ("a.py",), (None,), ("vendored.py",)], "p string")
    assert [r.x for r in paths.select(files.ignored(F.col("p"), ["vendor/", "*.min.js", "src/ge?", ""]).alias("x")).collect()] == [True, True, True, True, False, None, False]
