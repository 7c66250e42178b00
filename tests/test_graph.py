"""Graph operators on a small graph, with SQL-free expectations."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from weftmark.functions import text as T
from weftmark.operators import analysis, extract_code, graph, history, traversal
from weftmark.operators.graph import Graph
from weftmark.sources import files, node_link
from weftmark.streaming import live

NODES = "repo string, id string, label string, file_type string, source_file string, source_location string, community int"
LINKS = "repo string, source string, target string, relation string, confidence string, confidence_score double, source_file string, weight double, valid_from timestamp, valid_until timestamp, decay_weight double"


def link(a, b, relation="uses", confidence="EXTRACTED", score=1.0, until=None, weight=1.0):
    return ("r", a, b, relation, confidence, score, "s.py", weight, datetime(2026, 1, 1), until, 0.5)


@pytest.fixture(scope="module")
def small(spark):
    nodes = [("r", i, i.upper(), "code", f"src/{i}.py", None, c) for i, c in (("a", 0), ("b", 0), ("c", 0), ("d", 1), ("e", 1), ("f", 2))] + [("r", "file", "x.py", "code", "src/x.py", None, None), ("s", "a", None, None, None, None, None)]
    links = [link("a", "b"), link("b", "a", weight=None), link("b", "c"), link("c", "d", confidence="INFERRED", score=0.4), link("d", "e", until=datetime(2026, 2, 1)), link("a", "a"), link("x", None), link("a", "ghost"), link("d", "a", "supersedes"), link("e", "d", "supersedes", "INFERRED", 0.5)]
    return Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame(links, LINKS))


def test_degrees_and_merge(small):
    degree = {r.id: r.degree for r in graph.degrees(small.links).collect()}
    assert degree == {"a": 5, "b": 2, "c": 2, "d": 3, "e": 1, "ghost": 1}  # a meets itself on both ends
    merged = {(r.source, r.target, r.relation): r for r in graph.merged_links(small.links.unionByName(small.links)).collect()}
    assert merged[("a", "b", "uses")].n_rows == 2 and merged[("a", "b", "uses")].weight == 2.0
    assert {(r.source, r.target, r.missing_end) for r in graph.dangling(small).collect()} == {("a", "ghost", "target")}
    assert graph.hubs(small, 1).first().id == "a"


def test_empty_graph(spark):
    none = Graph(spark.createDataFrame([], NODES), spark.createDataFrame([], LINKS))
    for operator in (graph.hubs, graph.merged_links, analysis.cohesion, analysis.surprises, analysis.knowledge_gaps, analysis.bridges, analysis.community_labels, traversal.components):
        assert operator(none.links if operator is graph.merged_links else none).count() == 0


def test_traversal(small):
    seeds = small.nodes.where("repo = 'r' and id = 'a'").select("repo", "id")
    assert {(r.id, r.depth) for r in traversal.neighbourhood(small, seeds, 2).collect()} == {("a", 0), ("b", 1), ("d", 1), ("ghost", 1), ("c", 2), ("e", 2)}
    assert {(r.id, r.depth) for r in traversal.along(small, seeds, ["supersedes"], 5, "in").collect()} == {("a", 0), ("d", 1), ("e", 2)}
    assert {r.component for r in traversal.components(small).collect()} == {"a"}
    assert {(r.lo, r.hi) for r in traversal.induced(small, small.nodes.where("id in ('a', 'b', 'd')")).collect()} == {("a", "b"), ("a", "a"), ("a", "d")}


def test_long_path_is_one_component(spark):
    links = spark.createDataFrame([("r", f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [("r", "z1", "z2")], "repo string, source string, target string")
    sizes = {r.component: r["count"] for r in traversal.components(Graph(links, links)).groupBy("component").count().collect()}
    assert sizes == {"n000": 61, "z1": 2}


def test_chains_and_gaps(small):
    assert [r.path for r in analysis.supersession_chains(small).collect()] == ["e > d > a"]
    gaps = {r.id: r.reason for r in analysis.knowledge_gaps(small).collect()}
    assert gaps["f"] == "isolated" and gaps["d"] == "thin_community" and "a" not in gaps
    cohesion = {r.community: r.cohesion for r in analysis.cohesion(small).collect()}
    assert cohesion == {0: 2 / 3, 1: 1.0, 2: 1.0}


def test_decay_and_supersession(spark, small):
    frame = spark.createDataFrame([("uses", datetime(2026, 1, 1)), ("semantically_similar_to", datetime(2026, 1, 17)), ("uses", None), ("uses", datetime(2020, 1, 1)), ("uses", datetime(2027, 1, 1))], "relation string, at timestamp")
    got = [round(r[0], 6) for r in frame.select(history.decay(F.col("relation"), F.col("at"), F.lit("2026-01-31").cast("timestamp"))).collect()]
    assert got == [0.5, 0.5, 1.0, 0.1, 1.0]
    assert {(r.source, r.target) for r in history.superseded(small.links, F.lit("now")).collect()} == {("a", "b"), ("a", "a"), ("a", "ghost")}


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.slug(F.lit("src/a b.py"), F.lit("Run()"))) == "src_a_b_py_run"
    assert one(T.html_text(F.lit("<p>a<script>x\ny</script> b</p>"))) == "a b"
    assert one(T.word_count(F.lit("  \n"))) == 0 and one(T.word_count(F.lit(" a  b\tc "))) == 3
    assert one(T.terms(F.lit("How does the Merge Index work"))) == ["merge", "index", "work"]
    assert one(T.url_kind(F.lit("https://arxiv.org/abs/1"))) == "arxiv" and one(T.url_kind(F.lit("https://h.org/x.PDF?a=1"))) == "pdf"


def test_symbols(spark):
    code = [("r", "a.py", "import os\nfrom x.y import z\nclass A:\n    def f(self):\n        pass\n"), ("r", "b.go", 'package p\n\nimport "errors"\n\nfunc (x *T) Do(a int) int {\n'), ("r", "c.js", 'const { q } = require("./m");\nfunction go(a) {\n'), ("r", "d.py", None), ("r", "e.py", "")]
    got = {(r.source_file, r.line_no, r.kind, r.name) for r in extract_code.symbols(spark.createDataFrame(code, "repo string, source_file string, file_text string")).collect()}
    assert got == {("a.py", 1, "import", "os"), ("a.py", 2, "import", "x.y"), ("a.py", 3, "class", "A"), ("a.py", 4, "function", "f"), ("b.go", 3, "import", "errors"), ("b.go", 5, "function", "Do"), ("c.js", 1, "import", "./m"), ("c.js", 2, "function", "go")}


def test_node_link_round_trip(spark, tmp_path):
    for name, key, ends in (("one", "links", ("source", "target")), ("two", "edges", ("from", "to"))):
        (tmp_path / f"{name}.json").write_text(json.dumps({"nodes": [{"id": "a'", "label": "A<"}, {"id": "b"}], key: [{ends[0]: "a'", ends[1]: "b", "relation": "uses it"}]}))
    (tmp_path / "bad.json").write_text("{")
    read = node_link.read_node_link(spark, str(tmp_path))
    assert read.nodes.count() == 4 and {(r.source, r.target) for r in read.links.collect()} == {("a'", "b")}
    assert "MATCH (a:Node {id: 'a\\''}), (b:Node {id: 'b'}) MERGE (a)-[:USES_IT]->(b);" in {r.value for r in node_link.cypher_lines(read).collect()}
    assert '<node id="a\'"><data key="label">A&lt;</data></node>' in {r.value for r in node_link.graphml_lines(read).collect()}
    assert node_link.node_link_lines(read).count() == 6


def test_files(spark, tmp_path):
    for name in ("a.py", "b.md", "node_modules/c.js", ".env", "d.xyz"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text("x")
    got = {r.path.rsplit("/", 1)[1]: (r.kind, r.skip_reason) for r in files.list_files(spark, str(tmp_path)).collect()}
    assert got["a.py"] == ("code", None) and got["b.md"] == ("document", None) and got["c.js"][1] == "noise-dir" and got["d.xyz"] == (None, "unknown-kind")
    now = spark.createDataFrame([("a", datetime(2026, 1, 2)), ("b", datetime(2026, 1, 1)), ("n", None)], "path string, modified_at timestamp")
    old = spark.createDataFrame([("a", datetime(2026, 1, 1)), ("b", datetime(2026, 1, 1)), ("z", datetime(2026, 1, 1))], "path string, modified_at timestamp")
    status = {r.path: r.status for r in files.changed_since(now, old, ["path"]).collect()}
    assert status == {"a": "modified", "b": "unchanged", "n": "new", "z": "deleted"}


def test_streams_equal_batches(spark, tmp_path):
    data = [(1, datetime(2026, 1, 1, 0, 5), 7, "view", 1.5), (2, datetime(2026, 1, 1, 0, 20), 7, "view", 2.0), (3, datetime(2026, 1, 1, 3, 0), 7, "click", None), (4, datetime(2026, 1, 5), 8, "view", 1.0), (5, datetime(2026, 1, 1), None, "click", 1.0)]
    frame = spark.createDataFrame(data, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double")
    frame.write.parquet(str(tmp_path / "in"))
    for name, operator in (("windows", live.windowed_counts), ("sessions", live.user_sessions)):
        stream = operator(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")))
        query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
        batch = sorted(map(tuple, operator(frame).collect()))
        assert sorted(map(tuple, spark.table(name).collect())) == [r for r in batch if datetime(2026, 1, 5) not in r]
