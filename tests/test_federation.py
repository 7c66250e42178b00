"""Shared concepts and like vectors on small fixtures, and front matter."""

from pyspark.sql import functions as F

from weftmark.functions import text as T
from weftmark.operators import federation
from weftmark.operators.graph import Graph


def test_shared_concepts(spark):
    nodes = [(r, f"{r}{i}", label, "document", f"{r}/doc.md") for r in "abc" for i, label in enumerate(["Merge", "Index", "Cache", "Only " + r])]
    nodes += [("a", "a9", "merge", "document", None), ("b", "b9", "MERGE", "code", "x.py"), ("c", "c9", None, "paper", ""), ("d", "d0", "merge", "paper", "other.pdf")]
    links = [("a", "a0", "a1", "l.md"), ("a", "a0", "a2", None), ("b", "b0", "b1", None), ("b", "b0", "b2", None), ("b", "b2", "b0", None), ("c", "c0", "c1", None), ("c", "c0", "c3", None), ("c", "c0", None, None), ("d", "d0", "d0", None)]
    graph = Graph(spark.createDataFrame(nodes, "repo string, id string, label string, file_type string, source_file string"), spark.createDataFrame(links, "repo string, source string, target string, source_file string"))
    got = {(r.repo, r.id): (r.merged_id, r.likeness, r.n_files, r.joined) for r in federation.shared_with_representative(graph).collect()}
    assert got[("b", "b0")] == ("a::a0", 1.0, 1, True)
    assert got[("c", "c0")] == ("a::a0", round(1 / 3, 6), 1, False)
    assert got[("d", "d0")] == ("a::a0", 0.0, 0, False)
    assert set(got) == {("b", "b0"), ("c", "c0"), ("d", "d0"), ("b", "b1"), ("c", "c1"), ("b", "b2"), ("c", "c2")}
    assert federation.shared_with_representative(Graph(graph.nodes.limit(0), graph.links)).count() == 0


def test_like_vectors(spark):
    rows = [(2, [1.0, 0.0], "x"), (1, [2.0, 0.0], "x"), (3, [0.0, 1.0], "x"), (4, [1.0, 0.5], "x"), (5, [0.0, 0.0], "x"), (6, None, "x"), (7, None, "y"), (8, [1.0, 1.0], None)]
    frame = spark.createDataFrame(rows, "k int, v array<float>, g string")
    got = {r.k: (r.first, r.cosine, r.same) for r in federation.like_vectors(frame, "g", "k", "v").collect()}
    assert got == {1: (1, 1.0, True), 2: (1, 1.0, True), 3: (1, 0.0, False), 4: (1, 0.894, True), 5: (1, None, False), 6: (1, None, False)}


def test_front_matter(spark):
    texts = ["---\na: 1\nb_c:\n  - x\n---\nBody\n---\n", "no front", "---\nnever closed", "", "x\n---\na: 1\n---\n"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select(T.body(F.col("t")).alias("b"), T.front_matter_fields(F.col("t")).alias("n"))
    assert [tuple(r) for r in frame.collect()] == [("Body\n---\n", 2), *[(t, 0) for t in texts[1:]]]
