"""Running totals over spread groups, file batches, rationale comments and resolved imports on small fixtures."""

import random

from pyspark.sql import functions as F

from weftmark.operators import batches, extract_code


def test_running_totals_against_brute_force(spark):
    draw = random.Random(3)
    rows = [(draw.choice(["hot", "hot", "hot", "a", None]), f"{i:04}", draw.choice([None, 1, 5, 9]), i) for i in range(400)]
    frame = spark.createDataFrame(rows, "g string, o string, v bigint, part_of int").repartition(5)
    got = {r.o: r.before for r in batches.running_total(frame, ["g"], ["o"], "v").collect()}
    assert got == {o: sum(w or 0 for h, p, w, _ in rows if h == g and p < o) for g, o, _, _ in rows}
    assert batches.running_total(frame.limit(0), ["g"], ["o"], "v").count() == 0


def test_file_batches(spark):
    files = spark.createDataFrame([("r", "a/x.py", "1" * 8), ("r", "a/y.py", "1" * 16), ("r", "a/y.py", "1" * 4), ("r", "a/z.py", None), ("r", "a/zz.py", "12345678"), ("r", "top.py", ""), ("r", None, "x")], "repo string, source_file string, file_text string")
    got = {r.source_file: (r.top, r.n_tokens, r.batch_no) for r in batches.file_batches(files, F.floor(F.length("file_text") / 4), 5).collect()}
    assert got == {"a/x.py": ("a", 2, 0), "a/y.py": ("a", 4, 0), "a/z.py": ("a", 0, 1), "a/zz.py": ("a", 2, 1), "top.py": ("", 0, 0)}


def test_rationales_and_imports(spark):
    files = [
        ("r", "src/a.py", "from .b import One, two as zwei\nfrom os import path\n    # TODO: mend this  \nx = 1  # NOTE: not at the start\n# why: small\n# WHY: because\n"),
        ("r", "src/b.py", "class One:\n    pass\nfrom b import One\n"), ("r", "lib/b.py", "def two():\n    pass\n"), ("s", "b.py", None), ("r", "c.js", "// TODO: no"),
    ]
    frame = spark.createDataFrame(files, "repo string, source_file string, file_text string")
    assert {(r.line_no, r.mark, r.note) for r in extract_code.rationales(frame).collect()} == {(3, "TODO", "mend this"), (6, "WHY", "because")}
    got = {(r.source_file, r.name, r.target_file, r.defined) for r in extract_code.resolved_imports(frame).collect()}
    assert got == {("src/a.py", "One", "src/b.py", True), ("src/a.py", "One", "lib/b.py", False), ("src/a.py", "two", "lib/b.py", True), ("src/a.py", "two", "src/b.py", False), ("src/b.py", "One", "lib/b.py", False)}
