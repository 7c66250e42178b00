"""The general problems on small fixtures with nulls, ties, repeats, empty tables and clashing columns."""

import random
from datetime import datetime

from weftmark.operators import heavy_keys, orphan_references, snapshot_diff
from weftmark.operators.orphan_references import ForeignKey
from weftmark.operators.snapshot_diff import Snapshotted
from weftmark.plans import problems, scratch, skew
from pyspark.sql import functions as F

NODE = "repo string, snapshot_no int, id string, label string, community int, loaded_at timestamp, fp string, row string"


def at(day):
    return datetime(2026, 1, day)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def diff(spark, nodes, log, schema=NODE):
    table = Snapshotted("t", spark.createDataFrame(nodes, schema), ("id",), ("label", "community"))
    return rows(snapshot_diff.snapshot_changes([table], spark.createDataFrame(log, "repo string, snapshot_no int, extra string"), 3))


def test_snapshot_changes(spark):
    nodes = [
        ("r", 1, "a", "x", 1, at(1), "e", "e"), ("r", 1, "b", "x", None, at(1), None, None), ("r", 1, "c", "x", 1, at(1), None, None), ("r", 1, None, "x", 1, at(1), None, None),
        ("r", 3, "a", "old", 9, at(2), None, None), ("r", 3, "a", "x", 1, at(9), None, None), ("r", 3, "a", "x", 1, at(9), None, None), ("r", 3, "b", "x", 1, at(2), None, None), ("r", 3, "d", None, 1, at(2), None, None),
        ("r", 4, "a", "x", 1, at(3), None, None), ("r", 4, "b", "x", 1, at(3), None, None), ("r", 4, "d", "", 1, at(3), None, None), ("r", 4, "c", "x", 1, at(3), None, None),
        ("late", 3, "a", "x", 1, at(1), None, None), ("late", 4, "a", "x", 1, None, None, None), ("gone", 2, "z", "x", 1, at(1), None, None), ("unlogged", 1, "a", "x", 1, at(1), None, None),
    ]
    log = [("r", 1, None), ("r", 3, None), ("r", 3, None), ("r", 4, None), ("late", 3, None), ("late", 4, None), ("gone", 2, None), ("gone", 4, None)]
    assert diff(spark, nodes, log) == sorted([
        ("t", "r", 3, "b", "", "changed"), ("t", "r", 3, "c", "", "removed"), ("t", "r", 3, "d", "", "added"),
        ("t", "r", 4, "d", "", "changed"), ("t", "r", 4, "c", "", "added"), ("t", "gone", 4, "z", "", "removed"),
    ], key=repr)
    assert diff(spark, [], log) == []
    assert diff(spark, nodes, []) == []


def test_changed_values(spark):
    nodes = spark.createDataFrame([("r", 1, "a", "x", 1, at(1)), ("r", 2, "a", "y", None, at(2)), ("r", 1, "b", "x", 1, at(1)), ("r", 2, "b", "x", 1, at(1))], "repo string, snapshot_no int, id string, label string, community int, loaded_at timestamp")
    log = spark.createDataFrame([("r", 1), ("r", 2)], "repo string, snapshot_no int")
    table = Snapshotted("t", nodes, ("id",), ("label", "community"))
    got = snapshot_diff.changed_values(snapshot_diff.snapshot_changes([table], log, 2), table, log).collect()
    assert [(r.key_one, tuple(r.old_values), tuple(r.new_values)) for r in got] == [("a", ("x", 1), ("y", None))]


def test_orphan_kinds(spark):
    nodes = spark.createDataFrame([("r", 1, "a"), ("r", 1, "a"), ("r", 3, "b"), ("r", 2, None), ("s", 2, "c")], "repo string, snapshot_no int, id string")
    orphans = spark.createDataFrame([("r", 2, "a", 1), ("r", 2, "b", 2), ("r", 2, "c", 3), (None, 2, "a", 4)], "repo string, snapshot_no int, ref_id string, first int")
    found = rows(orphan_references.orphan_kinds(orphans, nodes).select("repo", "snapshot_no", "ref_id", "orphan_kind"))
    assert found == sorted([("r", 2, "a", "deleted"), ("r", 2, "b", "later"), ("r", 2, "c", "missing"), (None, 2, "a", "missing")], key=repr)
    assert orphan_references.orphan_kinds(orphans, nodes.limit(0)).where("orphan_kind <> 'missing'").count() == 0
    assert orphan_references.orphan_kinds(orphans.limit(0), nodes).count() == 0


def test_p2_found_takes_the_cascades_direct_orphans(spark, tmp_path, monkeypatch):
    tables = {
        "graph_nodes": ([("r", 1, "a"), ("r", 3, "b"), ("r", 2, None), ("s", 2, "c")], "repo string, snapshot_no int, id string"),
        "agent_edges": ([("r", 2, "a", "b"), ("r", 2, "a", "c"), ("r", 1, "a", None), ("r", 1, None, "z"), ("s", 2, "c", "c"), (None, 2, "a", None)], "repo string, snapshot_no int, from_id string, to_id string"),
        "annotations": ([("r", 3, "a"), ("r", 3, "a"), ("r", 3, None)], "repo string, snapshot_no int, id string"),
    }
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    cascade, used = orphan_references.orphan_cascade, []
    monkeypatch.setattr(orphan_references, "orphan_cascade", lambda *a: used.append(len(a[1])) or cascade(*a))
    assert rows(problems.p2_found(spark, str(tmp_path))) == [
        ("agent_edges", "from_id", "r", 2, "a", "deleted"), ("agent_edges", "from_id", None, 2, "a", "missing"), ("agent_edges", "to_id", "r", 1, "z", "missing"), ("agent_edges", "to_id", "r", 2, "b", "later"),
        ("agent_edges", "to_id", "r", 2, "c", "missing"), ("annotations", "id", "r", 3, "a", "deleted"),
    ]
    assert used == [3]


def test_cascade_follows_chains_and_cycles(spark):
    tables = {
        "part": spark.createDataFrame([("p1", "lost"), ("p2", "p1"), ("p3", "p2"), ("p4", None), ("p5", "p5"), ("p6", "p4"), ("p6", "p4")], "id string, whole string"),
        "note": spark.createDataFrame([("n1", "p3"), ("n2", "p6"), ("n3", "none")], "id string, about string"),
    }
    found = orphan_references.orphan_cascade(tables, [ForeignKey("part", ("whole",), "part", ("id",), ("id",)), ForeignKey("note", ("about",), "part", ("id",), ("id",))])
    assert {(r.in_table, r.record[0], r.level) for r in found.collect()} == {("part", "p1", 0), ("part", "p2", 1), ("part", "p3", 2), ("note", "n1", 3), ("note", "n3", 0)}


def test_cascade_by_other_columns_than_the_record(spark):
    """A child that refers to a parent by a column that is not the parent's record; keys that only pass a state on."""
    tables = {
        "p": spark.createDataFrame([(1, "c1", "gone"), (2, "c2", "here"), (3, None, "gone")], "rid int, code string, root string"),
        "root": spark.createDataFrame([("here",)], "name string"),
        "c": spark.createDataFrame([("x", "c1"), ("y", "c2"), ("z", "c9"), ("n", None)], "id string, code string"),
    }
    root, code = ForeignKey("p", ("root",), "root", ("name",), ("rid",)), ForeignKey("c", ("code",), "p", ("code",), ("id",))
    found = orphan_references.orphan_cascade(tables, [root, code])
    assert {(r.in_table, r.record[0], r.level) for r in found.collect()} == {("p", "1", 0), ("p", "3", 0), ("c", "x", 1), ("c", "z", 0)}
    passing = ForeignKey("c", ("code",), "p", ("code",), ("id",), checked=False)
    assert {(r.in_table, r.record[0], r.level) for r in orphan_references.orphan_cascade(tables, [root, passing]).collect()} == {("p", "1", 0), ("p", "3", 0), ("c", "x", 1)}


def test_long_chain_and_hot_reference(spark):
    chain = [(f"k{i}", f"k{i - 1}") for i in range(1, 9)]
    hot = [(f"h{i}", "nowhere") for i in range(500)] + [(f"u{i}", f"no{i}") for i in range(300)]
    tables = {"t": spark.createDataFrame(chain + hot, "id string, up string")}
    found = orphan_references.orphan_cascade(tables, [ForeignKey("t", ("up",), "t", ("id",), ("id",))]).collect()
    assert {r.record[0]: r.level for r in found} == {**{f"k{i}": i - 1 for i in range(1, 9)}, **dict.fromkeys([k for k, _ in hot], 0)}


def test_joins_give_the_same_rows_by_every_way(spark, monkeypatch):
    """What is broadcast if it is small gives the same rows where nothing counts as small."""
    nodes = [("r", 1, f"n{i}", "x", i, at(1), None, None) for i in range(40)] + [("r", 2, f"n{i}", "y" if i % 3 else "x", i, at(2), None, None) for i in range(5, 50)]
    log = [("r", 1, None), ("r", 2, None)]
    hot = spark.createDataFrame([(f"h{i}", "nowhere") for i in range(300)] + [(f"u{i}", f"no{i}") for i in range(300)], "id string, up string")
    key = ForeignKey("t", ("up",), "t", ("id",), ("id",))
    small = diff(spark, nodes, log), rows(orphan_references.orphan_cascade({"t": hot}, [key]))
    for module in (skew, snapshot_diff, scratch):
        monkeypatch.setattr(module, "fits_broadcast", lambda *a: False)
    assert (diff(spark, nodes, log), rows(orphan_references.orphan_cascade({"t": hot}, [key]))) == small and len(small[0]) == 38


def test_sieve_loses_nothing(spark):
    data = spark.range(5000).selectExpr("concat('k', id) as k", "id")
    wanted = data.where("id % 50 = 0 or k is null")
    left = {r.k for r in skew.sieved(data, wanted.select("k"), ["k"], 1 << 12).collect()}
    assert {f"k{i}" for i in range(0, 5000, 50)} <= left and len(left) < 400
    assert skew.sieved(data, wanted.limit(0).select("k"), ["k"]).count() == 0


def test_key_profile_against_brute_force(spark):
    draw = random.Random(5)
    data = [(draw.choice([None, "hot", "hot", "hot", "k1", "k2"]), draw.choice([None, "x", "y", "z", *map(str, range(40))]), draw.choice([None, 1, 2, 5])) for _ in range(4000)]
    df = spark.createDataFrame(data, "key string, o string, at int").repartition(7)
    for batch in (3, 10000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = rows(heavy_keys.key_profile(heavy_keys.keyed(df, "t.key", F.col("key"), [F.col("o")], F.col("at"))))
        expected = []
        for k in {d[0] for d in data}:
            own = [d for d in data if d[0] == k]
            times = [d[2] for d in own if d[2] is not None]
            expected.append(("t.key", k, len(own), len({d[1] for d in own} - {None}), min(times), max(times)))
        assert got == sorted(expected, key=repr)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert rows(heavy_keys.heavy_keys(heavy_keys.key_profile(heavy_keys.keyed(df, "t.key", F.col("key"), [F.col("o")], F.col("at"))), 3).select("key_text")) == [("hot",)]
    assert heavy_keys.key_profile(heavy_keys.keyed(df.limit(0), "t.key", F.col("key"), [F.col("o")], F.col("at"))).count() == 0
