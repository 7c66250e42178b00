"""Queries of the general problems (p1, p2, p4) over the project's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import heavy_keys, orphan_references, snapshot_diff
from ..operators.orphan_references import ForeignKey
from ..operators.snapshot_diff import Snapshotted
from ..sources.tables import load
from .scratch import broadcast_if_small

NODE_FIELDS = ("label", "file_type", "source_file", "source_location", "community")


def snapshotted(spark: SparkSession, d: str) -> list[Snapshotted]:
    return [
        Snapshotted("graph_nodes", load(spark, d, "graph_nodes"), ("id",), NODE_FIELDS),
        Snapshotted("agent_edges", load(spark, d, "agent_edges"), ("from_id", "to_id"), ("relation",)),
    ]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Nodes and agent edges added, removed or changed since the repo's preceding snapshot."""
    return snapshot_diff.snapshot_changes(snapshotted(spark, d), load(spark, d, "snapshot_log"))


def p1_changed_values(spark: SparkSession, d: str) -> DataFrame:
    """Old and new values of every node that changed, fetched for changed keys only."""
    nodes = snapshotted(spark, d)[0]
    log = load(spark, d, "snapshot_log")
    both = snapshot_diff.changed_values(snapshot_diff.snapshot_changes([nodes], log), nodes, log)
    return both.select("repo", "snapshot_no", F.col("key_one").alias("id"), *[F.col(f"{w}_values.{c}").alias(f"{w}_{c}") for c in NODE_FIELDS for w in ("old", "new")])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """References to nodes that the same repo's snapshot does not hold."""
    tables = {"agent_edges": load(spark, d, "agent_edges"), "annotations": load(spark, d, "annotations"), "graph_nodes": load(spark, d, "graph_nodes").where("id is not null")}
    cascade = orphan_references.orphan_cascade(tables, _node_references())
    ref = F.col("ref")
    direct = cascade.where("level = 0").select("in_table", "in_field", ref[0].alias("repo"), ref[1].cast("int").alias("snapshot_no"), ref[2].alias("ref_id"))
    # without a repo or snapshot a value is no key, so the cascade leaves it out, yet no node answers it
    for table, field in (("agent_edges", "from_id"), ("agent_edges", "to_id"), ("annotations", "id")):
        unplaced = tables[table].where(F.col(field).isNotNull() & (F.col("repo").isNull() | F.col("snapshot_no").isNull()))
        direct = direct.unionByName(unplaced.select(F.lit(table).alias("in_table"), F.lit(field).alias("in_field"), "repo", F.col("snapshot_no").cast("int").alias("snapshot_no"), F.col(field).alias("ref_id")))
    return orphan_references.orphan_kinds(direct.distinct(), tables["graph_nodes"]).select("in_table", "in_field", "repo", "snapshot_no", "ref_id", "orphan_kind")


def _node_references() -> list[ForeignKey]:
    """Both ends of agent edges and the node of an annotation."""
    node = ("repo", "snapshot_no", "id")
    edge = ("repo", "snapshot_no", "from_id", "to_id")
    return [
        ForeignKey("agent_edges", ("repo", "snapshot_no", "from_id"), "graph_nodes", node, edge),
        ForeignKey("agent_edges", ("repo", "snapshot_no", "to_id"), "graph_nodes", node, edge),
        ForeignKey("annotations", node, "graph_nodes", node, node),
    ]


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphaned records per table, field and snapshot number, direct ones and those that hang on them.

    Foreign keys: both ends of agent edges, the node of an annotation, and the file of a node; a node
    without its file passes its state on. ``annotations.peer_id`` names a peer, not a node, so it is no key.
    """
    tables = {
        "graph_nodes": load(spark, d, "graph_nodes").withColumn("source_file", F.when(F.col("source_file") != "", F.col("source_file"))).where("id is not null"),
        "agent_edges": load(spark, d, "agent_edges"),
        "annotations": load(spark, d, "annotations"),
        "source_files": load(spark, d, "source_files"),
    }
    file = ForeignKey("graph_nodes", ("repo", "source_file"), "source_files", ("repo", "source_file"), ("repo", "snapshot_no", "id"))
    cascade = orphan_references.orphan_cascade(tables, [file, *_node_references()])
    return cascade.groupBy("in_table", "in_field", F.col("record")[1].cast("int").alias("snapshot_no")).agg(
        F.count(F.when(F.col("level") == 0, 1)).alias("n_direct"), F.count(F.when(F.col("level") > 0, 1)).alias("n_inherited"),
    )


def p2_trails(spark: SparkSession, d: str) -> DataFrame:
    """What hangs on trails of agent edges that begin at a node that is not there, by how far along it is.

    An edge with a missing end is a direct orphan. An edge that goes on from the end of an orphaned one,
    and a note about such an end, inherit its state, and so on along the trail.
    """
    tables = {"agent_edges": load(spark, d, "agent_edges"), "annotations": load(spark, d, "annotations"), "graph_nodes": load(spark, d, "graph_nodes").where("id is not null")}
    end, edge, node = ("repo", "snapshot_no", "to_id"), ("repo", "snapshot_no", "from_id", "to_id"), ("repo", "snapshot_no", "id")
    onward = [ForeignKey("agent_edges", ("repo", "snapshot_no", "from_id"), "agent_edges", end, edge, False), ForeignKey("annotations", node, "agent_edges", end, node, False)]
    cascade = orphan_references.orphan_cascade(tables, [*_node_references(), *onward])
    return cascade.groupBy("in_table", "in_field", F.col("record")[1].cast("int").alias("snapshot_no"), "level").agg(F.count(F.lit(1)).alias("n_records"))


def keyed_rows(spark: SparkSession, d: str) -> DataFrame:
    """Communities and node ids of the node snapshots, and both ends of the newest links, as one keyed input."""
    nodes, links = load(spark, d, "graph_nodes"), load(spark, d, "graph_links")
    newest = load(spark, d, "snapshot_log").groupBy("repo").agg(F.max("snapshot_no").alias("snapshot_no"))
    links = links.join(broadcast_if_small(newest), "repo", "left")
    at = F.col("snapshot_no")
    col = F.col
    return (
        heavy_keys.keyed(nodes, "graph_nodes.community", col("community"), [col("repo"), col("id")], at)
        .unionByName(heavy_keys.keyed(nodes, "graph_nodes.id", col("id"), [col("repo"), col("id")], at))
        .unionByName(heavy_keys.keyed(links, "graph_links.target", col("target"), [col("repo"), col("source")], at))
        .unionByName(heavy_keys.keyed(links, "graph_links.source", col("source"), [col("repo"), col("target")], at))
    )


def _split_field(df: DataFrame) -> DataFrame:
    return df.withColumns({"in_table": F.split_part("f", F.lit("."), F.lit(1)), "in_field": F.split_part("f", F.lit("."), F.lit(2))})


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Keys with at least a fiftieth of their table's rows."""
    heavy = heavy_keys.heavy_keys(heavy_keys.key_profile(keyed_rows(spark, d).where("f <> 'graph_links.source'")))
    return _split_field(heavy).select("in_table", "in_field", "key_text")


def p4_profile(spark: SparkSession, d: str) -> DataFrame:
    """Rows, distinct nodes or neighbours, and first and last snapshot of every community and node id."""
    profile = _split_field(heavy_keys.key_profile(keyed_rows(spark, d)))
    return profile.select("in_table", "in_field", "key_text", "n_rows", "n_distinct", F.col("first_at").alias("first_snapshot"), F.col("last_at").alias("last_snapshot"))


def newest_nodes(spark: SparkSession, d: str, fields: list[str]) -> DataFrame:
    """The standing row of every node of the repo's newest delivered snapshot."""
    newest = load(spark, d, "snapshot_log").groupBy("repo").agg(F.max("snapshot_no").alias("snapshot_no"))
    rows = load(spark, d, "graph_nodes").where("id is not null").join(broadcast_if_small(newest), ["repo", "snapshot_no"])
    last = rows.groupBy("repo", "id").agg(F.max(F.struct("loaded_at", *fields)).alias("row"))
    return last.select("repo", "id", *[F.col(f"row.{c}").alias(c) for c in fields])


QUERIES = {"p1_found": p1_found, "p1_changed_values": p1_changed_values, "p2_found": p2_found, "p2_report": p2_report, "p2_trails": p2_trails, "p4_found": p4_found, "p4_profile": p4_profile}

_P1 = """
with log as (select repo, snapshot_no, lag(snapshot_no) over (partition by repo order by snapshot_no) as prev_no from (select distinct repo, snapshot_no from snapshot_log)),
n as (select repo, snapshot_no, id, arg_max(row(label, file_type, source_file, source_location, community), loaded_at) as v from graph_nodes where id is not null group by all),
e as (select repo, snapshot_no, from_id, to_id, arg_max(row(relation), loaded_at) as v from agent_edges where from_id is not null and to_id is not null group by all),
r as (select 'graph_nodes' as in_table, repo, snapshot_no, id as key_one, '' as key_two, v::varchar as v from n union all select 'agent_edges', repo, snapshot_no, from_id, to_id, v::varchar from e),
new as (select r.*, prev_no from r join log using (repo, snapshot_no) where prev_no is not null),
old as (select r.in_table, r.repo, log.snapshot_no, r.key_one, r.key_two, r.v from r join log on r.repo = log.repo and r.snapshot_no = log.prev_no)
select in_table, repo, snapshot_no::int as snapshot_no, key_one, key_two, case when old.v is null then 'added' when new.v is null then 'removed' else 'changed' end as change_kind
from new full join old using (in_table, repo, snapshot_no, key_one, key_two) where old.v is distinct from new.v
"""
_P1_VALUES = """
with log as (select repo, snapshot_no, lag(snapshot_no) over (partition by repo order by snapshot_no) as prev_no from (select distinct repo, snapshot_no from snapshot_log)),
n as (select repo, snapshot_no, id, arg_max(struct_pack(label, file_type, source_file, source_location, community), loaded_at) as v from graph_nodes where id is not null group by all)
select b.repo, b.snapshot_no::int as snapshot_no, b.id, a.v.label as old_label, b.v.label as new_label, a.v.file_type as old_file_type, b.v.file_type as new_file_type, a.v.source_file as old_source_file, b.v.source_file as new_source_file,
a.v.source_location as old_source_location, b.v.source_location as new_source_location, a.v.community as old_community, b.v.community as new_community
from n b join log on b.repo = log.repo and b.snapshot_no = log.snapshot_no join n a on a.repo = b.repo and a.id = b.id and a.snapshot_no = log.prev_no where a.v::varchar <> b.v::varchar
"""
_P2 = """
with refs as (select 'agent_edges' as in_table, 'from_id' as in_field, repo, snapshot_no, from_id as ref_id from agent_edges union select 'agent_edges', 'to_id', repo, snapshot_no, to_id from agent_edges union select 'annotations', 'id', repo, snapshot_no, id from annotations),
seen as (select repo, id, min(snapshot_no) as low from graph_nodes where id is not null group by all)
select in_table, in_field, refs.repo, refs.snapshot_no, ref_id, case when low is null then 'missing' when low < refs.snapshot_no then 'deleted' else 'later' end as orphan_kind
from refs left join seen on seen.repo = refs.repo and seen.id = ref_id
where ref_id is not null and not exists (select 1 from graph_nodes g where g.repo = refs.repo and g.snapshot_no = refs.snapshot_no and g.id = ref_id)
"""
_P2_REPORT = """
with node as (select distinct repo, snapshot_no, id from graph_nodes where id is not null),
lost as (select distinct repo, snapshot_no, id from graph_nodes g where id is not null and source_file <> '' and not exists (select 1 from source_files f where f.repo = g.repo and f.source_file = g.source_file)),
refs as (select distinct 'agent_edges' as in_table, 'from_id' as in_field, repo, snapshot_no, from_id as ref_id, from_id as a, to_id as b from agent_edges where from_id is not null
union all select distinct 'agent_edges', 'to_id', repo, snapshot_no, to_id, from_id, to_id from agent_edges where to_id is not null
union all select distinct 'annotations', 'id', repo, snapshot_no, id, id, null from annotations where id is not null),
direct as (select * from refs where not exists (select 1 from node where node.repo = refs.repo and node.snapshot_no = refs.snapshot_no and node.id = ref_id)),
inherited as (select * from refs where exists (select 1 from lost where lost.repo = refs.repo and lost.snapshot_no = refs.snapshot_no and lost.id = ref_id)
and not exists (select 1 from direct d where d.in_table = refs.in_table and d.repo = refs.repo and d.snapshot_no = refs.snapshot_no and d.a is not distinct from refs.a and d.b is not distinct from refs.b))
select in_table, in_field, snapshot_no, sum(direct)::bigint as n_direct, sum(1 - direct)::bigint as n_inherited from (
select in_table, in_field, snapshot_no, 1 as direct from direct union all select in_table, in_field, snapshot_no, 0 from inherited
union all select 'graph_nodes', 'source_file', snapshot_no, 1 from (select distinct repo, snapshot_no, id, source_file from graph_nodes g where id is not null and source_file <> '' and not exists (select 1 from source_files f where f.repo = g.repo and f.source_file = g.source_file))) group by all
"""
_P2_TRAILS = """
with recursive node as (select distinct repo, snapshot_no, id from graph_nodes where id is not null),
edge as (select distinct repo, snapshot_no, from_id, to_id from agent_edges where repo is not null and snapshot_no is not null),
note as (select distinct repo, snapshot_no, id from annotations where repo is not null and snapshot_no is not null and id is not null),
bad_from as (select * from edge where from_id is not null and not exists (select 1 from node n where n.repo = edge.repo and n.snapshot_no = edge.snapshot_no and n.id = from_id)),
bad_to as (select * from edge where to_id is not null and not exists (select 1 from node n where n.repo = edge.repo and n.snapshot_no = edge.snapshot_no and n.id = to_id)),
bad_note as (select * from note where not exists (select 1 from node n where n.repo = note.repo and n.snapshot_no = note.snapshot_no and n.id = note.id)),
walk as (select *, 0 as level from (select * from bad_from union select * from bad_to) union
select e.repo, e.snapshot_no, e.from_id, e.to_id, level + 1 from walk w join edge e on e.repo = w.repo and e.snapshot_no = w.snapshot_no and e.from_id = w.to_id where level < 40),
lv as (select repo, snapshot_no, from_id, to_id, min(level) as level from walk group by all),
nt as (select note.repo, note.snapshot_no, note.id, min(lv.level) + 1 as level from note join lv on lv.repo = note.repo and lv.snapshot_no = note.snapshot_no and lv.to_id = note.id
where not exists (select 1 from bad_note b where b.repo = note.repo and b.snapshot_no = note.snapshot_no and b.id = note.id) group by all)
select in_table, in_field, snapshot_no, level::int as level, count(*) as n_records from (
select 'agent_edges' as in_table, 'from_id' as in_field, snapshot_no, 0 as level from bad_from union all select 'agent_edges', 'to_id', snapshot_no, 0 from bad_to union all select 'agent_edges', 'from_id', snapshot_no, level from lv where level > 0
union all select 'annotations', 'id', snapshot_no, 0 from bad_note union all select 'annotations', 'id', snapshot_no, level from nt) group by all
"""
_P4_ROWS = """
with newest as (select repo, max(snapshot_no) as snapshot_no from snapshot_log group by repo),
k as (select 'graph_nodes' as in_table, 'community' as in_field, community::varchar as key_text, repo || chr(1) || id as o, snapshot_no as snap from graph_nodes
union all select 'graph_nodes', 'id', id, repo || chr(1) || id, snapshot_no from graph_nodes
union all select 'graph_links', 'target', target, l.repo || chr(1) || source, snapshot_no from graph_links l left join newest using (repo)
union all select 'graph_links', 'source', source, l.repo || chr(1) || target, snapshot_no from graph_links l left join newest using (repo))
"""
_P4 = _P4_ROWS + """
select in_table, in_field, key_text from (select in_table, in_field, key_text, count(*) as n from k group by all) join (select in_table, in_field, count(*) as total from k group by all) using (in_table, in_field)
where key_text is not null and in_field <> 'source' and n * 50 >= total
"""
_P4_PROFILE = _P4_ROWS + "select in_table, in_field, key_text, count(*) as n_rows, count(distinct o) as n_distinct, min(snap)::int as first_snapshot, max(snap)::int as last_snapshot from k group by all"
SQL = {"p1_found": _P1, "p1_changed_values": _P1_VALUES, "p2_found": _P2, "p2_report": _P2_REPORT, "p2_trails": _P2_TRAILS, "p4_found": _P4, "p4_profile": _P4_PROFILE}
