"""Nodes and communities over the snapshots of a repo, and links over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import whole_links

#: Half-lives in days, and the least weight that decay leaves.
HALF_LIFE, ALIKE_HALF_LIFE, FLOOR = 30.0, 14.0, 0.1


def standing_nodes(nodes: DataFrame, fields: list[str], also: list[str] | None = None) -> DataFrame:
    """The standing row of each (repo, snapshot_no, id): the latest loaded, among equals the greatest. ``also`` may name loaded_at."""
    rows = nodes.where("id is not null").groupBy("repo", "snapshot_no", "id").agg(F.max(F.struct("loaded_at", *fields)).alias("row"))
    return rows.select("repo", "snapshot_no", "id", *[F.col(f"row.{c}").alias(c) for c in [*fields, *(also or [])]])


def merged_fields(nodes: DataFrame, fields: list[str]) -> DataFrame:
    """Every (repo, id) once, each field from the latest load that has it, and the number of snapshots that hold it."""
    latest = [F.max(F.when(F.col(c).isNotNull(), F.struct("loaded_at", c))).getField(c).alias(c) for c in fields]
    return nodes.where("id is not null").groupBy("repo", "id").agg(*latest, F.count_distinct("snapshot_no").alias("n_snapshots"))


def entity_trace(nodes: DataFrame) -> DataFrame:
    """Per node: first and last snapshot, how many hold it, and how many communities it was in (none counts as one)."""
    rows = standing_nodes(nodes, ["community"])
    return rows.groupBy("repo", "id").agg(
        F.min("snapshot_no").alias("first_no"), F.max("snapshot_no").alias("last_no"), F.count(F.lit(1)).alias("n_snapshots"), F.count_distinct(F.coalesce("community", F.lit(-1))).alias("n_communities"),
    )


def node_drift(nodes: DataFrame, edges: DataFrame, top: int = 10) -> DataFrame:
    """Nodes of two or more snapshots that moved most: twice the community changes plus the change of degree, first to last."""
    ends = edges.where("from_id is not null and to_id is not null").select("repo", "snapshot_no", F.explode(F.array(F.struct(F.col("from_id").alias("id"), F.col("to_id").alias("other")), F.struct(F.col("to_id").alias("id"), F.col("from_id").alias("other")))).alias("e")).select("repo", "snapshot_no", "e.*")
    degree = ends.distinct().groupBy("repo", "snapshot_no", "id").agg(F.count(F.lit(1)).alias("degree"))
    rows = standing_nodes(nodes, ["community"]).join(degree, ["repo", "snapshot_no", "id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    moved = rows.groupBy("repo", "id").agg(
        F.count(F.lit(1)).alias("n"), (2 * (F.count_distinct(F.coalesce("community", F.lit(-1))) - 1) + F.abs(F.max_by("degree", "snapshot_no") - F.min_by("degree", "snapshot_no"))).alias("score"),
    ).where("n >= 2 and score > 0")
    return moved.withColumn("rank", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= top).select("repo", "rank", "id", "score")


def newly_formed(nodes: DataFrame, log: DataFrame) -> DataFrame:
    """Communities of the newest snapshot none of whose members was in an earlier one: (repo, community, n_nodes)."""
    newest = log.groupBy("repo").agg(F.max("snapshot_no").alias("newest_no"))
    rows = standing_nodes(nodes, ["community"]).join(newest, "repo")
    before = rows.where("snapshot_no < newest_no and community is not null").select("repo", "id").distinct().withColumn("old", F.lit(1))
    now = rows.where("snapshot_no = newest_no and community is not null").join(before, ["repo", "id"], "left")
    return now.groupBy("repo", "community").agg(F.count(F.lit(1)).alias("n_nodes"), F.max("old").alias("old")).where("old is null").drop("old")


def migrations(nodes: DataFrame, log: DataFrame) -> DataFrame:
    """Moves between communities from a repo's last but one to its newest snapshot: (repo, old_community, new_community, n_nodes)."""
    last = log.select("repo", "snapshot_no").distinct().withColumn("back", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("snapshot_no")))).where("back <= 2")
    rows = standing_nodes(nodes, ["community"]).join(last, ["repo", "snapshot_no"])
    new, old = rows.where("back = 1").select("repo", "id", F.col("community").alias("new_community")), rows.where("back = 2").select("repo", "id", F.col("community").alias("old_community"))
    return new.join(old, ["repo", "id"]).where("not (new_community <=> old_community)").groupBy("repo", "old_community", "new_community").agg(F.count(F.lit(1)).alias("n_nodes"))


def merge_plan(nodes: DataFrame, log: DataFrame, fields: list[str]) -> DataFrame:
    """What writing the newest snapshot over the one before would do to each node: create, update, keep or orphan; counted."""
    last = log.select("repo", "snapshot_no").distinct().withColumn("back", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("snapshot_no")))).where("back <= 2")
    rows = standing_nodes(nodes, fields).join(last, ["repo", "snapshot_no"]).select("repo", "id", "back", F.xxhash64(*[x for c in fields for x in (c, F.col(c).isNull())]).alias("fp"))
    sides = rows.groupBy("repo", "id").agg(F.max(F.when(F.col("back") == 1, F.col("fp"))).alias("new"), F.max(F.when(F.col("back") == 2, F.col("fp"))).alias("old"))
    action = F.when(F.col("old").isNull(), "create").when(F.col("new").isNull(), "orphan").when(F.col("new") == F.col("old"), "keep").otherwise("update")
    return sides.groupBy("repo", action.alias("action")).agg(F.count(F.lit(1)).alias("n_nodes"))


def decay(relation: Column, valid_from: Column, now: Column) -> Column:
    """Half of the weight is lost every half-life since ``valid_from``, down to a floor; unknown times keep all of it."""
    days = F.greatest(F.lit(0.0), (F.unix_micros(now.cast("timestamp")) - F.unix_micros(valid_from.cast("timestamp"))) / 86_400e6)
    half = F.when(relation == "semantically_similar_to", ALIKE_HALF_LIFE).otherwise(HALF_LIFE)
    return F.coalesce(F.greatest(F.lit(FLOOR), F.pow(F.lit(0.5), days / half)), F.lit(1.0))


def superseded(links: DataFrame, now: Column) -> DataFrame:
    """Open links that leave a superseded node, closed at ``now``: (repo, source, target, relation, valid_until)."""
    rows = whole_links(links)
    gone = rows.where("relation = 'supersedes' and valid_until is null").select("repo", F.col("target").alias("source")).distinct()
    return rows.where("relation <> 'supersedes' and valid_until is null").join(gone, ["repo", "source"], "left_semi").select("repo", "source", "target", "relation", now.alias("valid_until")).distinct()
