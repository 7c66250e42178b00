"""Reachability over the graph: level by level, with every level written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialize
from .graph import Graph, incident, pairs, whole_links


def levels(steps: DataFrame, seeds: DataFrame, depth: int, within: list[str] | None = None) -> DataFrame:
    """Breadth-first levels: (repo, id, depth) of all nodes within ``depth`` steps of the seeds (repo, id).

    ``steps`` are (repo, id, other). Columns of the seeds named in ``within`` keep several walks of a
    repo apart. A level is distinct by node before it is joined again, so a hub is expanded once;
    nodes seen before are dropped by an anti-join.
    """
    apart = ["repo", *(within or [])]
    steps = materialize(steps.select("repo", "id", "other"), "steps")
    seen = materialize(seeds.select(*apart, "id").distinct().withColumn("depth", F.lit(0)), "level")
    frontier = seen
    for at in range(1, depth + 1):
        reached = frontier.join(steps, ["repo", "id"]).select(*apart, F.col("other").alias("id")).distinct()
        frontier = materialize(reached.join(seen.select(*apart, "id"), [*apart, "id"], "left_anti").withColumn("depth", F.lit(at)), "level")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def neighbourhood(graph: Graph, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """Levels over links taken in both directions."""
    return levels(incident(pairs(graph.links)), seeds, depth)


def along(graph: Graph, seeds: DataFrame, relations: list[str], depth: int = 3, direction: str = "out") -> DataFrame:
    """Levels over links of given relations, in their direction, against it, or both."""
    chosen = whole_links(graph.links).where(F.col("relation").isin(relations))
    out = chosen.select("repo", F.col("source").alias("id"), F.col("target").alias("other"))
    back = chosen.select("repo", F.col("target").alias("id"), F.col("source").alias("other"))
    return levels({"out": out, "in": back, "both": out.unionByName(back)}[direction].distinct(), seeds, depth)


def induced(graph: Graph, members: DataFrame) -> DataFrame:
    """Distinct pairs of ``graph`` with both ends among ``members`` (repo, id)."""
    ids = members.select("repo", "id").distinct()
    return pairs(graph.links).join(ids.withColumnRenamed("id", "lo"), ["repo", "lo"], "left_semi").join(ids.withColumnRenamed("id", "hi"), ["repo", "hi"], "left_semi")


def components(graph: Graph) -> DataFrame:
    """(repo, id, component): the smallest id that each linked node can reach.

    Every round takes the smallest label among a node and its neighbours, then the label's own label
    (pointer jumping), so the rounds grow with the logarithm of the longest path.
    """
    steps = materialize(incident(pairs(graph.links)), "steps")
    labels = materialize(steps.groupBy("repo", "id").agg(F.least(F.first("id"), F.min("other")).alias("label")), "labels")
    while True:
        near = steps.join(labels.select("repo", F.col("id").alias("other"), "label"), ["repo", "other"]).groupBy("repo", "id").agg(F.min("label").alias("near"))
        closer = labels.join(near, ["repo", "id"]).select("repo", "id", "label", F.least("label", "near").alias("next"))
        jump = labels.select("repo", F.col("id").alias("next"), F.col("label").alias("far"))
        moved = materialize(closer.join(jump, ["repo", "next"]).select("repo", "id", F.col("label").alias("old"), F.least("next", "far").alias("label")), "labels")
        labels = moved.select("repo", "id", "label")
        if moved.where("old <> label").isEmpty():
            return labels.withColumnRenamed("label", "component")


def layers(links: DataFrame, relations: list[str]) -> DataFrame:
    """(repo, id, layer) of the nodes at ``relations``: 0 where nothing points to, else one more than the highest layer that points to it.

    Layers are peeled off round by round; nodes on a cycle or behind one have no layer (null).
    """
    steps = materialize(whole_links(links).where(F.col("relation").isin(relations)).select("repo", F.col("source").alias("id"), F.col("target").alias("other")).distinct(), "steps")
    left = materialize(steps.select("repo", F.explode(F.array("id", "other")).alias("id")).distinct(), "left")
    done, at = None, 0
    while True:
        held = steps.select("repo", F.col("other").alias("id"))
        layer = materialize(left.join(held, ["repo", "id"], "left_anti"), "layer")
        found = layer.withColumn("layer", F.lit(at))
        done = found if done is None else done.unionByName(found)
        if layer.isEmpty():
            return done.unionByName(left.withColumn("layer", F.lit(None).cast("int")))
        left = materialize(left.join(layer, ["repo", "id"], "left_anti"), "left")
        steps = materialize(steps.join(layer, ["repo", "id"], "left_anti"), "steps")
        at += 1
