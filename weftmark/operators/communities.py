"""Communities found in the links, and communities compared over snapshots."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import broadcast_if_small, materialize
from ..plans.skew import join_groups
from .analysis import membership, nearest_hosts
from .graph import Graph, incident, kept_links, pairs, whole_links
from .history import standing_nodes


def _turn(at: int) -> Column:
    """Whether a node may move in a round: about half of them, the other half in the next; another halving every two rounds."""
    return F.pmod(F.shiftright("bits", at // 2 % 62) + at, F.lit(2)) == 0


def _moved(edges: DataFrame, state: DataFrame, guard: int = 10_000) -> DataFrame:
    """Rounds of moves until no node gains by one: each joins the neighbouring community of greatest gain in modularity.

    Weights are whole numbers, so gains are exact; among equal gains staying comes first, then the least
    label. Neighbours that move at once would chase each other, hence the turns. A scope without a restless
    node takes no part in later rounds.
    """
    rested: list[DataFrame] = []
    for at in range(guard):
        there = state.select("scope", F.col("id").alias("other"), "label")
        own = ["scope", "id", "label", "k", "two_m", "bits"]
        near = edges.join(there, ["scope", "other"]).select(*own, "w", F.lit(False).alias("home"))
        stay = state.select(*own, F.lit(0).cast("bigint").alias("w"), F.lit(True).alias("home"))
        near = near.unionByName(stay).groupBy(*own).agg(F.sum("w").alias("w"), F.max("home").alias("home"))
        total = state.groupBy("scope", "label").agg(F.sum("k").alias("total"))
        loss = F.col("k") * (F.col("total") - F.when(F.col("home"), F.col("k")).otherwise(0)) - F.col("two_m") * F.col("w")
        best = near.join(total, ["scope", "label"]).groupBy("scope", "id", "k", "two_m", "bits").agg(
            F.min(F.struct(loss.alias("loss"), (~F.col("home")).alias("away"), "label"))["label"].alias("best"),
            F.max(F.when(F.col("home"), F.col("label"))).alias("own"),
        )
        label = F.when(_turn(at), F.col("best")).otherwise(F.col("own")).alias("label")
        moved = materialize(best.select("scope", "id", label, "k", "two_m", "bits", (F.col("best") != F.col("own")).alias("restless")), "labels")
        active = broadcast_if_small(moved.where("restless").select("scope").distinct())
        moved = moved.drop("restless")
        rested.append(moved.join(active, "scope", "left_anti"))
        state = moved.join(active, "scope", "left_semi")
        if active.isEmpty():
            return materialize(reduce(DataFrame.unionByName, rested), "rested")
    raise RuntimeError(f"nodes still move after {guard} rounds")


def _spread_partition(edges: DataFrame, state: DataFrame) -> DataFrame:
    """(scope, id, label): levels of moves over scopes of any size, by joins.

    After each level of moves the communities become the nodes of a smaller graph and move in turn, until a
    level merges nothing. All scopes run in the same rounds; each round and each smaller graph is written.
    """
    member = state.select("scope", "id", "label")
    weighed = lambda df, s: materialize(df.join(s.select("scope", "id", "k", "two_m", "bits"), ["scope", "id"]), "weighed")
    edges = weighed(edges, state)
    while True:
        state = _moved(edges, state)
        lead = state.select("scope", F.col("id").alias("label"), F.col("label").alias("lead"))
        member = materialize(member.join(lead, ["scope", "label"]).select("scope", "id", F.col("lead").alias("label")), "members")
        if state.select("scope", "label").distinct().count() == state.count():
            return member
        ends = lead.withColumnRenamed("label", "id")
        merged = state.groupBy("scope", "label", "two_m").agg(F.sum("k").alias("k"))
        state = materialize(merged.select("scope", F.col("label").alias("id"), "label", "k", "two_m", F.xxhash64("label").alias("bits")), "labels")
        smaller = edges.select("scope", "id", "other", "w").join(ends, ["scope", "id"]).select("scope", F.col("lead").alias("a"), F.col("other").alias("id"), "w").join(ends, ["scope", "id"])
        smaller = smaller.where("a <> lead").groupBy("scope", "a", "lead").agg(F.sum("w").alias("w"))
        edges = weighed(smaller.select("scope", F.col("a").alias("id"), F.col("lead").alias("other"), "w"), state)


def _level(src: np.ndarray, dst: np.ndarray, w: np.ndarray, k: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The rounds of :func:`_moved` over one scope; nodes and labels are ranks of ids, so order is that of the ids."""
    n, two_m = len(k), int(k.sum())
    label, at = np.arange(n), 0
    while True:
        pair, inverse = np.unique(np.concatenate([src * n + label[dst], np.arange(n) * n + label]), return_inverse=True)
        node, near = pair // n, pair % n
        weight = np.bincount(inverse, np.concatenate([w, np.zeros(n, np.int64)]), len(pair)).astype(np.int64)
        away = near != label[node]
        total = np.bincount(label, k, n).astype(np.int64)
        loss = k[node] * (total[near] - np.where(away, 0, k[node])) - two_m * weight
        order = np.lexsort((near, away, loss, node))
        best = near[order][np.searchsorted(node[order], np.arange(n))]
        if (best == label).all():
            return label
        label = np.where(((bits >> (at // 2 % 62)) + at) % 2 == 0, best, label)
        at += 1


def _small_partition(scope: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The levels of :func:`_spread_partition` for one scope of bounded size; ``rows`` are its links with their ends' hashes."""
    ids, src = np.unique(rows["id"].to_numpy(str), return_inverse=True)
    dst, w = np.searchsorted(ids, rows["other"].to_numpy(str)), rows["w"].to_numpy(np.int64)
    bits = np.zeros(len(ids), np.int64)
    bits[src] = rows["bits"].to_numpy(np.int64)
    k, member, rank = np.bincount(src, w, len(ids)).astype(np.int64), np.arange(len(ids)), np.arange(len(ids))
    while True:
        label = _level(src, dst, w, k, bits)
        heads, place = np.unique(label, return_inverse=True)
        member, rank = place[member], rank[heads]
        if len(heads) == len(label):
            return pd.DataFrame({"scope": rows["scope"].iloc[0], "id": ids, "label": ids[rank[member]]})
        bits, k = bits[heads], np.bincount(place, k, len(heads)).astype(np.int64)
        pair, inverse = np.unique((place[src] * len(heads) + place[dst])[place[src] != place[dst]], return_inverse=True)
        w = np.bincount(inverse, w[place[src] != place[dst]], len(pair)).astype(np.int64)
        src, dst = pair // len(heads), pair % len(heads)


def partition(edges: DataFrame, small: int = 200_000) -> DataFrame:
    """(scope, id, label) of the nodes at ``edges`` (scope, id, other, w), given in both directions without loops.

    Moves go level by level until no node gains and no level merges anything. A scope of up to ``small``
    link rows is settled within one task, since its rounds cost nothing there; larger ones take the same
    rounds by joins over the cluster. Both ways follow the same rules in whole numbers and give the same result.
    """
    plain = materialize(edges, "weighed")
    if plain.isEmpty():
        return plain.select("scope", "id", F.col("id").alias("label"))
    sizes = materialize(plain.groupBy("scope").agg(F.count(F.lit(1)).alias("size"), F.sum("w").alias("two_m")), "scopes")
    bounded = broadcast_if_small(sizes.where(F.col("size") <= small).select("scope"))
    rows = plain.join(bounded, "scope", "left_semi").withColumn("bits", F.xxhash64("id"))
    settled = rows.groupBy("scope").applyInPandas(_small_partition, "scope string, id string, label string")
    large = sizes.where(F.col("size") > small)
    if large.isEmpty():
        return materialize(settled, "members")
    rest = materialize(plain.join(broadcast_if_small(large.select("scope")), "scope", "left_semi"), "weighed")
    degree = rest.groupBy("scope", "id").agg(F.sum("w").alias("k")).join(broadcast_if_small(large.select("scope", "two_m")), "scope")
    state = materialize(degree.select("scope", "id", F.col("id").alias("label"), "k", "two_m", F.xxhash64("id").alias("bits")), "labels")
    return materialize(settled.unionByName(_spread_partition(rest, state)), "members")


def detect(graph: Graph, most_share: float = 0.25, least_split: int = 10) -> DataFrame:
    """(repo, id, community, n_members): communities by modularity, named by their smallest member.

    Every distinct pair of nodes weighs one; links that name no node and loops do not count. A
    community above ``least_split`` members and above ``most_share`` of its repo's nodes is divided
    once more by its inner links. A node without links is a community of its own.
    """
    ids = graph.nodes.select("repo", "id").distinct()
    steps = materialize(incident(pairs(kept_links(graph)).where("lo <> hi")), "steps")
    one = F.lit(1).cast("bigint").alias("w")
    scope = lambda part: F.concat(F.hex("repo"), F.lit(" "), part).alias("scope")
    repo = F.decode(F.unhex(F.split_part("scope", F.lit(" "), F.lit(1))), "utf-8").alias("repo")
    first = partition(steps.select(scope(F.lit("")), "id", "other", one)).select(repo, "id", F.col("label").alias("part"))
    most = ids.groupBy("repo").agg(F.greatest(F.lit(least_split), F.floor(F.count(F.lit(1)) * most_share)).alias("most"))
    large = materialize(first.groupBy("repo", "part").agg(F.count(F.lit(1)).alias("n")).join(most, "repo").where("n > most").select("repo", "part"), "large")
    split = materialize(first.join(broadcast_if_small(large), ["repo", "part"], "left_semi"), "split")
    other = split.select("repo", F.col("id").alias("other"), F.col("part").alias("other_part"))
    inner = steps.join(split, ["repo", "id"]).join(other, ["repo", "other"]).where("part = other_part")
    second = partition(inner.select(scope(F.col("part")), "id", "other", one)).select(repo, "id", F.col("label").alias("sub"))
    alone = F.coalesce("sub", F.when(F.col("divided"), F.col("id")), F.lit(""))
    placed = ids.join(first, ["repo", "id"], "left").join(second, ["repo", "id"], "left").join(broadcast_if_small(large.withColumn("divided", F.lit(True))), ["repo", "part"], "left")
    placed = materialize(placed.select("repo", "id", F.coalesce("part", "id").alias("part"), alone.alias("sub"), F.col("part").isNull().alias("single")), "placed")
    keys = ["repo", "part", "sub", "single"]
    groups = materialize(placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), F.count(F.lit(1)).alias("n_members"), F.min("id").alias("community")), "groups")
    return join_groups(placed, groups, keys).select("repo", "id", "community", "n_members")


def modularity(graph: Graph, members: DataFrame) -> DataFrame:
    """(repo, modularity) of a division (repo, id, community) over the distinct pairs between nodes, loops left out."""
    steps = incident(pairs(kept_links(graph)).where("lo <> hi")).join(members.select("repo", "id", "community"), ["repo", "id"])
    there = members.select("repo", F.col("id").alias("other"), F.col("community").alias("there"))
    inner = steps.join(there, ["repo", "other"]).groupBy("repo", "community").agg(F.count(F.lit(1)).alias("k"), F.count(F.when(F.col("community") == F.col("there"), 1)).alias("within"))
    two_m = F.sum("k")
    return inner.groupBy("repo").agg((F.sum("within") / two_m - F.sum((F.col("k") * F.col("k")).cast("decimal(38,0)")).cast("double") / (two_m * two_m)).alias("modularity"))


def last_two(log: DataFrame) -> DataFrame:
    """(repo, snapshot_no, back): a repo's newest delivered snapshot (back 1) and the one before (back 2)."""
    first = Window.partitionBy("repo").orderBy(F.desc("snapshot_no"))
    return log.select("repo", "snapshot_no").distinct().withColumn("back", F.row_number().over(first)).where("back <= 2")


def _old_and_new(nodes: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = membership_of(nodes, log)
    return rows.where("back = 2").select("repo", "id", F.col("community").alias("old_community")), rows.where("back = 1").select("repo", "id", F.col("community").alias("new_community"))


def membership_of(nodes: DataFrame, log: DataFrame) -> DataFrame:
    """Members of communities in the last two snapshots; nodes without one are members of none."""
    return standing_nodes(nodes, ["community"]).where("community is not null").join(broadcast_if_small(last_two(log)), ["repo", "snapshot_no"])


def matched(nodes: DataFrame, log: DataFrame, least: float = 0.7) -> DataFrame:
    """Communities of the last but one snapshot and their like in the newest: shared members of all members at least ``least``.

    Above one half no community has two partners, since communities of one snapshot share no member;
    so a plain join gives the one-to-one match.
    """
    old, new = _old_and_new(nodes, log)
    count = F.count(F.lit(1))
    both = old.join(new, ["repo", "id"]).groupBy("repo", "old_community", "new_community").agg(count.alias("n_shared"))
    sized = both.join(old.groupBy("repo", "old_community").agg(count.alias("n_old")), ["repo", "old_community"]).join(new.groupBy("repo", "new_community").agg(count.alias("n_new")), ["repo", "new_community"])
    likeness = F.col("n_shared") / (F.col("n_old") + F.col("n_new") - F.col("n_shared"))
    return sized.withColumn("likeness", likeness).where(F.col("likeness") >= least).select("repo", "old_community", "new_community", "n_shared", "likeness")


def link_drift(links: DataFrame, nodes: DataFrame, log: DataFrame, relations: list[str]) -> DataFrame:
    """Links of ``relations`` by what became of their ends' communities.

    orphaned: an end is in no community of either snapshot; community-resharded: an end's old
    community has no like; stable: both ends kept their community's number and it is its own like;
    else community-renamed.
    """
    old, new = _old_and_new(nodes, log)
    like = matched(nodes, log).select("repo", "old_community", F.col("new_community").alias("like"))
    ends = materialize(old.join(new, ["repo", "id"]).join(broadcast_if_small(materialize(like, "likes")), ["repo", "old_community"], "left"), "ends")
    rank = F.when(F.col("like").isNull(), 2).when((F.col("like") == F.col("new_community")) & (F.col("old_community") == F.col("new_community")), 0).otherwise(1)
    end = lambda side: ends.select("repo", F.col("id").alias(side), rank.alias(f"{side}_rank"))
    rows = whole_links(links).where(F.col("relation").isin(relations)).select("repo", "source", "target", "relation").distinct()
    worst = F.greatest("source_rank", "target_rank")
    kind = F.when(F.col("source_rank").isNull() | F.col("target_rank").isNull(), "orphaned").when(worst == 2, "community-resharded").when(worst == 1, "community-renamed").otherwise("stable")
    return rows.join(end("source"), ["repo", "source"], "left").join(end("target"), ["repo", "target"], "left").select("repo", "source", "target", "relation", kind.alias("drift"))


def routes(graph: Graph, least_size: int = 6) -> DataFrame:
    """Where each community is described: by a page of its own from ``least_size`` members on, else with its host, else in bucket -1."""
    sizes = membership(graph.nodes).groupBy("repo", "community").agg(F.count(F.lit(1)).alias("n_nodes"))
    hosted = sizes.join(nearest_hosts(graph, least_size).select("repo", "community", "host"), ["repo", "community"], "left")
    return hosted.select("repo", "community", "n_nodes", F.when(F.col("n_nodes") >= least_size, F.col("community")).otherwise(F.coalesce("host", F.lit(-1))).alias("page"))


def signatures(graph: Graph) -> DataFrame:
    """A number per community that depends on its members alone, in no order: the sum of 32 bits of each id's digest."""
    bits = F.conv(F.substring(F.md5("id"), 1, 8), 16, 10).cast("bigint")
    return membership(graph.nodes).groupBy("repo", "community").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum(bits).alias("signature"))
