"""Betweenness of nodes and links, from shortest paths out of some sources of each repo.

Level by level the number of shortest paths from every source grows outwards; then, from the last level
back to the first, each node hands on to those before it the share of paths that lead through them. All
repos and sources run in the same rounds, one row per source and node reached: so the tables hold as many
rows as nodes times sources, and the rounds are as many as the longest shortest path has links, twice.

With at least as many sources as a repo has linked nodes the result is exact; with fewer it is scaled up,
and its error falls with the square root of their number. Defined cases: repeated links count once; loops do
not count; nodes that no path leads through have 0; repos of fewer than three linked nodes have 0 throughout;
empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import materialize
from .graph import Graph, incident, pairs

AT = ["repo", "source", "id"]


def sampled_sources(steps: DataFrame, most: int) -> DataFrame:
    """(repo, source): up to ``most`` linked nodes of each repo, chosen by the digests of their ids."""
    first = Window.partitionBy("repo").orderBy(F.xxhash64("id"), "id")
    nodes = steps.select("repo", "id").distinct().withColumn("no", F.row_number().over(first))
    return nodes.where(F.col("no") <= most).select("repo", F.col("id").alias("source"))


def _counted_levels(steps: DataFrame, sources: DataFrame) -> list[DataFrame]:
    """Written levels (repo, source, id, paths): nodes first reached after 0, 1, ... links, with the number of shortest paths to them.

    Links go both ways, so only the two levels before can hold a node again.
    """
    levels = [materialize(sources.select("repo", "source", F.col("source").alias("id"), F.lit(1.0).alias("paths")), "level")]
    while True:
        onward = levels[-1].join(steps, ["repo", "id"]).groupBy("repo", "source", F.col("other").alias("id")).agg(F.sum("paths").alias("paths"))
        seen = reduce(DataFrame.unionByName, [x.select(*AT) for x in levels[-2:]])
        level = materialize(onward.join(seen, AT, "left_anti"), "level")
        if level.isEmpty():
            return levels
        levels.append(level)


def betweenness(graph: Graph, most_sources: int = 16) -> tuple[DataFrame, DataFrame]:
    """((repo, id, betweenness), (repo, lo, hi, betweenness)) of linked nodes and of linked pairs, as shares of all pairs of nodes."""
    links = pairs(graph.links).where("lo <> hi")
    steps = materialize(incident(links), "steps")
    sources = materialize(sampled_sources(steps, most_sources), "sources")
    levels = _counted_levels(steps, sources)
    later = levels[-1].withColumn("share", F.lit(0.0))
    through, across = [], []
    for level in reversed(levels[:-1]):
        # what each node of the later level hands on to a node before it, in proportion to the paths that come from there
        beyond = later.select("repo", "source", F.col("id").alias("other"), ((1 + F.col("share")) / F.col("paths")).alias("unit"))
        handed = level.join(steps, ["repo", "id"]).join(beyond, ["repo", "source", "other"]).select(*AT, "other", (F.col("paths") * F.col("unit")).alias("share"))
        handed = materialize(handed, "handed")
        across.append(handed.groupBy("repo", F.least("id", "other").alias("lo"), F.greatest("id", "other").alias("hi")).agg(F.sum("share").alias("share")))
        later = materialize(level.join(handed.groupBy(*AT).agg(F.sum("share").alias("share")), AT, "left").withColumn("share", F.coalesce("share", F.lit(0.0))), "shares")
        through.append(later.where("id <> source").select("repo", "id", "share"))
    none = lambda keys: steps.limit(0).select(*[F.lit("").alias(k) for k in keys], F.lit(0.0).alias("share"))
    total = lambda parts, keys: reduce(DataFrame.unionByName, parts or [none(keys)]).groupBy(*keys).agg(F.sum("share").alias("share"))
    count = F.count(F.lit(1))
    sizes = steps.select("repo", "id").distinct().groupBy("repo").agg(count.cast("double").alias("n")).join(sources.groupBy("repo").agg(count.alias("k")), "repo")
    share = lambda whole: F.round(F.coalesce(F.col("share") * F.col("n") / F.col("k") / F.when(whole > 0, whole), F.lit(0.0)), 9).alias("betweenness")
    nodes = steps.select("repo", "id").distinct().join(total(through, ["repo", "id"]), ["repo", "id"], "left").join(sizes, "repo")
    both = links.join(total(across, ["repo", "lo", "hi"]), ["repo", "lo", "hi"], "left").join(sizes, "repo")
    n = F.col("n")
    return nodes.select("repo", "id", share((n - 1) * (n - 2))), both.select("repo", "lo", "hi", share(n * (n - 1)))
