"""Concepts that several repos share, and vectors that stand for the same thing.

Both compare the members of a group with its representative alone: the group's smallest member. So the work
grows with the members, not with their pairs. A member that is unlike the representative stays apart, also if it
is like another member.

Defined cases: null and empty labels belong to no group; a node without neighbours is like none; groups within
one repo are no groups; a null or empty vector is like none; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import broadcast_if_small, materialize
from ..plans.skew import join_groups
from .graph import Graph, incident, pairs, whole_links

#: Kinds of file whose nodes are concepts, and the least likeness of neighbours of the same concept.
CONCEPT_TYPES, LIKE = ["document", "paper", "rationale", "image"], 0.5


def _base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/\\]*$", 0)


def _traits(graph: Graph, nodes: DataFrame) -> DataFrame:
    """(repo, id, kind, trait) of the given nodes: labels of neighbours, and names of the files of the node and of its links."""
    labels = graph.nodes.where("label <> ''").select("repo", F.col("id").alias("other"), F.lower("label").alias("trait"))
    near = incident(pairs(graph.links).where("lo <> hi")).join(nodes, ["repo", "id"], "left_semi").join(labels, ["repo", "other"]).select("repo", "id", F.lit("label").alias("kind"), "trait")
    ends = whole_links(graph.links).where("source_file <> ''").select("repo", F.explode(F.array_distinct(F.array("source", "target"))).alias("id"), "source_file")
    own = graph.nodes.where("source_file <> ''").select("repo", "id", "source_file")
    held = own.unionByName(ends).join(nodes, ["repo", "id"], "left_semi").select("repo", "id", F.lit("file").alias("kind"), _base_name(F.col("source_file")).alias("trait"))
    return near.unionByName(held).distinct()


def shared_with_representative(graph: Graph) -> DataFrame:
    """(repo, id, merged_id, likeness, n_files, joined): concept nodes against the first node of any repo with the same label.

    ``likeness`` is the share of neighbours' labels that both have of those that either has; ``n_files`` how many
    file names both are known by. They are one concept if the likeness is enough and they share a file name.
    """
    named = materialize(graph.nodes.where(F.col("file_type").isin(CONCEPT_TYPES) & (F.col("label") != "")).select(F.lower("label").alias("name"), "repo", "id"), "named")
    groups = named.groupBy("name").agg(F.min(F.struct("repo", "id")).alias("first"), F.max("repo").alias("last_repo"), F.count(F.lit(1)).alias("size"))
    groups = materialize(groups.where("first.repo <> last_repo").select("name", F.col("first.repo").alias("first_repo"), F.col("first.id").alias("first_id"), "size"), "groups")
    members = materialize(join_groups(named, groups, ["name"]).where("repo <> first_repo").select("repo", "id", "first_repo", "first_id"), "members")
    both = members.select("repo", "id").unionByName(members.select(F.col("first_repo").alias("repo"), F.col("first_id").alias("id"))).distinct()
    traits = materialize(_traits(graph, materialize(both, "compared")), "traits")
    sizes = traits.where("kind = 'label'").groupBy("repo", "id").agg(F.count(F.lit(1)).alias("n"))
    first = traits.select(F.col("repo").alias("first_repo"), F.col("id").alias("first_id"), "kind", "trait")
    common = members.join(traits, ["repo", "id"]).join(first, ["first_repo", "first_id", "kind", "trait"]).groupBy("repo", "id").agg(
        F.count(F.when(F.col("kind") == "label", 1)).alias("n_shared"), F.count(F.when(F.col("kind") == "file", 1)).alias("n_files"),
    )
    known = members.join(common, ["repo", "id"], "left").join(sizes, ["repo", "id"], "left")
    known = known.join(broadcast_if_small(sizes.select(F.col("repo").alias("first_repo"), F.col("id").alias("first_id"), F.col("n").alias("m"))), ["first_repo", "first_id"], "left")
    n_shared, n_files = F.coalesce("n_shared", F.lit(0)), F.coalesce("n_files", F.lit(0))
    likeness = F.coalesce(F.try_divide(n_shared, F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0)) - n_shared), F.lit(0.0))
    joined = (likeness >= LIKE) & (n_files >= 1)
    return known.select("repo", "id", F.concat("first_repo", F.lit("::"), "first_id").alias("merged_id"), F.round(likeness, 6).alias("likeness"), n_files.alias("n_files"), joined.alias("joined"))


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors of the same length, to three decimals; null where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.round(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), 3) + F.lit(0.0)  # no negative zero


def like_vectors(vectors: DataFrame, group: str, key: str, vector: str, least: float = 0.85) -> DataFrame:
    """(key, first, cosine, same): every vector against the one with the smallest key of its group."""
    first = vectors.where(F.size(vector) > 0).groupBy(group).agg(F.min(key).alias("first"))
    heads = vectors.select(group, F.col(key).alias("first"), F.col(vector).alias("head")).join(first, [group, "first"], "left_semi").dropDuplicates([group])
    both = vectors.join(broadcast_if_small(heads), group).select(F.col(key), "first", cosine(F.col(vector), F.col("head")).alias("cosine"))
    return both.withColumn("same", F.coalesce(F.col("cosine") >= least, F.lit(False)))
