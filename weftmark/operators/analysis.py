"""Communities, surprising links, gaps and reasoning over the graph, as joins and aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import materialize
from .graph import REASONING, STRUCTURAL, Graph, described, merged_links, pairs, whole_links


def category(path: Column) -> Column:
    """Kind of file by its suffix: code, paper, image or doc."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ext.isin("py", "ts", "js", "go", "rs", "java", "cpp", "c", "rb", "swift", "kt", "cs"), "code").when(ext == "pdf", "paper").when(ext.isin("png", "jpg", "jpeg", "webp", "gif", "svg"), "image").otherwise("doc")


def membership(nodes: DataFrame) -> DataFrame:
    return nodes.where("community is not null").select("repo", "id", "community")


def _with_ends(links: DataFrame, ends: DataFrame, columns: list[str], lo: str, hi: str) -> DataFrame:
    """``links`` with ``columns`` of either end, prefixed by a_ and b_; links without both ends drop out."""
    a = ends.select("repo", F.col("id").alias(lo), *[F.col(c).alias(f"a_{c}") for c in columns])
    b = ends.select("repo", F.col("id").alias(hi), *[F.col(c).alias(f"b_{c}") for c in columns])
    return links.join(a, ["repo", lo]).join(b, ["repo", hi])


def cohesion(graph: Graph) -> DataFrame:
    """Per community: members, links among them, and their share of all possible ones (1 for a single member)."""
    own = membership(graph.nodes)
    inner = _with_ends(pairs(graph.links).where("lo <> hi"), own, ["community"], "lo", "hi").where("a_community = b_community").groupBy("repo", F.col("a_community").alias("community")).agg(F.count(F.lit(1)).alias("n_links"))
    n = F.col("n_nodes")
    return (
        own.groupBy("repo", "community").agg(F.count(F.lit(1)).alias("n_nodes")).join(inner, ["repo", "community"], "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))
        .withColumn("cohesion", F.when(n <= 1, 1.0).otherwise(F.col("n_links") / (n * (n - 1) / 2)))
    )


def inter_community(graph: Graph) -> DataFrame:
    """Number of linked pairs between two communities of a repo: (repo, lo_community, hi_community, n_links)."""
    ends = _with_ends(pairs(graph.links), membership(graph.nodes), ["community"], "lo", "hi").where("a_community <> b_community")
    return ends.groupBy("repo", F.least("a_community", "b_community").alias("lo_community"), F.greatest("a_community", "b_community").alias("hi_community")).agg(F.count(F.lit(1)).alias("n_links"))


def community_labels(graph: Graph) -> DataFrame:
    """The label of each community's real member with most neighbours; 'Community n' where there is none."""
    members = described(graph).where("community is not null")
    real = members.where("not is_file and not is_concept and coalesce(label, '') <> ''")
    ranked = real.withColumn("rank", F.row_number().over(Window.partitionBy("repo", "community").orderBy(F.desc("degree"), "id"))).where("rank = 1")
    return members.select("repo", "community").distinct().join(ranked.select("repo", "community", "label"), ["repo", "community"], "left").select("repo", "community", F.coalesce("label", F.concat(F.lit("Community "), F.col("community").cast("string"))).alias("label"))


def nearest_hosts(graph: Graph, least_size: int = 6) -> DataFrame:
    """For each community below ``least_size`` the larger one with most links to it, then most members, then the lowest number."""
    sizes = membership(graph.nodes).groupBy("repo", "community").agg(F.count(F.lit(1)).alias("size"))
    both = inter_community(graph)
    ways = both.select("repo", F.explode(F.array(F.struct(F.col("lo_community").alias("community"), F.col("hi_community").alias("host")), F.struct(F.col("hi_community").alias("community"), F.col("lo_community").alias("host")))).alias("w"), "n_links").select("repo", "w.*", "n_links")
    small = ways.join(sizes.where(F.col("size") < least_size).select("repo", "community"), ["repo", "community"], "left_semi")
    hosted = small.join(sizes.where(F.col("size") >= least_size).select("repo", F.col("community").alias("host"), "size"), ["repo", "host"])
    first = Window.partitionBy("repo", "community").orderBy(F.desc("n_links"), F.desc("size"), "host")
    return hosted.withColumn("rank", F.row_number().over(first)).where("rank = 1").select("repo", "community", "host", "n_links")


def surprises(graph: Graph, top: int = 5) -> DataFrame:
    """The ``top`` links of each repo between different sources, scored by how little one would expect them.

    The score adds the confidence tier turned round (ambiguous 3 .. extracted 1), 2 for different
    kinds of file, 2 for different top folders, 1 for different communities; semantic likeness
    multiplies by 1.5, rounded down; a peripheral node (2 neighbours or fewer) that meets a hub (5
    or more) adds 1.
    """
    ends = described(graph).where("not is_file and not is_concept").select("repo", "id", "source_file", "community", "degree")
    links = merged_links(graph.links.where("valid_until is null")).where(~F.col("relation").isin(STRUCTURAL)).select("repo", "source", "target", "relation", "tier")
    both = _with_ends(links, ends, ["source_file", "community", "degree"], "source", "target").where("a_source_file <> b_source_file")
    bonus = lambda c, n: F.when(c, n).otherwise(0)
    folder = lambda c: F.split_part(F.col(c), F.lit("/"), F.lit(1))
    base = (
        F.when(F.col("tier") == 1, 3).when(F.col("tier") == 2, 2).otherwise(1)
        + bonus(category(F.col("a_source_file")) != category(F.col("b_source_file")), 2)
        + bonus(folder("a_source_file") != folder("b_source_file"), 2) + bonus(F.col("a_community") != F.col("b_community"), 1)
    )
    alike = F.when(F.col("relation") == "semantically_similar_to", F.floor(base * 1.5)).otherwise(base)
    reach = bonus((F.least("a_degree", "b_degree") <= 2) & (F.greatest("a_degree", "b_degree") >= 5), 1)
    scored = both.withColumn("score", (alike + reach).cast("int"))
    first = Window.partitionBy("repo").orderBy(F.desc("score"), "source", "target", "relation")
    return scored.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top).select("repo", "rank", "source", "target", "relation", "score")


def bridges(graph: Graph) -> DataFrame:
    """One link for each pair of communities: the least certain one, then by its ends."""
    links = merged_links(graph.links).select("repo", "source", "target", "relation", "tier")
    both = _with_ends(links, membership(graph.nodes), ["community"], "source", "target").where("a_community <> b_community")
    both = both.withColumns({"lo_community": F.least("a_community", "b_community"), "hi_community": F.greatest("a_community", "b_community")})
    first = Window.partitionBy("repo", "lo_community", "hi_community").orderBy("tier", "source", "target", "relation")
    return both.withColumn("rank", F.row_number().over(first)).where("rank = 1").select("repo", "lo_community", "hi_community", "source", "target", "relation", "tier")


def knowledge_gaps(graph: Graph, ambiguous_share: float = 0.2) -> DataFrame:
    """Real nodes that are isolated, in a thin community, or at ambiguous links of a repo rich in them; the first reason counts."""
    nodes = described(graph).where("not is_file and not is_concept")
    links = merged_links(graph.links)
    ends = lambda df: df.select("repo", F.explode(F.array("source", "target")).alias("id")).distinct()
    anchored = ends(links.where(F.col("relation").isin(REASONING)))
    isolated = nodes.where("degree <= 1").join(anchored, ["repo", "id"], "left_anti").select("repo", "id", F.lit(1).alias("n"))
    thin = membership(graph.nodes).groupBy("repo", "community").agg(F.count(F.lit(1)).alias("size")).where("size < 3")
    thinly = nodes.join(thin, ["repo", "community"], "left_semi").select("repo", "id", F.lit(2).alias("n"))
    rich = links.groupBy("repo").agg(F.avg((F.col("tier") == 1).cast("int")).alias("share")).where(F.col("share") >= ambiguous_share)
    doubtful = nodes.join(ends(links.where("tier = 1").join(rich, "repo", "left_semi")), ["repo", "id"], "left_semi").select("repo", "id", F.lit(3).alias("n"))
    first = isolated.unionByName(thinly).unionByName(doubtful).groupBy("repo", "id").agg(F.min("n").alias("n"))
    return first.select("repo", "id", F.element_at(F.array(F.lit("isolated"), F.lit("thin_community"), F.lit("high_ambiguity_context")), F.col("n")).alias("reason"))


def trusted(links: DataFrame, relation: str) -> DataFrame:
    """Links of a relation that are extracted or score one half or more."""
    return whole_links(links).where((F.col("relation") == relation) & ((F.col("confidence") == "EXTRACTED") | (F.col("confidence_score") >= 0.5)))


def contradictions(graph: Graph) -> DataFrame:
    """Unordered pairs that contradict each other, with the best score."""
    rows = trusted(graph.links, "contradicts")
    return rows.groupBy("repo", F.least("source", "target").alias("lo"), F.greatest("source", "target").alias("hi")).agg(F.max("confidence_score").alias("score"))


def supersession_chains(graph: Graph) -> DataFrame:
    """The longest chain of supersedes links from each node that nothing supersedes to each end it reaches, the least by ids among equals.

    (repo, path, n_nodes). An end supersedes nothing. Each round follows all chains by one link and keeps
    one per root and node, so the rounds hold pairs of root and node, not paths: where chains part and
    meet again, their ways do not multiply. A node already on the chain is not entered again.
    """
    step = trusted(graph.links, "supersedes").where("source <> target").select("repo", "source", "target").distinct()
    step = materialize(step, "supersedes")
    ends = materialize(step.select("repo", F.col("target").alias("last")).distinct().join(step.select("repo", F.col("source").alias("last")), ["repo", "last"], "left_anti"), "ends")
    roots = step.select("repo", F.col("source").alias("root")).distinct().join(step.select("repo", F.col("target").alias("root")), ["repo", "root"], "left_anti")
    chains = roots.select("repo", "root", F.col("root").alias("last"), F.array("root").alias("path"))
    done: list[DataFrame] = []
    while True:
        onward = chains.join(step.withColumnRenamed("source", "last"), ["repo", "last"]).where(~F.array_contains("path", F.col("target")))
        chains = onward.groupBy("repo", "root", F.col("target").alias("last")).agg(F.min(F.array_append("path", F.col("target"))).alias("path"))
        chains = materialize(chains, "chains")
        if chains.isEmpty():
            break
        done.append(chains.join(ends, ["repo", "last"], "left_semi"))
    if not done:
        return roots.select("repo", F.col("root").alias("path"), F.lit(0).alias("n_nodes")).limit(0)
    longest = reduce(DataFrame.unionByName, done).groupBy("repo", "root", "last").agg(F.max(F.struct(F.size("path").alias("n_nodes"), "path")).alias("c"))
    return longest.select("repo", F.array_join("c.path", " > ").alias("path"), "c.n_nodes")


def top_terms(graph: Graph, top: int = 3) -> DataFrame:
    """The words of labels that weigh most in each community; every member weighs its degree, at least 1."""
    words = F.explode(F.array_distinct(F.filter(F.split(F.lower("label"), "[^a-z0-9]+"), lambda w: F.length(w) > 2)))
    weighed = described(graph).where("community is not null").select("repo", "community", F.greatest("degree", F.lit(1)).alias("weight"), words.alias("term")).groupBy("repo", "community", "term").agg(F.sum("weight").alias("weight"))
    first = Window.partitionBy("repo", "community").orderBy(F.desc("weight"), "term")
    return weighed.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top).select("repo", "community", "rank", "term", "weight")
