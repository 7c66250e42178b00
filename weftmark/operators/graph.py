"""The graph as two DataFrames keyed by repo, and its basic relational operators.

Nodes are (repo, id, label, file_type, source_file, source_location, community), links are
(repo, source, target, relation, confidence, ...). Ids mean something only inside a repo, so every
key starts with it. Defined cases: links with a null end are no links; repeated links count once in
pair and degree operators; a link from a node to itself adds two to its degree; ties are broken by
id; empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Confidence tiers in rising order, the relation names known, file types and structural relations.
TIERS = {"AMBIGUOUS": 1, "INFERRED": 2, "EXTRACTED": 3}
RELATIONS = """binds_method calls case_of cites conceptually_related_to contains contradicts defines depends_on derived_shortcut documents evolved_into
implemented_by implements imports imports_from includes inherits instantiates method rationale_for realizes references related related_to semantically_similar_to
shares_data_with supersedes supports tests uses uses_component""".split()
FILE_TYPES = ["code", "document", "paper", "image", "rationale"]
STRUCTURAL = ["imports", "imports_from", "contains", "method"]
REASONING = ["supports", "contradicts", "supersedes", "evolved_into", "depends_on"]


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    links: DataFrame


def tier(confidence: Column) -> Column:
    return F.coalesce(*[F.when(confidence == name, F.lit(rank)) for name, rank in TIERS.items()], F.lit(0))


def whole_links(links: DataFrame) -> DataFrame:
    return links.where("source is not null and target is not null")


def kept_links(graph: Graph) -> DataFrame:
    """Links whose two ends are nodes of the graph."""
    ids = graph.nodes.select("repo", "id")
    return whole_links(graph.links).join(ids.withColumnRenamed("id", "source"), ["repo", "source"], "left_semi").join(ids.withColumnRenamed("id", "target"), ["repo", "target"], "left_semi")


def pairs(links: DataFrame) -> DataFrame:
    """Distinct unordered pairs (repo, lo, hi)."""
    return whole_links(links).select("repo", F.least("source", "target").alias("lo"), F.greatest("source", "target").alias("hi")).distinct()


def incident(pair: DataFrame) -> DataFrame:
    """Both directions of every pair as (repo, id, other), made by a generator in one pass."""
    ends = F.explode(F.array(F.struct(F.col("lo").alias("id"), F.col("hi").alias("other")), F.struct(F.col("hi").alias("id"), F.col("lo").alias("other"))))
    return pair.select("repo", ends.alias("e")).select("repo", "e.id", "e.other")


def degrees(links: DataFrame) -> DataFrame:
    """(repo, id, degree) over distinct neighbours; partial counts are combined before the shuffle."""
    return incident(pairs(links)).groupBy("repo", "id").agg(F.count(F.lit(1)).alias("degree"))


def is_file_node(label: Column, source_file: Column, degree: Column) -> Column:
    """A file's own node, or a bare method or function stub."""
    base = F.regexp_extract(F.coalesce(source_file, F.lit("")), "[^/]+$", 0)
    stub = label.startswith(".") & label.endswith("()")
    return F.coalesce((label != "") & ((label == base) | stub | (label.endswith("()") & (F.coalesce(degree, F.lit(0)) <= 1))), F.lit(False))


def is_concept_node(source_file: Column) -> Column:
    """No source, or one whose last path segment has no dot."""
    return ~F.coalesce(F.split_part(F.reverse(source_file), F.lit("/"), F.lit(1)).contains("."), F.lit(False))


def described(graph: Graph) -> DataFrame:
    """Nodes with their degree and what kind of node they are."""
    with_degree = graph.nodes.join(degrees(graph.links), ["repo", "id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return with_degree.withColumns({"is_file": is_file_node(F.col("label"), F.col("source_file"), F.col("degree")), "is_concept": is_concept_node(F.col("source_file"))})


def hubs(graph: Graph, top: int = 10) -> DataFrame:
    """The ``top`` nodes of each repo by degree over links that still hold, without file and concept nodes; nodes without links come last."""
    current = Graph(graph.nodes, graph.links.where("valid_until is null"))
    ranked = described(current).where("not is_file and not is_concept").withColumn("rank", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("degree"), "id")))
    return ranked.where(F.col("rank") <= top).select("repo", "rank", "id", "label", "degree")


def merged_links(links: DataFrame) -> DataFrame:
    """One row per (repo, source, target, relation): best tier and score, summed weight, widest validity.

    A null valid_until (still valid) wins over any date; weights add up as decimals, so the sum does
    not depend on the order of the rows.
    """
    until = F.when(F.bool_or(F.col("valid_until").isNull()), F.lit(None)).otherwise(F.max("valid_until"))
    return whole_links(links).groupBy("repo", "source", "target", "relation").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(tier(F.col("confidence"))).alias("tier"), F.max("confidence_score").alias("confidence_score"),
        F.sum(F.coalesce("weight", F.lit(1.0)).cast("decimal(18,6)")).cast("double").alias("weight"), F.min("valid_from").alias("valid_from"), until.alias("valid_until"),
        F.max("decay_weight").alias("decay_weight"), F.array_join(F.array_sort(F.collect_set("source_file")), "; ").alias("sources"),
    )


def dangling(graph: Graph) -> DataFrame:
    """Ends of links that name no node: (repo, source, target, relation, missing_end)."""
    ids = graph.nodes.select("repo", "id")
    links = whole_links(graph.links).select("repo", "source", "target", "relation").distinct()
    lost = lambda end: links.join(ids, (links["repo"] == ids["repo"]) & (links[end] == ids["id"]), "left_anti").withColumn("missing_end", F.lit(end))
    return lost("source").unionByName(lost("target"))


def node_errors(nodes: DataFrame) -> DataFrame:
    """Every error of every node row: (repo, id, error)."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    errors = F.array_compact(F.array(
        *[F.when(blank(c), F.lit(f"missing {c}")) for c in ("id", "label", "file_type", "source_file")],
        F.when(~blank("file_type") & ~F.col("file_type").isin(FILE_TYPES), F.lit("unknown file_type")),
    ))
    return nodes.select("repo", "id", F.explode(errors).alias("error"))


def link_errors(links: DataFrame) -> DataFrame:
    """Every error of every link row: (repo, source, target, error)."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    errors = F.array_compact(F.array(
        *[F.when(blank(c), F.lit(f"missing {c}")) for c in ("source", "target", "relation", "confidence", "source_file")],
        F.when(~blank("confidence") & ~F.col("confidence").isin(list(TIERS)), F.lit("unknown confidence")),
        F.when(~F.col("confidence_score").between(0, 1), F.lit("score out of range")), F.when(~F.col("decay_weight").between(0, 1), F.lit("decay out of range")),
        F.when(F.col("confidence_score").isNull(), F.lit("missing score")),
    ))
    return links.select("repo", "source", "target", F.explode(errors).alias("error"))


def concept_links(graph: Graph) -> DataFrame:
    """What implements what, once per pair of nodes: (repo, source, target, n_rows, tier, confidence_score).

    implemented_by is implements turned round; between a code node and another the code node is the
    source, whichever way it was written. Links both ways fall together in the direction of the best
    row (tier, then score, then the smaller source).
    """
    known = kept_links(graph).where(F.col("relation").isin("implements", "implemented_by"))
    back = F.col("relation") == "implemented_by"
    rows = known.select("repo", F.when(back, F.col("target")).otherwise(F.col("source")).alias("s"), F.when(back, F.col("source")).otherwise(F.col("target")).alias("t"), tier(F.col("confidence")).alias("tier"), "confidence_score")
    is_code = lambda end: graph.nodes.select("repo", F.col("id").alias(end), F.coalesce(F.col("file_type") == "code", F.lit(False)).alias(f"{end}_code"))
    typed = rows.join(is_code("s"), ["repo", "s"]).join(is_code("t"), ["repo", "t"])
    turned = F.col("t_code") & ~F.col("s_code")
    typed = typed.select("repo", F.when(turned, F.col("t")).otherwise(F.col("s")).alias("source"), F.when(turned, F.col("s")).otherwise(F.col("t")).alias("target"), "tier", "confidence_score")
    best = F.min(F.struct((-F.col("tier")).alias("t"), (-F.coalesce("confidence_score", F.lit(-1.0))).alias("s"), "source", "target")).alias("best")
    merged = typed.groupBy("repo", F.least("source", "target").alias("lo"), F.greatest("source", "target").alias("hi")).agg(F.count(F.lit(1)).alias("n_rows"), F.max("tier").alias("tier"), F.max("confidence_score").alias("confidence_score"), best)
    return merged.select("repo", "best.source", "best.target", "n_rows", "tier", "confidence_score")
