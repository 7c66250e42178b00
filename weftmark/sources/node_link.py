"""Graphs in node-link JSON, read into and written from the two DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import Graph

_NODE = "struct<id:string,label:string,file_type:string,source_file:string,source_location:string,community:int>"
_LINK = "struct<source:string,target:string,`from`:string,`to`:string,relation:string,confidence:string,confidence_score:double,source_file:string,weight:double,valid_from:timestamp,valid_until:timestamp,decay_weight:double>"


def read_node_link(spark: SparkSession, path: str) -> Graph:
    """Graph files as one Graph; a file's path is its repo. ``links`` and ``edges``, ``from``/``to`` and ``source``/``target`` are the same.

    Unreadable files give no rows; unknown fields are ignored.
    """
    raw = spark.read.schema(f"nodes array<{_NODE}>, links array<{_LINK}>, edges array<{_LINK}>").json(path, multiLine=True).withColumn("repo", F.input_file_name())
    nodes = raw.select("repo", F.explode("nodes").alias("n")).select("repo", "n.*")
    link = raw.select("repo", F.explode(F.coalesce("links", "edges")).alias("l")).select("repo", "l.*")
    ends = {"source": F.coalesce("source", "from"), "target": F.coalesce("target", "to")}
    return Graph(nodes, link.withColumns(ends).drop("from", "to"))


def node_link_lines(graph: Graph) -> DataFrame:
    """One JSON text per node and link, with their repo and kind, ready for ``write.partitionBy``."""
    line = lambda df, kind: df.select("repo", F.lit(kind).alias("kind"), F.to_json(F.struct(*[c for c in df.columns if c != "repo"])).alias("value"))
    return line(graph.nodes, "node").unionByName(line(graph.links, "link"))


def _quoted(c: str) -> F.Column:
    return F.concat(F.lit("'"), F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))


def cypher_lines(graph: Graph) -> DataFrame:
    """MERGE statements for nodes and links as (repo, value)."""
    nodes = graph.nodes.select("repo", F.format_string("MERGE (n:Node {id: %s}) SET n.label = %s;", _quoted("id"), _quoted("label")).alias("value"))
    name = F.upper(F.regexp_replace(F.coalesce("relation", F.lit("related")), "[^A-Za-z0-9_]", "_"))
    links = graph.links.select("repo", F.format_string("MATCH (a:Node {id: %s}), (b:Node {id: %s}) MERGE (a)-[:%s]->(b);", _quoted("source"), _quoted("target"), name).alias("value"))
    return nodes.unionByName(links)


def graphml_lines(graph: Graph) -> DataFrame:
    """GraphML elements as (repo, value); a null attribute is left out."""
    def escaped(c: str) -> F.Column:
        text = F.col(c).cast("string")
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            text = F.replace(text, F.lit(a), F.lit(b))
        return text

    data = lambda cs: F.concat(*[F.coalesce(F.concat(F.lit(f'<data key="{c}">'), escaped(c), F.lit("</data>")), F.lit("")) for c in cs])
    node = F.concat(F.lit('<node id="'), escaped("id"), F.lit('">'), data(["label", "file_type", "source_file", "community"]), F.lit("</node>"))
    edge = F.concat(F.lit('<edge source="'), escaped("source"), F.lit('" target="'), escaped("target"), F.lit('">'), data(["relation", "confidence", "weight", "valid_until"]), F.lit("</edge>"))
    return graph.nodes.where("id is not null").select("repo", node.alias("value")).unionByName(graph.links.where("source is not null and target is not null").select("repo", edge.alias("value")))
