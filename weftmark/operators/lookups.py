"""Looking things up in the graph: nodes, neighbours, notes, the text of a part of it, and whether notes keep to what they cite.

Every operator works for all repos at once. Defined cases: null labels match nothing; a repo without a
match gives no row; ties go to the smaller id; empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .graph import Graph, degrees, incident, kept_links, pairs, whole_links


def matching_nodes(nodes: DataFrame, term: str) -> DataFrame:
    """Nodes whose label holds ``term``, or whose id is ``term``, without regard to case."""
    low = term.lower()
    return nodes.where(F.coalesce(F.contains(F.lower("label"), F.lit(low)), F.lit(False)) | (F.lower("id") == low))


def first_match(nodes: DataFrame, term: str) -> DataFrame:
    """The matching node with the smallest id of each repo."""
    return matching_nodes(nodes, term).groupBy("repo").agg(F.min_by(F.struct(*[c for c in nodes.columns if c != "repo"]), "id").alias("n")).select("repo", "n.*")


def node_card(graph: Graph, files: DataFrame, term: str) -> DataFrame:
    """What is known of each repo's first node that matches ``term``: its fields, degree, and whether its file has changed since it was loaded."""
    found = first_match(graph.nodes, term).join(degrees(graph.links), ["repo", "id"], "left")
    held = files.groupBy("repo", "source_file").agg(F.max("modified_at").alias("modified_at"))
    state = F.when(F.col("modified_at").isNull(), "ghost").when(F.col("modified_at") > F.col("loaded_at"), "stale").otherwise("fresh")
    return found.join(held, ["repo", "source_file"], "left").select("repo", "id", "label", "source_file", "file_type", "community", F.coalesce("degree", F.lit(0)).alias("degree"), state.alias("state"))


def neighbours(graph: Graph, seeds: DataFrame, relation: str | None = None) -> DataFrame:
    """Links at the seeds (repo, id), once per other end and relation: (repo, id, other, label, relation, tier is the best confidence)."""
    links = whole_links(graph.links)
    if relation:
        links = links.where(F.contains(F.lower("relation"), F.lit(relation.lower())))
    ways = F.explode(F.array(F.struct(F.col("source").alias("id"), F.col("target").alias("other")), F.struct(F.col("target").alias("id"), F.col("source").alias("other")))).alias("e")
    near = links.select("repo", ways, "relation", "confidence").select("repo", "e.*", "relation", "confidence").join(seeds.select("repo", "id"), ["repo", "id"], "left_semi")
    named = graph.nodes.select("repo", F.col("id").alias("other"), "label")
    return near.groupBy("repo", "id", "other", "relation").agg(F.count(F.lit(1)).alias("n_links")).join(named, ["repo", "other"]).select("repo", "id", "other", "label", "relation", "n_links")


def filtered(rows: DataFrame, time_column: str, peer_id: str | None = None, time_from: str | None = None, time_to: str | None = None) -> DataFrame:
    """Rows of a peer within a span of time, both ends included; what is not given does not filter."""
    given = [(F.col("peer_id") == peer_id) if peer_id is not None else None, (F.col(time_column) >= time_from) if time_from is not None else None, (F.col(time_column) <= time_to) if time_to is not None else None]
    return reduce(lambda df, c: df.where(c), [c for c in given if c is not None], rows)


def at_nodes(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Agent edges with an end among the seeds (repo, id); an edge between two seeds comes once."""
    both = F.explode(F.array_distinct(F.array("from_id", "to_id"))).alias("id")
    rows = edges.select("repo", "snapshot_no", "from_id", "to_id", "relation", "ts").distinct()
    return rows.select("*", both).join(seeds.select("repo", "id"), ["repo", "id"], "left_semi").drop("id").distinct()


def layer_tokens(n_nodes: Column, n_links: Column, layer: int) -> Column:
    """Estimated tokens of a text of a part of the graph: names alone, names with links, or everything."""
    return {1: 50 * n_nodes, 2: 200 * n_nodes + 30 * n_links}.get(layer, 100 * n_nodes + 95 * n_links).cast("bigint")


def estimates(graph: Graph, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """How large the part within ``depth`` links of the seeds will be, by the links a node has on average, and its tokens by layer."""
    count = F.count(F.lit(1))
    linked = pairs(graph.links)
    size = graph.nodes.groupBy("repo").agg(count.alias("all_nodes")).join(linked.groupBy("repo").agg(count.alias("all_links")), "repo", "left").join(seeds.groupBy("repo").agg(count.alias("n_seeds")), "repo")
    size = size.withColumn("all_links", F.coalesce("all_links", F.lit(0))).withColumn("branching", 2 * F.col("all_links") / F.col("all_nodes"))
    spread = reduce(lambda x, _: x * F.col("branching"), range(depth), F.col("n_seeds").cast("double"))
    nodes = F.least(F.floor(spread).cast("bigint"), F.col("all_nodes"))
    size = size.withColumn("n_nodes", nodes).withColumn("n_links", F.least(F.floor(F.col("n_nodes") * F.col("branching") / 2).cast("bigint"), F.col("all_links")))
    return size.select("repo", "n_nodes", "n_links", *[layer_tokens(F.col("n_nodes"), F.col("n_links"), x).alias(f"tokens_{x}") for x in (1, 2, 3)])


def targets(graph: Graph, seeds: DataFrame) -> DataFrame:
    """Where a search from the seeds is to end if nobody says: the other nodes of highest degree, as many as the logarithm of the nodes to base 2, between 3 and 20."""
    asked = seeds.select("repo").distinct()
    many = graph.nodes.groupBy("repo").agg(F.greatest(F.lit(3), F.least(F.lit(20), F.length(F.bin(F.count(F.lit(1)))) - 1)).alias("k")).join(asked, "repo", "left_semi")
    others = graph.nodes.select("repo", "id").join(seeds.select("repo", "id"), ["repo", "id"], "left_anti").join(degrees(graph.links), ["repo", "id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    ranked = others.withColumn("rank", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("degree"), "id"))).where("rank <= 20")
    return ranked.join(many, "repo").where("rank <= k").select("repo", "rank", "id", "degree")


def _lines(graph: Graph, members: DataFrame, layer: int) -> DataFrame:
    """The lines of a text: (repo, part, weight, key, line); nodes (part 0) by degree, then the links among them (part 1)."""
    own = members.select("repo", "id").distinct()
    nodes = graph.nodes.join(own, ["repo", "id"], "left_semi").join(degrees(graph.links), ["repo", "id"], "left")
    name = T.clean_label(F.coalesce("label", "id"))
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    short = F.concat(F.lit("NODE "), F.col("id"), F.lit(" label="), name, F.lit(" community="), known("community"))
    full = F.concat(F.lit("NODE "), name, F.lit(" [src="), known("source_file"), F.lit(" loc="), known("source_location"), F.lit(" community="), known("community"), F.lit("]"))
    lines = nodes.select("repo", F.lit(0).alias("part"), F.coalesce("degree", F.lit(0)).alias("weight"), F.col("id").alias("key"), (full if layer == 3 else short).alias("line"))
    if layer == 1:
        return lines
    ends = lambda side: nodes.select("repo", F.col("id").alias(side), name.alias(f"{side}_name"))
    best = kept_links(graph).groupBy("repo", "source", "target").agg(F.min(F.struct(known("relation").alias("relation"), known("confidence").alias("confidence"))).alias("l"))
    among = best.join(ends("source"), ["repo", "source"]).join(ends("target"), ["repo", "target"])
    line = F.concat(F.lit("EDGE "), F.col("source_name"), F.lit(" --"), F.col("l.relation"), F.lit(" ["), F.col("l.confidence"), F.lit("]--> "), F.col("target_name"))
    return lines.unionByName(among.select("repo", F.lit(1).alias("part"), F.lit(0).cast("bigint").alias("weight"), F.concat_ws("\x01", "source", "target").alias("key"), line.alias("line")))


def graph_text(graph: Graph, members: DataFrame, token_budget: int = 2000, layer: int = 3) -> DataFrame:
    """(repo, text, cut): the part of each repo's graph at ``members`` as text of at most ``token_budget`` tokens of three characters.

    Lines stand by degree, then by id; what is beyond the budget is cut, also within a line. A line has at
    least eight characters, so only the first lines that can matter are ever brought together.
    """
    room = token_budget * 3
    order = Window.partitionBy("repo").orderBy("part", F.desc("weight"), "key")
    first = _lines(graph, members, layer).withColumn("no", F.row_number().over(order)).where(F.col("no") <= room // 8 + 1)
    gathered = first.groupBy("repo").agg(F.array_join(F.array_sort(F.collect_list(F.struct("no", "line")))["line"], "\n").alias("text"))
    cut = F.length("text") > room
    ended = F.concat(F.substring("text", 1, room), F.lit(f"\n... (truncated to ~{token_budget} token budget)"))
    return gathered.select("repo", F.when(cut, ended).otherwise(F.col("text")).alias("text"), cut.alias("cut"))


def label_tokens(nodes: DataFrame) -> DataFrame:
    """(repo, token, id): the words of three letters or more of every label."""
    words = F.explode(F.array_distinct(F.filter(T.word_tokens(F.coalesce("label", F.lit(""))), lambda w: F.length(w) > 2))).alias("token")
    return nodes.select("repo", "id", words).select("repo", "token", "id")


def cited_sentences(notes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every sentence of the notes (repo, id, body) with whether it stays: (repo, id, body, no, sentence, kept).

    A sentence goes if one of its words stands in a label of the repo but in none of the cited node's; a
    note cites the node it is on. Words are looked up by two joins on keys, never against all labels that hold them.
    """
    index = label_tokens(nodes)
    split = notes.where("body is not null").select("repo", "id", "body").distinct().select("repo", "id", "body", F.posexplode(T.sentences(F.col("body"))).alias("no", "sentence"))
    words = split.select("repo", "id", F.explode(F.array_distinct(T.word_tokens(F.col("sentence")))).alias("token"), "sentence").select("repo", "id", "token", "sentence")
    known = words.join(index.select("repo", "token").distinct(), ["repo", "token"], "left_semi")
    foreign = known.join(index.distinct(), ["repo", "token", "id"], "left_anti").select("repo", "id", "sentence").distinct().withColumn("foreign", F.lit(True))
    on = (F.col("s.repo") == F.col("f.repo")) & F.col("s.id").eqNullSafe(F.col("f.id")) & (F.col("s.sentence") == F.col("f.sentence"))
    return split.alias("s").join(foreign.alias("f"), on, "left").select("s.*", F.col("f.foreign").isNull().alias("kept"))


def extracted_neighbours(graph: Graph) -> DataFrame:
    """Per node the number of neighbours, and of those that an extracted link joins it to."""
    sure = incident(pairs(graph.links.where("confidence = 'EXTRACTED'"))).groupBy("repo", "id").agg(F.count(F.lit(1)).alias("n_extracted"))
    return degrees(graph.links).join(sure, ["repo", "id"], "left").select("repo", "id", "degree", F.coalesce("n_extracted", F.lit(0)).alias("n_extracted"))
