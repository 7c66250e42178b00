"""What a question draws from the graph: seeds, the nodes around them, paths, and their cost in tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.scratch import broadcast_if_small, materialize
from .graph import Graph, hubs, incident, kept_links, pairs
from .traversal import levels

#: Questions asked of every repo unless others are given.
QUESTIONS = ["which module loads the snapshot cache", "where is the schema index merged", "which notes mention the ledger export", "how does the manifest reach the store", "what calls the token parser"]


def seeds(nodes: DataFrame, questions: list[str], top: int = 3) -> DataFrame:
    """(repo, q, id): the ``top`` nodes of each repo and question by words of the question within the label; ties go to the greater id.

    Words have three letters or more; a word said twice counts twice.
    """
    hits = lambda q: sum([F.contains(F.lower("label"), F.lit(w)).cast("int") for w in q.lower().split() if len(w) > 2], F.lit(0))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("q"), hits(q).alias("score")) for n, q in enumerate(questions)])).alias("s")
    scored = nodes.where("label is not null").select("repo", "id", each).select("repo", "id", "s.*").where("score > 0")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("repo", "q").orderBy(F.desc("score"), F.desc("id")))).where(F.col("rank") <= top).select("repo", "q", "id")


def question_tokens(graph: Graph, files: DataFrame, questions: list[str] | None = None, depth: int = 3) -> DataFrame:
    """Tokens of what each question draws from its repo's graph, against the tokens of the repo's files.

    Drawn are the nodes within ``depth`` links of the seeds, and every link from one level to the
    next, one line each; four characters make a token, and 75 words of a file 100. Of several links
    between two nodes the first relation by name is written. Questions without a seed give no row.
    """
    questions = questions or QUESTIONS
    size = lambda c: F.length(F.coalesce(c, F.lit("")))
    links = kept_links(graph).groupBy("repo", F.least("source", "target").alias("lo"), F.greatest("source", "target").alias("hi")).agg(size(F.min("relation")).alias("rel"))
    ends = F.explode(F.array(F.struct(F.col("lo").alias("id"), F.col("hi").alias("other")), F.struct(F.col("hi").alias("id"), F.col("lo").alias("other")))).alias("e")
    steps = materialize(links.where("lo <> hi").select("repo", ends, "rel").select("repo", "e.*", "rel"), "steps")
    name = F.length(F.coalesce("label", "id"))
    texts = graph.nodes.select("repo", "id", name.alias("name"), (F.lit(15) + name + size(F.col("source_file")) + size(F.col("source_location"))).alias("chars"))
    drawn = materialize(levels(steps, seeds(graph.nodes, questions), depth, ["q"]).join(texts, ["repo", "id"]), "drawn")
    next_level = drawn.select("repo", "q", F.col("id").alias("other"), F.col("depth").alias("other_depth"), F.col("name").alias("other_name"))
    crossed = drawn.join(steps, ["repo", "id"]).join(next_level, ["repo", "q", "other"]).where("other_depth = depth + 1")
    lines = drawn.select("repo", "q", "chars").unionByName(crossed.select("repo", "q", (F.lit(12) + F.col("name") + F.col("rel") + F.col("other_name")).alias("chars")))
    asked = lines.groupBy("repo", "q").agg(F.greatest(F.lit(1), F.floor((F.sum("chars") + F.count(F.lit(1)) - 1) / 4)).cast("bigint").alias("query_tokens"))
    words = files.where("file_text is not null").select("repo", "source_file", T.word_count(F.col("file_text")).alias("n")).groupBy("repo", "source_file").agg(F.max("n").alias("n"))
    corpus = words.groupBy("repo").agg(F.floor(F.sum("n") * 100 / 75).cast("bigint").alias("corpus_tokens"))
    texted = F.element_at(F.array(*[F.lit(q) for q in questions]), F.col("q") + 1)
    return asked.join(corpus, "repo", "left").select("repo", texted.alias("question"), "query_tokens", "corpus_tokens", (F.col("corpus_tokens") / F.col("query_tokens")).alias("reduction"))


def hub_paths(graph: Graph, most_steps: int | None = None) -> DataFrame:
    """The shortest path between the first two hubs of each repo, the first one by its ids; null if they are not connected, or only beyond ``most_steps`` links.

    Each level keeps one path per node, the least of those that reach it, so levels stay as small as the graph. A repo
    is left out once its target is reached; links go both ways, so only the two levels before can hold a node again.
    """
    ranked = materialize(hubs(graph, 2).select("repo", "rank", "id"), "hubs")
    steps = materialize(incident(pairs(graph.links)), "steps")
    to = ranked.where("rank = 2").select("repo", F.col("id").alias("target"))
    before = frontier = materialize(ranked.where("rank = 1").select("repo", "id", F.array("id").alias("path")).join(to.select("repo"), "repo", "left_semi"), "level")
    reached = materialize(frontier.limit(0).select("repo", F.col("id").alias("target"), "path"), "reached")
    at = 0
    while (most_steps is None or at < most_steps) and not frontier.isEmpty():
        onward = frontier.join(steps, ["repo", "id"]).select("repo", F.col("other").alias("id"), F.array_append("path", F.col("other")).alias("path"))
        seen = frontier.select("repo", "id").unionByName(before.select("repo", "id"))
        level = materialize(onward.join(seen, ["repo", "id"], "left_anti").groupBy("repo", "id").agg(F.min("path").alias("path")), "level")
        hits = materialize(level.withColumnRenamed("id", "target").join(to, ["repo", "target"], "left_semi").select("repo", "target", "path"), "hits")
        before = frontier
        if hits.isEmpty():
            frontier = level
        else:
            reached = materialize(reached.unionByName(hits), "reached")
            frontier = materialize(level.join(broadcast_if_small(hits.select("repo")), "repo", "left_anti"), "level")
        at += 1
    found = to.join(reached, ["repo", "target"], "left")
    return ranked.where("rank = 1").select("repo", F.col("id").alias("source")).join(found, "repo").select("repo", "source", "target", F.array_join("path", " > ").alias("path"), (F.when(F.col("path").isNotNull(), F.size("path") - 1)).alias("n_steps"))
