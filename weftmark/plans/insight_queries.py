"""Queries on communities, questions and walks over each repo's graph, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analysis, centrality, communities, graph, retrieval, traversal
from ..sources.tables import load
from .graph_queries import _BASE, _LAST, _STANDING, newest_graph, on_graph, walked_pairs
from .scratch import broadcast_if_small, materialize
from .skew import join_groups

#: Relations whose links are followed over snapshots.
FOLLOWED = ["implements", "documents", "tests"]
DEPENDS = ["depends_on", "imports", "imports_from"]


def detected_communities(spark: SparkSession, d: str) -> DataFrame:
    """Members of each community that the links form."""
    return communities.detect(newest_graph(spark, d))


def given_modularity(spark: SparkSession, d: str) -> DataFrame:
    """Modularity of the communities that the nodes carry; nodes without one count as one community (-1)."""
    g = newest_graph(spark, d)
    return communities.modularity(g, g.nodes.withColumn("community", F.coalesce("community", F.lit(-1))))


def question_tokens(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.question_tokens(newest_graph(spark, d), load(spark, d, "source_files"))


def link_heat(spark: SparkSession, d: str) -> DataFrame:
    """Linked pairs by how often agents walked them: hot from the ninth tenth up, cold to the first, never, or warm.

    Tenths are exclusive quantiles of the repo's counts, taken from the histogram of counts; below ten
    counted pairs the greatest and the least count stand for them. Beside it the walks' weight,
    1 + ln(walks) up to 10, and the walks left after decay by a fifth.
    """
    walks = materialize(walked_pairs(spark, d), "walks")
    order = Window.partitionBy("repo").orderBy("n_walks")
    bars = walks.groupBy("repo", "n_walks").agg(F.count(F.lit(1)).alias("bar")).withColumn("upto", F.sum("bar").over(order))
    n = bars.groupBy("repo").agg(F.sum("bar").alias("n"))
    spans = bars.join(n, "repo")
    place = lambda tenth: F.least(F.greatest(F.floor(F.lit(tenth) * (F.col("n") + 1) / 10), F.lit(1)), F.greatest(F.col("n") - 1, F.lit(1)))
    value = lambda at: F.max(F.when((at > F.col("upto") - F.col("bar")) & (at <= F.col("upto")), F.col("n_walks")))
    rest = lambda tenth: F.lit(tenth) * (F.col("n") + 1) - place(tenth) * 10
    cuts = spans.groupBy("repo", "n").agg(F.min("n_walks").alias("least"), F.max("n_walks").alias("most"), *[value(place(t) + i).alias(f"x{t}_{i}") for t in (1, 9) for i in (0, 1)])
    cut = lambda t, few: F.when(F.col("n") < 10, F.col(few) * 10).otherwise(F.col(f"x{t}_0") * (10 - rest(t)) + F.col(f"x{t}_1") * rest(t))
    cuts = cuts.select("repo", cut(1, "least").alias("cold"), cut(9, "most").alias("hot"))
    linked = graph.pairs(load(spark, d, "graph_links")).join(walks, ["repo", "lo", "hi"], "left").join(broadcast_if_small(materialize(cuts, "cuts")), "repo", "left")
    heat = F.when(F.col("n_walks").isNull(), "never").when(F.col("n_walks") * 10 >= F.col("hot"), "hot").when(F.col("n_walks") * 10 <= F.col("cold"), "cold").otherwise("warm")
    weight = F.round(F.when(F.col("n_walks").isNotNull(), F.least(F.lit(10.0), 1 + F.ln("n_walks"))), 6)
    return linked.select("repo", "lo", "hi", heat.alias("heat"), weight.alias("weight"), F.floor(F.col("n_walks") * 4 / 5).cast("bigint").alias("decayed"))


def degree_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Nodes whose number of neighbours by agent edges differs between a repo's last two snapshots."""
    rows = load(spark, d, "agent_edges").where("from_id is not null and to_id is not null").join(broadcast_if_small(communities.last_two(load(spark, d, "snapshot_log"))), ["repo", "snapshot_no"])
    ends = F.explode(F.array(F.struct(F.col("from_id").alias("id"), F.col("to_id").alias("other")), F.struct(F.col("to_id").alias("id"), F.col("from_id").alias("other")))).alias("e")
    near = rows.select("repo", "back", ends).select("repo", "back", "e.id", "e.other").distinct()
    side = lambda b: F.count(F.when(F.col("back") == b, 1))
    return near.groupBy("repo", "id").agg(side(2).alias("old_degree"), side(1).alias("new_degree")).where("old_degree <> new_degree")


def graph_shape(spark: SparkSession, d: str) -> DataFrame:
    """Linked nodes, pairs and components of each repo, the links a node has on average, and whether the links form one tree."""
    g = newest_graph(spark, d)
    n_pairs = graph.pairs(g.links).groupBy("repo").agg(F.count(F.lit(1)).alias("n_pairs"))
    parts = traversal.components(g).groupBy("repo").agg(F.count(F.lit(1)).alias("n_nodes"), F.count(F.when(F.col("id") == F.col("component"), 1)).alias("n_components"))
    return parts.join(n_pairs, "repo").withColumn("branching", 2 * F.col("n_pairs") / F.col("n_nodes")).withColumn("is_tree", (F.col("n_components") == 1) & (F.col("n_pairs") == F.col("n_nodes") - 1))


def hub_siblings(spark: SparkSession, d: str) -> DataFrame:
    """The five real nodes with most neighbours in each community."""
    members = graph.described(newest_graph(spark, d)).where("community is not null and not is_file and not is_concept")
    first = Window.partitionBy("repo", "community").orderBy(F.desc("degree"), "id")
    return members.withColumn("rank", F.row_number().over(first)).where("rank <= 5").select("repo", "community", "rank", "id", "degree")


def node_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Per linked node: links, their distinct sources, and the mean score of inferred ones (0 without any)."""
    links = graph.whole_links(load(spark, d, "graph_links"))
    ends = links.select("repo", F.explode(F.array("source", "target")).alias("id"), "confidence", "confidence_score", "source_file")
    inferred = F.when(F.col("confidence") == "INFERRED", F.col("confidence_score").cast("decimal(18,6)"))
    per_file = ends.groupBy("repo", "id", "source_file").agg(F.count(F.lit(1)).alias("n"), F.sum(inferred).alias("total"), F.count(inferred).alias("scored"))
    mean = F.coalesce(F.try_divide(F.sum("total").cast("double"), F.sum("scored")), F.lit(0.0))
    return per_file.groupBy("repo", "id").agg(F.sum("n").alias("n_links"), F.count("source_file").alias("n_sources"), F.round(mean, 6).alias("mean_score"))


def shared_concepts(spark: SparkSession, d: str) -> DataFrame:
    """Labels that nodes of two repos or more bear, without regard to case: members, repos and the least member's name."""
    nodes = newest_graph(spark, d).nodes.where("label <> ''").select(F.lower("label").alias("label"), "repo", "id")
    per_repo = nodes.groupBy("label", "repo").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    return per_repo.groupBy("label").agg(F.sum("n").alias("n_nodes"), F.count(F.lit(1)).alias("n_repos"), F.min(F.concat("repo", F.lit(":"), "id")).alias("merged_id")).where("n_repos > 1")


def code_stems(spark: SparkSession, d: str) -> DataFrame:
    """A note's name for each code file: its stem, and where a repo has several of them eight digits of the path's digest."""
    files = load(spark, d, "source_files").where("file_type = 'code' and source_file is not null").select("repo", "source_file").distinct()
    rows = files.withColumn("stem", F.regexp_extract("source_file", r"([^/]*?)(\.[^./]*)?$", 1))
    groups = materialize(rows.groupBy("repo", "stem").agg(F.count(F.lit(1)).alias("size"), F.count(F.lit(1)).alias("n")), "stems")
    return join_groups(rows, groups, ["repo", "stem"]).select("repo", "source_file", F.when(F.col("n") == 1, F.col("stem")).otherwise(F.concat_ws("-", "stem", F.substring(F.sha2("source_file", 256), 1, 8))).alias("note"))


def suggested_questions(spark: SparkSession, d: str) -> DataFrame:
    """Seven subjects per repo that questions are worth asking about, by kind in a fixed order.

    Ambiguous open links; the three real nodes with neighbours in most other communities; real nodes
    with two inferred links or more among the five of highest degree; loose nodes; communities of
    five members or more that are linked below 0.15.
    """
    g = newest_graph(spark, d)
    nodes = materialize(graph.described(g).select("repo", "id", "community", "degree", "is_file", "is_concept"), "described")
    real = nodes.where("not is_file and not is_concept")
    links = graph.kept_links(g)
    row = lambda df, no, weight, subject: df.select("repo", F.lit(no).alias("kind"), weight.cast("bigint").alias("weight"), subject.alias("subject"))
    unsure = links.where("valid_until is null and confidence = 'AMBIGUOUS'").select("repo", "source", "target").distinct()
    ends = graph.incident(graph.pairs(links))
    there = analysis.membership(g.nodes).select("repo", F.col("id").alias("other"), F.col("community").alias("there"))
    foreign = ends.join(real.where("community is not null").select("repo", "id", "community"), ["repo", "id"]).join(there, ["repo", "other"]).where("there <> community").select("repo", "id", "there").distinct().groupBy("repo", "id").agg(F.count(F.lit(1)).alias("n"))
    bridges = foreign.withColumn("r", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("n"), "id"))).where("r <= 3")
    high = nodes.where("not is_file").withColumn("r", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("degree"), "id"))).where("r <= 5").select("repo", "id")
    inferred = links.where("confidence = 'INFERRED'").select("repo", F.explode(F.array_distinct(F.array("source", "target"))).alias("id")).join(high, ["repo", "id"], "left_semi").groupBy("repo", "id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    loose = analysis.cohesion(g).where("n_nodes >= 5 and cohesion < 0.15")
    rows = row(unsure, 1, F.lit(0), F.concat_ws(" ? ", "source", "target"))
    rows = rows.unionByName(row(bridges, 2, F.col("n"), F.col("id"))).unionByName(row(inferred, 3, F.col("n"), F.col("id")))
    rows = rows.unionByName(row(real.where("degree <= 1"), 4, F.lit(0), F.col("id"))).unionByName(row(loose, 5, F.col("n_nodes"), F.col("community").cast("string")))
    first = Window.partitionBy("repo").orderBy("kind", F.desc("weight"), "subject")
    names = F.array(*[F.lit(x) for x in ("ambiguous_edge", "bridge_node", "verify_inferred", "isolated_nodes", "low_cohesion")])
    return rows.withColumn("rank", F.row_number().over(first)).where("rank <= 7").select("repo", "rank", F.element_at(names, F.col("kind")).alias("kind"), "subject")


def node_betweenness(spark: SparkSession, d: str) -> DataFrame:
    """How much each linked node lies between others, by shortest paths from eight nodes of its repo."""
    return centrality.betweenness(newest_graph(spark, d), 8)[0]


def link_betweenness(spark: SparkSession, d: str) -> DataFrame:
    """How much each linked pair lies between others, by shortest paths from eight nodes of its repo."""
    return centrality.betweenness(newest_graph(spark, d), 8)[1]


def node_keys(spark: SparkSession, d: str) -> DataFrame:
    """Each node's id in drawings, and its label as Cypher and Markdown write it."""
    nodes = newest_graph(spark, d).nodes
    return nodes.select("repo", "id", T.element_id(F.col("id")).alias("element"), T.cypher_text(F.col("label")).alias("cypher"), T.markdown_text(F.col("label")).alias("markdown"))


def retained_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots of each repo from the newest on, and whether a store of five keeps them."""
    newest = Window.partitionBy("repo").orderBy(F.desc("snapshot_ts"), F.desc("snapshot_no"))
    log = load(spark, d, "snapshot_log").select("repo", "snapshot_no", "snapshot_ts").distinct().withColumn("age", F.row_number().over(newest))
    return log.select("repo", "snapshot_no", "age", (F.col("age") <= 5).alias("kept"))


def document_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of every document with text."""
    return load(spark, d, "documents").where("text is not null").select("doc_id", T.sentence_count(F.col("text")).alias("n_sentences"))


def tech_tags(spark: SparkSession, d: str) -> DataFrame:
    """Files of each repo by the technology that their suffix shows."""
    files = load(spark, d, "source_files").select("repo", "source_file").distinct()
    return files.groupBy("repo", T.tech_tag(F.col("source_file")).alias("tag")).agg(F.count(F.lit(1)).alias("n_files")).where("tag is not null")


QUERIES = {
    "node_betweenness": node_betweenness, "link_betweenness": link_betweenness, "node_keys": node_keys, "retained_snapshots": retained_snapshots, "document_sentences": document_sentences, "tech_tags": tech_tags, "concept_links": on_graph(graph.concept_links),
    "detected_communities": detected_communities, "given_modularity": given_modularity, "question_tokens": question_tokens, "hub_paths": on_graph(retrieval.hub_paths),
    "kept_links": on_graph(lambda g: graph.kept_links(g).select("repo", "source", "target", "relation", "confidence")),
    "matched_communities": lambda s, d: communities.matched(load(s, d, "graph_nodes"), load(s, d, "snapshot_log")),
    "link_drift": lambda s, d: communities.link_drift(load(s, d, "graph_links"), load(s, d, "graph_nodes"), load(s, d, "snapshot_log"), FOLLOWED),
    "community_pages": on_graph(communities.routes), "community_signatures": on_graph(communities.signatures), "dependency_layers": lambda s, d: traversal.layers(load(s, d, "graph_links"), DEPENDS),
    "link_heat": link_heat, "degree_deltas": degree_deltas, "graph_shape": graph_shape, "hub_siblings": hub_siblings, "node_evidence": node_evidence, "shared_concepts": shared_concepts, "code_stems": code_stems, "suggested_questions": suggested_questions,
}

_KEPT = _BASE + ", kl as (select w.* from w where exists (select 1 from n where n.repo = w.repo and n.id = w.source) and exists (select 1 from n where n.repo = w.repo and n.id = w.target)), kp as (select repo, least(source, target) as lo, greatest(source, target) as hi, coalesce(min(relation), '') as rel from kl where source <> target group by all), ki as (select repo, lo as id, hi as other, rel from kp union all select repo, hi, lo, rel from kp)"
_ASKED = ["which module loads the snapshot cache", "where is the schema index merged", "which notes mention the ledger export", "how does the manifest reach the store", "what calls the token parser"]
_TERMS = ", ".join(f"({n}, '{q}', '{w}')" for n, q in enumerate(_ASKED) for w in q.split() if len(w) > 2)
_PATHS = [f"p{t} as (select p.repo, inc.other as id, min(list_append(p.path, inc.other)) as path from p{t - 1} p join inc on inc.repo = p.repo and inc.id = p.id where " + " and ".join(f"not exists (select 1 from p{s} x where x.repo = p.repo and x.id = inc.other)" for s in range(t)) + " group by all)" for t in range(1, 7)]
_MATCH = f"with {_STANDING}, {_LAST}, old as (select repo, id, community as oc from s join last using (repo, snapshot_no) where back = 2 and community is not null), new as (select repo, id, community as nc from s join last using (repo, snapshot_no) where back = 1 and community is not null), sh as (select repo, oc, nc, count(*) as n_shared from old join new using (repo, id) group by all), mt as (select repo, oc as old_community, nc as new_community, n_shared, n_shared / (a + b - n_shared) as likeness from sh join (select repo, oc, count(*) as a from old group by all) using (repo, oc) join (select repo, nc, count(*) as b from new group by all) using (repo, nc) where n_shared / (a + b - n_shared) >= 0.7)"

SQL = {
    "given_modularity": _KEPT + ", cc as (select repo, id, coalesce(community, -1) as c from n), e as (select ki.repo, a.c as c, b.c as t from ki join cc a on a.repo = ki.repo and a.id = ki.id join cc b on b.repo = ki.repo and b.id = ki.other), g as (select repo, c, count(*) as k, count(*) filter (c = t) as within from e group by all) select repo, sum(within) / sum(k) - sum(k * k) / (sum(k) * sum(k)) as modularity from g group by repo",
    "question_tokens": _KEPT + f""", qs(q, question, term) as (values {_TERMS}),
sc as (select n.repo, q, id, count(*) as score from n join qs on contains(lower(label), term) group by all),
lv as (select repo, q, id, 0 as depth from (select *, row_number() over (partition by repo, q order by score desc, id desc) as r from sc) where r <= 3 union select lv.repo, q, ki.other, depth + 1 from lv join ki on ki.repo = lv.repo and ki.id = lv.id where depth < 3),
le as (select repo, q, id, min(depth) as depth from lv group by all), ln as (select le.*, coalesce(label, n.id) as name, source_file, source_location from le join n on n.repo = le.repo and n.id = le.id),
li as (select repo, q, 15 + length(name) + length(coalesce(source_file, '')) + length(coalesce(source_location, '')) as chars from ln union all
select a.repo, a.q, 12 + length(a.name) + length(rel) + length(b.name) from ln a join ki on ki.repo = a.repo and ki.id = a.id join ln b on b.repo = a.repo and b.q = a.q and b.id = ki.other and b.depth = a.depth + 1),
qt as (select repo, q, greatest(1, (sum(chars) + count(*) - 1) // 4)::bigint as query_tokens from li group by all),
fw as (select repo, source_file, max(case when trim(file_text, chr(32) || chr(9) || chr(10) || chr(13)) = '' then 0 else len(regexp_split_to_array(trim(file_text, chr(32) || chr(9) || chr(10) || chr(13)), '[ \\t\\r\\n]+')) end) as nw from source_files where file_text is not null group by all),
co as (select repo, (sum(nw) * 100 // 75)::bigint as corpus_tokens from fw group by repo)
select qt.repo, question, query_tokens, corpus_tokens, corpus_tokens / query_tokens as reduction from qt join (select distinct q, question from qs) using (q) left join co on co.repo = qt.repo""",
    "hub_paths": _BASE + ", p0 as (select repo, id, [id] as path from hub1), " + ", ".join(_PATHS) + ", pa as (" + " union all ".join(f"select * from p{t}" for t in range(7)) + ") select a.repo, a.id as source, b.id as target, array_to_string(path, ' > ') as path, (len(path) - 1)::int as n_steps from hub1 a join hub b on b.repo = a.repo and b.rank = 2 left join pa on pa.repo = b.repo and pa.id = b.id",
    "kept_links": _KEPT + " select repo, source, target, relation, confidence from kl",
    "matched_communities": _MATCH + " select * from mt",
    "link_drift": _MATCH + ", e as (select o.repo, o.id, case when l.new_community is null then 2 when l.new_community = nc and oc = nc then 0 else 1 end as r from old o join new x on x.repo = o.repo and x.id = o.id left join mt l on l.repo = o.repo and l.old_community = oc) select g.repo, source, target, relation, case when a.r is null or b.r is null then 'orphaned' when greatest(a.r, b.r) = 2 then 'community-resharded' when greatest(a.r, b.r) = 1 then 'community-renamed' else 'stable' end as drift from (select distinct repo, source, target, relation from graph_links where source is not null and target is not null and relation in ('implements', 'documents', 'tests')) g left join e a on a.repo = g.repo and a.id = source left join e b on b.repo = g.repo and b.id = target",
    "community_pages": _BASE + ", z as (select repo, community, count(*) as size from c group by all), y as (select repo, lo_community as community, hi_community as host, n_links from ic union all select repo, hi_community, lo_community, n_links from ic), h as (select * from (select y.*, row_number() over (partition by y.repo, y.community order by n_links desc, b.size desc, host) as r from y join z b on b.repo = y.repo and b.community = y.host and b.size >= 6) where r = 1) select z.repo, z.community, z.size as n_nodes, case when z.size >= 6 then z.community else coalesce(host, -1) end as page from z left join h on h.repo = z.repo and h.community = z.community",
    "community_signatures": _BASE + "select repo, community, count(*) as n_nodes, sum(('0x' || substring(md5(id), 1, 8))::bigint)::bigint as signature from c group by all",
    "dependency_layers": """with recursive st as (select distinct repo, source as id, target as other from graph_links where source is not null and target is not null and relation in ('depends_on', 'imports', 'imports_from')),
nd as (select repo, id from st union select repo, other from st), rc as (select repo, id as a, other as b from st union select rc.repo, rc.a, st.other from rc join st on st.repo = rc.repo and st.id = rc.b),
loops as (select repo, a from rc where a = b), bad as (select repo, a as id from loops union select rc.repo, rc.b from rc join loops on loops.repo = rc.repo and loops.a = rc.a),
wk as (select repo, id, 0 as l from nd where not exists (select 1 from st where st.repo = nd.repo and st.other = nd.id) union select wk.repo, st.other, l + 1 from wk join st on st.repo = wk.repo and st.id = wk.id where not exists (select 1 from bad where bad.repo = st.repo and bad.id = st.other))
select nd.repo, nd.id, max(l)::int as layer from nd left join wk on wk.repo = nd.repo and wk.id = nd.id group by all""",
    "link_heat": _BASE + """, a as (select repo, least(from_id, to_id) as lo, greatest(from_id, to_id) as hi, count(*) as n_walks from agent_edges where from_id is not null and to_id is not null group by all),
x as (select repo, list_sort(list(n_walks)) as l, count(*) as n from a group by repo), j as (select *, least(greatest((n + 1) // 10, 1), greatest(n - 1, 1)) as j1, least(greatest(9 * (n + 1) // 10, 1), greatest(n - 1, 1)) as j9 from x),
t as (select repo, case when n < 10 then l[1] * 10 else l[j1] * (10 - (n + 1 - j1 * 10)) + l[j1 + 1] * (n + 1 - j1 * 10) end as cold, case when n < 10 then l[n] * 10 else l[j9] * (10 - (9 * (n + 1) - j9 * 10)) + l[j9 + 1] * (9 * (n + 1) - j9 * 10) end as hot from j)
select u.repo, lo, hi, case when n_walks is null then 'never' when n_walks * 10 >= hot then 'hot' when n_walks * 10 <= cold then 'cold' else 'warm' end as heat, round(case when n_walks is not null then least(10.0::double, 1 + ln(n_walks)) end, 6) as weight, (n_walks * 4 // 5)::bigint as decayed from u left join a using (repo, lo, hi) left join t on t.repo = u.repo""",
    "degree_deltas": f"with {_LAST}, e as (select repo, back, from_id as id, to_id as other from agent_edges join last using (repo, snapshot_no) where back <= 2 and from_id is not null and to_id is not null union select repo, back, to_id, from_id from agent_edges join last using (repo, snapshot_no) where back <= 2 and from_id is not null and to_id is not null) select repo, id, count(*) filter (back = 2) as old_degree, count(*) filter (back = 1) as new_degree from e group by all having old_degree <> new_degree",
    "graph_shape": _BASE + ", r as (select repo, id, id as reach from deg union select r.repo, r.id, other from r join inc on inc.repo = r.repo and inc.id = r.reach), q as (select repo, id, min(reach) as component from r group by all), p as (select repo, count(*) as n_pairs from u group by repo), o as (select repo, count(*) as n_nodes, count(*) filter (id = component) as n_components from q group by repo) select repo, n_nodes, n_components, n_pairs, 2 * n_pairs / n_nodes as branching, n_components = 1 and n_pairs = n_nodes - 1 as is_tree from o join p using (repo)",
    "hub_siblings": _BASE + "select repo, community, rank, id, degree from (select *, row_number() over (partition by repo, community order by degree desc, id) as rank from k where community is not null and not is_file and not is_concept) where rank <= 5",
    "node_evidence": "with e as (select repo, source as id, * exclude (repo) from graph_links where source is not null and target is not null union all select repo, target, * exclude (repo) from graph_links where source is not null and target is not null) select repo, id, count(*) as n_links, count(distinct source_file) as n_sources, round(coalesce((sum(confidence_score::decimal(18,6)) filter (confidence = 'INFERRED'))::double / nullif(count(confidence_score) filter (confidence = 'INFERRED'), 0), 0), 6) as mean_score from e group by repo, id",
    "shared_concepts": _BASE + "select lower(label) as label, count(*) as n_nodes, count(distinct repo) as n_repos, min(repo || ':' || id) as merged_id from n where label <> '' group by lower(label) having count(distinct repo) > 1",
    "code_stems": r"with f as (select distinct repo, source_file, regexp_extract(source_file, '([^/]*?)(\.[^./]*)?$', 1) as stem from source_files where file_type = 'code' and source_file is not null), g as (select repo, stem, count(*) as n from f group by all) select repo, source_file, case when n = 1 then stem else stem || '-' || substring(sha256(source_file), 1, 8) end as note from f join g using (repo, stem)",
    "suggested_questions": _KEPT + """, ge as (select repo, lo as id, hi as other from kp union all select repo, hi, lo from kp),
br as (select * from (select *, row_number() over (partition by repo order by nf desc, id) as r from (select ge.repo, ge.id, count(distinct b.community) as nf from ge join k a on a.repo = ge.repo and a.id = ge.id and not a.is_file and not a.is_concept join c b on b.repo = ge.repo and b.id = ge.other where a.community <> b.community group by all)) where r <= 3),
top as (select * from (select *, row_number() over (partition by repo order by degree desc, id) as r from k where not is_file) where r <= 5),
vi as (select repo, id, count(*) as ni from (select repo, source as id from kl where confidence = 'INFERRED' union all select repo, target from kl where confidence = 'INFERRED' and source <> target) join top using (repo, id) group by all having count(*) >= 2),
co as (select x.repo, x.community, x.nn from (select repo, community, count(*) as nn from c group by all) x left join (select a.repo, a.community, count(*) as nl from u join c a on a.repo = u.repo and a.id = lo join c b on b.repo = u.repo and b.id = hi where a.community = b.community and lo <> hi group by all) y on y.repo = x.repo and y.community = x.community where nn >= 5 and coalesce(nl, 0) / (nn * (nn - 1) / 2) < 0.15),
al as (select distinct repo, 1 as kind, 0 as weight, source || ' ? ' || target as subject from kl where valid_until is null and confidence = 'AMBIGUOUS' union all select repo, 2, nf, id from br union all select repo, 3, ni, id from vi
union all select repo, 4, 0, id from k where degree <= 1 and not is_file and not is_concept union all select repo, 5, nn, community::varchar from co)
select repo, rank, ['ambiguous_edge', 'bridge_node', 'verify_inferred', 'isolated_nodes', 'low_cohesion'][kind] as kind, subject from (select *, row_number() over (partition by repo order by kind, weight desc, subject) as rank from al) where rank <= 7""",
    "node_keys": _BASE + r"select repo, id, substring(sha256(id), 1, 16) as element, replace(replace(label, '\', '\\'), '''', '\''') as cypher, replace(replace(replace(label, '`', ''''), '<', '&lt;'), '>', '&gt;') as markdown from n",
    "retained_snapshots": "select repo, snapshot_no, age, age <= 5 as kept from (select *, row_number() over (partition by repo order by snapshot_ts desc, snapshot_no desc) as age from (select distinct repo, snapshot_no, snapshot_ts from snapshot_log))",
    "document_sentences": r"select doc_id, (case when t = '' then 0 else len(regexp_extract_all(t, '[.!?][ \t\r\n]+')) + 1 end)::int as n_sentences from (select doc_id, regexp_replace(text, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') as t from documents where text is not null)",
    "tech_tags": r"select repo, tag, count(*) as n_files from (select distinct repo, source_file from source_files) join (values ('py', 'python'), ('ts', 'typescript'), ('js', 'javascript'), ('go', 'go'), ('rs', 'rust'), ('java', 'java'), ('rb', 'ruby'), ('c', 'c'), ('cpp', 'cpp'), ('cs', 'csharp'), ('swift', 'swift'), ('kt', 'kotlin'), ('sql', 'sql'), ('sh', 'shell')) m(suffix, tag) on lower(regexp_extract(source_file, '\.([^./]+)$', 1)) = suffix group by all",
    "concept_links": _KEPT + """, x as (select repo, case when relation = 'implemented_by' then target else source end as s, case when relation = 'implemented_by' then source else target end as t, case confidence when 'EXTRACTED' then 3 when 'INFERRED' then 2 when 'AMBIGUOUS' then 1 else 0 end as tier, confidence_score from kl where relation in ('implements', 'implemented_by')),
y as (select x.*, coalesce(b.file_type = 'code', false) and not coalesce(a.file_type = 'code', false) as turned from x join n a on a.repo = x.repo and a.id = s join n b on b.repo = x.repo and b.id = t), z as (select repo, case when turned then t else s end as source, case when turned then s else t end as target, tier, confidence_score from y)
select repo, source, target, n_rows, best as tier, confidence_score from (select repo, source, target, row_number() over (partition by repo, least(source, target), greatest(source, target) order by tier desc, coalesce(confidence_score, -1) desc, source, target) as r, count(*) over g as n_rows, max(tier) over g as best, max(confidence_score) over g as confidence_score from z window g as (partition by repo, least(source, target), greatest(source, target))) where r = 1""",
}
