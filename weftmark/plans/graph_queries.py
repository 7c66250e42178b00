"""Queries of the graph operators over each repo's newest graph and its history, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analysis, communities, extract_code, graph, history, traversal
from ..operators.graph import Graph
from ..sources import files
from ..sources.tables import load
from ..streaming import live
from .problems import newest_nodes
from .scratch import broadcast_if_small

FIELDS = ["label", "file_type", "source_file", "source_location", "community"]
#: The one moment that counts as now in every query over time.
NOW = "2026-09-01 00:00:00"


def newest_graph(spark: SparkSession, d: str) -> Graph:
    return Graph(newest_nodes(spark, d, FIELDS), load(spark, d, "graph_links"))


def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    """Nodes, links and links per confidence of each repo."""
    g = newest_graph(spark, d)
    of = lambda name: F.count(F.when(F.col("confidence") == name, 1)).alias(f"n_{name.lower()}")
    links = graph.whole_links(g.links).groupBy("repo").agg(F.count(F.lit(1)).alias("n_links"), *[of(t) for t in graph.TIERS], F.count(F.when(F.col("valid_until").isNotNull(), 1)).alias("n_closed"))
    return g.nodes.groupBy("repo").agg(F.count(F.lit(1)).alias("n_nodes")).join(links, "repo", "left")


def unknown_relations(spark: SparkSession, d: str) -> DataFrame:
    """Relations of agent edges outside the vocabulary, with their number."""
    edges = load(spark, d, "agent_edges")
    return edges.where(F.col("relation").isNotNull() & ~F.col("relation").isin(graph.RELATIONS)).groupBy("relation").agg(F.count(F.lit(1)).alias("n_edges"))


def node_error_counts(spark: SparkSession, d: str) -> DataFrame:
    return graph.node_errors(load(spark, d, "graph_nodes")).groupBy("repo", "error").agg(F.count(F.lit(1)).alias("n_rows"))


def link_error_counts(spark: SparkSession, d: str) -> DataFrame:
    return graph.link_errors(load(spark, d, "graph_links")).groupBy("repo", "error").agg(F.count(F.lit(1)).alias("n_rows"))


def node_roles(spark: SparkSession, d: str) -> DataFrame:
    return graph.described(newest_graph(spark, d)).select("repo", "id", "degree", "is_file", "is_concept")


def top_hub(g: Graph) -> DataFrame:
    return graph.hubs(g, 1).select("repo", "id")


def hub_reach(spark: SparkSession, d: str) -> DataFrame:
    """Nodes within three links of each repo's first hub, by distance."""
    g = newest_graph(spark, d)
    return traversal.neighbourhood(g, top_hub(g), 3)


def hub_ego(spark: SparkSession, d: str) -> DataFrame:
    """Links among each repo's first hub and its neighbours."""
    g = newest_graph(spark, d)
    return traversal.induced(g, traversal.neighbourhood(g, top_hub(g), 1))


def concept_hops(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that the first hub reaches over implements and depends_on links, in their direction."""
    g = newest_graph(spark, d)
    return traversal.along(g, top_hub(g), ["implements", "depends_on"], 3)


def snapshot_counts(spark: SparkSession, d: str) -> DataFrame:
    """Distinct nodes of each snapshot against the number its log gives."""
    rows = load(spark, d, "graph_nodes").where("id is not null").select("repo", "snapshot_no", "id").distinct().groupBy("repo", "snapshot_no").agg(F.count(F.lit(1)).alias("n_found"))
    return load(spark, d, "snapshot_log").select("repo", "snapshot_no", "node_count").join(rows, ["repo", "snapshot_no"], "left").select("repo", "snapshot_no", "node_count", F.coalesce("n_found", F.lit(0)).alias("n_found"))


def link_decay(spark: SparkSession, d: str) -> DataFrame:
    """Decayed weight of every link at NOW."""
    links = graph.whole_links(load(spark, d, "graph_links"))
    weight = history.decay(F.col("relation"), F.col("valid_from"), F.lit(NOW).cast("timestamp_ntz"))
    return links.select("repo", "source", "target", "relation", "valid_from", F.round(weight, 6).alias("decay"))


def superseded_links(spark: SparkSession, d: str) -> DataFrame:
    closed = history.superseded(load(spark, d, "graph_links"), F.lit(NOW))
    return closed


def calibration(spark: SparkSession, d: str) -> DataFrame:
    """Scores of inferred links in ten bins of a tenth; 1 falls into the last."""
    rows = load(spark, d, "graph_links").where("confidence = 'INFERRED' and confidence_score is not null")
    return rows.groupBy(F.least(F.lit(9), F.greatest(F.lit(0), F.floor(F.col("confidence_score") * 10))).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n_links"))


def score_flags(spark: SparkSession, d: str) -> DataFrame:
    """Signs that scores say little: one bin above 60 %, over 30 % at one half, under 5 % below it."""
    scores = load(spark, d, "graph_links").where("confidence = 'INFERRED' and confidence_score is not null")
    bins = calibration(spark, d).agg(F.max("n_links").alias("most"), F.sum("n_links").alias("n"))
    parts = scores.agg(F.count(F.when(F.col("confidence_score") == 0.5, 1)).alias("half"), F.count(F.when(F.col("confidence_score") < 0.5, 1)).alias("below"))
    flags = bins.withColumn("k", F.lit(1)).join(parts.withColumn("k", F.lit(1)), "k")
    return flags.select((F.col("most") > 0.6 * F.col("n")).alias("mode_collapse"), (F.col("half") > 0.3 * F.col("n")).alias("refusal"), (F.col("below") < 0.05 * F.col("n")).alias("no_negatives"))


def score_bands(spark: SparkSession, d: str) -> DataFrame:
    links = load(spark, d, "graph_links")
    return links.groupBy("repo", T.score_band(F.col("confidence_score")).alias("band")).agg(F.count(F.lit(1)).alias("n_links"))


def walked_pairs(spark: SparkSession, d: str) -> DataFrame:
    """How often the ends of agent edges meet; the batch form of the streaming counter."""
    return live.walk_counts(load(spark, d, "agent_edges").select("repo", F.col("from_id").alias("source"), F.col("to_id").alias("target")))


def never_walked(spark: SparkSession, d: str) -> DataFrame:
    """Linked pairs that no agent edge ever joined, per repo."""
    return graph.pairs(load(spark, d, "graph_links")).join(walked_pairs(spark, d), ["repo", "lo", "hi"], "left_anti").groupBy("repo").agg(F.count(F.lit(1)).alias("n_pairs"))


def annotations_compact(spark: SparkSession, d: str) -> DataFrame:
    """The last note per node, relation and peer; among equal times the greatest body."""
    rows = load(spark, d, "annotations").where("id is not null")
    last = rows.groupBy("repo", "id", "relation", "peer_id").agg(F.max(F.struct("recorded_at", "loaded_at", "body")).alias("row"))
    return last.select("repo", "id", "relation", "peer_id", "row.recorded_at", "row.body")


def recent_edges(spark: SparkSession, d: str) -> DataFrame:
    """The five latest agent edges of each repo."""
    rows = load(spark, d, "agent_edges").where("from_id is not null and to_id is not null").select("repo", "from_id", "to_id", "relation", "ts").distinct()
    first = Window.partitionBy("repo").orderBy(F.desc("ts"), "from_id", "to_id", F.asc_nulls_last("relation"))
    return rows.withColumn("rank", F.row_number().over(first)).where("rank <= 5")


def resolved_notes(spark: SparkSession, d: str) -> DataFrame:
    """Annotations with the node they mean: by id, else by label without case (the smallest id), else none."""
    nodes = newest_nodes(spark, d, ["label"])
    notes = load(spark, d, "annotations").where("id is not null or label is not null").select("repo", "id", "label").distinct()
    by_label = nodes.where("label is not null").groupBy("repo", F.lower("label").alias("low")).agg(F.min("id").alias("label_id"))
    exact = nodes.select("repo", "id", F.col("id").alias("exact_id"))
    found = notes.join(exact, ["repo", "id"], "left").withColumn("low", F.lower("label")).join(by_label, ["repo", "low"], "left")
    return found.select("repo", "id", "label", F.coalesce("exact_id", "label_id").alias("node_id"))


def node_search(spark: SparkSession, d: str) -> DataFrame:
    """The 20 nodes that fit a question best: 1 for a term in the label, one half for one in the source."""
    words = ["schema", "merge", "index"]
    hit = lambda c, n: sum([F.when(F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(w)), n).otherwise(0.0) for w in words], F.lit(0.0))
    scored = newest_nodes(spark, d, ["label", "source_file"]).withColumn("score", hit("label", 1.0) + hit("source_file", 0.5)).where("score > 0")
    return scored.select("repo", "id", "score").orderBy(F.desc("score"), F.desc("id"), F.desc("repo")).limit(20)


def file_status(spark: SparkSession, d: str) -> DataFrame:
    """Files of each repo's newest snapshot against those that its snapshot before pointed to, counted by status.

    The manifest is that earlier snapshot: a file's entry is from when its nodes were last loaded then.
    """
    last = communities.last_two(load(spark, d, "snapshot_log"))
    held = history.standing_nodes(load(spark, d, "graph_nodes"), ["source_file"], ["loaded_at"]).where("source_file <> ''").join(broadcast_if_small(last), ["repo", "snapshot_no"])
    changed = load(spark, d, "source_files").groupBy("repo", "source_file").agg(F.max("modified_at").alias("modified_at"))
    now = held.where("back = 1").select("repo", "source_file").distinct().join(changed, ["repo", "source_file"])
    manifest = held.where("back = 2").select("repo", "source_file", F.col("loaded_at").alias("modified_at"))
    return files.changed_since(now, manifest, ["repo", "source_file"]).groupBy("repo", "status").agg(F.count(F.lit(1)).alias("n_files"))


def node_staleness(spark: SparkSession, d: str) -> DataFrame:
    """Newest nodes by the state of their file: gone (ghost), changed since the node was loaded (stale) or fresh."""
    nodes = newest_nodes(spark, d, ["source_file"]).where("source_file <> ''")
    loaded = load(spark, d, "graph_nodes").where("id is not null").groupBy("repo", "id").agg(F.max("loaded_at").alias("loaded_at"))
    held = load(spark, d, "source_files").groupBy("repo", "source_file").agg(F.max("modified_at").alias("modified_at"))
    state = F.when(F.col("modified_at").isNull(), "ghost").when(F.col("modified_at") > F.col("loaded_at"), "stale").otherwise("fresh")
    return nodes.join(loaded, ["repo", "id"]).join(held, ["repo", "source_file"], "left").groupBy("repo", state.alias("state")).agg(F.count(F.lit(1)).alias("n_nodes"))


def file_categories(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "source_files").groupBy("repo", analysis.category(F.col("source_file")).alias("category")).agg(F.count(F.lit(1)).alias("n_files"))


def node_slugs(spark: SparkSession, d: str) -> DataFrame:
    """Ids made from path and label, beside cleaned labels."""
    return newest_nodes(spark, d, FIELDS).select("repo", "id", T.slug(F.col("source_file"), F.col("label")).alias("slug"), T.clean_label(F.col("label")).alias("clean"))


def secret_documents(spark: SparkSession, d: str) -> DataFrame:
    """What redaction finds in each document, empty for nothing, and how long the text is then."""
    docs = load(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.array_join(T.secret_names(F.col("text")), ",").alias("secrets"), F.length(T.redacted(F.col("text"))).alias("n_chars"))


def disarmed_documents(spark: SparkSession, d: str) -> DataFrame:
    """Length of each document with and without its steering phrases."""
    docs = load(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.length("text").alias("before"), F.length(T.disarmed(F.col("text"))).alias("after"))


def paper_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents that show three signs of a paper or more."""
    return load(spark, d, "documents").where("text is not null").select("doc_id", T.paper_signs(F.col("text")).alias("n_signs")).where("n_signs >= 3")


def corpus_size(spark: SparkSession, d: str) -> DataFrame:
    """Documents, words and estimated tokens per file type."""
    docs = load(spark, d, "documents")
    words = F.sum(T.word_count(F.col("text")))
    return docs.groupBy("file_type").agg(F.count(F.lit(1)).alias("n_docs"), words.alias("n_words"), F.floor(words * 100 / 75).cast("bigint").alias("n_tokens"), F.sum(F.floor(F.length("text") / 4)).cast("bigint").alias("n_quarter_chars"))


def code_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols found in the code files, by suffix and kind."""
    code = load(spark, d, "source_files").where("file_type = 'code'")
    found = extract_code.symbols(code.select("repo", "source_file", "file_text").distinct())
    return found.groupBy(F.lower(F.regexp_extract("source_file", r"\.([^./]+)$", 1)).alias("suffix"), "kind").agg(F.count(F.lit(1)).alias("n_symbols"))


def import_components(spark: SparkSession, d: str) -> DataFrame:
    """Groups of files that import the same things, by connected components: sizes per repo."""
    code = load(spark, d, "source_files").where("file_type = 'code'").select("repo", "source_file", "file_text").distinct()
    links = extract_code.symbol_graph(code).where("relation = 'imports'")
    parts = traversal.components(Graph(links, links))
    return parts.groupBy("repo", "component").agg(F.count(F.lit(1)).alias("n_members"))


def on_graph(operator):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return operator(newest_graph(spark, d))
    run.__doc__ = operator.__doc__
    return run


QUERIES = {
    "hub_nodes": on_graph(graph.hubs), "graph_stats": graph_stats, "node_degree": on_graph(lambda g: graph.degrees(g.links)), "node_roles": node_roles, "merged_links": on_graph(lambda g: graph.merged_links(g.links)),
    "dangling_links": on_graph(graph.dangling), "unknown_relations": unknown_relations, "node_errors": node_error_counts, "link_errors": link_error_counts,
    "community_cohesion": on_graph(analysis.cohesion), "inter_community": on_graph(analysis.inter_community), "community_labels": on_graph(analysis.community_labels), "nearest_hosts": on_graph(analysis.nearest_hosts),
    "surprising_links": on_graph(analysis.surprises), "community_bridges": on_graph(analysis.bridges), "knowledge_gaps": on_graph(analysis.knowledge_gaps), "contradictions": on_graph(analysis.contradictions),
    "supersession_chains": on_graph(analysis.supersession_chains), "top_terms": on_graph(analysis.top_terms),
    "hub_reach": hub_reach, "hub_ego": hub_ego, "concept_hops": concept_hops, "components": on_graph(traversal.components),
    "entity_trace": lambda s, d: history.entity_trace(load(s, d, "graph_nodes")), "node_drift": lambda s, d: history.node_drift(load(s, d, "graph_nodes"), load(s, d, "agent_edges")),
    "newly_formed": lambda s, d: history.newly_formed(load(s, d, "graph_nodes"), load(s, d, "snapshot_log")), "migrations": lambda s, d: history.migrations(load(s, d, "graph_nodes"), load(s, d, "snapshot_log")),
    "merge_plan": lambda s, d: history.merge_plan(load(s, d, "graph_nodes"), load(s, d, "snapshot_log"), FIELDS), "snapshot_counts": snapshot_counts, "link_decay": link_decay, "superseded_links": superseded_links,
    "calibration": calibration, "score_flags": score_flags, "score_bands": score_bands, "walked_pairs": walked_pairs, "never_walked": never_walked, "annotations_compact": annotations_compact, "recent_edges": recent_edges,
    "resolved_notes": resolved_notes, "node_search": node_search, "file_status": file_status, "node_staleness": node_staleness, "file_categories": file_categories, "node_slugs": node_slugs,
    "secret_documents": secret_documents, "disarmed_documents": disarmed_documents, "paper_documents": paper_documents, "corpus_size": corpus_size, "code_symbols": code_symbols, "import_components": import_components,
    "event_windows": lambda s, d: live.windowed_counts(load(s, d, "events")), "user_sessions": lambda s, d: live.user_sessions(load(s, d, "events")),
}

_KNOWN = """'binds_method', 'calls', 'case_of', 'cites', 'conceptually_related_to', 'contains', 'contradicts', 'defines', 'depends_on', 'derived_shortcut', 'documents', 'evolved_into', 'implemented_by', 'implements',
'imports', 'imports_from', 'includes', 'inherits', 'instantiates', 'method', 'rationale_for', 'realizes', 'references', 'related', 'related_to', 'semantically_similar_to', 'shares_data_with', 'supersedes', 'supports',
'tests', 'uses', 'uses_component'"""
_BASE = """
with recursive newest as (select repo, max(snapshot_no) as snapshot_no from snapshot_log group by repo),
n as (select repo, id, v.label as label, v.file_type as file_type, v.source_file as source_file, v.source_location as source_location, v.community as community from (
select repo, id, arg_max(struct_pack(label, file_type, source_file, source_location, community), loaded_at) as v from graph_nodes join newest using (repo, snapshot_no) where id is not null group by all)),
w as (select * from graph_links where source is not null and target is not null),
u as (select distinct repo, least(source, target) as lo, greatest(source, target) as hi from w),
inc as (select repo, lo as id, hi as other from u union all select repo, hi, lo from u),
deg as (select repo, id, count(*) as degree from inc group by all),
cu as (select distinct repo, least(source, target) as lo, greatest(source, target) as hi from w where valid_until is null),
cdeg as (select repo, id, count(*) as degree from (select repo, lo as id, hi as other from cu union all select repo, hi, lo from cu) group by all),
k as (select n.*, coalesce(deg.degree, 0) as degree, coalesce(cdeg.degree, 0) as current_degree,
coalesce(label <> '' and (label = regexp_extract(coalesce(source_file, ''), '[^/]+$') or (label like '.%' and label like '%()') or (label like '%()' and coalesce(deg.degree, 0) <= 1)), false) as is_file,
coalesce(label <> '' and (label = regexp_extract(coalesce(source_file, ''), '[^/]+$') or (label like '.%' and label like '%()') or (label like '%()' and coalesce(cdeg.degree, 0) <= 1)), false) as is_file_now,
not coalesce(contains(regexp_extract(coalesce(source_file, ''), '[^/]*$'), '.'), false) as is_concept from n left join deg using (repo, id) left join cdeg using (repo, id)),
hub as (select * from (select repo, row_number() over (partition by repo order by current_degree desc, id) as rank, id, label, current_degree as degree from k where not is_file_now and not is_concept)),
hub1 as (select repo, id from hub where rank = 1),
m as (select repo, source, target, relation, count(*) as n_rows, max(case confidence when 'EXTRACTED' then 3 when 'INFERRED' then 2 when 'AMBIGUOUS' then 1 else 0 end) as tier, max(confidence_score) as confidence_score,
sum(coalesce(weight, 1)::decimal(18,6))::double as weight, min(valid_from) as valid_from, case when bool_or(valid_until is null) then null else max(valid_until) end as valid_until, max(decay_weight) as decay_weight,
coalesce(array_to_string(list_sort(list(distinct source_file) filter (source_file is not null)), '; '), '') as sources from w group by repo, source, target, relation),
mc as (select repo, source, target, relation, max(case confidence when 'EXTRACTED' then 3 when 'INFERRED' then 2 when 'AMBIGUOUS' then 1 else 0 end) as tier from w where valid_until is null group by repo, source, target, relation),
c as (select repo, id, community from n where community is not null),
ic as (select a.repo, least(a.community, b.community) as lo_community, greatest(a.community, b.community) as hi_community, count(*) as n_links from u join c a on a.repo = u.repo and a.id = lo join c b on b.repo = u.repo and b.id = hi where a.community <> b.community group by all)
"""
_STANDING = "s as (select repo, snapshot_no, id, v.community as community, v from (select repo, snapshot_no, id, arg_max(struct_pack(label, file_type, source_file, source_location, community), loaded_at) as v from graph_nodes where id is not null group by all))"
_LAST = "last as (select repo, snapshot_no, row_number() over (partition by repo order by snapshot_no desc) as back from (select distinct repo, snapshot_no from snapshot_log))"
_CAT = "case when regexp_matches({0}, '(?i)\\.(py|ts|js|go|rs|java|cpp|c|rb|swift|kt|cs)$') then 'code' when {0} ilike '%.pdf' then 'paper' when regexp_matches({0}, '(?i)\\.(png|jpg|jpeg|webp|gif|svg)$') then 'image' else 'doc' end"


def _levels(steps: str, depth: int) -> str:
    return _BASE + f", {steps}, lv as (select repo, id, 0 as depth from hub1 union select step.repo, other, depth + 1 from lv join step on step.repo = lv.repo and step.id = lv.id where depth < {depth}) select repo, id, min(depth)::int as depth from lv group by all"


#: The patterns as the comparison states them, for its own dialect.
_SECRET = [
    ("aws_access_key", r"(AKIA|ASIA|AGPA|AIDA|AROA|ANPA|ANVA|AIPA)[0-9A-Z]{16}"), ("github_pat", r"ghp_[A-Za-z0-9]{36}"), ("openai_api_key", r"\b(sk-proj-[A-Za-z0-9_-]{64,}|sk-[A-Za-z0-9]{48,})\b"),
    ("slack_token", r"xox[baprs]-[A-Za-z0-9-]+"), ("bearer_token", r"Bearer\s+[A-Za-z0-9._-]{20,}"), ("pem_private_key", r"(?s)-----BEGIN[ A-Z]+PRIVATE KEY-----.*?-----END[ A-Z]+PRIVATE KEY-----"),
    ("email_credential", r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+:[A-Za-z0-9@#$%^&*()_+=!\-]{8,}"),
]
_STEERING = [r"(?m)^-{3,}\s*$", r"(?i)<\s*/?\s*system\s*>", r"(?i)\bignore\s+(all\s+)?(prior\s+)?instructions\b", r"(?im)^\s*(system|assistant|user)\s*:\s*$"]
_PAPER = [
    r"(?i)\barxiv\b", r"(?i)\bdoi\s*:", r"(?i)\babstract\b", r"(?i)\bproceedings\b", r"(?i)\bjournal\b", r"(?i)\bpreprint\b", r"\\cite\{", r"\[\d+\]", r"\[\n\d+\n\]",
    r"(?i)eq\.\s*\d+|equation\s+\d+", r"\d{4}\.\d{4,5}", r"(?i)\bwe propose\b", r"(?i)\bliterature\b",
]


def _chain(column: str, patterns: list[str], by: str) -> str:
    for p in patterns:
        column = f"regexp_replace({column}, '{p}', '{by}', 'g')"
    return column


_NAMES = " || ".join(f"case when regexp_matches({_chain('t', [p for _, p in _SECRET[:i]], '[REDACTED]')}, '{_SECRET[i][1]}') then '{_SECRET[i][0]},' else '' end" for i in range(len(_SECRET)))

#: What declares and imports in the languages of the tables, as the comparison states it; names come from the first group that is not empty.
_SYMBOLS = r"""with pat(lang, kind, p) as (values
('py', 'class', '^\s*class\s+(\w+)()'), ('py', 'function', '^\s*(?:async\s+)?def\s+(\w+)()'), ('py', 'import', '^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))'),
('js', 'class', '^\s*(?:export\s+)?(?:default\s+)?class\s+(\w+)()'), ('js', 'function', '^\s*(?:export\s+)?(?:async\s+)?(?:function\s+(\w+)|const\s+(\w+)\s*=\s*(?:async\s*)?\()'), ('js', 'import', '(?:from\s+|require\()["'']([^"'']+)["'']()'),
('java', 'class', '^\s*(?:public\s+|final\s+|abstract\s+)*(?:class|interface)\s+(\w+)()'), ('java', 'function', '^\s+(?:public|private|protected|static|final|\s)*[\w<>\[\]]+\s+(\w+)\s*\([^;]*(?:\{|;)\s*$()'), ('java', 'import', '^\s*import\s+([\w.]+)()'),
('go', 'class', '^type\s+(\w+)()'), ('go', 'function', '^func\s+(?:\([^)]*\)\s*)?(\w+)()'), ('go', 'import', '^\s*(?:import\s+)?"([\w./]+)"\s*$()'),
('rs', 'class', '^\s*(?:pub\s+)?(?:struct|enum|trait)\s+(\w+)()'), ('rs', 'function', '^\s*(?:pub\s+)?fn\s+(\w+)()'), ('rs', 'import', '^\s*use\s+([\w:]+)()'),
('c', 'class', '^\s*struct\s+(\w+)\s*\{()'), ('c', 'function', '^(?:static\s+)?[\w\s*]+?\b(\w+)\s*\([^;]*\)\s*\{?\s*$()'), ('c', 'import', '^\s*#include\s+[<"]([^>"]+)[>"]()'),
('rb', 'class', '^\s*(?:class|module)\s+(\w+)()'), ('rb', 'function', '^\s*def\s+(?:self\.)?(\w+)()'), ('rb', 'import', '^\s*require(?:_relative)?\s+["'']([^"'']+)["'']()')),
f as (select distinct repo, source_file, file_text, lower(regexp_extract(source_file, '\.([^./]+)$', 1)) as suffix from source_files where file_type = 'code' and file_text is not null),
ln as (select repo, source_file, suffix, case when suffix in ('ts', 'tsx', 'jsx', 'vue', 'svelte') then 'js' when suffix in ('h', 'cpp', 'cc', 'cxx', 'hpp') then 'c' else suffix end as lang, unnest(regexp_split_to_array(file_text, '\r\n|\n|\r')) as line from f),
sy as (select repo, source_file, suffix, kind, coalesce(nullif(regexp_extract(line, p, 1), ''), nullif(regexp_extract(line, p, 2), '')) as name from ln join pat using (lang)),
sk as (select * from sy where name is not null and name not in ('if', 'for', 'while', 'switch', 'return', 'catch', 'else', 'sizeof'))
"""

SQL = {
    "code_symbols": _SYMBOLS + "select suffix, kind, count(*) as n_symbols from sk group by all",
    "import_components": _SYMBOLS.replace("with pat", "with recursive pat", 1) + ", li as (select distinct repo, source_file as s, name as t from sk where kind = 'import'), st as (select repo, s as id, t as other from li union select repo, t, s from li), r as (select repo, id, other as reach from st union select repo, id, id from st union select r.repo, r.id, st.other from r join st on st.repo = r.repo and st.id = r.reach) "
    "select repo, component, count(*) as n_members from (select repo, id, min(reach) as component from r group by all) group by all",
    "hub_nodes": _BASE + "select repo, rank, id, label, degree from hub where rank <= 10",
    "graph_stats": _BASE + "select n.repo, n_nodes, n_links, n_ambiguous, n_inferred, n_extracted, n_closed from (select repo, count(*) as n_nodes from n group by repo) n left join (select repo, count(*) as n_links, count(*) filter (confidence = 'AMBIGUOUS') as n_ambiguous, count(*) filter (confidence = 'INFERRED') as n_inferred, count(*) filter (confidence = 'EXTRACTED') as n_extracted, count(valid_until) as n_closed from w group by repo) l using (repo)",
    "node_degree": _BASE + "select repo, id, degree from deg",
    "node_roles": _BASE + "select repo, id, degree, is_file, is_concept from k",
    "merged_links": _BASE + "select * from m",
    "dangling_links": _BASE + "select distinct repo, source, target, relation, 'source' as missing_end from w where not exists (select 1 from n where n.repo = w.repo and n.id = w.source) union all select distinct repo, source, target, relation, 'target' from w where not exists (select 1 from n where n.repo = w.repo and n.id = w.target)",
    "unknown_relations": "select relation, count(*) as n_edges from agent_edges where relation is not null and relation not in (" + _KNOWN + ") group by relation",
    "node_errors": "select repo, error, count(*) as n_rows from (" + " union all ".join([f"select repo, 'missing {c}' as error from graph_nodes where coalesce({c}, '') = ''" for c in ("id", "label", "file_type", "source_file")] + ["select repo, 'unknown file_type' from graph_nodes where file_type <> '' and file_type not in ('code', 'document', 'paper', 'image', 'rationale')"]) + ") group by all",
    "link_errors": "select repo, error, count(*) as n_rows from (" + " union all ".join([f"select repo, 'missing {c}' as error from graph_links where coalesce({c}, '') = ''" for c in ("source", "target", "relation", "confidence", "source_file")] + ["select repo, 'unknown confidence' from graph_links where confidence <> '' and confidence not in ('EXTRACTED', 'INFERRED', 'AMBIGUOUS')", "select repo, 'score out of range' from graph_links where confidence_score not between 0 and 1", "select repo, 'decay out of range' from graph_links where decay_weight not between 0 and 1", "select repo, 'missing score' from graph_links where confidence_score is null"]) + ") group by all",
    "community_cohesion": _BASE + "select c.repo, c.community, n_nodes, coalesce(n_links, 0) as n_links, case when n_nodes <= 1 then 1 else coalesce(n_links, 0) / (n_nodes * (n_nodes - 1) / 2) end as cohesion from (select repo, community, count(*) as n_nodes from c group by all) c left join (select a.repo, a.community, count(*) as n_links from u join c a on a.repo = u.repo and a.id = lo join c b on b.repo = u.repo and b.id = hi where a.community = b.community and lo <> hi group by all) i on i.repo = c.repo and i.community = c.community",
    "inter_community": _BASE + "select * from ic",
    "community_labels": _BASE + "select repo, community, coalesce(first(label order by degree desc, id) filter (not is_file and not is_concept and coalesce(label, '') <> ''), 'Community ' || community) as label from k where community is not null group by repo, community",
    "nearest_hosts": _BASE + ", z as (select repo, community, count(*) as size from c group by all), y as (select repo, lo_community as community, hi_community as host, n_links from ic union all select repo, hi_community, lo_community, n_links from ic) select repo, community, host, n_links from (select y.*, row_number() over (partition by y.repo, y.community order by n_links desc, b.size desc, host) as r from y join z a on a.repo = y.repo and a.community = y.community and a.size < 6 join z b on b.repo = y.repo and b.community = y.host and b.size >= 6) where r = 1",
    "surprising_links": _BASE + f""", b as (select mc.*, x.source_file as sa, y.source_file as sb, x.community as ca, y.community as cb, x.degree as da, y.degree as db from mc join k x on x.repo = mc.repo and x.id = source and not x.is_file and not x.is_concept join k y on y.repo = mc.repo and y.id = target and not y.is_file and not y.is_concept
where relation not in ('imports', 'imports_from', 'contains', 'method') and x.source_file <> y.source_file),
t as (select *, case tier when 1 then 3 when 2 then 2 else 1 end + case when {_CAT.format('sa')} <> {_CAT.format('sb')} then 2 else 0 end + case when split_part(sa, '/', 1) <> split_part(sb, '/', 1) then 2 else 0 end + case when ca <> cb then 1 else 0 end as base from b),
v as (select *, (case when relation = 'semantically_similar_to' then floor(base * 1.5) else base end + case when least(da, db) <= 2 and greatest(da, db) >= 5 then 1 else 0 end)::int as score from t)
select repo, rank, source, target, relation, score from (select *, row_number() over (partition by repo order by score desc, source, target, relation) as rank from v) where rank <= 5""",
    "community_bridges": _BASE + "select repo, lo_community, hi_community, source, target, relation, tier from (select m.*, least(a.community, b.community) as lo_community, greatest(a.community, b.community) as hi_community, row_number() over (partition by m.repo, least(a.community, b.community), greatest(a.community, b.community) order by tier, source, target, relation) as r from m join c a on a.repo = m.repo and a.id = source join c b on b.repo = m.repo and b.id = target where a.community <> b.community) where r = 1",
    "knowledge_gaps": _BASE + """, e as (select repo, source as id, relation, tier from m union all select repo, target, relation, tier from m), rich as (select repo from m group by repo having avg((tier = 1)::int) >= 0.2), thin as (select repo, community from c group by all having count(*) < 3),
g as (select repo, id, 1 as r from k where degree <= 1 and not exists (select 1 from e where e.repo = k.repo and e.id = k.id and relation in ('supports', 'contradicts', 'supersedes', 'evolved_into', 'depends_on')) and not is_file and not is_concept
union all select repo, id, 2 from k join thin using (repo, community) where not is_file and not is_concept
union all select repo, id, 3 from k where not is_file and not is_concept and repo in (select repo from rich) and exists (select 1 from e where e.repo = k.repo and e.id = k.id and tier = 1))
select repo, id, ['isolated', 'thin_community', 'high_ambiguity_context'][min(r)] as reason from g group by repo, id""",
    "contradictions": _BASE + "select repo, least(source, target) as lo, greatest(source, target) as hi, max(confidence_score) as score from w where relation = 'contradicts' and (confidence = 'EXTRACTED' or confidence_score >= 0.5) group by all",
    "supersession_chains": _BASE + """, st as (select distinct repo, source, target from w where relation = 'supersedes' and source <> target and (confidence = 'EXTRACTED' or confidence_score >= 0.5)),
p as (select distinct repo, source as last, [source] as path from st where not exists (select 1 from st x where x.repo = st.repo and x.target = st.source) union all select p.repo, target, list_append(path, target) from p join st on st.repo = p.repo and st.source = p.last where not list_contains(path, target))
select repo, array_to_string(path, ' > ') as path, len(path)::int as n_nodes from (select *, row_number() over (partition by repo, path[1], last order by len(path) desc, path) as r from p where len(path) > 1 and not exists (select 1 from st where st.repo = p.repo and st.source = p.last)) where r = 1""",
    "top_terms": _BASE + ", t as (select repo, community, greatest(degree, 1) as weight, unnest(list_distinct(list_filter(regexp_split_to_array(lower(label), '[^a-z0-9]+'), lambda x: length(x) > 2))) as term from k where community is not null) select repo, community, rank, term, weight from (select *, row_number() over (partition by repo, community order by weight desc, term) as rank from (select repo, community, term, sum(weight)::bigint as weight from t group by all)) where rank <= 3",
    "hub_reach": _levels("step as (select repo, id, other from inc)", 3),
    "hub_ego": _BASE + ", e as (select repo, id from hub1 union select inc.repo, other from inc join hub1 using (repo, id)) select * from u where exists (select 1 from e where e.repo = u.repo and e.id = lo) and exists (select 1 from e where e.repo = u.repo and e.id = hi)",
    "concept_hops": _levels("step as (select distinct repo, source as id, target as other from w where relation in ('implements', 'depends_on'))", 3),
    "components": _BASE + ", r as (select repo, id, id as reach from deg union select r.repo, r.id, other from r join inc on inc.repo = r.repo and inc.id = r.reach) select repo, id, min(reach) as component from r group by all",
    "entity_trace": f"with {_STANDING} select repo, id, min(snapshot_no)::int as first_no, max(snapshot_no)::int as last_no, count(*) as n_snapshots, count(distinct coalesce(community, -1)) as n_communities from s group by all",
    "node_drift": f"with {_STANDING}, e as (select distinct repo, snapshot_no, from_id as id, to_id as other from agent_edges where from_id is not null and to_id is not null union select repo, snapshot_no, to_id, from_id from agent_edges where from_id is not null and to_id is not null), d as (select repo, snapshot_no, id, count(*) as degree from e group by all), j as (select s.*, coalesce(degree, 0) as degree from s left join d using (repo, snapshot_no, id)), x as (select repo, id, count(*) as n, 2 * (count(distinct coalesce(community, -1)) - 1) + abs(arg_max(degree, snapshot_no) - arg_min(degree, snapshot_no)) as score from j group by repo, id) select repo, rank, id, score from (select *, row_number() over (partition by repo order by score desc, id) as rank from x where n >= 2 and score > 0) where rank <= 10",
    "newly_formed": f"with {_STANDING}, newest as (select repo, max(snapshot_no) as newest_no from snapshot_log group by repo), b as (select distinct repo, id from s join newest using (repo) where snapshot_no < newest_no and community is not null) select repo, community, count(*) as n_nodes from s join newest using (repo) left join b using (repo, id) where snapshot_no = newest_no and community is not null group by repo, community having count(b.id) = 0",
    "migrations": f"with {_STANDING}, {_LAST} select a.repo, b.community as old_community, a.community as new_community, count(*) as n_nodes from (select * from s join last using (repo, snapshot_no) where back = 1) a join (select * from s join last using (repo, snapshot_no) where back = 2) b on a.repo = b.repo and a.id = b.id where a.community is distinct from b.community group by all",
    "merge_plan": f"with {_STANDING}, {_LAST}, x as (select coalesce(a.repo, b.repo) as repo, case when b.id is null then 'create' when a.id is null then 'orphan' when a.v::varchar = b.v::varchar then 'keep' else 'update' end as action from (select * from s join last using (repo, snapshot_no) where back = 1) a full join (select * from s join last using (repo, snapshot_no) where back = 2) b on a.repo = b.repo and a.id = b.id) select repo, action, count(*) as n_nodes from x group by all",
    "snapshot_counts": "select l.repo, l.snapshot_no, node_count, count(distinct id) as n_found from snapshot_log l left join graph_nodes g on g.repo = l.repo and g.snapshot_no = l.snapshot_no group by all",
    "link_decay": f"select repo, source, target, relation, valid_from, round(coalesce(greatest(0.1, pow(0.5, greatest(0, (epoch_us(timestamp '{NOW}') - epoch_us(valid_from)) / 86400e6) / case when relation = 'semantically_similar_to' then 14.0 else 30.0 end)), 1.0), 6) as decay from graph_links where source is not null and target is not null",
    "superseded_links": _BASE + f"select distinct repo, source, target, relation, '{NOW}' as valid_until from w where relation <> 'supersedes' and valid_until is null and exists (select 1 from w x where x.repo = w.repo and x.relation = 'supersedes' and x.valid_until is null and x.target = w.source)",
    "calibration": "select least(9, greatest(0, floor(confidence_score * 10)))::int as bin, count(*) as n_links from graph_links where confidence = 'INFERRED' and confidence_score is not null group by all",
    "score_flags": "with s as (select confidence_score as x, least(9, greatest(0, floor(confidence_score * 10))) as bin from graph_links where confidence = 'INFERRED' and confidence_score is not null), b as (select count(*) as n from s group by bin) select (select max(n) > 0.6 * sum(n) from b) as mode_collapse, count(*) filter (x = 0.5) > 0.3 * count(*) as refusal, count(*) filter (x < 0.5) < 0.05 * count(*) as no_negatives from s",
    "score_bands": "select repo, case when confidence_score >= 0.8 then 'high' when confidence_score >= 0.5 then 'medium' when confidence_score >= 0 then 'low' end as band, count(*) as n_links from graph_links group by all",
    "walked_pairs": "select repo, least(from_id, to_id) as lo, greatest(from_id, to_id) as hi, count(*) as n_walks from agent_edges where from_id is not null and to_id is not null group by all",
    "never_walked": _BASE + "select repo, count(*) as n_pairs from u where not exists (select 1 from agent_edges a where a.repo = u.repo and a.from_id is not null and a.to_id is not null and least(from_id, to_id) = lo and greatest(from_id, to_id) = hi) group by repo",
    "annotations_compact": "select repo, id, relation, peer_id, recorded_at, body from (select *, row_number() over (partition by repo, id, relation, peer_id order by recorded_at desc nulls last, loaded_at desc nulls last, body desc nulls last) as r from annotations where id is not null) where r = 1",
    "recent_edges": "select * from (select *, row_number() over (partition by repo order by ts desc, from_id, to_id, relation nulls last) as rank from (select distinct repo, from_id, to_id, relation, ts from agent_edges where from_id is not null and to_id is not null)) where rank <= 5",
    "resolved_notes": _BASE + "select x.repo, x.id, x.label, coalesce(n.id, l.label_id) as node_id from (select distinct repo, id, label from annotations where id is not null or label is not null) x left join n on n.repo = x.repo and n.id = x.id left join (select repo, lower(label) as low, min(id) as label_id from n where label is not null group by all) l on l.repo = x.repo and l.low = lower(x.label)",
    "node_search": _BASE + "select repo, id, score from (select repo, id, (" + " + ".join([f"case when contains(lower(coalesce(label, '')), '{t}') then 1.0 else 0 end + case when contains(lower(coalesce(source_file, '')), '{t}') then 0.5 else 0 end" for t in ("schema", "merge", "index")]) + ")::double as score from n) where score > 0 order by score desc, id desc, repo desc limit 20",
    "file_status": f"with {_LAST}, h as (select repo, back, v.source_file as source_file, loaded_at from (select repo, snapshot_no, id, max(loaded_at) as loaded_at, arg_max(struct_pack(source_file), loaded_at) as v from graph_nodes where id is not null group by all) join last using (repo, snapshot_no) where v.source_file <> ''), "
    "n as (select repo, source_file, max(modified_at) as new_at from source_files join (select distinct repo, source_file from h where back = 1) using (repo, source_file) group by all), o as (select repo, source_file, max(loaded_at) as old_at from h where back = 2 group by all) "
    "select repo, case when old_at is null then 'new' when new_at is null then 'deleted' when new_at > old_at then 'modified' else 'unchanged' end as status, count(*) as n_files from n full join o using (repo, source_file) group by all",
    "node_staleness": _BASE + "select n.repo, case when modified_at is null then 'ghost' when modified_at > loaded_at then 'stale' else 'fresh' end as state, count(*) as n_nodes from n join (select repo, id, max(loaded_at) as loaded_at from graph_nodes group by all) g on g.repo = n.repo and g.id = n.id left join (select repo, source_file, max(modified_at) as modified_at from source_files group by all) f on f.repo = n.repo and f.source_file = n.source_file where n.source_file <> '' group by all",
    "file_categories": f"select repo, {_CAT.format('source_file')} as category, count(*) as n_files from source_files group by all",
    "node_slugs": _BASE + r"select repo, id, regexp_replace(lower(regexp_replace(concat_ws('_', source_file, label), '[^a-zA-Z0-9]+', '_', 'g')), '^_+|_+$', '', 'g') as slug, substring(regexp_replace(label, '[\x00-\x1f\x7f]', '', 'g'), 1, 256) as clean from n",
    "secret_documents": f"select doc_id, rtrim(names, ',') as secrets, n_chars from (select doc_id, {_NAMES} as names, length({_chain('t', [p for _, p in _SECRET], '[REDACTED]')}) as n_chars from (select doc_id, text as t from documents where text is not null))",
    "disarmed_documents": f"select doc_id, length(t) as before, length({_chain('t', _STEERING, '[stripped]')}) as after from (select doc_id, text as t from documents where text is not null)",
    "paper_documents": "select doc_id, n_signs from (select doc_id, " + " + ".join(f"regexp_matches(text, '{p}')::int" for p in _PAPER) + " as n_signs from documents where text is not null) where n_signs >= 3",
    "corpus_size": "with t as (select file_type, length(text) as n, case when trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(13)) = '' then 0 else len(regexp_split_to_array(trim(text, chr(32) || chr(9) || chr(10) || chr(13)), '[ \\t\\r\\n]+')) end as words from documents) select file_type, count(*) as n_docs, sum(words)::bigint as n_words, (sum(words) * 100 // 75)::bigint as n_tokens, sum(n // 4)::bigint as n_quarter_chars from t group by all",
    "event_windows": "select date_trunc('hour', ts) as window_start, event_type, count(*) as n_events, sum(value::decimal(18,4)) as value from events group by all",
    "user_sessions": "with o as (select user_id, ts, coalesce(ts > lag(ts) over (partition by user_id order by ts) + interval 30 minute, true)::int as opens from events where user_id is not null), g as (select *, sum(opens) over (partition by user_id order by ts rows unbounded preceding) as no from o) select user_id, min(ts) as session_start, count(*) as n_events from g group by user_id, no",
}
