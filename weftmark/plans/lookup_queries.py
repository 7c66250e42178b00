"""Queries that look things up in each repo's newest graph, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as T
from ..operators import batches, extract_code, federation, graph, history, lookups, snapshot_diff, traversal
from ..sources import files
from ..sources.tables import load
from . import problems
from .graph_queries import _BASE, newest_graph, top_hub
from .scratch import broadcast_if_small, materialize

#: What is looked up where a caller would name something.
TERM, SPAN = "schema", ("2026-02-01", "2026-04-01")


def _loaded_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The newest snapshot's standing nodes with the time they were loaded."""
    fields = ["label", "file_type", "source_file", "source_location", "community"]
    newest = load(spark, d, "snapshot_log").groupBy("repo").agg(F.max("snapshot_no").alias("snapshot_no"))
    return history.standing_nodes(load(spark, d, "graph_nodes").join(broadcast_if_small(newest), ["repo", "snapshot_no"]), fields, ["loaded_at"]).drop("snapshot_no")


def node_cards(spark: SparkSession, d: str) -> DataFrame:
    """What is known of the first node of each repo that a word finds."""
    g = graph.Graph(_loaded_nodes(spark, d), load(spark, d, "graph_links"))
    return lookups.node_card(g, load(spark, d, "source_files"), TERM)


def node_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The neighbours of the first node of each repo that a word finds, by relation."""
    g = newest_graph(spark, d)
    return lookups.neighbours(g, lookups.first_match(g.nodes, TERM))


def dated_annotations(spark: SparkSession, d: str) -> DataFrame:
    """Notes by known peers within two months."""
    rows = load(spark, d, "annotations").where("peer_id is not null")
    return lookups.filtered(rows, "recorded_at", time_from=SPAN[0], time_to=SPAN[1]).select("repo", "id", "peer_id", "relation", "recorded_at").distinct()


def hub_agent_edges(spark: SparkSession, d: str) -> DataFrame:
    """Agent edges at the first hub of each repo."""
    return lookups.at_nodes(load(spark, d, "agent_edges"), top_hub(newest_graph(spark, d)))


def hub_texts(spark: SparkSession, d: str) -> DataFrame:
    """The first hub of each repo and what lies within two links of it, as text of 300 tokens, in three layers."""
    g = newest_graph(spark, d)
    members = materialize(traversal.neighbourhood(g, top_hub(g), 2).select("repo", "id"), "members")
    each = [lookups.graph_text(g, members, 300, layer).withColumn("layer", F.lit(layer)) for layer in (1, 2, 3)]
    return each[0].unionByName(each[1]).unionByName(each[2])


def hub_estimates(spark: SparkSession, d: str) -> DataFrame:
    """How much two links around the first hub of each repo are expected to hold, and its tokens by layer."""
    g = newest_graph(spark, d)
    return lookups.estimates(g, top_hub(g))


def hub_targets(spark: SparkSession, d: str) -> DataFrame:
    """Where searches from the first hub of each repo end if nobody says."""
    g = newest_graph(spark, d)
    return lookups.targets(g, top_hub(g))


def label_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The words of labels with the number of nodes that bear them, per repo."""
    return lookups.label_tokens(newest_graph(spark, d).nodes).groupBy("repo", "token").agg(F.count(F.lit(1)).alias("n_nodes"), F.min("id").alias("first_id"))


def cited_notes(spark: SparkSession, d: str) -> DataFrame:
    """How many sentences of each note stay if those go that name other nodes than the note's own."""
    found = lookups.cited_sentences(load(spark, d, "annotations"), newest_graph(spark, d).nodes)
    return found.groupBy("repo", "id", "body").agg(F.count(F.when(F.col("kept"), 1)).alias("n_kept"), F.count(F.when(~F.col("kept"), 1)).alias("n_dropped"))


def capped_documents(spark: SparkSession, d: str) -> DataFrame:
    """How long each document is, whole and cut to 100 tokens at the end of a sentence."""
    docs = load(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.length("text").alias("n_chars"), F.size(T.sentences(F.col("text"))).alias("n_sentences"), F.length(T.capped(F.col("text"), 100)).alias("n_capped"))


def node_names(spark: SparkSession, d: str) -> DataFrame:
    """Tag, file name, link and front matter value of each label."""
    label = F.coalesce("label", F.lit(""))
    return newest_graph(spark, d).nodes.select("repo", "id", N.tag(label).alias("tag"), N.file_name(label).alias("file_name"), N.wikilink(label).alias("link"), N.front_matter_value(label).alias("value"))


def corpus_digests(spark: SparkSession, d: str) -> DataFrame:
    """Files of each repo, and a number that changes with any file's path or content but not with their order."""
    own = load(spark, d, "source_files").groupBy("repo", "source_file").agg(F.max(F.coalesce("file_text", F.lit(""))).alias("file_text"))
    bits = F.conv(F.substring(N.content_digest(F.col("source_file"), F.col("file_text")), 1, 8), 16, 10).cast("bigint")
    return own.groupBy("repo").agg(F.count(F.lit(1)).alias("n_files"), F.sum(bits).alias("digest"))


def note_intents(spark: SparkSession, d: str) -> DataFrame:
    """What the notes ask for, counted per repo."""
    return load(spark, d, "annotations").where("body is not null").groupBy("repo", N.intent(F.col("body")).alias("intent")).agg(F.count(F.lit(1)).alias("n_notes"))


def community_members(spark: SparkSession, d: str) -> DataFrame:
    """The members of each repo's largest community, by degree."""
    g = newest_graph(spark, d)
    sizes = g.nodes.where("community is not null").groupBy("repo", "community").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("repo").agg(F.max(F.struct("n", (-F.col("community")).alias("c"))).alias("m")).select("repo", (-F.col("m.c")).alias("community"))
    return graph.described(g).join(largest, ["repo", "community"]).select("repo", "community", "id", "label", "degree")


def extracted_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return lookups.extracted_neighbours(newest_graph(spark, d))


def change_summary(spark: SparkSession, d: str) -> DataFrame:
    """How much each snapshot of a repo added, removed and changed, per table."""
    changes = snapshot_diff.snapshot_changes(problems.snapshotted(spark, d), load(spark, d, "snapshot_log"))
    of = lambda kind: F.count(F.when(F.col("change_kind") == kind, 1)).alias(f"n_{kind}")
    return changes.groupBy("in_table", "repo", "snapshot_no").agg(of("added"), of("removed"), of("changed"))


def ignored_files(spark: SparkSession, d: str) -> DataFrame:
    """Files that patterns of names exclude, counted per repo and top folder."""
    rows = load(spark, d, "source_files").where("source_file is not null").select("repo", "source_file").distinct()
    gone = rows.where(files.ignored(F.col("source_file"), ["third_party*", "*.min.js", "vendor/", "/build", "src/gen/*", "?ib"]))
    return gone.groupBy("repo", F.split_part("source_file", F.lit("/"), F.lit(1)).alias("top")).agg(F.count(F.lit(1)).alias("n_files"))


def file_batches(spark: SparkSession, d: str) -> DataFrame:
    """The files of each top folder of a repo in batches of 2,000 tokens, four characters each."""
    return batches.file_batches(load(spark, d, "source_files"), F.floor(F.length("file_text") / 4), 2000)


def resolved_imports(spark: SparkSession, d: str) -> DataFrame:
    """Names that Python files import from other files of their repo, and whether they are declared there."""
    return extract_code.resolved_imports(load(spark, d, "source_files").where("file_type = 'code'").select("repo", "source_file", "file_text").distinct())


def federated_concepts(spark: SparkSession, d: str) -> DataFrame:
    """Concept nodes of several repos with one label, against the first of them."""
    return federation.shared_with_representative(newest_graph(spark, d))


def like_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Every vector against the first of its label."""
    return federation.like_vectors(load(spark, d, "embeddings"), "label", "vec_id", "embedding")


def document_bodies(spark: SparkSession, d: str) -> DataFrame:
    """How long each document is without its front matter, and how many fields that has."""
    docs = load(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.length(T.body(F.col("text"))).alias("n_chars"), T.front_matter_fields(F.col("text")).alias("n_fields"))


def merged_fields(spark: SparkSession, d: str) -> DataFrame:
    """Every node of a repo once, each field from the latest load that has it, with the number of snapshots that hold it."""
    return history.merged_fields(load(spark, d, "graph_nodes"), ["label", "file_type", "source_file"])


QUERIES = {q.__name__: q for q in (node_cards, node_neighbours, dated_annotations, hub_agent_edges, hub_texts, hub_estimates, hub_targets, label_tokens, cited_notes, capped_documents, node_names, corpus_digests, note_intents, community_members, extracted_neighbours, change_summary, ignored_files, file_batches, resolved_imports, federated_concepts, like_vectors, document_bodies, merged_fields)}

_MATCH = "hit as (select * from (select *, row_number() over (partition by repo order by id) as r from n where coalesce(contains(lower(label), 'schema'), false) or lower(id) = 'schema') where r = 1)"
_NEAR = ", e0 as (select repo, id from hub1), e1 as (select repo, id from e0 union select i.repo, i.other from inc i join e0 on e0.repo = i.repo and e0.id = i.id), e2 as (select repo, id from e1 union select i.repo, i.other from inc i join e1 on e1.repo = i.repo and e1.id = i.id), em as (select k.* from k join e2 using (repo, id))"
_CLEAN = r"substring(regexp_replace(coalesce({0}label, {0}id), '[\x00-\x1f\x7f]', '', 'g'), 1, 256)"
_EDGES = (
    "el as (select w.repo, w.source, w.target, min(struct_pack(relation := coalesce(relation, ''), confidence := coalesce(confidence, ''))) as l from w where exists (select 1 from n where n.repo = w.repo and n.id = w.source) and exists (select 1 from n where n.repo = w.repo and n.id = w.target) group by all), "
    "ed as (select el.repo, 1 as part, 0 as weight, el.source || chr(1) || el.target as key, 'EDGE ' || " + _CLEAN.format("a.") + " || ' --' || l.relation || ' [' || l.confidence || ']--> ' || " + _CLEAN.format("b.") + " as line from el join em a on a.repo = el.repo and a.id = el.source join em b on b.repo = el.repo and b.id = el.target)"
)
_LINES = {
    1: "select repo, 0 as part, degree as weight, id as key, 'NODE ' || id || ' label=' || " + _CLEAN.format("") + " || ' community=' || coalesce(community::varchar, '') as line from em",
    3: "select repo, 0 as part, degree as weight, id as key, 'NODE ' || " + _CLEAN.format("") + " || ' [src=' || coalesce(source_file, '') || ' loc=' || coalesce(source_location, '') || ' community=' || coalesce(community::varchar, '') || ']' as line from em",
}
_TEXT = "select repo, case when length(t) > 900 then substring(t, 1, 900) || chr(10) || '... (truncated to ~300 token budget)' else t end as text, length(t) > 900 as cut, {0}::int as layer from (select repo, string_agg(line, chr(10) order by part, weight desc, key) as t from ({1}) group by repo)"
_SENT = r"list_filter(list_transform(string_split(regexp_replace({}, '([.!?])\s+', '\1' || chr(2), 'g'), chr(2)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"

SQL = {
    "node_cards": _BASE + f", {_MATCH}, ld as (select repo, id, max(loaded_at) as loaded_at from graph_nodes join newest using (repo, snapshot_no) where id is not null group by all), f as (select repo, source_file, max(modified_at) as modified_at from source_files group by all) "
    "select hit.repo, hit.id, label, hit.source_file, file_type, community, coalesce(degree, 0) as degree, case when modified_at is null then 'ghost' when modified_at > loaded_at then 'stale' else 'fresh' end as state from hit left join deg on deg.repo = hit.repo and deg.id = hit.id join ld on ld.repo = hit.repo and ld.id = hit.id left join f on f.repo = hit.repo and f.source_file = hit.source_file",
    "node_neighbours": _BASE + f", {_MATCH}, x as (select repo, source as id, target as other, relation from w union all select repo, target, source, relation from w) select x.repo, x.id, x.other, n.label, x.relation, count(*) as n_links from x join hit on hit.repo = x.repo and hit.id = x.id join n on n.repo = x.repo and n.id = x.other group by all",
    "dated_annotations": "select distinct repo, id, peer_id, relation, recorded_at from annotations where peer_id is not null and recorded_at >= '2026-02-01' and recorded_at <= '2026-04-01'",
    "hub_agent_edges": _BASE + "select distinct a.repo, snapshot_no, from_id, to_id, relation, ts from agent_edges a join hub1 on hub1.repo = a.repo and (hub1.id = from_id or hub1.id = to_id)",
    "hub_texts": _BASE + _NEAR + ", " + _EDGES + " " + " union all ".join([_TEXT.format(1, _LINES[1]), _TEXT.format(2, _LINES[1] + " union all select * from ed"), _TEXT.format(3, _LINES[3] + " union all select * from ed")]),
    "hub_estimates": _BASE + ", z as (select n.repo, count(*) as nn, coalesce(max(l.nl), 0) as nl from n join hub1 on hub1.repo = n.repo left join (select repo, count(*) as nl from u group by repo) l on l.repo = n.repo group by n.repo), y as (select *, 2 * nl / nn as bf from z), x as (select *, least(floor(1.0::double * bf * bf)::bigint, nn) as n_nodes from y), v as (select *, least(floor(n_nodes * bf / 2)::bigint, nl) as n_links from x) "
    "select repo, n_nodes, n_links, 50 * n_nodes as tokens_1, 200 * n_nodes + 30 * n_links as tokens_2, 100 * n_nodes + 95 * n_links as tokens_3 from v",
    "hub_targets": _BASE + ", s as (select repo, greatest(3, least(20, floor(log2(count(*)))))::int as kk from n group by repo) select repo, rank, id, degree from (select k.repo, k.id, k.degree, row_number() over (partition by k.repo order by k.degree desc, k.id) as rank from k where not exists (select 1 from hub1 where hub1.repo = k.repo and hub1.id = k.id)) join s using (repo) where rank <= kk and repo in (select repo from hub1)",
    "label_tokens": _BASE + "select repo, token, count(*) as n_nodes, min(id) as first_id from (select repo, id, unnest(list_distinct(regexp_extract_all(lower(label), '[a-z0-9_]+'))) as token from n) where length(token) > 2 group by all",
    "cited_notes": _BASE + f", ix as (select distinct repo, id, token from (select repo, id, unnest(list_distinct(regexp_extract_all(lower(label), '[a-z0-9_]+'))) as token from n) where length(token) > 2), it as (select distinct repo, token from ix), "
    f"nt as (select *, row_number() over () as note from (select distinct repo, id, body from annotations where body is not null)), st as (select repo, id, note, unnest({_SENT.format('body')}) as sentence from nt), "
    "wd as (select distinct repo, id, sentence, unnest(regexp_extract_all(lower(sentence), '[a-z0-9_]+')) as token from st), "
    "bad as (select distinct wd.repo, wd.id, sentence from wd join it on it.repo = wd.repo and it.token = wd.token where not exists (select 1 from ix where ix.repo = wd.repo and ix.token = wd.token and ix.id = wd.id)) "
    "select nt.repo, nt.id, nt.body, count(*) filter (bad.sentence is null) as n_kept, count(bad.sentence) as n_dropped from st join nt on nt.note = st.note left join bad on bad.repo = st.repo and bad.id is not distinct from st.id and bad.sentence = st.sentence group by nt.repo, nt.id, nt.body",
    "capped_documents": f"select doc_id, length(text) as n_chars, len(l)::int as n_sentences, (case when length(text) <= 400 then length(text) when n = 0 then length(regexp_replace(regexp_replace(substring(coalesce(l[1], text), 1, 400), '(?s) [^ ]*$', ''), '[.!?,; ]+$', '') || '…') "
    f"when n < len(l) then length(regexp_replace(array_to_string(l[1:n], ' '), '[.!?]+$', '') || '…') else length(array_to_string(l, ' ')) end)::int as n_capped from (select *, len(list_filter(list_transform(range(1, len(l) + 1), lambda i: list_sum(list_transform(l[1:i], lambda x: length(x) + 1))), lambda c: c <= 400)) as n from (select doc_id, text, {_SENT.format('text')} as l from documents where text is not null))",
    "node_names": _BASE + r", x as (select repo, id, coalesce(label, '') as l from n), y as (select *, regexp_replace(regexp_replace(lower(l), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as h, regexp_replace(regexp_replace(l, '[\\/*?:\x22<>|#^\[\]\x00-\x1f\x7f\x{85}\x{2028}\x{2029}]', '', 'g'), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') as f, regexp_replace(regexp_replace(l, '[\n\r]', ' ', 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{85}\x{2028}\x{2029}]', '', 'g') as v from x), "
    r"z as (select *, case when f = '' then 'unnamed' when length(f) > 200 then substring(f, 1, 191) || '_' || substring(sha256(f), 1, 8) else f end as fn from y) select repo, id, case when h = '' then 'community' when regexp_matches(h, '^[0-9]') then 'x' || h else h end as tag, fn as file_name, "
    r"'[[' || fn || '|' || regexp_replace(replace(replace(l, ']]', '] ]'), '|', '-'), '[\x00-\x1f\x7f]', ' ', 'g') || ']]' as link, "
    r"case when regexp_matches(v, '[:#\[\]{},]') or regexp_matches(v, '^[-?!&*|>%@`]') or lower(v) in ('yes', 'no', 'true', 'false', 'null', 'on', 'off', '~') or regexp_matches(v, '^([-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?|0x[0-9a-fA-F]+|0o[0-7]+|\.\w+)$') then chr(34) || replace(v, chr(34), chr(92) || chr(34)) || chr(34) else v end as value from z",
    "corpus_digests": "select repo, count(*) as n_files, sum(('0x' || substring(sha256(file_text || chr(0) || coalesce(source_file, '')), 1, 8))::bigint)::bigint as digest from (select repo, source_file, max(coalesce(file_text, '')) as file_text from source_files group by all) group by repo",
    "note_intents": r"select repo, case when regexp_matches(body, '(?i)\b(what''?s in|overview of|summarize)\b') then 'summarize' when regexp_matches(body, '(?i)\b(connects?|relates?|between|path|from\s+.+\s+to)\b') then 'connect' else 'explore' end as intent, count(*) as n_notes from annotations where body is not null group by all",
    "community_members": _BASE + ", z as (select repo, community, row_number() over (partition by repo order by count(*) desc, community) as r from c group by repo, community) select k.repo, k.community, k.id, k.label, k.degree from k join z on z.repo = k.repo and z.community = k.community and r = 1",
    "extracted_neighbours": _BASE + ", x as (select distinct repo, least(source, target) as lo, greatest(source, target) as hi from w where confidence = 'EXTRACTED'), y as (select repo, id, count(*) as n from (select repo, lo as id from x union all select repo, hi from x) group by all) select deg.repo, deg.id, degree, coalesce(n, 0) as n_extracted from deg left join y using (repo, id)",
    "change_summary": "select in_table, repo, snapshot_no, count(*) filter (change_kind = 'added') as n_added, count(*) filter (change_kind = 'removed') as n_removed, count(*) filter (change_kind = 'changed') as n_changed from (" + problems.SQL["p1_found"] + ") group by all",
    "ignored_files": r"select repo, split_part(source_file, '/', 1) as top, count(*) as n_files from (select distinct repo, source_file from source_files where source_file is not null) where regexp_matches(source_file, '(^|/)(third_party[^/]*|[^/]*\.min\.js|vendor|build|[^/]ib)(/|$)') or regexp_matches(source_file, '^(third_party.*|.*\.min\.js|src/gen/.*)$') group by all",
    "file_batches": "with f as (select repo, source_file, max(coalesce(length(file_text) // 4, 0)) as n_tokens from source_files where source_file is not null group by all), t as (select *, case when contains(source_file, '/') then split_part(source_file, '/', 1) else '' end as top from f) "
    "select repo, top, source_file, n_tokens, (coalesce(sum(n_tokens) over (partition by repo, top order by source_file rows between unbounded preceding and 1 preceding), 0) // 2000)::bigint as batch_no from t",
    "resolved_imports": r"with f as (select distinct repo, source_file, file_text from source_files where file_type = 'code' and source_file ilike '%.py' and file_text is not null), l as (select repo, source_file, unnest(regexp_split_to_array(file_text, '\r\n|\n|\r')) as line from f), "
    r"i as (select repo, source_file, regexp_extract(line, '^\s*from\s+\.*([\w.]+)\s+import\s+\(?([^#)]+)', 1) as m, regexp_extract(line, '^\s*from\s+\.*([\w.]+)\s+import\s+\(?([^#)]+)', 2) as n from l), "
    r"k as (select distinct repo, source_file, list_last(string_split(m, '.')) as stem, regexp_extract(name, '^\s*(\w+)', 1) as name from (select repo, source_file, m, unnest(string_split(n, ',')) as name from i where m <> '')), "
    r"t as (select distinct repo, source_file as target_file, regexp_extract(source_file, '([^/]*?)(\.[^./]*)?$', 1) as stem from f), "
    r"s as (select distinct repo, source_file as target_file, coalesce(nullif(regexp_extract(line, '^\s*class\s+(\w+)', 1), ''), regexp_extract(line, '^\s*(?:async\s+)?def\s+(\w+)', 1)) as name from l) "
    "select k.repo, k.source_file, k.name, t.target_file, s.name is not null as defined from k join t on t.repo = k.repo and t.stem = k.stem and t.target_file <> k.source_file left join s on s.repo = k.repo and s.target_file = t.target_file and s.name = k.name where k.name <> ''",
    "federated_concepts": _BASE + """, nm as (select lower(label) as name, repo, id from n where file_type in ('document', 'paper', 'rationale', 'image') and label <> ''), gr as (select name, min((repo, id)) as f, max(repo) as lr from nm group by name),
mb as (select nm.repo, nm.id, f[1] as fr, f[2] as fi from nm join gr using (name) where f[1] <> lr and nm.repo <> f[1]),
tr as (select distinct i.repo, i.id, 'label' as kind, lower(o.label) as trait from inc i join n o on o.repo = i.repo and o.id = i.other where i.id <> i.other and o.label <> '' union select repo, id, 'file', regexp_extract(source_file, '[^/\\\\]*$') from n where source_file <> '' union select repo, unnest([source, target]), 'file', regexp_extract(source_file, '[^/\\\\]*$') from w where source_file <> ''),
sz as (select repo, id, count(*) as c from tr where kind = 'label' group by all),
cm as (select mb.repo, mb.id, count(*) filter (a.kind = 'label') as ns, count(*) filter (a.kind = 'file') as nf from mb join tr a on a.repo = mb.repo and a.id = mb.id join tr b on b.repo = fr and b.id = fi and b.kind = a.kind and b.trait = a.trait group by all),
x as (select mb.*, coalesce(ns, 0) as ns, coalesce(nf, 0) as nf, coalesce(p.c, 0) + coalesce(q.c, 0) - coalesce(ns, 0) as u from mb left join cm on cm.repo = mb.repo and cm.id = mb.id left join sz p on p.repo = mb.repo and p.id = mb.id left join sz q on q.repo = fr and q.id = fi)
select repo, id, fr || '::' || fi as merged_id, round(coalesce(ns / nullif(u, 0), 0), 6) as likeness, nf as n_files, coalesce(ns / nullif(u, 0), 0) >= 0.5 and nf >= 1 as joined from x""",
    "like_vectors": "with f as (select label, min(vec_id) as first from embeddings where len(embedding) > 0 group by label), h as (select f.label, first, embedding::double[] as head from f join embeddings e on e.vec_id = f.first and e.label = f.label) "
    "select vec_id, first, round(list_cosine_similarity(embedding::double[], head), 3) + 0.0::double as cosine, coalesce(round(list_cosine_similarity(embedding::double[], head), 3) >= 0.85, false) as same from embeddings join h using (label)",
    "document_bodies": r"select doc_id, length(regexp_replace(text, '^---\n(?s:.*?)\n---[ \t]*\n?', ''))::int as n_chars, (case when regexp_matches(text, '^---\n(?s:.*?)\n---[ \t]*(\n|$)') then len(regexp_extract_all(regexp_extract(text, '^---\n((?s:.*?))\n---', 1), '(?m)^[A-Za-z_][A-Za-z0-9_-]*:')) else 0 end)::int as n_fields from documents where text is not null",
    "merged_fields": "select repo, id, arg_max(label, loaded_at) filter (label is not null) as label, arg_max(file_type, loaded_at) filter (file_type is not null) as file_type, arg_max(source_file, loaded_at) filter (source_file is not null) as source_file, count(distinct snapshot_no) as n_snapshots from graph_nodes where id is not null group by repo, id",
}
