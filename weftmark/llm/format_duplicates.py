"""Records that differ in nothing but formatting, collapsed and counted.

Byte-identical rows are collapsed first, with counts; only the distinct survivors are brought into
canonical form (see :mod:`weftmark.llm.canonical`); these are grouped again on the full
canonical fields, and the counts are summed. All groupings combine before they shuffle, so a group
that holds a third of all rows reaches the reducer as one row per task.

Defined cases: null fields are like empty ones; records whose canonical first field is empty belong
to no group; among equals the smallest id (binary order) is the first; records with a null id are
left out; repeated ids within a repo count as one record; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .canonical import unformatted, unformatted_json
from ..plans.scratch import materialize
from ..plans.skew import join_groups


def raw_groups(records: DataFrame, fields: list[str], repo: str = "repo") -> DataFrame:
    """Byte-identical rows as one row with their smallest id and their number."""
    return records.groupBy(repo, *fields).agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n_rows"))


def canonical_fields(fields: list[str], json_fields: tuple[str, ...] = ()) -> dict[str, F.Column]:
    return {f"c_{c}": unformatted_json(F.col(c)) if c in json_fields else unformatted(F.col(c)) for c in fields}


def canonical_groups(raw: DataFrame, fields: list[str], repo: str = "repo") -> DataFrame:
    """Raw groups summed by their full canonical fields: (repo, c_*, group_id, n_copies, n_rows = raw groups in it)."""
    return raw.where(F.col(f"c_{fields[0]}") != "").groupBy(repo, *[f"c_{c}" for c in fields]).agg(
        F.min("first_id").alias("group_id"), F.sum("n_rows").alias("n_copies"), F.count(F.lit(1)).alias("n_rows"),
    )


def collapsed(records: DataFrame, fields: list[str], json_fields: tuple[str, ...] = (), repo: str = "repo") -> DataFrame:
    """One record per group of equals: (repo, first_id, n_copies); records that stand alone have 1 copy."""
    raw = raw_groups(records.where(F.col("id").isNotNull()), fields, repo).withColumns(canonical_fields(fields, json_fields))
    return canonical_groups(raw, fields, repo).select(repo, F.col("group_id").alias("first_id"), "n_copies")


def copies(records: DataFrame, fields: list[str], json_fields: tuple[str, ...] = (), repo: str = "repo") -> DataFrame:
    """One row for every record but the first of its group: (repo, first_id, copy_id).

    A raw group finds its canonical group, and a record its raw group, by :func:`join_groups`.
    """
    own = materialize(records.where(F.col("id").isNotNull()).select(repo, "id", *fields), "records")
    canonical = [f"c_{c}" for c in fields]
    raw = materialize(raw_groups(own, fields, repo).withColumns(canonical_fields(fields, json_fields)), "raw_groups")
    groups = materialize(canonical_groups(raw, fields, repo).where("n_copies > 1"), "canonical_groups")
    named = materialize(join_groups(raw, groups.select(repo, *canonical, "group_id", F.col("n_rows").alias("size")), [repo, *canonical]).select(repo, *fields, F.col("n_rows").alias("size"), "group_id"), "named_groups")
    return join_groups(own, named, [repo, *fields]).where(F.col("id") != F.col("group_id")).select(repo, F.col("group_id").alias("first_id"), F.col("id").alias("copy_id"))
