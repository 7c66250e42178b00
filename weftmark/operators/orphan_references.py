"""References to records that do not exist, and what hangs on them.

Direct orphans are references without a parent record. The cascade then treats every record with an
orphaned parent as indirectly orphaned: each round semi-joins the references with the keys that the
round before found, down the foreign-key graph, until a round finds nothing new (a fixpoint, also
where foreign keys form a cycle).

The keys that are referred to are counted once for each parent, with the parent's own keys in the same
aggregate; so a key that a third of all rows refer to is one row there, and its rows are found by a
broadcast instead of a shuffle (:func:`weftmark.plans.skew.join_groups`).

Defined cases: a null in any key column is no reference; repeated rows count once; a record reached
on several ways is reported at its first level, direct before inherited; empty tables (no parents:
every reference is an orphan); extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import broadcast_if_small, materialize
from ..plans.skew import join_small_or_groups


@dataclass(frozen=True)
class ForeignKey:
    """``child[fields]`` names rows of ``parent`` by ``parent_keys``; ``record`` identifies the child's record.

    ``parent_keys`` may be any columns of the parent. A key that is not ``checked`` reports no direct
    orphans of its own and only passes its parent's state on.
    """

    child: str
    fields: tuple[str, ...]
    parent: str
    parent_keys: tuple[str, ...]
    record: tuple[str, ...]
    checked: bool = True

    @property
    def target(self) -> tuple[str, tuple[str, ...]]:
        return self.parent, self.parent_keys


def _texts(columns: tuple[str, ...]) -> Column:
    return F.array(*[F.col(c).cast("string") for c in columns])


def _with_keys(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Rows whose ``columns`` are all there, with their text as k0, k1, ..."""
    for c in columns:
        rows = rows.where(F.col(c).isNotNull())
    return rows.withColumns({f"k{i}": F.col(c).cast("string") for i, c in enumerate(columns)})


def _key_names(columns: tuple[str, ...]) -> list[str]:
    return [f"k{i}" for i in range(len(columns))]


def referred_keys(tables: dict[str, DataFrame], keys: list[ForeignKey]) -> DataFrame:
    """Keys that ``keys``, all with one target, refer to: (k0, ..., held, n_0, ...), n_i the rows that refer by the i-th key.

    Parent rows and references meet in one aggregate, which combines before its shuffle.
    """
    names = _key_names(keys[0].parent_keys)
    sides = [_with_keys(tables[keys[0].parent], keys[0].parent_keys).select(*names, F.lit(-1).alias("by"))]
    sides += [_with_keys(tables[k.child], k.fields).select(*names, F.lit(i).alias("by")) for i, k in enumerate(keys)]
    counts = [F.count(F.when(F.col("by") == i, 1)).alias(f"n_{i}") for i in range(len(keys))]
    return reduce(DataFrame.unionByName, sides).groupBy(*names).agg(F.max(F.col("by") == -1).alias("held"), *counts).where(F.greatest(F.lit(0), *[F.col(f"n_{i}") for i in range(len(keys))]) > 0)


def orphan_cascade(tables: dict[str, DataFrame], keys: list[ForeignKey]) -> DataFrame:
    """Orphaned records: (in_table, in_field, record array, ref array, level); level 0 is direct, above that inherited.

    ``in_field`` is the last column of the reference. Each round is written to the shared folder, so
    plans stay short; rounds are as many as the longest chain of orphans. Tables are read in every
    round that concerns them, so they should be plain scans or written tables.
    """
    by_target = {t: [k for k in keys if k.target == t] for t in dict.fromkeys(k.target for k in keys)}
    referred = {t: materialize(referred_keys(tables, own), "referred") for t, own in by_target.items()}
    asked = {k: list(dict.fromkeys(o.parent_keys for o in keys if o.parent == k.child)) for k in keys}

    def orphaned(fk: ForeignKey, lost: DataFrame, level: int) -> DataFrame:
        """Records that refer by ``fk`` to keys of ``lost``, with the columns by which others refer to them in turn."""
        names = _key_names(fk.fields)
        lost = materialize(lost.select(*names, F.col(f"n_{by_target[fk.target].index(fk)}").alias("size")).where("size > 0"), "lost")
        given = [_texts(fk.record).alias("record"), _texts(fk.fields).alias("ref"), *[_texts(p).alias(f"as_{i}") for i, p in enumerate(asked[fk])]]
        rows = _with_keys(tables[fk.child], fk.fields).select(*names, *given)
        return join_small_or_groups(rows, lost, names).drop(*names).distinct().withColumn("level", F.lit(level))

    last = {k: materialize(orphaned(k, referred[k.target].where("not held"), 0), "orphans") for k in keys if k.checked}
    found: dict[ForeignKey, list[DataFrame]] = {k: [last[k]] if k in last else [] for k in keys}
    level = 0
    while last:
        level += 1
        new: dict[ForeignKey, DataFrame] = {}
        for k in keys:
            above = [last[o].select(F.col(f"as_{asked[o].index(k.parent_keys)}").alias("as")) for o in last if o.child == k.parent]
            if not above:
                continue
            names = _key_names(k.fields)
            gone = reduce(DataFrame.unionByName, above).select(*[F.col("as")[i].alias(n) for i, n in enumerate(names)]).distinct()
            rows = orphaned(k, referred[k.target].join(broadcast_if_small(gone), names, "left_semi"), level)
            seen = [df.select("record") for o in keys if o.child == k.child for df in found[o]]
            if seen:
                rows = rows.join(reduce(DataFrame.unionByName, seen), "record", "left_anti")
            rows = materialize(rows, "orphans")
            if not rows.isEmpty():
                new[k] = rows
        for k, rows in new.items():
            found[k].append(rows)
        last = new
    flat = [df.select(F.lit(k.child).alias("in_table"), F.lit(k.fields[-1]).alias("in_field"), "record", "ref", "level") for k in keys for df in found[k]]
    return reduce(DataFrame.unionByName, flat)


def orphan_kinds(orphans: DataFrame, parents: DataFrame, parent_key: str = "id", scope: str = "repo", version: str = "snapshot_no") -> DataFrame:
    """``orphans`` (with ``ref_id``, scope and version), absent in their version, with ``orphan_kind`` by the versions that hold the parent.

    deleted where the parent was in an earlier version, later where only in a later one, missing where
    in none of the scope. Only versions of the orphans' own keys are looked up.
    """
    asked = orphans.select(scope, F.col("ref_id").alias(parent_key)).distinct()
    held = parents.join(broadcast_if_small(asked), [scope, parent_key], "left_semi")
    first = held.groupBy(scope, F.col(parent_key).alias("ref_id")).agg(F.min(F.col(version).cast("int")).alias("first_in"))
    kind = F.when(F.col("first_in").isNull(), "missing").when(F.col("first_in") < F.col(version), "deleted").otherwise("later")
    return orphans.join(broadcast_if_small(first), [scope, "ref_id"], "left").withColumn("orphan_kind", kind).drop("first_in")
