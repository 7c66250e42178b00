"""What changed between consecutive full snapshots of the same table.

A bucketed index (key -> fingerprint of the compared fields) of every repo's last snapshot is kept.
All tables are read once, into record rows that lie apart by snapshot number. Each delivery probes the
index with its own keys: keys only in the delivery were added, keys only in the index were removed,
keys whose fingerprints differ were changed. The index is then swapped for one that holds the
delivery. Old values are fetched only for changed keys (:func:`changed_values`).

Defined cases: rows without a key are no records; of several rows of one record in a snapshot the one
with the greatest ``loaded_at`` stands (null is least; among equal times the greatest fingerprint);
null equals null and differs from every value; a repo's first snapshot yields nothing; snapshots
missing from the log are ignored; empty tables yield an empty result; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import BucketedTable, broadcast_if_small, fits_broadcast, materialize
from ..plans.skew import join_groups, sieved

KEYS = ["in_table", "repo", "key_one", "key_two"]
CHANGES = "in_table string, repo string, snapshot_no int, key_one string, key_two string, change_kind string"


@dataclass(frozen=True)
class Snapshotted:
    """A table delivered as full snapshots: its name, the one or two key columns and the compared columns."""

    name: str
    rows: DataFrame
    keys: tuple[str, ...]
    compared: tuple[str, ...]


def fingerprint(columns: list[Column]) -> Column:
    """64 bits over the columns, with a flag for each null so that nulls keep their place."""
    return F.xxhash64(*[x for c in columns for x in (c, c.isNull())])


def delivered(log: DataFrame) -> DataFrame:
    """Each snapshot in the log with the numbers of the repo's preceding and following one."""
    by_repo = Window.partitionBy("repo").orderBy("snapshot_no")
    return (
        log.select("repo", F.col("snapshot_no").cast("int").alias("snapshot_no")).distinct()
        .withColumns({"prev_no": F.lag("snapshot_no").over(by_repo), "next_no": F.lead("snapshot_no").over(by_repo)})
    )


def record_rows(table: Snapshotted) -> DataFrame:
    """Rows that are records, as their keys, snapshot number, load time and fingerprint."""
    one, two = F.col(table.keys[0]), F.col(table.keys[1]) if len(table.keys) > 1 else F.lit("")
    return table.rows.where(one.isNotNull() & two.isNotNull()).select(
        F.lit(table.name).alias("in_table"), F.col("repo"), one.cast("string").alias("key_one"), two.cast("string").alias("key_two"),
        F.col("snapshot_no").cast("int").alias("snapshot_no"), F.struct("loaded_at", fingerprint([F.col(c) for c in table.compared])).alias("row"),
    )


def logged_rows(tables: list[Snapshotted], history: DataFrame) -> DataFrame:
    """The written record rows of all logged snapshots, with the repo's neighbouring numbers, in a folder per snapshot number.

    Every table is read once here, whatever the number of deliveries.
    """
    rows = reduce(DataFrame.unionByName, [record_rows(t) for t in tables])
    if fits_broadcast(history):
        placed = rows.join(F.broadcast(history), ["repo", "snapshot_no"])
    else:
        sizes = rows.groupBy("repo", "snapshot_no").agg(F.count(F.lit(1)).alias("size"))
        placed = join_groups(rows, materialize(history.join(sizes, ["repo", "snapshot_no"]), "sized_history"), ["repo", "snapshot_no"])
    return materialize(placed.select(*KEYS, "row", "prev_no", "next_no", "snapshot_no"), "record_rows", ["snapshot_no"])


def standing(rows: DataFrame) -> DataFrame:
    """The standing row of every record of one snapshot number; repeated rows are combined before the shuffle."""
    last = rows.groupBy(*KEYS).agg(F.max("row").alias("row"), F.max("prev_no").alias("prev_no"), F.max("next_no").alias("new_next"))
    return last.select(*KEYS, F.col("row").getField("col2").alias("new_fp"), "prev_no", "new_next")


def probe(index: DataFrame, new: DataFrame, no: int) -> DataFrame:
    """The next index with each key's change: both sides are spread by key, so only ``new`` was shuffled.

    A key stays in the index only while a later snapshot of its repo is to be compared with it.
    """
    old = index.where("next_no is not null").select(*KEYS, F.col("fp").alias("old_fp"), F.col("next_no").alias("old_next"))
    due = F.col("old_fp").isNotNull() & (F.col("old_next") == no)
    kind = (
        F.when(F.col("new_fp").isNull() & due, "removed")
        .when(F.col("new_fp").isNotNull() & F.col("prev_no").isNotNull() & F.coalesce(~due, F.lit(True)), "added")
        .when(due & (F.col("new_fp") != F.col("old_fp")), "changed")
    )
    following = F.when(F.col("new_fp").isNotNull(), F.col("new_next")).when(F.col("old_next") > no, F.col("old_next"))
    both = old.join(new, KEYS, "full_outer")
    step = both.select(*KEYS, F.coalesce("new_fp", "old_fp").alias("fp"), following.alias("next_no"), kind.alias("change_kind"), F.lit(no).alias("snapshot_no"))
    return step.where("next_no is not null or change_kind is not null")


def snapshot_changes(tables: list[Snapshotted], log: DataFrame, buckets: int | None = None) -> DataFrame:
    """One row for each record added, removed or changed by a snapshot after the repo's first.

    The loop runs over snapshot numbers, which are as many as deliveries of one repo; each turn
    shuffles the delivery once by key and joins it with the index, bucketed by the same key. Only
    repos with a delivery to come are in the index.
    """
    spark = log.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    history = materialize(delivered(log), "deliveries")
    numbers = [r[0] for r in history.select("snapshot_no").distinct().orderBy("snapshot_no").collect()]
    if len(numbers) < 2:
        return spark.createDataFrame([], CHANGES)
    rows = logged_rows(tables, history)
    steps: list[BucketedTable] = []
    try:
        for no in numbers:
            new = standing(rows.where(F.col("snapshot_no") == no))
            step = probe(steps[-1].read(), new, no) if steps else _first(new, no)
            steps.append(BucketedTable.write(step, "snapshot_index", KEYS, buckets))
    finally:
        for step in steps:
            step.forget()
    found = spark.read.schema("in_table string, repo string, key_one string, key_two string, change_kind string, snapshot_no int").parquet(*[s.path for s in steps])
    return found.where("change_kind is not null").select("in_table", "repo", "snapshot_no", "key_one", "key_two", "change_kind")


def _first(new: DataFrame, no: int) -> DataFrame:
    """The index after the first snapshot number: no repo has an earlier one."""
    return new.where("new_next is not null").select(*KEYS, F.col("new_fp").alias("fp"), F.col("new_next").alias("next_no"), F.lit(None).cast("string").alias("change_kind"), F.lit(no).alias("snapshot_no"))


def changed_values(changes: DataFrame, table: Snapshotted, log: DataFrame) -> DataFrame:
    """Old and new compared fields of the records of ``table`` that changed, as structs.

    Rows of other keys than the changed ones, and of other snapshots than the two concerned, are sifted
    out before anything is shuffled (:func:`weftmark.plans.skew.sieved`); the standing row is chosen as
    in :func:`snapshot_changes`.
    """
    own = changes.where((F.col("in_table") == table.name) & (F.col("change_kind") == "changed"))
    own = own.join(broadcast_if_small(delivered(log).select("repo", "snapshot_no", "prev_no")), ["repo", "snapshot_no"])
    one, two = F.col(table.keys[0]), F.col(table.keys[1]) if len(table.keys) > 1 else F.lit("")
    values = F.struct(*table.compared)
    rows = table.rows.where(one.isNotNull() & two.isNotNull()).select(
        "repo", one.cast("string").alias("key_one"), two.cast("string").alias("key_two"), F.col("snapshot_no").cast("int").alias("at_no"),
        F.struct("loaded_at", fingerprint([F.col(c) for c in table.compared]), values).alias("row"),
    )
    at = ["repo", "key_one", "key_two", "at_no"]
    wanted = materialize(own.select("repo", "key_one", "key_two", "snapshot_no", F.explode(F.array("prev_no", "snapshot_no")).alias("at_no")), "wanted")
    held = sieved(rows, wanted, at).groupBy(*at).agg(F.max("row").getField("col3").alias("held")).join(wanted, at)
    return held.groupBy("repo", "key_one", "key_two", "snapshot_no").agg(
        F.max(F.when(F.col("at_no") < F.col("snapshot_no"), F.col("held"))).alias("old_values"),
        F.max(F.when(F.col("at_no") == F.col("snapshot_no"), F.col("held"))).alias("new_values"),
    )
