"""Running totals over groups of any size, and files cut into batches by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import broadcast_if_small, materialize


def running_total(rows: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """``rows`` with ``before``: the sum of ``value`` over the rows of the same group that stand before.

    Rows are range-partitioned by group and order, so a group of any size spreads over partitions; each
    partition adds up its own rows, and the sums of a group's earlier partitions, one row each, are added.
    Null values count as 0. Rows that are equal by ``order`` follow each other in some order.
    """
    spread = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    placed = materialize(spread.withColumns({"part": F.spark_partition_id(), "row_no": F.monotonically_increasing_id()}), "placed")
    number = F.coalesce(F.col(value), F.lit(0))
    earlier = lambda keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy(*group, "part").agg(F.sum(number).alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(earlier(group, "part")), F.lit(0))).drop("n")
    within = placed.withColumn("within", F.coalesce(F.sum(number).over(earlier([*group, "part"], "row_no")), F.lit(0)))
    on = [within[k].eqNullSafe(F.col(f"p.{k}")) for k in [*group, "part"]]
    joined = within.join(broadcast_if_small(parts).alias("p"), on)
    return joined.select(*[within[c] for c in rows.columns], (within["within"] + F.col("p.offset")).alias("before"))


def file_batches(files: DataFrame, tokens: Column, budget: int) -> DataFrame:
    """(repo, top, source_file, n_tokens, batch_no): the files of each top folder, in order of their paths, in batches of about ``budget`` tokens.

    A file belongs to the batch in which it begins, so a batch goes beyond the budget by less than its last
    file. Files at the root have the top folder ''.
    """
    top = F.when(F.col("source_file").contains("/"), F.split_part("source_file", F.lit("/"), F.lit(1))).otherwise("")
    sized = files.where("source_file is not null").groupBy("repo", "source_file").agg(F.max(F.coalesce(tokens, F.lit(0))).cast("bigint").alias("n_tokens"))
    totals = running_total(sized.select("repo", top.alias("top"), "source_file", "n_tokens"), ["repo", "top"], ["source_file"], "n_tokens")
    return totals.select("repo", "top", "source_file", "n_tokens", F.floor(F.col("before") / budget).cast("bigint").alias("batch_no"))
