"""Per-key results where a few keys hold most rows.

Rows are range-partitioned on (key, secondary value, row number), with boundaries that Spark takes
from sampled quantiles, so a heavy key spreads over as many partitions as its rows fill. Each
partition reduces its sorted rows to one partial state per key; the states of keys that cross a
boundary are stitched: counts add up, and a secondary value that ends one part and begins the next
counts once.

Defined cases: null keys form a group of their own (key_text null), so totals stay whole; null
secondary values are counted as rows, not as distinct values; repeated rows count each time; empty
tables give an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import materialize

_STATE = "part int, f string, has_key boolean, key string, n_rows bigint, n_distinct bigint, first_o string, first_has boolean, last_o string, last_has boolean, low bigint, high bigint"
_NONE = np.int64(2**62)


def keyed(rows: DataFrame, field: str, key: Column, secondary: list[Column], version: Column) -> DataFrame:
    """Rows of one table as (f, has_key, key, has_o, o, at): ``field`` names them, a null secondary part voids the secondary."""
    whole = reduce(lambda x, y: x & y, [c.isNotNull() for c in secondary])
    return rows.select(
        F.lit(field).alias("f"), key.isNotNull().alias("has_key"), F.coalesce(key.cast("string"), F.lit("")).alias("key"),
        whole.alias("has_o"), F.when(whole, F.concat_ws("\u0000", *secondary)).otherwise("").alias("o"), version.cast("bigint").alias("at"),
    )


def _starts(columns: list[pa.Array]) -> np.ndarray:
    """True where a row differs from the one before it in any column; the first row always does."""
    n = len(columns[0])
    differs = np.zeros(n, bool)
    differs[0] = True
    for c in columns:
        differs[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return differs


def _partial_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One state per key of the partition: sorted batches are cut into runs; a run at a batch's end is carried on."""
    schema = pa.schema([("part", pa.int32()), ("f", pa.string()), ("has_key", pa.bool_()), ("key", pa.string()), ("n_rows", pa.int64()), ("n_distinct", pa.int64()), ("first_o", pa.string()), ("first_has", pa.bool_()), ("last_o", pa.string()), ("last_has", pa.bool_()), ("low", pa.int64()), ("high", pa.int64())])
    carried: dict | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        col = {name: batch.column(name) for name in batch.schema.names}
        new_key = _starts([col["f"], col["has_key"], col["key"]])
        new_pair = new_key | _starts([col["has_o"], col["o"]])
        has = col["has_o"].to_numpy(zero_copy_only=False)
        at = col["at"].fill_null(int(_NONE)).to_numpy()
        first = np.flatnonzero(new_key)
        last = np.append(first[1:], batch.num_rows) - 1
        take = lambda name, where: col[name].take(pa.array(where))
        states = pa.table({
            "part": take("part", first).cast(pa.int32()), "f": take("f", first), "has_key": take("has_key", first), "key": take("key", first),
            "n_rows": last - first + 1, "n_distinct": np.add.reduceat((new_pair & has).astype(np.int64), first),
            "first_o": take("o", first), "first_has": take("has_o", first), "last_o": take("o", last), "last_has": take("has_o", last),
            "low": np.minimum.reduceat(at, first), "high": np.maximum.reduceat(np.where(at == _NONE, -_NONE, at), first),
        }, schema=schema)
        if carried is not None:
            head = states.slice(0, 1).to_pylist()[0]
            if all(head[k] == carried[k] for k in ("f", "has_key", "key")):
                same = head["first_has"] and carried["last_has"] and head["first_o"] == carried["last_o"]
                carried |= {"n_rows": carried["n_rows"] + head["n_rows"], "n_distinct": carried["n_distinct"] + head["n_distinct"] - same, "last_o": head["last_o"], "last_has": head["last_has"], "low": min(carried["low"], head["low"]), "high": max(carried["high"], head["high"])}
                states = states.slice(1)
            if not states.num_rows:
                continue
            yield from pa.Table.from_pylist([carried], schema=schema).to_batches()
        carried = states.slice(states.num_rows - 1).to_pylist()[0]
        yield from states.slice(0, states.num_rows - 1).to_batches()
    if carried is not None:
        yield from pa.Table.from_pylist([carried], schema=schema).to_batches()


def key_profile(rows: DataFrame, part_rows: int = 250_000) -> DataFrame:
    """Per (f, key): n_rows, n_distinct secondary values, first_at and last_at (null where no row has a version).

    ``rows`` come from :func:`keyed`, several tables united if wanted. They are cut into as many ranges
    as hold ``part_rows`` each, so that a task stays as large however many rows there are. The number of
    partial states of one key is that of the partitions it fills, so the stitching window stays small.
    """
    order = ["f", "has_key", "key", "has_o", "o"]
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // part_rows))
    spread = rows.withColumn("row_no", F.monotonically_increasing_id()).repartitionByRange(parts, *order, "row_no").sortWithinPartitions(*order)
    states = spread.select("f", "has_key", "key", "has_o", "o", "at", F.spark_partition_id().alias("part")).mapInArrow(_partial_states, _STATE)
    before = Window.partitionBy("f", "has_key", "key").orderBy("part")
    crosses = F.col("first_has") & F.lag("last_has").over(before) & (F.lag("last_o").over(before) == F.col("first_o"))
    stitched = states.withColumn("twice", F.coalesce(crosses, F.lit(False)).cast("bigint")).groupBy("f", "has_key", "key").agg(
        F.sum("n_rows").alias("n_rows"), (F.sum("n_distinct") - F.sum("twice")).alias("n_distinct"), F.min("low").alias("low"), F.max("high").alias("high"),
    )
    known = lambda c: F.when(F.abs(F.col(c)) != int(_NONE), F.col(c).cast("int"))
    return stitched.select("f", F.when(F.col("has_key"), F.col("key")).alias("key_text"), "n_rows", "n_distinct", known("low").alias("first_at"), known("high").alias("last_at"))


def heavy_keys(profile: DataFrame, share: int = 50) -> DataFrame:
    """Non-null keys with at least one ``share``-th of the rows of their ``f``; totals are one row per ``f``.

    The profile, one row per key, is written once and read for both the totals and the keys.
    """
    profile = materialize(profile, "profile")
    totals = profile.groupBy("f").agg(F.sum("n_rows").alias("total"))
    return profile.where(F.col("key_text").isNotNull()).join(F.broadcast(totals), "f").where(F.col("n_rows") * share >= F.col("total")).drop("total")
