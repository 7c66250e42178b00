"""Filling containers of fixed capacity with items, by patterns fitted to the histogram of sizes.

Only the histogram goes to the driver: it has at most ``capacity`` entries, whatever the corpus.
There, patterns of a few lengths that fill a container exactly are enumerated, repeat counts are
fitted to the histogram by non-negative least squares and rounded down to what the histogram holds,
and what is left is packed by repeated greedy patterns over lengths. The resulting plan says for
each length which containers take its first, second, ... item. Items are ranked within their length
by a range partition (a length that holds a third of all items spreads over many partitions) and
look their container up in the plan.

Defined cases: an item of no size takes no container (null container and position); only an item
above the capacity is cut, into full pieces and a rest, and the rest is packed like an item; ties
between equal sizes go by id and piece; repeated ids are items of their own; an empty table gives
an empty result; extra columns are not read.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import broadcast_if_small, materialize

Pattern = list[tuple[int, int]]


def enumerate_patterns(lengths: np.ndarray, counts: np.ndarray, capacity: int, per_length: int = 6, most_items: int = 4) -> list[Pattern]:
    """Patterns of up to ``most_items`` lengths that fill the capacity exactly.

    For every length as the largest: alone, with its complement, and with one or two of the most
    frequent lengths and the complement of those; ``per_length`` of each kind at most.
    """
    present = set(lengths.tolist())
    frequent = lengths[np.argsort(-counts, kind="stable")][: 8 * per_length].tolist()
    found: dict[tuple[int, ...], None] = {}
    for a in lengths.tolist():
        if a == capacity:
            found[(a,)] = None
        if capacity - a in present:
            found[tuple(sorted((a, capacity - a)))] = None
        triples = quads = 0
        for i, b in enumerate(frequent):
            if most_items >= 3 and triples < per_length and (c := capacity - a - b) in present:
                found[tuple(sorted((a, b, c)))] = None
                triples += 1
            for c in frequent[i : i + per_length]:
                if most_items >= 4 and quads < per_length and (e := capacity - a - b - c) in present:
                    found[tuple(sorted((a, b, c, e)))] = None
                    quads += 1
    return [[(x, p.count(x)) for x in sorted(set(p), reverse=True)] for p in found]


def fit_counts(patterns: list[Pattern], lengths: np.ndarray, counts: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 with the least squared difference between the patterns' use of lengths and the histogram.

    Projected gradient with momentum over the sparse pattern matrix; the step is one over a bound of its norm.
    """
    if not patterns:
        return np.zeros(0)
    row = np.concatenate([np.searchsorted(lengths, [x for x, _ in p]) for p in patterns])
    col = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    value = np.concatenate([[k for _, k in p] for p in patterns]).astype(float)
    use = lambda x: np.bincount(row, value * x[col], len(lengths))
    pull = lambda r: np.bincount(col, value * r[row], len(patterns))
    step = 1 / (np.bincount(row, value, len(lengths)).max() * np.bincount(col, value, len(patterns)).max())
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * pull(use(y) - counts))
        following = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / following * (new - x), new, following
    return x


def greedy_pattern(active: list[int], left: dict[int, int], capacity: int) -> Pattern:
    """The largest length left, then again and again the largest that still fits."""
    pattern, gap, at = [], capacity, len(active)
    while at and gap:
        at = bisect_right(active, gap, 0, at)
        if not at:
            break
        length = active[at - 1]
        n = min(left[length], gap // length)
        pattern.append((length, n))
        gap -= n * length
        at -= 1
    return pattern


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, Pattern]]:
    """(repeats, pattern) pairs that use every item of the histogram exactly once."""
    lengths = np.array(sorted(histogram))
    counts = np.array([histogram[x] for x in lengths.tolist()], dtype=float)
    left = dict(histogram)
    chosen: list[tuple[int, Pattern]] = []

    def take(pattern: Pattern, wanted: int) -> None:
        n = min([wanted, *(left[x] // k for x, k in pattern)])
        if n > 0:
            chosen.append((n, pattern))
            for x, k in pattern:
                left[x] -= n * k

    patterns = enumerate_patterns(lengths, counts, capacity)
    fitted = fit_counts(patterns, lengths, counts)
    for i in np.argsort(-fitted, kind="stable").tolist():
        take(patterns[i], int(fitted[i] + 1e-6))
    active = [x for x in sorted(left) if left[x]]
    while active:
        pattern = greedy_pattern(active, left, capacity)
        take(pattern, min(left[x] // k for x, k in pattern))
        for x, _ in pattern:
            if not left[x]:
                active.remove(x)
    return chosen


def slots(chosen: list[tuple[int, Pattern]]) -> list[tuple[int, int, int, int, int, int]]:
    """The plan by length: (length, first rank, first container, items a container, first position, first offset)."""
    used: dict[int, int] = {}
    rows, container = [], 0
    for repeats, pattern in chosen:
        position = offset = 0
        for length, k in pattern:
            rows.append((length, used.get(length, 0), container, k, position, offset))
            used[length] = used.get(length, 0) + repeats * k
            position, offset = position + k, offset + k * length
        container += repeats
    return rows


def _place(shared):
    """Looks (window, length, rank) up in the broadcast plan, whose tables by window are sorted by (length, first rank)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        keys = {w: t[:, 0] * (1 << 44) + t[:, 1] for w, t in tables.items()}
        for batch in batches:
            window, length, rank = (batch.column(c).to_numpy().astype(np.int64) for c in ("window_id", "n_tokens", "rank"))
            out = np.zeros((3, batch.num_rows), np.int64)
            for w in np.unique(window).tolist():
                of = window == w
                row = tables[w][np.searchsorted(keys[w], length[of] * (1 << 44) + rank[of], "right") - 1]
                nth = rank[of] - row[:, 1]
                out[0, of] = row[:, 2] + nth // row[:, 3]
                out[1, of] = row[:, 4] + nth % row[:, 3]
                out[2, of] = row[:, 5] + nth % row[:, 3] * length[of]
            keep = ["window_id", "item", "piece_no", "n_tokens"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(x) for x in out)], names=[*keep, "window_no", "position", "token_offset"])
    return run


def pack(sizes: DataFrame, capacities: dict[int, int], item_column: str = "doc_id", size_column: str = "n_tokens") -> DataFrame:
    """(window_id, item, piece_no, n_tokens, window_no, position, token_offset) for each item or piece and window kind.

    ``capacities`` are few settings: window_id -> capacity. Pieces of one item are made by a
    generator in the row's task, so even an item of many pieces is never a group.
    """
    kind = sizes.select(item_column).schema[0].dataType.simpleString()
    settings = F.explode(F.array(*[F.struct(F.lit(w).alias("window_id"), F.lit(c).cast("bigint").alias("capacity")) for w, c in sorted(capacities.items())]))
    sizes = materialize(sizes.select(item_column, size_column), "sizes")
    sized = sizes.select(F.col(item_column).alias("item"), F.coalesce(F.col(size_column).cast("bigint"), F.lit(0)).alias("size")).select("item", "size", settings.alias("s")).select("item", "size", "s.*")
    pieces = sized.withColumn("piece_no", F.explode(F.expr("sequence(0L, greatest(1L, (size + capacity - 1) div capacity) - 1)")))
    pieces = pieces.select("window_id", "item", "piece_no", F.least("capacity", F.col("size") - F.col("piece_no") * F.col("capacity")).alias("n_tokens"))
    items = pieces.where("n_tokens > 0")
    # ranks within a length: rows are sorted by it across partitions, so a row's number in its partition is enough
    numbered = materialize(
        items.repartitionByRange("window_id", "n_tokens", "item", "piece_no").sortWithinPartitions("window_id", "n_tokens", "item", "piece_no")
        .withColumns({"part": F.spark_partition_id(), "row_no": F.monotonically_increasing_id()}),
        "items",
    )
    runs = numbered.groupBy("window_id", "n_tokens", "part").agg(F.count(F.lit(1)).alias("n"), F.min("row_no").alias("first_row"))
    before = Window.partitionBy("window_id", "n_tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(runs.select("window_id", "n_tokens", "part", "n", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first_row")).alias("shift")), "starts")
    histograms: dict[int, dict[int, int]] = {w: {} for w in capacities}
    for w, length, n in starts.groupBy("window_id", "n_tokens").agg(F.sum("n")).collect():  # at most one row per window kind and length up to its capacity
        histograms[w][length] = n
    tables = {w: np.array(sorted(slots(plan(h, capacities[w]))) or [(0, 0, 0, 1, 0, 0)], dtype=np.int64) for w, h in histograms.items()}
    ranked = numbered.join(broadcast_if_small(starts.drop("n")), ["window_id", "n_tokens", "part"]).withColumn("rank", F.col("row_no") + F.col("shift"))
    placed = ranked.select("window_id", "item", "piece_no", "n_tokens", "rank").mapInArrow(_place(sizes.sparkSession.sparkContext.broadcast(tables)), f"window_id int, item {kind}, piece_no bigint, n_tokens bigint, window_no bigint, position bigint, token_offset bigint")
    nowhere = F.lit(None).cast("bigint")
    empty = pieces.where("n_tokens <= 0").select("window_id", "item", "piece_no", F.lit(0).cast("bigint").alias("n_tokens"), nowhere.alias("window_no"), nowhere.alias("position"), nowhere.alias("token_offset"))
    return placed.unionByName(empty).withColumnRenamed("item", item_column)
