"""Problem 7: filling containers of fixed capacity with items of varying length.

Pattern packing by non-negative least squares: patterns of a few lengths that fill a container are enumerated, their
repeat counts are fitted to the histogram of lengths and rounded down; what is left is packed by best fit over the
histogram. All of this works on counts of lengths, of which there are at most as many as the capacity; the documents
are then dealt to the places of their length without being gathered anywhere.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import batches_of, columns_of, cut

#: Classes of length from which patterns are built, lengths of a pattern at most, and the fill a pattern needs.
CLASSES, LARGEST_PATTERN, LEAST_FILL = 24, 4, 0.97


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """x >= 0 that minimises |a @ x - b|, by the active-set method: columns enter while the gradient wants them and
    leave when they would become negative; it ends when no column can improve."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, dtype=bool)
    w = a.T @ b
    limit = tolerance * max(1.0, float(np.abs(w).max(initial=0)))
    for _ in range(10 * n + 10):
        free = np.where(passive, -np.inf, w)
        k = int(free.argmax()) if n else -1
        if k < 0 or free[k] <= limit:
            break
        passive[k] = True
        while True:
            s = np.zeros(n)
            s[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            if s[passive].min(initial=1.0) > 0:
                x = s
                break
            low = passive & (s <= 0)
            step = (x[low] / np.maximum(x[low] - s[low], 1e-300)).min()
            x = x + step * (s - x)
            passive &= x > 1e-12
            x[~passive] = 0.0
            if not passive.any():
                break
        w = a.T @ (b - a @ x)
        w[k] = 0.0 if not passive[k] else w[k]  # a column that leaves at once isn't tried again in this round
    return x


def _patterns(sizes: list[int], capacity: int, sep: int) -> list[tuple[int, ...]]:
    """Non-increasing tuples of classes whose sizes, with separators, fill at least LEAST_FILL of the capacity."""
    out: list[tuple[int, ...]] = []

    def grow(first: int, used: int, chosen: tuple[int, ...]) -> None:
        if chosen and used >= LEAST_FILL * capacity:
            out.append(chosen)
        if len(chosen) == LARGEST_PATTERN:
            return
        for k in range(first, len(sizes)):
            need = sizes[k] + (sep if chosen else 0)
            if used + need <= capacity:
                grow(k, used + need, (*chosen, k))

    grow(0, 0, ())
    return out


class _Left:
    """Lengths that are still to be placed, as counts."""

    def __init__(self, histogram: dict[int, int]):
        self.n = {k: v for k, v in histogram.items() if v > 0}
        self.keys = sorted(self.n)

    def take(self, length: int, count: int) -> None:
        self.n[length] -= count
        if not self.n[length]:
            del self.n[length]
            self.keys.pop(bisect_left(self.keys, length))

    def longest(self, room: int, want: dict[int, int]) -> int | None:
        """The longest length within the room of which more are left than wanted."""
        k = bisect_right(self.keys, room) - 1
        while k >= 0 and self.n[self.keys[k]] <= want.get(self.keys[k], 0):
            k -= 1
        return self.keys[k] if k >= 0 else None

    def fill(self, chosen: list[int], want: dict[int, int], room: int, sep: int) -> int:
        """Adds the longest items that fit, one after another; the room that is left."""
        while (length := self.longest(room - sep, want)) is not None:
            chosen.append(length)
            want[length] = want.get(length, 0) + 1
            room -= length + sep
        return room


def plan(histogram: dict[int, int], capacity: int, sep: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one container, number of such containers); every counted item has a place.

    Depends on the histogram alone; its work is bounded by the capacity, not by the number of items."""
    left, out = _Left({k: v for k, v in histogram.items() if 0 < k <= capacity}), []
    if not left.keys:
        return out
    # Patterns over quantile classes; a class is represented by its longest length, so that its patterns always fit.
    lengths = np.array(left.keys)
    weight = np.cumsum([left.n[k] for k in left.keys])
    edges = sorted({int(lengths[min(len(lengths) - 1, int(np.searchsorted(weight, weight[-1] * (q + 1) / CLASSES)))]) for q in range(CLASSES)}, reverse=True)
    found = _patterns(edges, capacity, sep)
    if found:
        a = np.zeros((len(edges), len(found)))
        for p, chosen in enumerate(found):
            for k in chosen:
                a[k, p] += 1
        low = [edges[k + 1] if k + 1 < len(edges) else 0 for k in range(len(edges))]
        b = np.array([sum(n for length, n in left.n.items() if lo < length <= hi) for lo, hi in zip(low, edges)], dtype=float)
        repeats = np.floor(nonnegative_least_squares(a, b) + 1e-9).astype(int)
        for p in np.argsort(-repeats, kind="stable"):
            todo = int(repeats[p])
            while todo > 0:  # the longest lengths of each class first; as many containers alike as they last
                chosen: list[int] = []
                want: dict[int, int] = defaultdict(int)
                room = capacity
                for k in found[p]:
                    room -= sep if chosen else 0
                    length = left.longest(min(edges[k], room), want)
                    if length is None or length <= low[k]:
                        break
                    chosen.append(length)
                    want[length] += 1
                    room -= length
                if len(chosen) < len(found[p]):
                    break
                # Lengths shorter than their class leave room: further items fill it.
                room = left.fill(chosen, want, room, sep)
                times = min(todo, *(left.n[x] // c for x, c in want.items()))
                for x, c in want.items():
                    left.take(x, times * c)
                out.append((tuple(chosen), times))
                todo -= times
    while left.keys:  # residuals: the longest first, then whatever fits best, as many containers alike as possible
        first = left.keys[-1]
        chosen, want, room = [first], defaultdict(int, {first: 1}), capacity - first
        left.fill(chosen, want, room, sep)
        times = min(left.n[x] // c for x, c in want.items())
        for x, c in want.items():
            left.take(x, times * c)
        out.append((tuple(chosen), times))
    return out


def _places(containers: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank, first container and place of the runs of ranks that lie in alike containers."""
    runs, rank, base = defaultdict(list), defaultdict(int), 1
    for lengths, times in containers:
        for slot, length in enumerate(lengths):
            runs[length].append((rank[length], base, slot))
            rank[length] += times
        base += times
    return {k: tuple(np.array(c, dtype=np.int64) for c in zip(*v)) for k, v in runs.items()}


def pack(items: DataFrame, capacity: int, sep: int, *, partitions: int | None = None) -> DataFrame:
    """Rows (id, part, length, container, place) of items (id, length): where each item goes.

    An item longer than the capacity is split into full containers and a rest (part 0, 1, ...); no other is split.
    ``sep`` lies between two items of one container. Items of null or non-positive length and null ids are left out,
    an id given twice is placed once (its greatest length), ties are dealt in any but a lossless way: each part has
    one place. An empty table gives no rows."""
    if capacity <= 0 or sep < 0:
        raise ValueError("capacity must be positive and sep not negative")
    sc = items.sparkSession.sparkContext
    items = items.where("id IS NOT NULL AND length > 0").groupBy("id").agg(F.max("length").alias("length"))
    whole = F.floor((F.col("length") - 1) / F.lit(capacity))
    parts = items.select("id", F.explode(F.sequence(F.lit(0), whole.cast("int"))).alias("part"), "length")
    parts = cut(parts.select("id", "part", F.least(F.lit(capacity).cast("long"), F.col("length") - F.col("part") * F.lit(capacity)).cast("long").alias("length")))
    # Ranks within a length: the place within the partition, and the count of the partitions before, which stays a table
    # (of partitions times lengths). A length of a third of all items is never gathered.
    def placed_in_partition(batches):
        seen: dict[int, int] = {}
        for b in batches:
            own = []
            for length in b.column(b.schema.get_field_index("length")).to_pylist():
                k = seen.get(length, 0)
                seen[length] = k + 1
                own.append(k)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.int64())], [*b.schema.names, "own"])

    numbered = parts.withColumn("pid", F.spark_partition_id()).mapInArrow(placed_in_partition, "id long, part int, length long, pid int, own long")
    per = numbered.groupBy("length", "pid").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select("length", "pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    counts = columns_of(per.groupBy("length").agg(F.sum("n").alias("n")))  # at most ``capacity`` rows
    histogram = dict(zip(counts["length"].tolist(), counts["n"].tolist()))
    shared = sc.broadcast(_places(plan(histogram, capacity, sep)))  # bounded by the capacity, as the plan is

    def deal(batches):
        places = shared.value
        for b in batches:
            ids, part, lengths, ranks = batches_of(b, ["id", "part", "length", "rank"])
            containers, slots = [], []
            for length, rank in zip(lengths, ranks):
                first, base, slot = places[length]
                k = int(np.searchsorted(first, rank, side="right")) - 1
                containers.append(int(base[k] + rank - first[k]))
                slots.append(int(slot[k]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(part, pa.int32()), pa.array(lengths, pa.int64()), pa.array(containers, pa.int64()), pa.array(slots, pa.int32())], ["id", "part", "length", "container", "place"])

    ranked = numbered.join(starts.hint("merge"), ["length", "pid"]).select("id", "part", "length", (F.col("start") + F.col("own")).alias("rank"))
    return ranked.mapInArrow(deal, "id long, part int, length long, container long, place int")


def fill(placed: DataFrame, capacity: int, sep: int) -> DataFrame:
    """One row (containers, items, tokens, used, fullest, fill, lower_bound, gap): how well the containers are filled; used
    counts separators. lower_bound: containers that any packing needs, the greater of what the total takes (each item
    but one of a container brings a separator) and of the items of which no two fit together; gap: how far above it
    the containers are, as a share."""
    per = placed.groupBy("container").agg(F.count("*").alias("n"), F.sum("length").alias("tokens"))
    total = per.agg(F.count("*").alias("containers"), F.coalesce(F.sum("n"), F.lit(0)).alias("items"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.col("tokens") + (F.col("n") - 1) * sep), F.lit(0)).alias("used"), F.max(F.col("tokens") + (F.col("n") - 1) * sep).alias("fullest"))
    large = placed.agg(F.count_if(F.col("length") * 2 + sep > capacity).alias("large"))
    total = total.crossJoin(large).withColumn("fill", F.col("used") / (F.col("containers") * F.lit(capacity)))  # one row each
    bound = F.greatest(F.ceil((F.col("tokens") + F.col("items") * sep) / F.lit(capacity + sep)), F.col("large"))
    return total.withColumn("lower_bound", bound).withColumn("gap", F.col("containers") / F.col("lower_bound") - 1).drop("large")
