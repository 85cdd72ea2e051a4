"""Filling fixed-capacity containers with items (problem 8).

Method: exact-complement hashing. Only the histogram of item sizes (at most ``capacity`` entries, however many
items there are) is planned on: sizes are taken from the largest down and each is completed to exactly the
capacity by a single, a pair or a triple of other sizes, as many times as all of them are still available;
what remains goes best-fit into the smallest gap that holds it. A plan is a list of patterns with
multiplicities, and the items find their container by the rank among the items of their size, which is
computed with per-salt counts so that one frequent size never meets in one task.

Defined cases: an item of more than the capacity is cut into full containers and one remainder, and only
such an item is cut; an item of size 0, or null, takes no room and has a null container; equal sizes are told
apart by key and piece; a key given twice is packed twice; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SALTED = 50_000  # a size of more items is ranked in salts of about half as many to as many
RANK = 44  # bits of a rank within a size


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (sizes of one container) and how many containers of each, for sizes of 1..capacity."""
    left = np.zeros(capacity + 1, np.int64)
    for size, n in histogram.items():
        left[size] = n
    out: list[tuple[tuple[int, ...], int]] = []

    def pair(gap: int) -> tuple[int, int, int]:
        """The pair of sizes with this sum that is available most often, and how often."""
        low = np.arange(1, gap // 2 + 1)
        if not len(low):
            return 0, 0, 0
        n = np.minimum(left[low], left[gap - low])
        if gap % 2 == 0:
            n[-1] = left[gap // 2] // 2
        at = int(n.argmax())
        return int(low[at]), int(gap - low[at]), int(n[at])

    def take(pattern: tuple[int, ...], times: int) -> None:
        for size in pattern:
            left[size] -= times
        out.append((pattern, times))

    for size in range(capacity, 0, -1):
        gap = capacity - size
        if left[size] and gap == 0:
            take((size,), int(left[size]))
        while left[size] and 0 < gap <= size:
            times = left[size] // 2 if gap == size else min(left[size], left[gap])
            if not times:
                break
            take((size, gap), int(times))
        while left[size] > 0 and gap > 1:
            a, b, n = pair(gap)
            same = 1 + (a == size) + (b == size)
            times = min(n, int(left[size]) // same)
            if not times:
                break
            take((size, a, b), times)
    # triples: pair sums are indexed once by a convolution; counts only fall, so the index errs to one side only
    there = (left > 0).astype(np.float64)
    if there.any():
        width = 1 << int(2 * capacity + 2).bit_length()

        def index() -> np.ndarray:
            return np.rint(np.fft.irfft(np.fft.rfft((left > 0).astype(np.float64), width) ** 2, width)[: capacity + 1]) > 0

        sums, stale = index(), 0
        for size in range(capacity, 0, -1):
            gap = capacity - size
            third = gap - 2
            while left[size] > 0 and third > 0:
                if stale > 8:
                    sums, stale = index(), 0
                thirds = np.flatnonzero((left[1 : third + 1] > 0) & sums[gap - 1 : gap - third - 1 : -1])
                if not len(thirds):
                    break
                third = int(thirds[-1]) + 1
                a, b, n = pair(gap - third)
                chosen = (size, third, a, b)
                times = min([n, *(int(left[x]) // chosen.count(x) for x in chosen)]) if n else 0
                if times:
                    take(chosen, times)
                else:
                    stale += 1
                    third -= 1
    # the rest: best fit, with containers of one gap kept together
    open_: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]
    gaps = np.zeros(capacity + 1, bool)
    for size in range(capacity, 0, -1):
        while left[size] > 0:
            fits = np.flatnonzero(gaps[size:])
            if len(fits):
                gap = size + int(fits[0])
                pattern, n = open_[gap].pop()
                gaps[gap] = bool(open_[gap])
                times = min(n, int(left[size]))
                if times < n:
                    open_[gap].append((pattern, n - times))
                    gaps[gap] = True
                grown, times, rest = (*pattern, size), times, gap - size
                left[size] -= times
            else:
                each = capacity // size
                times = max(1, int(left[size]) // each)
                each = min(each, int(left[size]))
                grown, rest = (size,) * each, capacity - size * each
                left[size] -= times * each
            if rest:
                open_[rest].append((grown, times))
                gaps[rest] = True
            else:
                out.append((grown, times))
    out += [p for group in open_ for p in group]
    return out


def pieces(items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """Items as pieces of at most the capacity: ``key, piece, start, n`` (one row of n = 0 for a size of 0 or null)."""
    n = F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0))
    last = F.greatest(F.ceil(n / capacity) - 1, F.lit(0)).cast("bigint")
    cut = items.select(F.col(key), n.alias("_n"), F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece"))
    start = F.col("piece") * capacity
    return cut.select(key, F.col("piece").cast("int").alias("piece"), start.alias("start"), F.least(F.col("_n") - start, F.lit(capacity).cast("bigint")).alias("n"))


def pack(items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """``key, piece, start, n, container``: every item, laid into containers of ``capacity``.

    ``items`` is read three times; give a stored table. The driver gets the histogram (at most ``capacity`` rows) and the counts
    of the salted sizes (one row per SALTED items beyond it).
    """
    spark = items.sparkSession
    cut = pieces(items, key, size, capacity)
    histogram = {r["n"]: r["c"] for r in cut.filter("n > 0").groupBy("n").agg(F.count("*").alias("c")).collect()}
    empty = cut.filter("n = 0").select(key, "piece", "start", "n", F.lit(None).cast("bigint").alias("container"))
    if not histogram:
        return empty
    # a size is salted by how often it occurs; a power of two each, so that one mask gives the salt
    mask = np.zeros(capacity + 1, np.int64)
    for n, c in histogram.items():
        mask[n] = (1 << (c // SALTED).bit_length()) - 1
    often = np.flatnonzero(mask).tolist()
    # a constant array, folded once
    chosen = F.get(F.split(F.lit(",".join(map(str, mask))), ",").cast("array<bigint>"), F.col("n").cast("int"))
    salted = cut.filter("n > 0").withColumn("_mask", chosen).withColumn("_salt", F.xxhash64(key, "piece").bitwiseAND(F.col("_mask")))
    counts = salted.filter("_mask > 0").groupBy("n", "_salt").agg(F.count("*").alias("c")).collect() if often else []
    # ranks of a size start where those of its smaller salts end
    base = np.zeros(capacity + 2, np.int64)
    base[1:] = np.cumsum(mask + 1)
    before = np.zeros(base[-1], np.int64)
    for n, salt, c in counts:
        before[base[n] + salt] = c
    for n in often:
        part = before[base[n] : base[n + 1]]
        part[:] = np.cumsum(part) - part
    table = segments(plan(histogram, capacity), histogram)
    send = spark.sparkContext.broadcast((base, before, table))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, before, (code, shift, each, at) = send.value
        for batch in batches:
            n, salt, rank = (batch.column(3 + i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            rank = rank + before[base[n] + salt]
            row = np.searchsorted(code, (n << RANK) | rank, side="right") - 1
            container = at[row] + (rank - shift[row]) // each[row]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(container)], [key, "piece", "start", "n", "container"])

    w = Window.partitionBy("n", "_salt").orderBy(key, "piece")
    ranked = salted.withColumn("_r", F.row_number().over(w) - 1).select(key, "piece", "start", "n", "_salt", "_r")
    kind = items.schema[key].dataType.simpleString()
    return ranked.mapInArrow(place, f"`{key}` {kind}, piece int, start bigint, n bigint, container bigint").unionAll(empty)


def segments(patterns: list[tuple[tuple[int, ...], int]], histogram: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of items of one size in rank order: code (size and first rank), first rank, items a container, first container; by code."""
    rows, base, reached = [], 0, dict.fromkeys(histogram, 0)
    for pattern, times in patterns:
        for s in set(pattern):
            each = pattern.count(s)
            rows.append(((s << RANK) | reached[s], reached[s], each, base))
            reached[s] += each * times
        base += times
    assert reached == histogram, "the plan holds every item once"
    return tuple(np.array(sorted(rows), np.int64).reshape(-1, 4).T.copy())
