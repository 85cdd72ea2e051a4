"""Percentiles of very large numeric columns (problem 2).

Method: Dyadic Count-sketches. A value is encoded by the leading 31 bits of its double (exponent and 20 bits of the
mantissa), which keeps the order: a universe of 2**BITS codes. For each binary resolution of the codes with more than WIDTH
nodes there is one signed Count-sketch of DEPTH rows of WIDTH counters; the coarser resolutions are counted exactly,
once, at the finest of them. Sketches are linear: those of days and partitions merge by addition, and negative
weights delete values. A rank is inverted by descending from the exact resolution, choosing at each finer one the
half in which it lies.

A sketch has CELLS counters, whatever it holds. While it holds fewer than SPARSE different codes it is sent as codes and counts,
from which the receiver makes the same counters; ranks are always inverted on the counters.

Error: a percentile's value is off by at most the resolution of a code (1 / 2**20 of the value), its rank by the
sketches' errors, each about sqrt(F2 / WIDTH) with F2 the sum of squared counts of the nodes of a resolution.

Defined cases: null, NaN, infinite and negative values do not count; a group without a value gives no row; a null in a
group's key is a key of its own; a run delivered again counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, WIDTH, DEPTH = 31, 2048, 5
LEVELS = BITS - 11  # resolutions with a sketch; at the next one there are 2**11 = WIDTH nodes
CELLS = WIDTH + LEVELS * DEPTH * WIDTH
SPARSE = CELLS // 2
HELD = 4_000_000  # codes a task gathers before it sends them on
# Spellings of the units, in nanoseconds.
UNITS = {"ns": 1.0, "nanosecond": 1.0, "nanoseconds": 1.0, "us": 1e3, "µs": 1e3, "μs": 1e3, "microsecond": 1e3, "microseconds": 1e3}


def encode(values: np.ndarray) -> np.ndarray:
    """Codes of finite values of 0 or more; the code of a larger value is never smaller."""
    return (np.abs(np.asarray(values, np.float64)).view(np.int64) >> 32).astype(np.int64)


def decode(codes: np.ndarray) -> np.ndarray:
    """The middle of the values of each code."""
    return ((np.asarray(codes, np.int64) << 32) | (1 << 31)).view(np.float64)


def _hash(nodes: np.ndarray, level: int) -> np.ndarray:
    h = (nodes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((level + 1) * 0x632BE59BD9B4E019 % 2**64)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def _place(h: np.ndarray, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Counter within a row, and sign: 12 bits of the node's hash for each of the five rows."""
    bits = (h >> np.uint64(12 * row)).astype(np.int64)
    return bits & (WIDTH - 1), 1 - ((bits >> 10) & 2)


class Sketch:
    """Counters of all resolutions in one array: the exact resolution first."""

    def __init__(self) -> None:
        self.cells = np.zeros(CELLS, np.int64)

    def update(self, values: np.ndarray, weight: int = 1) -> None:
        """Add values (``weight`` 1), or delete them (-1)."""
        values = np.asarray(values, np.float64)
        codes, counts = np.unique(encode(values[np.isfinite(values) & (values >= 0)]), return_counts=True)
        self.add_codes(codes, counts * weight)

    def add_codes(self, codes: np.ndarray, counts: np.ndarray) -> None:
        """Add counts of ascending codes."""
        for level in range(LEVELS + 1):
            if not len(codes):
                return
            if level == LEVELS:
                np.add.at(self.cells, codes, counts)
                return
            h, at = _hash(codes, level), WIDTH + level * DEPTH * WIDTH
            for row in range(DEPTH):
                place, sign = _place(h, row)
                # sums below 2**53 are exact as doubles
                self.cells[at + row * WIDTH : at + (row + 1) * WIDTH] += np.bincount(place, sign * counts, WIDTH).astype(np.int64)
            parents = codes >> 1
            first = np.flatnonzero(np.append(True, parents[1:] != parents[:-1]))
            codes, counts = parents[first], np.add.reduceat(counts, first)

    def add(self, cells: np.ndarray) -> None:
        self.cells += cells

    @property
    def n(self) -> int:
        return int(self.cells[:WIDTH].sum())

    def estimate(self, nodes: np.ndarray, level: int) -> np.ndarray:
        h, at = _hash(nodes, level), WIDTH + level * DEPTH * WIDTH
        rows = []
        for row in range(DEPTH):
            place, sign = _place(h, row)
            rows.append(self.cells[at + row * WIDTH + place] * sign)
        return np.median(rows, axis=0)

    def quantile(self, q: float) -> float | None:
        """About the value at rank ceil(q n)."""
        n = self.n
        if n <= 0:
            return None
        rank = max(1, int(np.ceil(round(q * n, 9))))
        sums = np.cumsum(self.cells[:WIDTH])
        node = int(np.searchsorted(sums, rank))
        inside = float(self.cells[node])
        rank -= int(sums[node] - self.cells[node])
        for level in range(LEVELS - 1, -1, -1):
            # both halves are estimated, and made to add up to what their parent holds
            left, right = self.estimate(np.array([2 * node, 2 * node + 1]), level)
            left = min(max((left + inside - right) / 2, 0.0), inside)
            if rank <= left:
                node, inside = 2 * node, left
            else:
                node, inside, rank = 2 * node + 1, inside - left, rank - left
        return float(decode(np.array([node]))[0])


class Part:
    """What is known of one group: codes and counts while they are few, then counters."""

    def __init__(self) -> None:
        self.codes: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.size, self.sketch = 0, None

    def put(self, codes: np.ndarray, counts: np.ndarray) -> None:
        self.codes.append(codes)
        self.counts.append(counts)
        self.size += len(codes)
        if self.size > 2 * SPARSE:
            self.settle()
            if self.size > SPARSE:
                self.dense()

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        """The codes in order, each once; counts of 0 are gone."""
        if len(self.codes) != 1:
            codes, counts = np.concatenate([*self.codes, np.empty(0, np.int64)]), np.concatenate([*self.counts, np.empty(0, np.int64)])
            order = np.argsort(codes, kind="stable")
            codes, counts = codes[order], counts[order]
            first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.empty(0, np.int64)
            counts = np.add.reduceat(counts, first) if len(first) else counts
            self.codes, self.counts = [codes[first][counts != 0]], [counts[counts != 0]]
            self.size = len(self.codes[0])
        return self.codes[0], self.counts[0]

    def dense(self) -> Sketch:
        """The counters; what came as codes is in them from now on."""
        self.sketch = self.sketch or Sketch()
        self.sketch.add_codes(*self.settle())
        self.codes, self.counts, self.size = [], [], 0
        return self.sketch


def valid_runs(runs: DataFrame) -> DataFrame:
    """``run_id, surface, build, measured_on, factor, samples`` with the warm-up left out."""
    unit = F.lower(F.trim("unit"))
    factor: Column = F.lit(None).cast("double")
    for name, value in UNITS.items():
        factor = F.when(unit == name, F.lit(value)).otherwise(factor)
    skip = F.when(F.col("warmup_excluded") == F.lit(False), F.greatest(F.coalesce("warmup_count", F.lit(0)), F.lit(0))).otherwise(F.lit(0))
    kept = F.slice("samples", skip + 1, F.greatest(F.size("samples") - skip, F.lit(0)))
    usable = runs.filter("run_id is not null and samples is not null")
    return usable.select("run_id", "surface", "build", "measured_on", factor.alias("factor"), kept.alias("samples")).filter("factor is not null")


def _schema(df: DataFrame, keys: list[str], more: str) -> str:
    return ", ".join(f"_k{i} {df.schema[k].dataType.simpleString()}" for i, k in enumerate(keys)) + ", " + more


def _named(df: DataFrame, keys: list[str], *more: str) -> DataFrame:
    return df.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], *more)


FORM = "codes array<int>, counts array<bigint>, cells array<bigint>"


def _sent(parts: dict[tuple, Part], keys: int) -> Iterator[pd.DataFrame]:
    """Rows of parts: codes with counts (no counts if all are 1), or counters."""
    for key, part in parts.items():
        codes, counts, cells = None, None, None
        if part.sketch is None:
            codes, counts = part.settle()
            codes, counts = codes.astype(np.int32), None if (counts == 1).all() else counts
        else:
            cells = part.dense().cells
        yield pd.DataFrame({**{f"_k{i}": [key[i]] for i in range(keys)}, "codes": [codes], "counts": [counts], "cells": [cells]})


def partial(runs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, codes, counts, cells``: sketches of parts of the groups of ``keys``, each run once.

    Rows are spread by the run alone, so a hot group is in all tasks, and each task sends one part of every group it met.
    """
    names = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    spread = valid_runs(runs).select("run_id", "factor", "samples", *names).repartition("run_id").sortWithinPartitions("run_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        parts: dict[tuple, Part] = {}
        last, held = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            fresh = np.append(ids[0] != last, ids[1:] != ids[:-1])  # others are delivered again
            last = ids[-1]
            lists = batch.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False) * np.repeat(batch.column(1).to_numpy(zero_copy_only=False), sizes)
            rows = list(zip(*[batch.column(3 + i).to_pylist() for i in range(len(keys))]))
            number: dict[tuple, int] = {}
            group = np.repeat(np.array([number.setdefault(r, len(number)) for r in rows], np.int64), sizes)
            good = np.repeat(fresh, sizes) & np.isfinite(values) & (values >= 0)
            both, counts = np.unique((group[good] << 32) | encode(values[good]), return_counts=True)
            cut = np.searchsorted(both, np.arange(len(number) + 1, dtype=np.int64) << 32)
            codes = both & 0xFFFFFFFF
            for key, g in number.items():
                if cut[g + 1] > cut[g]:
                    parts.setdefault(key, Part()).put(codes[cut[g] : cut[g + 1]], counts[cut[g] : cut[g + 1]])
            held += len(both)
            if held > HELD:
                yield from _sent(parts, len(keys))
                parts, held = {}, 0
        yield from _sent(parts, len(keys))

    def arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in run(batches):
            yield pa.RecordBatch.from_pandas(frame, schema=target, preserve_index=False)

    schema = _schema(runs, keys, FORM)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))
    return _named(spread.mapInArrow(arrow, schema), keys, "codes", "counts", "cells")


def _gathered(frames: Iterator[pd.DataFrame], keys: int) -> Iterator[tuple[tuple, Part]]:
    """The parts of equal keys in sorted rows, added up one group at a time."""
    current, part = None, Part()
    for frame in frames:
        for *key, codes, counts, cells in frame.itertuples(index=False):
            key = tuple(None if v is None or v is pd.NaT or v != v else v for v in key)
            if current is not None and key != current:
                yield current, part
                part = Part()
            current = key
            if cells is not None:
                part.dense().add(np.asarray(cells, np.int64))
            if codes is not None and len(codes):
                part.put(np.asarray(codes, np.int64), np.ones(len(codes), np.int64) if counts is None else np.asarray(counts, np.int64))
            if part.sketch is not None and part.size > SPARSE:
                part.dense()
    if current is not None:
        yield current, part


def _together(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.repartition(*keys).sortWithinPartitions(*keys).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "codes", "counts", "cells")


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of equal ``keys`` added up; a task adds as it reads, one sketch at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, part in _gathered(frames, len(keys)):
            yield from _sent({key: part}, len(keys))

    return _named(_together(sketches, keys).mapInPandas(run, _schema(sketches, keys, FORM)), keys, "codes", "counts", "cells")


def percentiles(sketches: DataFrame, keys: list[str], pcts: tuple[int, ...] = (50, 99)) -> DataFrame:
    """``keys, pct, n, value`` of all sketches of equal ``keys`` together."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, part in _gathered(frames, len(keys)):
            sketch = part.dense()
            if sketch.n > 0:
                yield pd.DataFrame({**{f"_k{i}": [v] * len(pcts) for i, v in enumerate(key)}, "pct": list(pcts), "n": sketch.n, "value": [sketch.quantile(p / 100) for p in pcts]})

    return _named(_together(sketches, keys).mapInPandas(run, _schema(sketches, keys, "pct int, n bigint, value double")), keys, "pct", "n", "value")


def exceeding(runs: DataFrame, targets: DataFrame) -> DataFrame:
    """``surface, build, pct`` whose percentile over all valid samples is above the surface's target."""
    got = percentiles(partial(runs, ["surface", "build"]), ["surface", "build"])
    limit = targets.groupBy("surface").agg(F.max("p50").alias("p50"), F.max("p99").alias("p99"))
    joined = got.join(F.broadcast(limit), "surface").filter(F.col("value") > F.when(F.col("pct") == 50, F.col("p50")).otherwise(F.col("p99")))
    return joined.select("surface", "build", "pct")
