"""Near-duplicate records with small edits (problem 4).

Method: SuperMinHash. Every element (a three-word sequence) draws one permutation of the signature's places and
one fraction per step; the signature keeps the least step plus fraction at each place, and a document stops as
soon as no later step can lower any place. The first BANDS * ROWS places of a signature are cut into bands, which propose
pairs; all places, kept as two bits each, estimate the similarity of a proposed pair inside its band. What is left
is verified on the sets themselves, and union-find groups the verified links.

Records with equal sets are one class and are proposed once; they are only listed one by one at the end.
No sequence and no band is left out for being frequent: all rows of a band are compared, and a band of more than BLOCK
rows is split into blocks, every two of which meet in a task of their own. The estimate can be switched off
(``agreeing = (0, 0)``): every pair that shares a band is then verified.

Defined cases: a text without a sequence (null, empty, shorter than three words) is in no pair and a group of its
own; a re-delivered record counts once; an empty table gives an empty result. A key is looked at once, with the
first of its texts in byte order should they differ.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import materialize
from . import textkernel as K

WORDS, SIMILARITY = 3, 0.5
ROWS, BANDS, PLACES = 2, 16, 128
AGREEING = (82, 64)  # of PLACES first bits, and pairs of bits; at a similarity of 0.5 96 and 80 are expected to agree, with deviations of 4.9 and 5.5
SKETCH = ("s1", "s2", "t1", "t2")
BLOCK = 16_384  # rows of a band that are compared in one task
TILE, SHIFTED = 512, 64
TASK_ROWS = 400_000  # band rows of one task
SPARSE = 12  # steps for which permutations are kept as lists of swaps


def elements(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct word sequences of all texts as 40-bit hashes in order of text, and how many each text has."""
    texts = texts.fill_null("")
    cps, offsets = K.code_points(pa.compute.replace_substring(texts, "İ", "i̇"))
    cps = K.lower_table()[cps]
    kinds = (((cps >= 97) & (cps <= 122)) | ((cps >= 48) & (cps <= 57))).astype(np.uint8)
    starts = K.runs(kinds, offsets)
    lengths = np.diff(np.append(starts, len(cps)))
    if len(starts):
        word = kinds[starts] == 1
        starts, lengths = starts[word], lengths[word]
    h = K.hashes(cps, starts, lengths)
    owner = np.searchsorted(offsets, starts, side="right") - 1
    n = len(h) - words + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    sequence = h[:n].copy()
    for i in range(1, words):
        sequence = K.mix(sequence * np.uint64(31)) + h[i : n + i]
    sequence = K.mix(sequence)
    inside = owner[:n] == owner[words - 1 :]
    keyed = np.sort((owner[:n][inside].astype(np.uint64) << np.uint64(40)) | (sequence[inside] >> np.uint64(24)))
    keyed = keyed[np.append(True, keyed[1:] != keyed[:-1])] if len(keyed) else keyed
    return keyed & np.uint64((1 << 40) - 1), np.bincount((keyed >> np.uint64(40)).astype(np.int64), minlength=len(texts))


def superminhash(flat: np.ndarray, counts: np.ndarray, places: int) -> np.ndarray:
    """The SuperMinHash signature of every set of hashes; infinite for an empty one."""
    out = np.full((len(counts), places), np.inf)
    ends = np.cumsum(counts)
    a = 0
    while a < len(counts):
        base = ends[a] - counts[a]
        b = max(a + 1, int(np.searchsorted(ends, base + 50_000, side="right")))
        _superminhash(flat[base : ends[b - 1]], np.repeat(np.arange(b - a), counts[a:b]), out[a:b])
        a = b
    return out


def _superminhash(flat: np.ndarray, owner: np.ndarray, out: np.ndarray) -> None:
    """Most sets are done after a few steps, so the permutations start as the list of their swaps and become arrays only for what is left."""
    places = out.shape[1]
    low, swaps, order = out.reshape(-1), [], None
    for j in range(places):
        if not len(flat):
            return
        draw = K.mix(flat + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % 2**64))
        other = (j + ((draw & np.uint64(0xFFFF)) % np.uint64(places - j))).astype(np.uint8)
        if order is None:
            place, here = other.copy(), np.full(len(flat), j, np.uint8)
            for at, put in swaps:
                np.copyto(place, put, where=at == other)
                np.copyto(here, put, where=at == j)
            swaps.append((other, here))
        else:
            row = np.arange(len(flat))
            place = order[row, other]
            order[row, other] = order[row, j]
        np.minimum.at(low, owner * places + place, j + (draw >> np.uint64(16)).astype(np.float64) / 2.0**48)
        if j % 2 == 1 or j < 4:
            keep = (out.max(axis=1) >= j + 1)[owner]
            if not keep.all():
                flat, owner = flat[keep], owner[keep]
                swaps = [(at[keep], put[keep]) for at, put in swaps]
                order = order[keep] if order is not None else None
        if j == SPARSE - 1:
            row = np.arange(len(flat))
            order = np.broadcast_to(np.arange(places, dtype=np.uint8), (len(flat), places)).copy()
            for at, put in swaps:
                order[row, at] = put
            swaps = []


def bands(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key per band of the first places."""
    bits = np.ascontiguousarray(signature[:, : BANDS * ROWS]).view(np.uint64).reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(K.mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(77)), (len(signature), BANDS)).copy()
    for i in range(ROWS):
        key = K.mix((key ^ bits[:, :, i]).ravel()).reshape(key.shape)
    return key.view(np.int64)


def sketch(signature: np.ndarray) -> np.ndarray:
    """Two bits per place: the first bits of all places, and then the second ones, as PLACES / 32 integers."""
    h = K.mix(signature.view(np.uint64).ravel()).reshape(signature.shape)
    planes = [np.packbits(((h >> np.uint64(i)) & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64) for i in range(2)]
    return np.hstack(planes)


def set_ids(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit id per set, equal for equal sets; 0 for an empty one."""
    total = np.append(np.uint64(0), np.cumsum(K.mix(flat + np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64))
    ends = np.append(0, np.cumsum(counts))
    ids = K.mix((total[ends[1:]] - total[ends[:-1]]) ^ counts.astype(np.uint64)).view(np.int64).copy()
    ids[counts == 0] = 0
    return ids


def signed(records: DataFrame, key: str, text: str) -> DataFrame:
    """``key, class, s1, s2, t1, t2, bands`` of every row with a sequence; bands and sketches only at a class's first row in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            for a, b in K.slices(batch.column(1)):
                part = batch.slice(a, b - a)
                flat, counts = elements(part.column(1))
                ids = set_ids(flat, counts)
                first = np.zeros(len(ids), bool)
                for i, c in enumerate(ids.tolist()):
                    if c and c not in met:
                        met.add(c)
                        first[i] = True
                signature = superminhash(flat[np.repeat(first, counts)], counts[first], PLACES)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.where(first, BANDS, 0))).astype(np.int32)), pa.array(bands(signature).ravel()))
                s = np.zeros((len(ids), len(SKETCH)), np.int64)
                s[first] = sketch(signature)
                out = pa.RecordBatch.from_arrays([part.column(0), pa.array(ids), *[pa.array(c) for c in np.ascontiguousarray(s.T)], lists], ["key", "class", *SKETCH, "bands"])
                yield out.filter(pa.array(ids != 0))

    return records.select(key, text).mapInArrow(run, f"key {records.schema[key].dataType.simpleString()}, class bigint, {', '.join(f'{c} bigint' for c in SKETCH)}, bands array<bigint>")


def large(signatures: DataFrame) -> DataFrame:
    """``band, blocks`` of the bands of more than BLOCK rows. One that is missed is compared like any other, so no row depends on it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> pa.RecordBatch:
            ids, n = np.unique(np.concatenate(more), return_counts=True)
            keep = n > 8
            return pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(n[keep])], ["band", "n"])

        more: list[np.ndarray] = []
        for batch in batches:
            more.append(batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False))
            if sum(map(len, more)) > 4_000_000:
                yield counted()
                more = []
        if more:
            yield counted()

    sums = signatures.select("bands").mapInArrow(run, "band bigint, n bigint").groupBy("band").agg(F.sum("n").alias("n"))
    return sums.filter(F.col("n") > BLOCK).select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))


def differing(s: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many places the sketches of rows ``x`` and ``y`` differ."""
    half = s.shape[1] // 2
    return np.bitwise_count((s[x, :half] ^ s[y, :half]) | (s[x, half:] ^ s[y, half:])).sum(1)


def alike(s: np.ndarray, left: np.ndarray, right: np.ndarray, agreeing: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Of all ``left`` x ``right`` rows those whose sketches agree in enough places."""
    x, y = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for i in range(0, len(left), TILE):
        a = left[i : i + TILE]
        for j in range(0, len(right), TILE):
            b = right[j : j + TILE]
            other = np.bitwise_count(s[a, 0][:, None] ^ s[b, 0]) + np.bitwise_count(s[a, 1][:, None] ^ s[b, 1])
            at = np.flatnonzero(other <= PLACES - agreeing[0])
            p, q = a[at // len(b)], b[at % len(b)]
            keep = differing(s, p, q) <= PLACES - agreeing[1]
            x.append(p[keep])
            y.append(q[keep])
    return np.concatenate(x), np.concatenate(y)


def meeting(group: np.ndarray, side: np.ndarray, ids: np.ndarray, s: np.ndarray, agreeing: tuple[int, int] = AGREEING) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs of different ids that agree, of each group of the sorted rows; sides 1 and 2 meet each other only."""
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    sizes = np.diff(np.append(starts, len(group)))
    few = (sizes <= SHIFTED) & (np.maximum.reduceat(side, starts) == 0)
    small = np.repeat(few, sizes)
    for shift in range(1, min(SHIFTED, int(sizes.max()))):
        x = np.flatnonzero(small[:-shift] & (group[:-shift] == group[shift:]))
        if not len(x):
            break
        x = x[np.bitwise_count(s[x, :2] ^ s[x + shift, :2]).sum(1) <= PLACES - agreeing[0]]
        x = x[(differing(s, x, x + shift) <= PLACES - agreeing[1]) & (ids[x] != ids[x + shift])]
        yield x, x + shift
    for a, n in zip(starts[~few].tolist(), sizes[~few].tolist()):
        rows = np.arange(a, a + n)
        across = side[a : a + n].any()
        if across:
            pairs = [(rows[side[rows] == 1], rows[side[rows] == 2])]
        else:
            pairs = [(rows[i : i + TILE], rows[i:]) for i in range(0, n, TILE)]
        for left, right in pairs:
            x, y = alike(s, left, right, agreeing)
            keep = (ids[x] != ids[y]) & (across | (x < y))
            yield x[keep], y[keep]


def _meet(agreeing: tuple[int, int]):
    """Rows sorted by group to pairs; a group may go over several batches."""

    def pairs(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, s = rows[:, 2], np.ascontiguousarray(rows[:, 3:]).view(np.uint64)
        for x, y in meeting(rows[:, 0], rows[:, 1], ids, s, agreeing):
            for i in range(0, len(x), 500_000):
                a, b = ids[x[i : i + 500_000]], ids[y[i : i + 500_000]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            side = columns[1] if len(columns) == 3 + len(SKETCH) else np.zeros(len(columns[0]), np.int64)
            rows = np.column_stack([columns[0], side, *columns[-1 - len(SKETCH) :]])
            last = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
            if held and held[0][0, 0] != rows[0, 0] or last:
                yield from pairs(np.concatenate([*held, rows[:last]]))
                held = []
            held.append(rows[last:])
        if held:
            yield from pairs(np.concatenate(held))

    return run


def partitions(df: DataFrame, rows: int, each: int = TASK_ROWS) -> int:
    """As many partitions as keep a task at about ``each`` rows, and not less than the session's."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def proposed(signatures: DataFrame, agreeing: tuple[int, int] = AGREEING) -> DataFrame:
    """``a, b``: pairs of classes, a < b, that share a band and look similar enough."""
    n = partitions(signatures, signatures.count() * BANDS)
    rows = signatures.filter(F.size("bands") > 0).select(F.explode("bands").alias("band"), "class", *SKETCH)
    hot = materialize(large(signatures))
    sent = [rows.withColumnRenamed("band", "g")]
    if hot.limit(1).count():
        sent[0] = rows.join(hot, "band", "left_anti").withColumnRenamed("band", "g")
        split = rows.join(hot, "band").withColumn("p", F.pmod(F.xxhash64("class"), "blocks").cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        side = F.when(F.col("p") == F.col("q"), 0).when(F.col("p") < F.col("q"), 1).otherwise(2).cast("bigint")
        sent.append(split.select(F.xxhash64("band", F.least("p", "q"), F.greatest("p", "q")).alias("g"), side.alias("side"), "class", *SKETCH))
    met = [r.repartition(n, "g").sortWithinPartitions("g").mapInArrow(_meet(agreeing), "a bigint, b bigint") for r in sent]
    return reduce(DataFrame.unionAll, met).distinct()


def verified(pairs: DataFrame, records: DataFrame, text: str, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs of classes whose sets have at least the similarity."""
    spark = pairs.sparkSession
    n = pairs.count()
    # a filter of about 16 slots a pair, and never more than 2^28 (32 MB): it keeps sets that are in no pair from being sent, no result depends on it
    slots = 1 << min(28, max(16, (16 * n).bit_length()))
    slot = pairs.select(F.explode(F.array("a", "b")).alias("c")).select((F.pmod("c", F.lit(slots)) + 1).alias("s"))
    marked = slot.groupBy(F.bitmap_bucket_number("s").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits")).collect()
    there = np.zeros(slots // 8 + 4096, np.uint8)
    for at, some in marked:
        # bucket 1 holds the first 32,768 slots, each byte eight of them, the lowest bit first
        there[(at - 1) * 4096 : at * 4096] |= np.frombuffer(some, np.uint8)
    send = spark.sparkContext.broadcast(there)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, met = send.value, set()
        for batch in batches:
            for a, b in K.slices(batch.column(0)):
                flat, counts = elements(batch.column(0).slice(a, b - a))
                ids, ends = set_ids(flat, counts), np.cumsum(counts)
                short = (flat >> np.uint64(8)).astype(np.uint32)
                slot = np.mod(ids, slots)
                wanted = (ids != 0) & ((there[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1).astype(bool)
                keep = [i for i in np.flatnonzero(wanted).tolist() if not (ids[i] in met or met.add(ids[i]))]
                yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array([short[ends[i] - counts[i] : ends[i]].tobytes() for i in keep], pa.binary())], ["class", "set"])

    sets = records.select(text).mapInArrow(run, "class bigint, set binary")
    tasks = partitions(pairs, n, TASK_ROWS // 8)
    wide = pairs.repartition(tasks, "a").join(sets.select(F.col("class").alias("a"), F.col("set").alias("x")), "a")
    wide = wide.repartition(tasks, "b").join(sets.select(F.col("class").alias("b"), F.col("set").alias("y")), "b")

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for c in range(0, len(frame), 5000):
                part = frame.iloc[c : c + 5000]
                keyed, sizes = [], np.zeros((2, len(part)), np.int64)
                for side, name in enumerate("xy"):
                    column = part[name].tolist()
                    sizes[side] = [len(s) // 4 for s in column]
                    keyed.append((np.repeat(np.arange(len(part), dtype=np.uint64), sizes[side]) << np.uint64(32)) | np.frombuffer(b"".join(column), np.uint32))
                every = np.sort(np.concatenate(keyed))
                shared = np.bincount((every[1:][every[1:] == every[:-1]] >> np.uint64(32)).astype(np.int64), minlength=len(part))
                value = shared / np.maximum(sizes.sum(0) - shared, 1)
                good = value >= similarity
                yield pd.DataFrame({"a": part["a"].to_numpy()[good], "b": part["b"].to_numpy()[good], "similarity": value[good]})

    return wide.select("a", "b", "x", "y").mapInPandas(compare, "a bigint, b bigint, similarity double").dropDuplicates(["a", "b"])


def links(records: DataFrame, key: str, text: str, agreeing: tuple[int, int] = AGREEING) -> tuple[DataFrame, DataFrame]:
    """``key, class`` of every record with a sequence, and ``a, b, similarity`` of the similar classes."""
    signatures = materialize(signed(records, key, text))
    pairs = materialize(proposed(signatures, agreeing))
    members = signatures.groupBy("key").agg(F.min("class").alias("class"))
    return members, verified(pairs, records, text)


def text_pairs(records: DataFrame, key: str, text: str) -> DataFrame:
    """``key_a, key_b``: all pairs of different records of at least the similarity, in byte order."""
    members, classes = links(records, key, text)
    members = materialize(members)
    several = members.groupBy("class").count().filter("count > 1").select("class")
    same = members.join(several, "class")
    same = same.select("class", F.col("key").alias("x")).join(same.select("class", F.col("key").alias("y")), "class").filter("x < y").select("x", "y")
    other = classes.join(members.select(F.col("class").alias("a"), F.col("key").alias("x")), "a").join(members.select(F.col("class").alias("b"), F.col("key").alias("y")), "b").select("x", "y")
    return same.unionAll(other).select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b"))


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of ``a, b``: the least node of each connected component.

    Each round runs union-find over every task's own edges, which leaves a forest, and then sends every tree edge
    to the least root any task knows of the node; rounds end when no label changes.
    """

    def forest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while parent.setdefault(root, root) != root:
                root = parent[root]
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for frame in frames:
            for a, b in zip(frame["a"].tolist(), frame["b"].tolist()):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
        nodes = [n for n in parent if find(n) != n]
        yield pd.DataFrame({"a": np.array(nodes, np.int64), "b": np.array([find(n) for n in nodes], np.int64)})

    current = materialize(edges.select("a", "b").mapInPandas(forest, "a bigint, b bigint"))
    while True:
        # all roots that tasks know of a node are joined to the least of them
        least = current.groupBy("a").agg(F.min("b").alias("least"), F.max("b").alias("most"))
        if not least.filter("least <> most").limit(1).count():
            jumped = least.select("a", F.col("least").alias("b"))
            up = jumped.select(F.col("a").alias("b"), F.col("b").alias("up"))
            if not jumped.join(up, "b", "left_semi").limit(1).count():
                return jumped.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(jumped.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
            current = materialize(jumped.join(up, "b", "left").select("a", F.coalesce("up", "b").alias("b")))
            continue
        across = current.join(least, "a").filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        kept = least.select("a", F.col("least").alias("b"))
        current = materialize(kept.unionAll(across).repartition("a").mapInPandas(forest, "a bigint, b bigint"))


def groups(records: DataFrame, key: str, text: str) -> DataFrame:
    """``key, class, group, links``: every record once; ``links``: other classes similar to its own, ``group``: its component."""
    members, classes = links(records, key, text)
    classes = materialize(classes)
    both = classes.select(F.col("a").alias("class")).unionAll(classes.select(F.col("b"))).groupBy("class").agg(F.count("*").alias("links"))
    roots = components(classes).select(F.col("node").alias("class"), F.col("root").alias("group"))
    every = records.filter(F.col(key).isNotNull()).select(F.col(key).alias("key")).distinct().join(members, "key", "left")
    found = every.join(both, "class", "left").join(roots, "class", "left")
    return found.select("key", "class", F.coalesce("group", "class").alias("group"), F.coalesce("links", F.lit(0)).alias("links"))


def normal(value: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKC", value).casefold() if c.isalnum())


@F.pandas_udf(T.StringType())
def _normal(values: pd.Series) -> pd.Series:
    return values.map(normal, na_action="ignore")


def _segments(length: int, parts: int) -> list[tuple[int, int]]:
    """Start and size of the parts of a string of the length; the last ones are the longer ones."""
    size, long = divmod(length, parts)
    out, at = [], 0
    for i in range(parts):
        n = size + (i >= parts - long)
        out.append((at, n))
        at += n
    return out


def spelling_pairs(values: DataFrame, column: str, distance: int = 2) -> DataFrame:
    """``key_a, key_b``: pairs of distinct strings within the edit distance after normalisation.

    Signatures of word sets say nothing of edits inside one short word, so strings meet by segments: one of
    ``distance + 1`` segments of the shorter string is found unchanged in the longer one, shifted by no more than
    the distance. That misses no pair; the distance itself is then computed.
    """
    parts = distance + 1

    @F.pandas_udf("array<string>")
    def own(names: pd.Series) -> pd.Series:
        return names.map(lambda s: [f"{len(s)}:{i}:{s[a : a + n]}" for i, (a, n) in enumerate(_segments(len(s), parts))])

    @F.pandas_udf("array<string>")
    def probes(names: pd.Series) -> pd.Series:
        def each(s: str) -> list[str]:
            keys = set()
            for length in range(max(0, len(s) - distance), len(s) + 1):
                for i, (a, n) in enumerate(_segments(length, parts)):
                    for start in range(max(0, a - distance), min(len(s) - n, a + distance) + 1):
                        keys.add(f"{length}:{i}:{s[start : start + n]}")
            return sorted(keys)

        return names.map(each)

    raw = materialize(values.filter(F.col(column).isNotNull()).select(F.col(column).alias("raw")).distinct().withColumn("name", _normal("raw")))
    names = raw.select("name").distinct()
    left = names.select(F.col("name").alias("x"), F.explode(own("name")).alias("k"))
    right = names.select(F.col("name").alias("y"), F.explode(probes("name")).alias("k"))
    near = left.join(right, "k").filter("x <> y").select("x", "y").distinct().filter(F.levenshtein("x", "y", distance) >= 0)
    near = near.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    same = raw.select("name", F.col("raw").alias("a")).join(raw.select("name", F.col("raw").alias("b")), "name").filter("a < b").select("a", "b")
    other = near.join(raw.select(F.col("name").alias("x"), F.col("raw").alias("a")), "x").join(raw.select(F.col("name").alias("y"), F.col("raw").alias("b")), "y").select("a", "b")
    return same.unionAll(other).select(F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b"))
