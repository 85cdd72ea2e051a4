"""Most similar vectors for every vector (problem 1).

Method: a robust-pruned directed graph per shard (see ``vamana``). Vectors go to the shard of their nearest
centre; every vector searches the graphs of its nearest shards by beam search, and the lists are merged. There is a shard per
SHARD vectors, so the work of a vector does not grow with the collection: up to CENTRES shards have one level of centres,
fitted on at most ``SAMPLE`` vectors (those of the smallest hashed ids); beyond that, coarse cells have FAN centres each, which
are fitted within the cell on a sample of bounded size and never leave the executors. Every vector is indexed. A shard of
more than ``MOST`` vectors is divided by the hash of the id into graphs of at most about that size, each of
which is searched, and one of more than twice as many searchers has them spread over several tasks.

Exact copies of a vector are indexed once; their members find each other and share the neighbours found.

Defined cases: unusable vectors (null, of another size, with null, NaN or infinite elements, all zero) are no
items; ties in similarity go to the smaller id; a collection of fewer than k + 1 items gives shorter lists; a
re-delivered item counts once; an empty collection gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialize
from . import vamana

SAMPLE, SHARD, CENTRES, MOST = 16_384, 2_000, 1_024, 20_000
TASK_ROWS = 50_000  # visits of one task
FAN, CELL_SAMPLE, CELL_ROWS = 512, 8_192, 500_000  # centres of a cell, vectors they are fitted on, and rows of a cell in one task
DEGREE, BEAM, PROBES = 12, 14, 4
NEXT_CELL = (4, 2)  # shards searched in the nearest cell, and in the second


def items(products: DataFrame, batches: DataFrame, name: str = "body", size: int = 64) -> DataFrame:
    """``item, vec`` (unit vector as float32 bytes) of every usable vector of both tables, once per item."""
    newest = products.filter("object_id is not null").groupBy("object_id").agg(F.max(F.coalesce("version", F.lit(-1))).alias("_newest"))
    rows = products.filter("object_id is not null").select("object_id", F.coalesce("version", F.lit(-1)).alias("_v"), F.try_element_at("vectors", F.lit(name)).alias("v"))
    now = rows.join(newest, "object_id").filter("_v = _newest").dropDuplicates(["object_id"]).select(F.col("object_id").alias("item"), "v")
    pairs = batches.select(F.explode(F.arrays_zip(F.col("input_ids").alias("i"), F.col("vectors").alias("v"))).alias("p"))
    inputs = pairs.select(F.col("p.i").alias("item"), F.col("p.v").alias("v")).filter("item is not null and v is not null").dropDuplicates(["item"])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            lists = batch.column(1)
            right = np.asarray(pa.compute.fill_null(pa.compute.equal(pa.compute.list_value_length(lists), size), False))
            kept = batch.filter(pa.array(right))
            flat = kept.column(1).flatten()
            x = np.asarray(flat.fill_null(float("nan")) if flat.null_count else flat, np.float64).reshape(-1, size)
            good = np.isfinite(x).all(1) & x.any(1)
            x = x[good]
            x = np.ascontiguousarray((x / np.abs(x).max(1, keepdims=True, initial=0)), np.float64)
            x = np.ascontiguousarray(x / np.sqrt((x * x).sum(1, keepdims=True)), np.float32)
            yield pa.RecordBatch.from_arrays([kept.column(0).filter(pa.array(good)), pa.array([r.tobytes() for r in x], pa.binary())], ["item", "vec"])

    return now.unionAll(inputs).mapInArrow(run, "item bigint, vec binary")


def _matrix(column: pd.Series | pa.Array) -> np.ndarray:
    values = column.to_pylist() if isinstance(column, pa.Array) else list(column)
    if not values:
        return np.empty((0, 0), np.float32)
    return np.frombuffer(b"".join(values), np.float32).reshape(len(values), -1)


def centres(x: np.ndarray, k: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """Spherical k-means."""
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-30), c)
    return np.ascontiguousarray(c, np.float32)


ROUTES = "item bigint, vec binary, shard bigint, own boolean"


def _routes(items: list[pa.Array], vec: pa.Array, near: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
    """One row per vector and shard it searches."""
    row = np.repeat(np.arange(len(near)), near.shape[1])
    return pa.RecordBatch.from_arrays([items.take(pa.array(row)), vec.take(pa.array(row)), pa.array(near.ravel().astype(np.int64)), pa.array(own.ravel())], ["item", "vec", "shard", "own"])


def _first(similar: np.ndarray, k: int) -> np.ndarray:
    return np.argsort(-similar, axis=1, kind="stable")[:, :k]


def flat_routes(reps: DataFrame, c: np.ndarray, probes: int) -> DataFrame:
    """``item, vec, shard, own``: the shards of the ``probes`` nearest centres, the first of them its own."""
    send = reps.sparkSession.sparkContext.broadcast(c)  # at most CENTRES vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = _first(_matrix(batch.column(1)) @ send.value.T, probes)
                yield _routes(batch.column(0), batch.column(1), near, np.arange(near.shape[1])[None, :] + np.zeros((len(near), 1), int) == 0)

    return reps.mapInArrow(run, ROUTES)


def cell_routes(reps: DataFrame, coarse: np.ndarray, total: int) -> DataFrame:
    """The same over two levels: the nearest centres within the two nearest coarse cells.

    Vectors are spread by cell, a large cell over several tasks; a cell's centres come first in each of its tasks and are held while
    its vectors stream by.
    """
    spark = reps.sparkSession
    send = spark.sparkContext.broadcast(coarse)  # at most SAMPLE / 2 vectors

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = _first(_matrix(batch.column(1)) @ send.value.T, 2)
                yield _routes(batch.column(0), batch.column(1), near, np.arange(near.shape[1])[None, :] + np.zeros((len(near), 1), int) == 0)

    placed = materialize(reps.mapInArrow(cells, ROUTES).withColumnRenamed("shard", "cell"))
    # bounded: one row per coarse cell
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.sum(F.col("own").cast("int")).alias("owned")).collect()
    # a sample of every cell by the hash of the id, of about CELL_SAMPLE vectors and no more than twice that
    counts = spark.createDataFrame([(r["cell"], r["owned"], -(-r["n"] // CELL_ROWS)) for r in sizes], "cell bigint, owned bigint, tasks int")
    share = F.least(F.lit(1 << 20), F.ceil(F.lit(CELL_SAMPLE << 20) / F.col("owned"))).cast("bigint")
    sample = placed.filter("own").join(F.broadcast(counts), "cell").filter(F.pmod(F.xxhash64("item", F.lit(1)), F.lit(1 << 20)) < share)

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(frame.sort_values("item")["vec"])
        fine = centres(x, max(1, min(FAN, len(x) // 4)))
        return pd.DataFrame({"cell": frame["cell"].iloc[:1], "vec": [fine.tobytes()]})

    fitted = materialize(sample.select("cell", "item", "vec").groupBy("cell").applyInPandas(fit, "cell bigint, vec binary"))
    empty = F.lit(None).cast("bigint")
    heads = fitted.join(F.broadcast(counts), "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), F.lit(0).alias("kind"), empty.alias("item"), "vec", F.lit(False).alias("own"))
    rows = placed.join(F.broadcast(counts), "cell").select("cell", F.pmod(F.xxhash64("item"), F.col("tasks")).cast("int").alias("task"), F.lit(1).alias("kind"), "item", "vec", "own")

    def fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_cell = None, None
        for batch in batches:
            kind = batch.column(2).to_numpy(zero_copy_only=False)
            cell = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = [*np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]) | (kind[1:] != kind[:-1]) | (kind[1:] == 0))).tolist(), len(kind)] if len(kind) else []
            for a, b in zip(cuts, cuts[1:]):
                part = batch.slice(a, b - a)
                x = _matrix(part.column(4))
                if kind[a] == 0:
                    held, held_cell = x.reshape(-1, send.value.shape[1]), cell[a]
                    continue
                if held_cell != cell[a]:
                    continue  # the second-nearest cell of some vectors that is no vector's nearest
                own = part.column(5).to_numpy(zero_copy_only=False)
                for mine, probes in zip((True, False), NEXT_CELL):
                    some = np.flatnonzero(own == mine)
                    if len(some):
                        near = _first(x[some] @ held.T, probes)
                        first = (np.arange(near.shape[1]) == 0)[None, :] & np.full((len(some), 1), mine)
                        yield _routes(part.column(3).take(pa.array(some)), part.column(4).take(pa.array(some)), near + cell[a] * FAN, first)

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * total // CELL_ROWS))
    return heads.unionAll(rows).repartition(n, "cell", "task").sortWithinPartitions("cell", "task", "kind").mapInArrow(fine, ROUTES)


def divided(routed: DataFrame) -> DataFrame:
    """``shard, part, block, role, item, vec``: visits, large shards divided into parts and their searchers into blocks."""
    sizes = routed.groupBy("shard").agg(F.sum(F.col("own").cast("int")).alias("_own"), F.count("*").alias("_all"))
    ways = sizes.select("shard", F.greatest(F.lit(1), F.ceil(F.col("_own") / MOST)).cast("int").alias("parts"), F.greatest(F.lit(1), F.ceil(F.col("_all") / (4 * MOST))).cast("int").alias("blocks"))
    # shards of the usual size are not in this table
    odd = materialize(ways.filter("parts > 1 or blocks > 1"))
    rows = routed.join(odd, "shard", "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("parts", "blocks")})
    mine, home = F.pmod(F.xxhash64("item"), F.col("parts")).cast("int"), F.pmod(F.xxhash64("item", F.lit(2)), F.col("blocks")).cast("int")
    each = rows.withColumn("mine", mine).withColumn("home", home).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    indexed = F.col("own") & (F.col("part") == F.col("mine"))
    # what is indexed is in all blocks of its part, and searches in one
    each = each.withColumn("block", F.explode(F.when(indexed, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("home"))))
    role = F.when(~indexed, 1).when(F.col("block") == F.col("home"), 0).otherwise(2)
    return each.select("shard", "part", "block", role.alias("role"), "item", "vec")


def nearest(vectors: DataFrame, k: int = 5, probes: int = PROBES, degree: int = DEGREE, beam: int = BEAM) -> DataFrame:
    """``item, neighbour, similarity``: about the ``k`` most similar other items of every item of ``item, vec``."""
    spark = vectors.sparkSession
    # a class of exact copies: its smallest id stands for it
    stored = materialize(vectors.withColumn("_h", F.struct(F.xxhash64("vec").alias("a"), F.crc32("vec").alias("b"))))
    first = Window.partitionBy("_h").orderBy("item")
    few = stored.select("item", "_h").withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= k + 1)
    classes = materialize(few.groupBy("_h").agg(F.array_sort(F.collect_list("item")).alias("members")).withColumn("rep", F.col("members")[0]))
    reps = stored.join(classes.select(F.col("rep").alias("item")), "item", "left_semi").select("item", "vec")
    total = classes.count()
    if not total:
        return spark.createDataFrame([], "item bigint, neighbour bigint, similarity double")
    share = min(1 << 20, -(-(SAMPLE + SAMPLE // 4) * (1 << 20) // total))  # a little more than the sample, by the hash of the id
    sample = _matrix(reps.filter(F.pmod(F.xxhash64("item"), F.lit(1 << 20)) < share).orderBy(F.xxhash64("item"), "item").limit(SAMPLE).toPandas()["vec"])
    shards = max(1, total // SHARD)
    if shards <= CENTRES:
        routed = flat_routes(reps, centres(sample, min(shards, len(sample))), probes)
    else:
        routed = materialize(cell_routes(reps, centres(sample, min(-(-shards // FAN), len(sample) // 2)), total))
    visits = divided(routed) if total > MOST else routed.select("shard", F.lit(0).alias("part"), F.lit(0).alias("block"), F.when(F.col("own"), 0).otherwise(1).alias("role"), "item", "vec")

    def shard(frame: pd.DataFrame) -> pd.DataFrame:
        # role 0: indexed and searching, 1: only searching, 2: only indexed, for it searches in another block
        frame = frame.sort_values(["role", "item"], kind="stable", key=lambda c: c.map({0: 0, 2: 1, 1: 2}) if c.name == "role" else c)
        q, ids, role = _matrix(frame["vec"]), frame["item"].to_numpy(), frame["role"].to_numpy()
        n = int((role != 1).sum())
        rows = np.flatnonzero(role != 2)
        near, sim = vamana.neighbours(np.ascontiguousarray(q[:n]), q[rows], np.where(rows < n, rows, -1), k, degree, beam)
        row, col = np.nonzero(near >= 0)
        return pd.DataFrame({"rep": ids[rows[row]], "other": ids[near[row, col]], "similarity": sim[row, col].astype(float)})

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total * probes // TASK_ROWS))
    found = visits.repartition(tasks, "shard", "part", "block").groupBy("shard", "part", "block").applyInPandas(shard, "rep bigint, other bigint, similarity double")
    top = Window.partitionBy("rep").orderBy(F.desc("similarity"), "other")
    links = found.withColumn("_r", F.row_number().over(top)).filter(F.col("_r") <= k).drop("_r")
    # classes of one member, nearly all, need no more; the others bring their members in
    several = classes.filter(F.size("members") > 1)
    members = several.select(F.col("rep").alias("other"), F.col("members").alias("_members"))
    spread = links.join(members, "other", "left").select("rep", F.explode(F.coalesce("_members", F.array("other"))).alias("neighbour"), "similarity")
    own_class = several.select("rep", F.explode("members").alias("neighbour"), F.lit(1.0).alias("similarity"))
    joined = spread.unionAll(own_class)
    copies = stored.join(several.select("_h", "rep"), "_h").select(F.col("rep").alias("_rep"), "item").filter("item <> _rep")
    each = joined.withColumnRenamed("rep", "item").unionAll(joined.join(copies, F.col("rep") == F.col("_rep")).select("item", "neighbour", "similarity"))
    best = Window.partitionBy("item").orderBy(F.desc("similarity"), "neighbour")
    return each.filter("item <> neighbour").withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k).drop("_r")


def pairs(nearest: DataFrame) -> DataFrame:
    """``item_a, item_b``: the pairs, smaller id first, of which at least one lists the other."""
    return nearest.select(F.least("item", "neighbour").alias("item_a"), F.greatest("item", "neighbour").alias("item_b")).distinct()
