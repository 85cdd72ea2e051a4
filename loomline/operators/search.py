"""Vector and hybrid search: exact top-k with abstention, rank fusion, and what follows the ranking."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vector as V
from ..functions.text import highlights, spread
from ..sources.tables import folder, materialize
from .documents import build_filter, document_sort, metrics, range_facet, terms_facet

K_RRF = 60


def vector_topk(df: DataFrame, key: str, column: str, query: list[float], k: int, metric: str = "cosine", allow: DataFrame | None = None, cutoff: float | None = None) -> DataFrame:
    """``doc, distance``: nearest first, ties by key. The cutoff applies after the candidate limit."""
    if allow is not None:
        df = df.join(allow, key, "left_semi")
    q = F.array(*[F.lit(float(x)) for x in query])
    got = df.select(F.col(key).alias("doc"), V.METRICS[metric](F.col(column), q).alias("distance")).filter(F.col("distance").isNotNull())
    top = got.orderBy("distance", "doc").limit(k)
    return top if cutoff is None else top.filter(F.col("distance") <= cutoff)


@dataclass
class Partitions:
    """Vectors stored by their nearest centre, one directory each, with every partition's radius and size."""

    spark: SparkSession
    path: str
    key: str
    column: str
    centres: list[list[float]]
    schema: T.StructType
    radius: dict[int, float]
    sizes: dict[int, int]

    def rows(self, parts: list[int]) -> DataFrame:
        """The rows of some partitions; the others are not read."""
        return self.spark.read.schema(self.schema).parquet(self.path).filter(F.col("part").isin(parts))


def partitioned(df: DataFrame, key: str, column: str, centres: list[list[float]], path: str | None = None) -> Partitions:
    """Store vectors by their nearest centre (ties to the first). One pass measures the distances; radii and sizes are one row per centre."""
    spark, path = df.sparkSession, path or folder(df.sparkSession)
    each = F.array(*[V.squared_l2(F.col(column), F.array(*[F.lit(float(x)) for x in c])) for c in centres])
    rows = df.withColumn("_d", each).withColumn("_near", F.array_min("_d")).withColumn("part", (F.array_position("_d", F.col("_near")) - 1).cast("int"))
    rows = rows.drop("_d")
    rows.filter("part >= 0").write.mode("overwrite").partitionBy("part").parquet(path)
    found = spark.read.schema(rows.schema).parquet(path).groupBy("part").agg(F.sqrt(F.max("_near")).alias("r"), F.count("*").alias("n")).collect()
    return Partitions(spark, path, key, column, centres, rows.schema, {r["part"]: r["r"] for r in found}, {r["part"]: r["n"] for r in found})


def _measured(rows: DataFrame, key: str, column: str, query: list[float], metric: str = "squared_l2") -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.select(F.col(key).alias("doc"), V.METRICS[metric](F.col(column), q).alias("distance")).filter(F.col("distance").isNotNull())


def _gap(a: list[float], b: list[float]) -> float:
    return sum((x - y) ** 2 for x, y in zip(a, b)) ** 0.5


def routed_topk(stored: Partitions, query: list[float], k: int) -> DataFrame:
    """``doc, distance`` (squared Euclidean) exactly as over all rows, reading only partitions that can hold a hit.

    A partition's radius bounds from below how near its vectors can be. The nearest partition gives the k-th distance
    (at most k rows are looked at for it), and every partition whose bound is not beyond it is read.
    """
    bound = {p: max(0.0, _gap(query, stored.centres[p]) - r) for p, r in stored.radius.items()}
    if not bound:
        return _measured(stored.rows([]), stored.key, stored.column, query).limit(0)
    near = min(bound, key=lambda p: (bound[p], p))
    first = _measured(stored.rows([near]), stored.key, stored.column, query).orderBy("distance", "doc").limit(k).agg(F.count("*").alias("n"), F.max("distance").alias("far")).first()
    wanted = [p for p, b in bound.items() if first["n"] < k or b * b <= first["far"] * (1 + 1e-9)]
    return _measured(stored.rows(wanted), stored.key, stored.column, query).orderBy("distance", "doc").limit(k)


def ann_topk(stored: Partitions, query: list[float], k: int, probes: int, allow: DataFrame | None = None) -> DataFrame:
    """``doc, distance``: the exact best of the ``probes`` nearest partitions, an approximation of those of all."""
    order = sorted(stored.radius, key=lambda p: (_gap(query, stored.centres[p]), p))
    rows = stored.rows(order[:probes])
    rows = rows if allow is None else rows.join(allow, stored.key, "left_semi")
    return _measured(rows, stored.key, stored.column, query).orderBy("distance", "doc").limit(k)


def adaptive_topk(stored: Partitions, query: list[float], k: int, threshold: int, probes: int, allow: DataFrame | None = None) -> DataFrame:
    """Exact while at most ``threshold`` vectors are eligible, else the approximate search."""
    eligible = sum(stored.sizes.values()) if allow is None else allow.limit(threshold + 1).count()
    return ann_topk(stored, query, k, len(stored.centres) if eligible <= threshold else probes, allow)


def statistics(docs: DataFrame, key: str, eligible: DataFrame, matched: DataFrame) -> DataFrame:
    """``total, eligible, matched``: counts of a search, in one row."""
    parts = docs.select(F.lit(1).alias("t"), F.lit(0).alias("e"), F.lit(0).alias("m")).unionAll(eligible.select(F.lit(0), F.lit(1), F.lit(0))).unionAll(matched.select(F.lit(0), F.lit(0), F.lit(1)))
    return parts.agg(F.sum("t").alias("total"), F.sum("e").alias("eligible"), F.sum("m").alias("matched"))


def enrich(docs: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Embeddings set where the text's digest is still the one they were made from; others stay as they are."""
    new = vectors.select(key, F.col("digest").alias("_d"), F.col("vector").alias("_v"))
    joined = docs.join(new, key, "left")
    same = F.col("_d") == F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    return joined.withColumn("vector", F.when(same, F.col("_v")).otherwise(F.col("vector"))).withColumn("enriched", F.coalesce(same, F.lit(False))).drop("_d", "_v")


def abstain(ranked: DataFrame, score: str, minimum: float, margin: float) -> DataFrame:
    """``outcome, doc, score``: the best hit, or why there is none (no_candidates, below_threshold, ambiguous)."""
    two = ranked.orderBy(F.desc(score), "doc").limit(2).agg(F.sort_array(F.collect_list(F.struct(F.col(score).alias("s"), (-F.col("doc")).alias("d"))), asc=False).alias("t"))
    first, second = F.get("t", F.lit(0)), F.get("t", F.lit(1))
    outcome = F.when(F.size("t") == 0, "no_candidates").when(first["s"] < minimum, "below_threshold").when(second.isNotNull() & (first["s"] - second["s"] < margin), "ambiguous").otherwise("match")
    return two.select(outcome.alias("outcome"), F.when(outcome == "match", -first["d"]).alias("doc"), first["s"].alias("score"))


def with_rank(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows with their rank from 1: a top-k first, so only those rows are numbered."""
    top = df.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def _branches(branches: list[tuple[DataFrame, float]]) -> DataFrame:
    parts = [df.select("doc", (F.lit(weight) * F.col("part")).alias("part")) for df, weight in branches]
    return reduce(DataFrame.unionAll, parts).groupBy("doc").agg(F.sum("part").alias("score"))


def rrf(branches: list[tuple[DataFrame, float]]) -> DataFrame:
    """``doc, score`` of branches ``doc, rank``: the sum of weight / (60 + rank). Ranks are taken as they are, with their gaps."""
    return _branches([(df.withColumn("part", 1.0 / (K_RRF + F.col("rank"))), w) for df, w in branches])


def rrf_nanos(branches: list[tuple[DataFrame, int]], explain: bool = False) -> DataFrame:
    """The same in whole billionths, each branch rounded down; ``explain`` adds ``parts``, branch, rank and score of each, in order of branch."""
    parts = []
    for i, (df, w) in enumerate(branches):
        nanos = F.floor(F.lit(w * 1_000_000_000) / (K_RRF + F.col("rank"))).cast("bigint")
        parts.append(df.select("doc", nanos.alias("part"), F.struct(F.lit(i).alias("branch"), "rank", nanos.alias("score")).alias("_e")))
    more = [F.array_sort(F.collect_list("_e")).alias("parts")] if explain else []
    return reduce(DataFrame.unionAll, parts).groupBy("doc").agg(F.sum("part").alias("score"), *more)


def weighted(lexical: DataFrame, vector: DataFrame, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Lexical scores over their best one, vector ones as 1 / (1 + distance)."""
    top = F.max("score").over(Window.partitionBy(F.lit(1)))
    return _branches([(lexical.withColumn("part", F.col("score") / top), weights[0]), (vector.withColumn("part", 1.0 / (1.0 + F.col("distance"))), weights[1])])


def relative(lexical: DataFrame, vector: DataFrame, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Both branches from 0 to 1 by their least and greatest value; 1 where these are equal."""
    w = Window.partitionBy(F.lit(1))

    def scaled(c: Column) -> Column:
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        return F.when(hi > lo, (c - lo) / (hi - lo)).otherwise(F.lit(1.0))

    return _branches([(lexical.withColumn("part", scaled(F.col("score"))), weights[0]), (vector.withColumn("part", scaled(-F.col("distance"))), weights[1])])


def rerank(ranked: DataFrame, given: DataFrame, maximum: int = 256) -> DataFrame:
    """``doc, rank``: hits with a given score first, by that score, then the others as they were. More than ``maximum`` given scores are refused."""
    if given.limit(maximum + 1).count() > maximum:
        raise ValueError(f"more than {maximum} given scores")
    joined = ranked.join(F.broadcast(given.select("doc", F.col("score").alias("_given"))), "doc", "left")
    order = [F.col("_given").desc_nulls_last(), F.when(F.col("_given").isNotNull(), F.col("doc")).asc_nulls_last(), F.col("rank")]
    return joined.withColumn("rank", F.row_number().over(Window.orderBy(*order))).drop("_given")


def first_per_parent(ranked: DataFrame, parent: str, k: int) -> DataFrame:
    """At most ``k`` hits per parent, in rank order; hits without a parent all stay."""
    n = F.row_number().over(Window.partitionBy(parent).orderBy("rank"))
    return ranked.withColumn("_n", n).filter(F.col(parent).isNull() | (F.col("_n") <= k)).drop("_n")


def autocut(ranked: DataFrame, jumps: int) -> DataFrame:
    """The hits before the ``jumps``-th jump: a strict local maximum of the fall of the normalised score below a straight line.

    The last hit is a maximum if it lies above both of the two before it. One hit, or equal first and last scores, stay whole.
    """
    w, every = Window.orderBy("rank"), Window.partitionBy(F.lit(1))
    first, last, n = F.min_by("score", "rank").over(every), F.max_by("score", "rank").over(every), F.count("*").over(every)
    fall = F.when(last != first, (F.col("score") - first) / (last - first) - (F.row_number().over(w) - 1) / (n - 1))
    rows = ranked.withColumn("_d", fall).withColumn("_i", F.row_number().over(w)).withColumn("_n", n)
    before, behind = F.col("_d") > F.lag("_d").over(w), F.col("_d") > F.lead("_d").over(w)
    peak = F.when(F.col("_i") == F.col("_n"), (F.col("_n") > 2) & before & (F.col("_d") > F.lag("_d", 2).over(w))).otherwise(before & behind)
    counted = rows.withColumn("_p", F.sum(F.when(peak, 1).otherwise(0)).over(w))
    return counted.filter(F.col("_p") < jumps).drop("_d", "_i", "_n", "_p")


def window(ranked: DataFrame, offset: int, limit: int) -> DataFrame:
    if offset + limit > 1024:
        raise ValueError("offset + limit is at most 1024")
    return ranked.filter((F.col("rank") > offset) & (F.col("rank") <= offset + limit))


_nfkc = spread(lambda t: unicodedata.normalize("NFKC", t) if t is not None else None, T.StringType())


def scoped(memories: DataFrame, project: str, now: int, kind: str | None = None, layer: str | None = None) -> DataFrame:
    """Live memories of a project, in any spelling that NFKC makes the same, and of the global scope."""
    plain = F.when(F.col("project").rlike("^[\\x00-\\x7f]*$"), F.col("project")).otherwise(_nfkc("project"))
    got = memories.filter(F.col("expires_at_micros").isNull() | (F.col("expires_at_micros") > now))
    got = got.filter(F.col("kind") == kind) if kind else got
    got = got.filter(F.col("layer") == layer) if layer else got
    return got.withColumn("_p", plain).filter(F.col("_p").isin(unicodedata.normalize("NFKC", project), "_global")).drop("_p")


def branches_of(mode: str, vector: bool) -> tuple[bool, bool]:
    """Whether a recall has a lexical and a vector branch; without a vector every mode is lexical."""
    if mode not in ("lexical", "hybrid", "semantic"):
        raise ValueError(f"no mode {mode}")
    return mode != "semantic" or not vector, mode != "lexical" and vector


def content_id(columns: list[str]) -> Column:
    """The same content has the same id."""
    return F.sha2(F.concat_ws("\0", *[F.coalesce(F.col(c), F.lit("")) for c in columns]), 256)


def session_cover(ranked: DataFrame, session: str, most: int = 8) -> DataFrame:
    """The first hit of up to ``most`` sessions moves to the head, the rest keep their order."""
    first = F.row_number().over(Window.partitionBy(session).orderBy("rank")) == 1
    rows = ranked.withColumn("_f", first & F.col(session).isNotNull())
    rows = rows.withColumn("_h", F.col("_f") & (F.sum(F.col("_f").cast("int")).over(Window.orderBy("rank")) <= most))
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("_h"), "rank"))).drop("_f", "_h")


@dataclass
class Request:
    """A composed search. Branches are ``doc, score`` (lexical) and ``doc, distance`` (vectors), at most ``candidates`` of each count."""

    lexical: DataFrame | None = None
    vectors: list[DataFrame] = field(default_factory=list)
    weights: tuple[float, ...] = ()
    candidates: int = 100
    fusion: str = "rrf"
    filter: dict | None = None
    sort: list[tuple[str, bool, bool]] = field(default_factory=list)
    facets: list[str] = field(default_factory=list)
    range_facets: dict[str, list[tuple[float | None, float | None]]] = field(default_factory=dict)
    metrics: list[str] = field(default_factory=list)
    rerank: DataFrame | None = None
    parent: str | None = None
    first_k: int = 1
    autocut: int | None = None
    offset: int = 0
    limit: int = 10
    highlight: tuple[str, list[str]] | None = None


@dataclass
class Result:
    """``hits``: the documents' columns with ``doc, score, rank`` (and ``fragments``), and what was counted over the candidates."""

    hits: DataFrame
    facets: dict[str, DataFrame]
    range_facets: dict[str, DataFrame]
    metrics: dict[str, DataFrame]
    statistics: DataFrame


MOST_HITS, MOST_WINDOW, MOST_CANDIDATES = 1024, 1024, 10_000


def compose(docs: DataFrame, key: str, request: Request) -> Result:
    """Filter, branches, fusion, sort and facets, rerank, first per parent, autocut, offset, limit, highlight, in this order.

    Lexical ranks are those before the filter, with the gaps it leaves; vector ranks are those among the eligible. Without
    branches every eligible document is a candidate of score 0. Facets and metrics are over all candidates; autocut sees the
    window only, and none where a sort is given. Ties go to the smaller id. Branches are bounded, so what follows the fusion is small.
    """
    if request.offset + request.limit > MOST_WINDOW or request.candidates > MOST_CANDIDATES or (request.autocut or 0) > 16 or request.first_k > 100:
        raise ValueError("a request beyond its bounds")
    eligible = docs.filter(build_filter(request.filter)) if request.filter else docs
    names = eligible.select(F.col(key).alias("doc"))
    branches, lexical = [], None
    if request.lexical is not None:
        lexical = with_rank(request.lexical, [F.desc("score"), F.col("doc")], request.candidates)
        branches.append(lexical.join(names, "doc", "left_semi"))
    for near in request.vectors:
        branches.append(with_rank(near.join(names, "doc", "left_semi"), [F.col("distance"), F.col("doc")], request.candidates))
    weights = list(request.weights) or [1.0] * len(branches)
    if not branches:
        fused = names.withColumn("score", F.lit(0.0))
    else:
        fused = _branches([(b.withColumn("part", _part(b, request.fusion, lexical)), w) for b, w in zip(branches, weights)])
    candidates = fused.join(eligible, F.col("doc") == F.col(key))
    candidates = materialize(candidates)
    facets = {f: terms_facet(candidates, f) for f in request.facets}
    ranges = {f: range_facet(candidates, f, r) for f, r in request.range_facets.items()}
    counted = {f: metrics(candidates, f) for f in request.metrics}
    order = [*document_sort(candidates, [(F.col(c), down, first) for c, down, first in request.sort], "doc")] if request.sort else [F.desc("score"), F.col("doc")]
    window_ = request.offset + request.limit
    hits = with_rank(candidates, order, MOST_HITS if request.parent or request.rerank is not None else window_)
    if request.rerank is not None:
        hits = rerank(hits, request.rerank)
    if request.parent:
        hits = first_per_parent(hits, request.parent, request.first_k)
    hits = hits.withColumn("rank", F.row_number().over(Window.orderBy("rank"))).filter(F.col("rank") <= window_)
    if request.autocut and not request.sort:
        hits = autocut(hits, request.autocut)
    hits = window(hits, request.offset, request.limit)
    if request.highlight:
        column, terms = request.highlight
        hits = hits.withColumn("fragments", spread(lambda t: highlights(t, terms), T.ArrayType(T.StringType()))(F.col(column)))
    return Result(hits, facets, ranges, counted, statistics(docs, key, eligible, candidates))


def _part(branch: DataFrame, fusion: str, lexical: DataFrame | None) -> Column:
    """A branch's share of the fused score, before its weight."""
    every = Window.partitionBy(F.lit(1))
    if fusion == "rrf":
        return 1.0 / (K_RRF + F.col("rank"))
    value = F.col("score") if "score" in branch.columns else -F.col("distance")
    if fusion == "weighted":
        return F.col("score") / F.max("score").over(every) if "score" in branch.columns else 1.0 / (1.0 + F.col("distance"))
    if fusion != "relative":
        raise ValueError(f"no fusion {fusion}")
    low, high = F.min(value).over(every), F.max(value).over(every)
    return F.when(high > low, (value - low) / (high - low)).otherwise(F.lit(1.0))


def recall(collections: dict[str, tuple[DataFrame, DataFrame]], limit: int, candidates: int = 100) -> DataFrame:
    """``collection, doc, score`` of up to three collections of scored rows ``doc, score`` and live documents ``doc``.

    Only live documents are candidates, before the branch is cut, so ranks have no gaps; each collection is fused by itself,
    and all are merged by score, collection and id.
    """
    if not 1 <= len(collections) <= 3 or limit > 64 or candidates > 1000:
        raise ValueError("1 to 3 collections, 64 results, 1,000 candidates")
    found = []
    for name, (scored, live) in collections.items():
        ranked = with_rank(scored.join(live.select("doc"), "doc", "left_semi"), [F.desc("score"), F.col("doc")], candidates)
        found.append(ranked.select(F.lit(name).alias("collection"), "doc", (1.0 / (K_RRF + F.col("rank"))).alias("score")))
    return reduce(DataFrame.unionAll, found).orderBy(F.desc("score"), "collection", "doc").limit(limit)
