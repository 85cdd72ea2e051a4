"""Queries of the operators of this package, over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import materialize, table
from . import bpe, fusion, near_dup, packing, pii, reading, similar, sketches, splitting

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return similar.pairs(p1_nearest(spark, d))


def p1_nearest(spark: SparkSession, d: str) -> DataFrame:
    return similar.nearest(similar.items(table(spark, d, "product_documents"), table(spark, d, "embedding_batches")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return sketches.exceeding(table(spark, d, "latency_runs"), table(spark, d, "warm_targets"))


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    days = sketches.partial(table(spark, d, "latency_runs"), ["surface", "build", "measured_on"])
    return sketches.percentiles(sketches.merge(days, ["surface", "build"]), ["surface", "build"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_pieces(spark, d).filter("piece = 1").select("object_id")


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.pieces(table(spark, d, "product_documents"), table(spark, d, "embedding_profiles"))


def p3_totals(spark: SparkSession, d: str) -> DataFrame:
    """Of every document that is split: its tokens, those of all pieces but the repeated ones, and whether no piece exceeds the limit of its profile."""
    limits = splitting.oversized(table(spark, d, "product_documents"), table(spark, d, "embedding_profiles")).select("object_id", "max_input_tokens_per_input")
    within = F.min(F.col("n_tokens") <= F.col("max_input_tokens_per_input")).alias("within")
    return p3_pieces(spark, d).join(limits, "object_id").groupBy("object_id").agg(F.sum(F.col("n_tokens") - F.col("n_overlap")).alias("n_tokens"), within)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    text = near_dup.text_pairs(table(spark, d, "memory_store"), "memory_id", "text").select(F.lit("text").alias("field"), "key_a", "key_b")
    project = near_dup.spelling_pairs(table(spark, d, "memory_recalls"), "project").select(F.lit("project").alias("field"), "key_a", "key_b")
    return text.unionAll(project)


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_dup.groups(table(spark, d, "memory_store"), "memory_id", "text")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return fusion.agreed_first(table(spark, d, "hybrid_candidates"))


def p5_ranking(spark: SparkSession, d: str) -> DataFrame:
    return fusion.ranking(table(spark, d, "hybrid_candidates")).withColumn("combined", F.round("combined", 9))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """``key, text`` of memories and current documents; the key carries its table in front."""
    memories = table(spark, d, "memory_store").filter("memory_id is not null and text is not null").select(F.concat(F.lit("memory_store/"), "memory_id").alias("key"), "text")
    documents = table(spark, d, "product_documents").filter("object_id is not null")
    newest = documents.groupBy("object_id").agg(F.max(F.coalesce("version", F.lit(-1))).alias("_newest"))
    rows = documents.select("object_id", F.coalesce("version", F.lit(-1)).alias("_v"), "text").join(newest, "object_id").filter("_v = _newest and text is not null")
    return memories.unionAll(rows.select(F.concat(F.lit("product_documents/"), F.col("object_id").cast("string")).alias("key"), "text"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    texts = _texts(spark, d)
    found = pii.entities(texts, pii.model(texts, table(spark, d, "given_names")))
    at = F.instr("key", "/")
    return found.select(F.expr("substring_index(key, '/', 1)").alias("source_table"), F.col("key").substr(at + 1, F.length("key")).alias("item_key"), "pii_type", "pii_text")


def p6_redacted(spark: SparkSession, d: str) -> DataFrame:
    texts = _texts(spark, d)
    return pii.redacted(texts, pii.model(texts, table(spark, d, "given_names")))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents"), "doc_id", "text")


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    sizes = materialize(bpe.count(table(spark, d, "documents"), "doc_id", "text"))
    # the windows are a fixed table of few rows
    windows = table(spark, d, "context_windows").filter("window_id is not null and capacity_tokens >= 1").orderBy("window_id").collect()
    packed = [packing.pack(sizes, "doc_id", "n_tokens", w["capacity_tokens"]).withColumn("window_id", F.lit(w["window_id"])) for w in windows]
    return reduce(DataFrame.unionAll, packed).select("window_id", "container", "doc_id", "piece", F.col("start").alias("start_token"), F.col("n").alias("n_tokens"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Of every window: the documents laid into it, how many of them stand in it whole or in pieces without a gap, and whether no container is overfull."""
    packed = materialize(p8_pack(spark, d))
    limits = table(spark, d, "context_windows").select("window_id", "capacity_tokens")
    over = packed.filter("container is not null").groupBy("window_id", "container").agg(F.sum("n_tokens").alias("n")).join(limits, "window_id").groupBy("window_id").agg(F.max(F.col("n") > F.col("capacity_tokens")).alias("over"))
    each = packed.groupBy("window_id", "doc_id").agg(F.max(F.col("start_token") + F.col("n_tokens")).alias("end"), F.sum("n_tokens").alias("n"))
    whole = each.groupBy("window_id").agg(F.count("*").alias("documents"), F.sum((F.col("end") == F.col("n")).cast("bigint")).alias("complete"))
    return whole.join(over, "window_id").select("window_id", "documents", "complete", (~F.col("over")).alias("within"))


def p9_levels(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    texts, votes = reading.labelled(documents, table(spark, d, "reading_labels"))
    return reading.levels(documents, reading.fit(texts, votes))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_levels(spark, d).filter("p_demanding > 0.5").select("doc_id")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_nearest, p2_found, p2_percentiles, p3_found, p3_pieces, p3_totals, p4_found, p4_groups, p5_found, p5_ranking, p6_found, p6_redacted, p7_ids, p8_pack, p8_fill, p9_found, p9_levels)}


_SQUASHED = "0.5 * ln(CASE WHEN {c} IS NULL THEN 0.001 ELSE greatest(0.001, 1 / (1 + exp(least(700, -(CASE WHEN s_{c} > 0 THEN ({c} - m_{c}) / (1.4826 * s_{c}) ELSE 0 END))))) END)"

_SCORES = f"""WITH c AS (SELECT request_id, object_id, MAX(CASE WHEN isnan(lexical) THEN NULL ELSE lexical END) AS lexical, MAX(CASE WHEN isnan(vector) THEN NULL WHEN vector_metric IN ('squared_l2', 'negative_dot') THEN -vector ELSE vector END) AS vector FROM hybrid_candidates GROUP BY 1, 2),
m AS (SELECT request_id, quantile_disc(lexical, 0.5) AS m_lexical, quantile_disc(vector, 0.5) AS m_vector FROM c GROUP BY 1),
s AS (SELECT request_id, quantile_disc(abs(lexical - m_lexical), 0.5) AS s_lexical, quantile_disc(abs(vector - m_vector), 0.5) AS s_vector FROM c JOIN m USING (request_id) GROUP BY 1),
k AS (SELECT c.*, {_SQUASHED.format(c="lexical")} + {_SQUASHED.format(c="vector")} AS score FROM c JOIN m USING (request_id) JOIN s USING (request_id))"""

# where a result has an exact form in SQL; the others are held against brute force in the tests
ORACLES = {
    "p2_found": """WITH once AS (SELECT DISTINCT ON (run_id) * FROM latency_runs WHERE samples IS NOT NULL ORDER BY run_id),
s AS (SELECT surface, build, unnest(CASE WHEN warmup_excluded IS FALSE THEN samples[COALESCE(warmup_count, 0) + 1:] ELSE samples END) * CASE WHEN lower(unit) IN ('ns', 'nanosecond', 'nanoseconds') THEN 1 ELSE 1000 END AS v FROM once),
q AS (SELECT surface, build, quantile_disc(v, 0.5) AS a, quantile_disc(v, 0.99) AS b FROM s WHERE v >= 0 AND NOT isnan(v) GROUP BY 1, 2)
SELECT surface, build, 50 AS pct FROM q JOIN warm_targets USING (surface) WHERE a > p50 UNION ALL SELECT surface, build, 99 FROM q JOIN warm_targets USING (surface) WHERE b > p99""",
    "p3_found": r"""WITH now AS (SELECT DISTINCT ON (object_id) object_id, profile_id, text FROM product_documents ORDER BY object_id, version DESC)
SELECT object_id FROM now JOIN embedding_profiles USING (profile_id) WHERE len(regexp_extract_all(text, '[^ \t\r\n]+')) > max_input_tokens_per_input""",
    "p3_totals": r"""WITH now AS (SELECT DISTINCT ON (object_id) object_id, profile_id, text FROM product_documents ORDER BY object_id, version DESC), t AS (SELECT object_id, len(regexp_extract_all(text, '[^ \t\r\n]+')) AS n, max_input_tokens_per_input AS most FROM now JOIN embedding_profiles USING (profile_id))
SELECT object_id, n AS n_tokens, true AS within FROM t WHERE n > most""",
    "p8_fill": "SELECT window_id, (SELECT COUNT(*) FROM documents) AS documents, (SELECT COUNT(*) FROM documents) AS complete, true AS within FROM context_windows",
    "p5_found": _SCORES + """,
r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, object_id) AS b, rank() OVER (PARTITION BY request_id ORDER BY lexical DESC NULLS LAST) AS x, rank() OVER (PARTITION BY request_id ORDER BY vector DESC NULLS LAST) AS y FROM k)
SELECT request_id, object_id FROM r WHERE b = 1 AND x <= 3 AND y <= 3 AND lexical IS NOT NULL AND vector IS NOT NULL""",
    "p5_ranking": _SCORES + " SELECT request_id, object_id, lexical, vector, ROUND(exp(score), 9) AS combined FROM k",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
