"""Queries of the engine's operators over the test tables, and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions import vector as V
from ..operators import documents as D
from ..operators import evaluation as E
from ..operators import keyspace as K
from ..operators import lexical as L
from ..operators import relational as R
from ..operators import search as S
from ..sources.tables import table
from ..streaming import ingest
from .sql import Engine

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
PROBE = [0.1 if i % 3 == 0 else -0.05 if i % 3 == 1 else 0.02 for i in range(64)]
_PROBE_SQL = "[" + ", ".join(map(str, PROBE)) + "]::DOUBLE[]"


def query(sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


_stored: dict[tuple[str, str, str], object] = {}


def stored(spark: SparkSession, d: str, name: str, make: Callable[[], object]):
    """What is written once per session and read by several queries."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _stored:
        _stored[key] = make()
    return _stored[key]


def engine(spark: SparkSession, d: str) -> Engine:
    e = Engine(spark)
    keys = {"orders": ["o_orderkey"], "customer": ["c_custkey"], "nation": ["n_nationkey"], "region": ["r_regionkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "events": ["event_id"], "warm_targets": ["surface"]}
    for name, key in keys.items():
        e.register(name, table(spark, d, name), key)
    # re-delivered rows count once
    e.register("ledger", table(spark, d, "ledger").dropDuplicates(["tenant", "sequence_no"]), ["tenant", "sequence_no"], unique={"by_sequence": ["sequence_no"]})
    e.relations["orders"].indexes = {"by_status": ["o_orderstatus"], "by_priority": ["o_orderpriority"], "by_customer": ["o_custkey"]}
    e.relations["nation"].indexes = {"by_region": ["n_regionkey"]}
    e.relations["events"].indexes = {"by_value": ["value"], "by_type_value": ["event_type", "value"]}
    return e


def dialect(name: str, sql: str, oracle: str | None = None, args: list | None = None) -> None:
    """A query in the engine's SQL; the oracle is the same text unless its meaning differs in the other system."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return engine(spark, d).execute(sql, args)

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = oracle or sql


_LEDGER = "(SELECT DISTINCT tenant, sequence_no, amount, booked_at FROM ledger) ledger"

# scans, predicates, order and limits
dialect("sql_pk_lookup", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 77")
dialect("sql_parameters", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = ?", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 12", [12])
dialect("sql_secondary_lookup", "SELECT * FROM nation WHERE n_regionkey = 2 LIMIT 100")
dialect("sql_intersection", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
dialect("sql_range_scan", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 200 LIMIT 50", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 200 ORDER BY o_orderkey LIMIT 50")
dialect("sql_prefix_scan", "SELECT tenant, sequence_no, amount FROM ledger WHERE tenant = 't-055' LIMIT 40", f"SELECT tenant, sequence_no, amount FROM {_LEDGER} WHERE tenant = 't-055' ORDER BY sequence_no LIMIT 40")
dialect("sql_prefix_range", "SELECT tenant, sequence_no FROM ledger WHERE tenant = 't-055' AND sequence_no > 300 LIMIT 40", f"SELECT tenant, sequence_no FROM {_LEDGER} WHERE tenant = 't-055' AND sequence_no > 300 ORDER BY sequence_no LIMIT 40")
dialect("sql_desc_scan", "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 25")
dialect("sql_offset", "SELECT p_partkey, p_brand FROM part ORDER BY p_partkey LIMIT 10 OFFSET 37")
dialect("sql_alias", "SELECT r_regionkey AS id, r_name AS label FROM region LIMIT 10")
dialect("sql_like", "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%_1%' AND c_name NOT LIKE '%9' LIMIT 100000")
dialect("sql_in_null", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (1, 3, NULL, 7) LIMIT 100")
dialect("sql_not_in_null", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (1, NULL) LIMIT 100")
dialect("sql_between", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 100000 AND 101000 OR o_totalprice NOT BETWEEN 2000 AND 499000 LIMIT 1000000")
dialect("sql_kleene", "SELECT tenant, sequence_no, amount FROM ledger WHERE NOT (amount > 0 OR tenant = 't-001') LIMIT 1000000", f"SELECT tenant, sequence_no, amount FROM {_LEDGER} WHERE NOT (amount > 0 OR tenant = 't-001')")
dialect("sql_is_null", "SELECT tenant, sequence_no FROM ledger WHERE amount IS NULL LIMIT 1000000", f"SELECT tenant, sequence_no FROM {_LEDGER} WHERE amount IS NULL")
dialect("sql_row_compare", "SELECT tenant, sequence_no FROM ledger WHERE (tenant, sequence_no) > ('t-050', 500) LIMIT 60", f"SELECT tenant, sequence_no FROM {_LEDGER} WHERE tenant > 't-050' OR (tenant = 't-050' AND sequence_no > 500) ORDER BY tenant, sequence_no LIMIT 60")
# joins
dialect("sql_join_inner", "SELECT orders.o_orderkey, customer.c_name FROM orders JOIN customer ON orders.o_custkey = customer.c_custkey WHERE orders.o_orderstatus = 'F'", """SELECT o_orderkey AS "orders.o_orderkey", c_name AS "customer.c_name" FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'""")
dialect("sql_join_bounded", "SELECT supplier.s_suppkey, nation.n_name FROM supplier JOIN nation ON supplier.s_nationkey = nation.n_nationkey LIMIT 20", """SELECT s_suppkey AS "supplier.s_suppkey", n_name AS "nation.n_name" FROM supplier JOIN nation ON s_nationkey = n_nationkey ORDER BY s_suppkey LIMIT 20""")
dialect("sql_join_left_filter", "SELECT nation.n_name AS nation, region.r_name AS region FROM nation JOIN region ON nation.n_regionkey = region.r_regionkey WHERE nation.n_nationkey > 10 LIMIT 100", "SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey > 10")
dialect("sql_join_secondary_left", "SELECT orders.o_orderkey AS id, customer.c_name AS name FROM orders JOIN customer ON orders.o_custkey = customer.c_custkey WHERE orders.o_orderpriority = '1-URGENT' LIMIT 30", "SELECT o_orderkey AS id, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderkey LIMIT 30")


@query("SELECT a.sequence_no AS id, a.amount AS amount FROM (SELECT DISTINCT tenant, sequence_no, amount FROM ledger) a JOIN (SELECT DISTINCT tenant, sequence_no, amount FROM ledger) b ON a.tenant = b.tenant AND a.sequence_no = b.sequence_no WHERE a.tenant = 't-055'")
def sql_join_composite(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d)
    e.register("copy", e.relation("ledger").df, ["tenant", "sequence_no"])
    return e.execute("SELECT ledger.sequence_no AS id, copy.amount AS amount FROM ledger JOIN copy ON ledger.tenant = copy.tenant AND ledger.sequence_no = copy.sequence_no WHERE ledger.tenant = 't-055'")


# aggregates, windows, CTE
dialect("agg_total", "SELECT COUNT(*) AS n, COUNT(amount) AS present, SUM(amount) AS total, MIN(amount) AS low, MAX(amount) AS high FROM ledger", f"SELECT COUNT(*) AS n, COUNT(amount) AS present, CAST(SUM(amount) AS DECIMAL(38,0)) AS total, MIN(amount) AS low, MAX(amount) AS high FROM {_LEDGER}")
dialect("agg_group_limit", "SELECT tenant, COUNT(*) AS n, SUM(amount) AS total FROM ledger GROUP BY tenant LIMIT 30", f"SELECT tenant, COUNT(*) AS n, CAST(SUM(amount) AS DECIMAL(38,0)) AS total FROM {_LEDGER} GROUP BY tenant ORDER BY tenant NULLS FIRST LIMIT 30")
dialect("agg_having_hidden", "SELECT o_orderpriority, COUNT(*) AS n FROM orders GROUP BY o_orderpriority HAVING MAX(o_totalprice) > 1000 AND n > 10 LIMIT 100", "SELECT o_orderpriority, COUNT(*) AS n FROM orders GROUP BY o_orderpriority HAVING MAX(o_totalprice) > 1000 AND COUNT(*) > 10")
dialect("agg_group_order", "SELECT event_type, COUNT(*) AS n, MIN(event_id) AS first FROM events GROUP BY event_type ORDER BY COUNT(*) DESC, event_type LIMIT 3", "SELECT event_type, COUNT(*) AS n, MIN(event_id) AS first FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 3")
dialect("distinct_first_seen", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders LIMIT 8", "SELECT o_orderstatus, o_orderpriority FROM orders GROUP BY 1, 2 ORDER BY MIN(o_orderkey) LIMIT 8")
dialect("win_row_number", "SELECT tenant, ROW_NUMBER() OVER (PARTITION BY tenant ORDER BY sequence_no) AS rn, sequence_no FROM ledger ORDER BY tenant, sequence_no LIMIT 200", f"SELECT tenant, ROW_NUMBER() OVER (PARTITION BY tenant ORDER BY sequence_no) AS rn, sequence_no FROM {_LEDGER} ORDER BY tenant, sequence_no LIMIT 200")
dialect("win_rank", "SELECT o_orderkey, RANK() OVER (ORDER BY o_orderkey) AS r FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 10", "SELECT o_orderkey, RANK() OVER (ORDER BY o_orderkey) AS r FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 10")
dialect("distinct_desc_offset", "SELECT DISTINCT o_orderpriority FROM orders ORDER BY o_orderkey DESC LIMIT 3 OFFSET 1", "SELECT o_orderpriority FROM orders GROUP BY 1 ORDER BY MAX(o_orderkey) DESC LIMIT 3 OFFSET 1")
dialect("sql_secondary_range", "SELECT event_id, value FROM events WHERE value >= 100 AND value < 130 ORDER BY value, event_id LIMIT 40", "SELECT event_id, value FROM events WHERE value >= 100 AND value < 130 ORDER BY value, event_id LIMIT 40")
dialect("sql_secondary_prefix_range", "SELECT event_id, event_type, value FROM events WHERE event_type = 'click' AND value > 50 ORDER BY event_type, value, event_id DESC LIMIT 40".replace(" DESC", ""), "SELECT event_id, event_type, value FROM events WHERE event_type = 'click' AND value > 50 ORDER BY value, event_id LIMIT 40")
dialect("cte_bounded", "WITH late AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 900 LIMIT 30) SELECT o_custkey FROM late LIMIT 100", "WITH late AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 900 ORDER BY o_orderkey LIMIT 30) SELECT o_custkey FROM late")


@query("SELECT o_orderkey, RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS r FROM orders")
def win_rank_all(spark: SparkSession, d: str) -> DataFrame:
    """Ranks with ties, beyond the dialect: over every customer's orders."""
    return R.numbered(table(spark, d, "orders"), ["o_custkey"], ["o_orderpriority"], "r", rank=True).select("o_orderkey", "r")


@query("SELECT l_returnflag, COUNT(*) AS n, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS quantity, ROUND(AVG(l_discount), 6) AS discount, MAX(l_shipdate)::DATE AS last FROM lineitem GROUP BY 1")
def agg_lineitem(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("quantity"), F.round(F.avg("l_discount"), 6).alias("discount"), F.max("l_shipdate").cast("date").alias("last"))


@query("SELECT l_linestatus, ROUND(AVG(l_extendedprice), 4) AS mean FROM lineitem GROUP BY 1")
def agg_avg_decimal(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_linestatus").agg(F.round(F.avg(F.col("l_extendedprice").cast("decimal(12,2)")).cast("double"), 4).alias("mean"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 1234 ORDER BY o_orderkey LIMIT 100")
def cursor_page(spark: SparkSession, d: str) -> DataFrame:
    return R.page(table(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], [1234], 100)


@query("SELECT COUNT(*) AS n FROM orders")
def scan_budget(spark: SparkSession, d: str) -> DataFrame:
    """A total under a budget: it holds no rows, so it is over the whole table, however many rows there are."""
    return Engine(spark, 1_048_576).register("orders", table(spark, d, "orders"), ["o_orderkey"]).execute("SELECT COUNT(*) AS n FROM orders")


@query("SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1")
def dml_unique(spark: SparkSession, d: str) -> DataFrame:
    return R.unique_violations(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT s_suppkey FROM supplier WHERE NOT (s_acctbal >= 0)")
def dml_check(spark: SparkSession, d: str) -> DataFrame:
    return R.check_violations(table(spark, d, "supplier"), F.col("s_acctbal") >= 0).select("s_suppkey")


@query("SELECT o_orderkey FROM orders o WHERE o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c_nationkey < 20)")
def dml_foreign_key(spark: SparkSession, d: str) -> DataFrame:
    return R.foreign_key_violations(table(spark, d, "orders"), table(spark, d, "customer").filter("c_nationkey < 20"), ["o_custkey"], ["c_custkey"]).select("o_orderkey")


@query("SELECT sequence_no FROM ledger WHERE amount IS NULL OR tenant IS NULL")
def dml_not_null(spark: SparkSession, d: str) -> DataFrame:
    return R.not_null_violations(table(spark, d, "ledger"), ["amount", "tenant"]).select("sequence_no")


@query("SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN 'renamed' ELSE n_name END AS n_name, n_regionkey FROM nation")
def dml_replace(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation")
    return R.upsert(nation, nation.filter("n_nationkey < 5").withColumn("n_name", F.lit("renamed")), ["n_nationkey"])


@query("SELECT * FROM nation WHERE n_regionkey <> 1")
def dml_delete(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation")
    return R.delete(nation, nation.filter("n_regionkey = 1"), ["n_nationkey"])


# document values
@query("SELECT o_orderpriority AS value, COUNT(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def facet_terms(spark: SparkSession, d: str) -> DataFrame:
    return D.terms_facet(table(spark, d, "orders").filter("o_orderstatus = 'O'"), "o_orderpriority")


@query("SELECT * FROM (SELECT 0 AS ordinal, COUNT(*) FILTER (p_retailprice < 1000) AS n FROM part UNION ALL SELECT 1, COUNT(*) FILTER (p_retailprice >= 1000 AND p_retailprice < 1500) FROM part UNION ALL SELECT 2, COUNT(*) FILTER (p_retailprice >= 1200) FROM part UNION ALL SELECT 3, COUNT(*) FILTER (p_retailprice >= 900000) FROM part)")
def facet_range(spark: SparkSession, d: str) -> DataFrame:
    return D.range_facet(table(spark, d, "part"), "p_retailprice", [(None, 1000), (1000, 1500), (1200, None), (900_000, None)])


@query("SELECT COUNT(amount) AS n, CAST(SUM(amount) AS BIGINT) AS total, MIN(amount) AS low, MAX(amount) AS high, ROUND(AVG(amount), 6) AS mean FROM ledger")
def metric_aggs(spark: SparkSession, d: str) -> DataFrame:
    return D.metrics(table(spark, d, "ledger"), "amount").withColumn("mean", F.round("mean", 6))


@query("SELECT sequence_no, tenant FROM ledger WHERE NOT COALESCE(amount > 1000, false) AND (COALESCE(tenant IN ('t-001', 't-055'), false) OR COALESCE(tenant LIKE '%-06%', false))")
def dv_not_missing(spark: SparkSession, d: str) -> DataFrame:
    tree = {"op": "and", "of": [{"op": "not", "of": {"op": "gt", "field": "amount", "value": 1000}}, {"op": "or", "of": [{"op": "in", "field": "tenant", "value": ["t-001", "t-055"]}, {"op": "like", "field": "tenant", "value": "%-06%"}]}]}
    return table(spark, d, "ledger").filter(D.build_filter(tree)).select("sequence_no", "tenant")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50 ORDER BY k DESC NULLS LAST, event_id LIMIT 100")
def doc_filter_sort(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "events").select("event_id", F.parse_json("props").alias("doc")).withColumn("k", D.at_path("doc", "$.k", "bigint"))
    got = docs.filter(D.false_if_missing(F.col("k") >= 50))
    return got.orderBy(*D.document_sort(got, [(F.col("k"), True, False)], "event_id")).limit(100).select("event_id", "k")


@query("SELECT CASE WHEN event_id % 3 = 0 THEN 0 WHEN event_id % 3 = 1 THEN 1 ELSE 2 END AS state, COUNT(*) AS n FROM events GROUP BY 1")
def doc_group_missing_vs_null(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("event_id") % 3 == 0, "{}").when(F.col("event_id") % 3 == 1, '{"k": null}').otherwise(F.col("props"))
    docs = table(spark, d, "events").select(F.parse_json(text).alias("doc"))
    return docs.groupBy(D.path_state("doc", "$.k").alias("state")).agg(F.count("*").alias("n"))


@query("SELECT CAST(json_extract(props, '$.k') AS VARCHAR) AS g0, COUNT(*) AS n, CAST(SUM(CAST(json_extract(props, '$.k') AS BIGINT)) AS DECIMAL(38,0)) AS total FROM events GROUP BY 1")
def doc_group_metrics(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "events").select(F.parse_json("props").alias("doc"))
    return D.group_documents(docs, "doc", ["$.k"], {"total": "$.k"})


@query("SELECT event_id, k FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) WHERE k >= 20 AND k <> 31 AND (k < 60 OR (k = 60 AND event_id > 100)) ORDER BY k DESC, event_id LIMIT 50")
def doc_query_page(spark: SparkSession, d: str) -> DataFrame:
    """The page behind a cursor of a filtered and sorted document query."""
    docs = table(spark, d, "events").select("event_id", F.parse_json("props").alias("doc"))
    node = {"op": "and", "of": [{"op": "ge", "path": "$.k", "value": 20}, {"op": "ne", "path": "$.k", "value": 31}]}
    page = D.query_documents(docs, "event_id", "doc", node, [("$.k", True, False)], [(3, 60.0, None), 100], 50)
    return page.select("event_id", D.at_path("doc", "$.k", "bigint").alias("k"))


@query("SELECT event_id, value FROM events WHERE value > 100 OR (value = 100 AND event_id > 5) ORDER BY value, event_id LIMIT 50")
def doc_cursor_page(spark: SparkSession, d: str) -> DataFrame:
    return R.page(table(spark, d, "events").select("event_id", "value"), ["value", "event_id"], [100.0, 5], 50)


@query("SELECT event_id FROM events WHERE starts_with(event_type, 's') OR contains(props, '77')")
def doc_prefix_contains(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").filter(D.build_filter({"op": "or", "of": [{"op": "prefix", "field": "event_type", "value": "s"}, {"op": "contains", "field": "props", "value": "77"}]})).select("event_id")


# keyspace
_LAST = "SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1"


@query(_LAST)
def ks_string_latest(spark: SparkSession, d: str) -> DataFrame:
    return K.last_write(table(spark, d, "events"), ["user_id"], "event_id", ["event_type", "value"])


@query("SELECT user_id, CAST(SUM(CAST(floor(value) AS BIGINT)) AS BIGINT) AS value FROM events GROUP BY 1")
def ks_counter(spark: SparkSession, d: str) -> DataFrame:
    return K.counters(table(spark, d, "events").withColumn("delta", F.floor("value")), "user_id", "delta", "event_id")


@query("SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events WHERE user_id > 7 GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 60")
def ks_hash_scan(spark: SparkSession, d: str) -> DataFrame:
    fields = K.last_write(table(spark, d, "events"), ["user_id", "event_type"], "event_id", ["value"])
    return K.scan(fields.filter("user_id > 7"), ["user_id", "event_type"], None, 60)


@query("SELECT user_id, event_id AS member, value AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) - 1 AS rank FROM events) WHERE rank <= 9")
def ks_zrange(spark: SparkSession, d: str) -> DataFrame:
    scores = table(spark, d, "events").select("user_id", F.col("event_id").alias("member"), F.col("value").alias("score"))
    return K.zrange(scores, "user_id", "score", "member", 0, 9)


@query("SELECT user_id, event_id AS member, value AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id DESC) - 1 AS rank, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE rank >= n - 3")
def ks_zrevrange_tail(spark: SparkSession, d: str) -> DataFrame:
    scores = table(spark, d, "events").select("user_id", F.col("event_id").alias("member"), F.col("value").alias("score"))
    return K.zrange(scores, "user_id", "score", "member", -3, -1, reverse=True)


@query("SELECT event_id AS member, value AS score FROM events WHERE value >= 10 AND value < 12 ORDER BY value, event_id LIMIT 30 OFFSET 5")
def ks_zscore_range(spark: SparkSession, d: str) -> DataFrame:
    scores = table(spark, d, "events").select(F.col("event_id").alias("member"), F.col("value").alias("score"))
    return K.zrange_by_score(scores, "score", "member", 10, 12, (True, False), 5, 30)


@query("SELECT user_id, list_slice(list(event_id ORDER BY event_id), -5, -2)[1] AS first, len(list_slice(list(event_id ORDER BY event_id), -5, -2)) AS n FROM events GROUP BY 1")
def ks_lrange(spark: SparkSession, d: str) -> DataFrame:
    lists = K.static_list(table(spark, d, "events"), "user_id", "event_id", "event_id").select("user_id", K.lrange(F.col("items"), -5, -2).alias("c"))
    return lists.select("user_id", F.get("c", F.lit(0)).alias("first"), F.size("c").alias("n"))


@query("(SELECT user_id FROM events WHERE event_type = 'view' UNION SELECT user_id FROM events WHERE event_type = 'error') EXCEPT SELECT user_id FROM events WHERE value > 200")
def ks_setops(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    some = R.union_sets(e.filter("event_type = 'view'").select("user_id"), e.filter("event_type = 'error'").select("user_id"))
    return R.subtract_sets(some, e.filter("value > 200").select("user_id"))


@query("SELECT user_id FROM events WHERE event_type = 'view' AND value > 100 INTERSECT SELECT user_id FROM events WHERE event_type = 'click' AND value > 100")
def ks_sinter(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").filter("value > 100")
    return R.intersect_sets(e.filter("event_type = 'view'").select("user_id"), e.filter("event_type = 'click'").select("user_id"))


@query("SELECT user_id, id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS id FROM events) WHERE id BETWEEN 3 AND 6")
def ks_stream_range(spark: SparkSession, d: str) -> DataFrame:
    return K.xadd(table(spark, d, "events"), "user_id", "event_id").filter(F.col("id").between(3, 6)).select("user_id", "id", "event_id")


_SEED = K.splitmix64(42)


@query(f"SELECT user_id, event_type AS member FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type) - 1 AS r, count(*) OVER (PARTITION BY user_id) AS n FROM (SELECT DISTINCT user_id, event_type FROM events)) WHERE r = ({_SEED}::HUGEINT % n)")
def ks_spop(spark: SparkSession, d: str) -> DataFrame:
    return K.srandmember(table(spark, d, "events").withColumnRenamed("event_type", "member"), "user_id", "member", 42, 1).select("user_id", "member")


@query("SELECT memory_id, CASE WHEN expires_at_micros IS NULL THEN 'persistent' WHEN expires_at_micros > 1750000000000000 THEN 'remaining' ELSE 'missing' END AS state, CASE WHEN expires_at_micros > 1750000000000000 THEN expires_at_micros - 1750000000000000 END AS remaining FROM memory_store")
def ks_ttl(spark: SparkSession, d: str) -> DataFrame:
    return K.ttl(table(spark, d, "memory_store"), "expires_at_micros", 1_750_000_000_000_000).select("memory_id", "state", "remaining")


@query("SELECT memory_id FROM memory_store WHERE expires_at_micros IS NULL OR expires_at_micros > 1750000000000000")
def ks_live(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "memory_store").filter(K.visible(F.col("expires_at_micros"), 1_750_000_000_000_000)).select("memory_id")


@query("SELECT c_custkey, hex(encode('éü' || c_name)[2:7]) AS part, hex(encode(c_name || 'ñ')[-4:-2]) AS tail FROM customer")
def ks_getrange(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of names with characters of two bytes; cuts fall inside these."""
    c = table(spark, d, "customer")
    first, last = F.concat(F.lit("éü"), F.col("c_name")), F.concat(F.col("c_name"), F.lit("ñ"))
    return c.select("c_custkey", F.hex(K.getrange(first, 1, 6)).alias("part"), F.hex(K.getrange(last, -4, -2)).alias("tail"))


@query("SELECT memory_id FROM (SELECT memory_id, row_number() OVER (ORDER BY expires_at_micros, memory_id) AS r FROM (SELECT DISTINCT memory_id, expires_at_micros FROM memory_store) WHERE expires_at_micros <= 1750000000000000) WHERE r <= 100")
def ks_due(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "memory_store").select("memory_id", "expires_at_micros").distinct()
    return K.due(rows, "expires_at_micros", 1_750_000_000_000_000, ["memory_id"], 100).select("memory_id")


@query("SELECT user_id, pos, event_type, value FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (VALUES (0, 'click'), (1, 'none'), (2, 'view'), (3, 'click')) w(pos, event_type) LEFT JOIN (SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2) f USING (user_id, event_type)")
def ks_hmget(spark: SparkSession, d: str) -> DataFrame:
    fields = K.last_write(table(spark, d, "events"), ["user_id", "event_type"], "event_id", ["value"])
    return K.hash_get(fields, ["user_id"], "event_type", "value", ["click", "none", "view", "click"])


@query("SELECT user_id, COUNT(*) AS live FROM (SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2) WHERE value > 20 GROUP BY 1")
def ks_hlen(spark: SparkSession, d: str) -> DataFrame:
    """Live fields of each hash; a field's value stands for its expiry."""
    fields = K.last_write(table(spark, d, "events"), ["user_id", "event_type"], "event_id", ["value"])
    return fields.filter(K.visible(F.col("value"), 20)).groupBy("user_id").agg(F.count("*").alias("live"))


_LOG = "SELECT CAST(user_id AS VARCHAR) AS key, event_id AS seq, event_type, value, row_number() OVER w AS i FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)"


def _log(spark: SparkSession, d: str, family: str, op: Column, arg: Column, value: Column) -> DataFrame:
    """The events as operations on their user's key, which is created before all of them."""
    e = table(spark, d, "events")
    key, none = F.col("user_id").cast("string").alias("key"), F.lit(None).cast("string")
    first = e.select("user_id").distinct().select(key, F.lit(-1).cast("bigint").alias("seq"), F.lit("create").alias("op"), F.lit(family).alias("arg"), none.alias("value"), F.lit(0).cast("bigint").alias("at"))
    return first.unionAll(e.select(key, F.col("event_id").cast("bigint"), op, arg, value, F.lit(0).cast("bigint")))


@query(f"SELECT seq, CAST(i AS VARCHAR) AS result FROM ({_LOG})")
def ks_list_push(spark: SparkSession, d: str) -> DataFrame:
    """Pushes on both ends answer the new length."""
    log = _log(spark, d, "list", F.when(F.col("event_id") % 2 == 0, "lpush").otherwise("rpush"), F.lit(None).cast("string"), F.col("event_type"))
    return K.replay(log).filter("seq >= 0").select("seq", "result")


@query(f"SELECT seq, lag(event_type) OVER (PARTITION BY key, event_type ORDER BY seq) IS NULL AS changed FROM ({_LOG})")
def ks_set_add(spark: SparkSession, d: str) -> DataFrame:
    return K.replay(_log(spark, d, "set", F.lit("sadd"), F.lit(None).cast("string"), F.col("event_type"))).filter("seq >= 0").select("seq", "changed")


@query(f"SELECT seq, CAST(CAST(SUM(floor(value)) OVER (PARTITION BY key, event_type ORDER BY seq) AS BIGINT) AS VARCHAR) AS result FROM ({_LOG})")
def ks_hash_incr(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d, "hash", F.lit("hincrby"), F.col("event_type"), F.floor("value").cast("string"))
    return K.replay(log).filter("seq >= 0").select("seq", "result")


@query(f"SELECT seq, CAST(CAST(SUM(floor(value)) OVER (PARTITION BY key, event_type ORDER BY seq) AS BIGINT) AS VARCHAR) || '.0' AS result FROM ({_LOG})")
def ks_zset_incr(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d, "zset", F.lit("zincrby"), F.col("event_type"), F.floor("value").cast("string"))
    return K.replay(log).filter("seq >= 0").select("seq", "result")


@query(f"SELECT key, r - 1 AS place, CAST(seq AS VARCHAR) || '=' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || '.0' AS result FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY floor(value), CAST(seq AS VARCHAR)) AS r FROM ({_LOG})) WHERE r <= 3")
def ks_zpop(spark: SparkSession, d: str) -> DataFrame:
    """Three pops of the least member after all have been added; ties go by the bytes of the member."""
    log = _log(spark, d, "zset", F.lit("zadd"), F.col("event_id").cast("string"), F.floor("value").cast("string"))
    pops = log.filter("op = 'create'").select("key", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("i"), "at")
    pops = pops.select("key", (F.lit(1 << 50) + F.col("i")).alias("seq"), F.lit("zpopmin").alias("op"), F.lit(None).cast("string").alias("arg"), F.lit(None).cast("string").alias("value"), "at")
    return K.replay(log.unionByName(pops)).filter(F.col("seq") >= 1 << 50).filter("result is not null").select("key", (F.col("seq") - (1 << 50)).alias("place"), "result")


@query(f"SELECT seq, CASE WHEN i % 3 = 0 THEN 'missing' ELSE CAST(10 - i % 3 AS VARCHAR) END AS result FROM ({_LOG})")
def ks_expire(spark: SparkSession, d: str) -> DataFrame:
    """Each third event finds the key gone: every event sets it anew, it expires ten ticks later, and is asked for its time left."""
    e = K.xadd(table(spark, d, "events"), "user_id", "event_id")
    steps = F.array(*[F.struct(F.lit(op).alias("op"), F.lit(n).alias("n")) for n, op in enumerate(("set", "expire", "ttl"))])
    at = F.when((F.col("s.op") == "ttl") & (F.col("id") % 3 == 0), 10).when(F.col("s.op") == "ttl", F.col("id") % 3).otherwise(0).cast("bigint")
    log = e.select(F.col("user_id").cast("string").alias("key"), "event_id", "id", F.explode(steps).alias("s"))
    log = log.select("key", (F.col("event_id") * 4 + F.col("s.n")).cast("bigint").alias("seq"), F.col("s.op").alias("op"), F.lit(None).cast("string").alias("arg"), F.lit("10").alias("value"), at.alias("at"))
    return K.replay(log).filter("seq % 4 = 2").select(F.expr("seq div 4").alias("seq"), "result")


@query(f"SELECT seq, CAST(SUM(octet_length(encode('é' || event_type))) OVER (PARTITION BY key ORDER BY seq) AS VARCHAR) AS result FROM ({_LOG})")
def ks_append(spark: SparkSession, d: str) -> DataFrame:
    """Appends answer the length in bytes."""
    log = _log(spark, d, "hash", F.lit("append"), F.lit(None).cast("string"), F.concat(F.lit("é"), F.col("event_type"))).filter("op <> 'create'")
    return K.replay(log).select("seq", "result")


@query(f"SELECT seq, CAST(i AS VARCHAR) AS result FROM ({_LOG})")
def ks_xadd(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d, "stream", F.lit("xadd"), F.lit('["type"]'), F.col("event_type"))
    return K.replay(log).filter("seq >= 0").select("seq", "result")


@query("SELECT event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 AS changed FROM events")
def ks_setnx_replay(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), F.lit("setnx").alias("op"), F.lit(None).cast("string").alias("arg"), "event_type", F.lit(0).cast("bigint").alias("at")).withColumnRenamed("event_type", "value")
    return K.replay(log).select("seq", "changed")


@query("SELECT user_id, CAST(COUNT(DISTINCT event_type) AS BIGINT) AS n FROM events GROUP BY 1")
def ks_cardinality(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id", "event_type").distinct().groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '^C.*[1-4].$')")
def ks_glob(spark: SparkSession, d: str) -> DataFrame:
    # the glob C*[1-4]? ; a byte glob becomes one anchored pattern
    return table(spark, d, "customer").filter(F.col("c_name").rlike("(?s)^" + X.glob_regex(b"C*[1-4]?").pattern.decode().replace("\\Z", "\\z"))).select("c_custkey")


@query("WITH v AS (SELECT c_name, row_number() OVER (ORDER BY c_name) AS n FROM customer WHERE c_name > 'Customer#000000100') SELECT c_name, regexp_matches(c_name, '^.*[1-3]5$') AS match, n = 300 AS last FROM v WHERE n <= 300 AND (regexp_matches(c_name, '^.*[1-3]5$') OR (n = 300 AND (SELECT COUNT(*) FROM v) > 300))")
def ks_scan_match(spark: SparkSession, d: str) -> DataFrame:
    return K.scan_match(table(spark, d, "customer").select("c_name"), ["c_name"], "c_name", b"*[1-3]5", ["Customer#000000100"], 1000, 300)


# vectors
@query(f"SELECT vec_id AS doc, ROUND(1 - list_cosine_similarity(embedding::DOUBLE[], {_PROBE_SQL}), 9) AS distance FROM embeddings ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], {_PROBE_SQL}), vec_id LIMIT 10")
def vec_exact_cosine(spark: SparkSession, d: str) -> DataFrame:
    return S.vector_topk(table(spark, d, "embeddings"), "vec_id", "embedding", PROBE, 10).withColumn("distance", F.round("distance", 9))


@query(f"SELECT vec_id AS doc, ROUND(pow(list_distance(embedding::DOUBLE[], {_PROBE_SQL}), 2), 9) AS distance FROM embeddings ORDER BY pow(list_distance(embedding::DOUBLE[], {_PROBE_SQL}), 2), vec_id LIMIT 10")
def vec_exact_l2(spark: SparkSession, d: str) -> DataFrame:
    return S.vector_topk(table(spark, d, "embeddings"), "vec_id", "embedding", PROBE, 10, "squared_l2").withColumn("distance", F.round("distance", 9))


@query(f"SELECT vec_id AS doc, ROUND(-list_dot_product(embedding::DOUBLE[], {_PROBE_SQL}), 9) AS distance FROM embeddings ORDER BY -list_dot_product(embedding::DOUBLE[], {_PROBE_SQL}), vec_id LIMIT 10")
def vec_exact_dot(spark: SparkSession, d: str) -> DataFrame:
    return S.vector_topk(table(spark, d, "embeddings"), "vec_id", "embedding", PROBE, 10, "negative_dot").withColumn("distance", F.round("distance", 9))


@query(f"SELECT vec_id AS doc FROM (SELECT vec_id, 1 - list_cosine_similarity(embedding::DOUBLE[], {_PROBE_SQL}) AS x FROM embeddings WHERE label IN (1, 2) ORDER BY x, vec_id LIMIT 40) WHERE x <= 0.95")
def vec_filtered_cutoff(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return S.vector_topk(e, "vec_id", "embedding", PROBE, 40, allow=e.filter("label in (1, 2)").select("vec_id"), cutoff=0.95).select("doc")


@query(f"WITH s AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], {_PROBE_SQL}) AS x, row_number() OVER (ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_PROBE_SQL}) DESC, vec_id) AS r FROM embeddings) SELECT CASE WHEN a.x < 0.1 THEN 'below_threshold' WHEN a.x - b.x < 0.0001 THEN 'ambiguous' ELSE 'match' END AS outcome, ROUND(a.x, 9) AS score FROM s a, s b WHERE a.r = 1 AND b.r = 2")
def vec_abstain(spark: SparkSession, d: str) -> DataFrame:
    q = F.array(*[F.lit(x) for x in PROBE])
    ranked = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), V.scaled_cosine(F.col("embedding"), q).alias("score"))
    return S.abstain(ranked, "score", 0.1, 0.0001).select("outcome", F.round("score", 9).alias("score"))


_Q15 = "list_transform({v}, lambda x: CAST(round(x * 32767) AS HUGEINT))"
_NANOS = f"""WITH p AS (SELECT vec_id, {_Q15.format(v="embedding::DOUBLE[]")} AS a, {_Q15.format(v=_PROBE_SQL)} AS b FROM embeddings),
q AS (SELECT vec_id, list_sum(list_transform(list_zip(a, b), lambda x: x[1] * x[2]))::HUGEINT AS d, list_sum(list_transform(a, lambda x: x * x))::HUGEINT * list_sum(list_transform(b, lambda x: x * x))::HUGEINT AS n FROM p),
r AS (SELECT vec_id, d, n, CAST(floor(sqrt(n::DOUBLE)) AS HUGEINT) AS g FROM q), t AS (SELECT vec_id, d, CASE WHEN g * g > n THEN g - 1 WHEN (g + 1) * (g + 1) <= n THEN g + 1 ELSE g END AS root FROM r),
s AS (SELECT vec_id, CAST(sign(d) * least((abs(d) * 1000000000 + root // 2) // root, 1000000000) AS BIGINT) AS nanos FROM t)"""


def _nanos(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", V.q15_cosine_nanos(V.q15(F.col("embedding")), V.q15(F.array(*[F.lit(x) for x in PROBE]))).alias("nanos"))


@query(_NANOS + " SELECT vec_id, nanos FROM s")
def vec_integer_cosine(spark: SparkSession, d: str) -> DataFrame:
    return _nanos(spark, d)


@query(_NANOS + ", k AS (SELECT *, row_number() OVER (ORDER BY nanos DESC, vec_id) AS r FROM s) SELECT CASE WHEN a.nanos < 100000000 THEN 'below_threshold' WHEN a.nanos - b.nanos < 1000 THEN 'ambiguous' ELSE 'match' END AS outcome, a.nanos AS score FROM k a, k b WHERE a.r = 1 AND b.r = 2")
def vec_q15_retrieve(spark: SparkSession, d: str) -> DataFrame:
    """The best hit by whole numbers, or why there is none."""
    return S.abstain(_nanos(spark, d).select(F.col("vec_id").alias("doc"), F.col("nanos").alias("score")), "score", 100_000_000, 1000).select("outcome", "score")


_RANGE = "(SELECT MIN(list_min(embedding))::DOUBLE AS lo, MAX(list_max(embedding))::DOUBLE AS hi FROM embeddings)"


@query(f"SELECT vec_id, ROUND(list_sum(list_transform(list_zip(list_transform(embedding::DOUBLE[], lambda x: greatest(0, least(255, round((x - lo) / (hi - lo) * 255)))), list_transform({_PROBE_SQL}, lambda x: greatest(0, least(255, round((x - lo) / (hi - lo) * 255))))), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) * pow((hi - lo) / 255, 2), 9) AS distance FROM embeddings, {_RANGE}")
def vec_quantized(spark: SparkSession, d: str) -> DataFrame:
    """Distances of 8-bit codes over the range of all elements (one row reaches the driver)."""
    e = table(spark, d, "embeddings")
    low, high = V.sq8_range([tuple(e.agg(F.min(F.array_min("embedding")).cast("double"), F.max(F.array_max("embedding")).cast("double")).first())])
    codes = V.sq8(F.col("embedding"), low, high)
    return e.select("vec_id", F.round(V.sq8_squared_l2(codes, V.sq8(F.array(*[F.lit(x) for x in PROBE]), low, high), low, high), 9).alias("distance"))


@query("SELECT vec_id, ROUND(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding[1:32]::DOUBLE[], embedding[1:32]::DOUBLE[])), 9) AS first FROM embeddings")
def vec_truncated(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.round(V.normalized(F.col("embedding"), 32)[0], 9).alias("first"))


def _partitions(spark: SparkSession, d: str) -> S.Partitions:
    """The vectors by centre, stored once per session."""

    def make() -> S.Partitions:
        e = table(spark, d, "embeddings")
        return S.partitioned(e, "vec_id", "embedding", [list(r["embedding"]) for r in e.orderBy("vec_id").limit(12).collect()])

    return stored(spark, d, "partitions", make)


@query(f"SELECT vec_id AS doc, ROUND(pow(list_distance(embedding::DOUBLE[], {_PROBE_SQL}), 2), 9) AS distance FROM embeddings ORDER BY pow(list_distance(embedding::DOUBLE[], {_PROBE_SQL}), 2), vec_id LIMIT 10")
def vec_routed(spark: SparkSession, d: str) -> DataFrame:
    return S.routed_topk(_partitions(spark, d), PROBE, 10).withColumn("distance", F.round("distance", 9))


@query(f"SELECT vec_id AS doc, ROUND(pow(list_distance(embedding::DOUBLE[], {_PROBE_SQL}), 2), 9) AS distance FROM embeddings WHERE label = 1 ORDER BY 2, vec_id LIMIT 10")
def vec_adaptive(spark: SparkSession, d: str) -> DataFrame:
    """Few eligible vectors are searched exactly."""
    allow = table(spark, d, "embeddings").filter("label = 1").select("vec_id")
    return S.adaptive_topk(_partitions(spark, d), PROBE, 10, 1_000_000, 3, allow).withColumn("distance", F.round("distance", 9))


@query(f"WITH c AS (SELECT embedding::DOUBLE[] AS c, row_number() OVER (ORDER BY vec_id) - 1 AS p FROM embeddings QUALIFY p < 12), a AS (SELECT vec_id, any_value(embedding)::DOUBLE[] AS e, arg_min(p, list_distance(embedding::DOUBLE[], c)) AS p FROM embeddings, c GROUP BY 1), n AS (SELECT p FROM c ORDER BY list_distance(c, {_PROBE_SQL}), p LIMIT 4) SELECT vec_id AS doc, ROUND(pow(list_distance(e, {_PROBE_SQL}), 2), 9) AS distance FROM a WHERE p IN (SELECT p FROM n) ORDER BY 2, 1 LIMIT 10")
def vec_ann(spark: SparkSession, d: str) -> DataFrame:
    """The approximate search over the nearest partitions; its recall is measured in the tests."""
    return S.ann_topk(_partitions(spark, d), PROBE, 10, 4).withColumn("distance", F.round("distance", 9))


# lexical search. The oracle tokenises with a plain pattern, so what it scores are ASCII texts: the distinct recall requests.
_SCORED = r"""WITH docs AS (SELECT recall_id AS doc, regexp_extract_all(lower(query), '[a-z0-9]+') AS t FROM (SELECT DISTINCT recall_id, query FROM memory_recalls) WHERE query IS NOT NULL),
s AS (SELECT COUNT(*) AS n, AVG(len(t)) AS a FROM docs), words AS (SELECT doc, len(t) AS l, unnest(t) AS term FROM docs),
tf AS (SELECT doc, term, any_value(l) AS l, COUNT(*) AS f FROM words WHERE {where} GROUP BY 1, 2), df AS (SELECT term, COUNT(*) AS df FROM tf GROUP BY 1)
SELECT doc, ROUND(SUM(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / a))), 9) AS score FROM tf JOIN df USING (term), s GROUP BY 1"""


def _requests(spark: SparkSession, d: str) -> L.Index:
    docs = table(spark, d, "memory_recalls").filter("query is not null").select("recall_id", "query").dropDuplicates(["recall_id"])
    return stored(spark, d, "requests", lambda: L.index(docs, "recall_id", "query"))


@query(_SCORED.format(where="term IN ('vector', 'graph', 'on', 'the')"))
def bm25_scores(spark: SparkSession, d: str) -> DataFrame:
    return L.bm25(_requests(spark, d), "Vector graph on the graph").select("doc", F.round("score", 9).alias("score"))


@query(_SCORED.format(where="term = 'schema' OR starts_with(term, 're')"))
def lex_prefix_scores(spark: SparkSession, d: str) -> DataFrame:
    ix = _requests(spark, d)
    return L.score_terms(ix, dict.fromkeys(L.prefix_terms(ix, "schema re"), 1)).select("doc", F.round("score", 9).alias("score"))


@query(_SCORED.format(where="levenshtein(term, 'grahp') <= 2"))
def lex_fuzzy_scores(spark: SparkSession, d: str) -> DataFrame:
    ix = _requests(spark, d)
    return L.score_terms(ix, dict.fromkeys(L.fuzzy_terms(ix, "grahp", 2), 1)).select("doc", F.round("score", 9).alias("score"))


@query(r"WITH d AS (SELECT DISTINCT recall_id AS doc, regexp_extract_all(lower(query), '[a-z0-9]+') AS t, query FROM memory_recalls WHERE query IS NOT NULL), m AS (SELECT doc, list_contains(t, 'the') AS must, regexp_matches(lower(query), '(^|[^a-z0-9])on the($|[^a-z0-9])') AS a, regexp_matches(lower(query), '(^|[^a-z0-9])wri') AS b, list_contains(t, 'vector') AS bad FROM d) SELECT doc, (1 + a::INT + b::INT)::DOUBLE AS score FROM m WHERE must AND NOT bad")
def lex_boolean_scores(spark: SparkSession, d: str) -> DataFrame:
    tree = {"boolean": {"must": [{"term": "the"}], "should": [{"phrase": "on the"}, {"prefix": "wri"}], "must_not": [{"term": "vector"}]}}
    return L.compound(_requests(spark, d), tree)


@query(r"SELECT DISTINCT recall_id AS doc, 0.0::DOUBLE AS score FROM memory_recalls WHERE query IS NOT NULL AND NOT list_contains(regexp_extract_all(lower(query), '[a-z0-9]+'), 'the')")
def lex_must_not(spark: SparkSession, d: str) -> DataFrame:
    """Documents without any of the clauses' terms match a query that only forbids."""
    return L.compound(_requests(spark, d), {"boolean": {"must_not": [{"term": "the"}]}})


def _documents(spark: SparkSession, d: str, **filters: bool) -> L.Index:
    """The index over all documents with a text."""
    docs = table(spark, d, "documents").filter("text is not null")
    return stored(spark, d, f"documents {sorted(filters)}", lambda: L.index(docs, "doc_id", "text", **filters))


@query("SELECT COUNT(*) AS n FROM documents WHERE text IS NOT NULL")
def lex_index(spark: SparkSession, d: str) -> DataFrame:
    """Analyses all documents and stores their postings; the other lexical queries read these."""
    return _documents(spark, d).documents.agg(F.count("*").alias("n"))


# what NFKC and case folding do to the characters that the documents hold
_NORMAL = "translate(replace(replace(replace(lower(nfc_normalize({c})), '½', '1⁄2'), 'ß', 'ss'), 'ﬁ', 'fi'), '０１２３４５６７８９', '0123456789')"
_WORDS = r"WITH docs AS (SELECT doc_id AS doc, regexp_extract_all(@, '[\p{L}\p{N}]+') AS t FROM documents WHERE text IS NOT NULL)".replace("@", _NORMAL.format(c="text"))
_RANKED = _WORDS + """, s AS (SELECT COUNT(*) AS n, AVG(len(t)) AS a FROM docs), words AS (SELECT doc, len(t) AS l, unnest(t) AS term FROM docs),
tf AS (SELECT doc, term, any_value(l) AS l, COUNT(*) AS f FROM words WHERE {where} GROUP BY 1, 2), df AS (SELECT term, COUNT(*) AS df FROM tf GROUP BY 1)
SELECT doc, ROUND(SUM(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / a))), 9) AS score FROM tf JOIN df USING (term), s GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {limit}"""


def _ranked(where: str, limit: int) -> str:
    return _RANKED.replace("{where}", where).replace("{limit}", str(limit))


def _first(scored: DataFrame, n: int) -> DataFrame:
    return scored.select("doc", F.round("score", 9).alias("score")).orderBy(F.desc("score"), "doc").limit(n)


@query(_ranked("term IN ('appellate', 'tribunal', 'burden', 'of', 'substantiation')", 10))
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _first(L.bm25(_documents(spark, d), "appellate tribunal burden of substantiation"), 10)


@query(_WORDS + " SELECT doc FROM docs WHERE list_has_all(t, ['judge', 'dog', 'farmer'])")
def lex_and(spark: SparkSession, d: str) -> DataFrame:
    return L.bm25(_documents(spark, d), "judge dog farmer", minimum=3).select("doc")


@query(_WORDS + " SELECT doc FROM docs WHERE len(list_intersect(t, ['judge', 'dog', 'farmer'])) >= 2")
def lex_min_match(spark: SparkSession, d: str) -> DataFrame:
    return L.bm25(_documents(spark, d), "judge dog farmer", minimum=2).select("doc")


@query(_WORDS + " SELECT doc FROM docs WHERE contains(' ' || list_aggregate(t, 'string_agg', ' ') || ' ', ' two boxes ')")
def lex_phrase(spark: SparkSession, d: str) -> DataFrame:
    return L.phrase(_documents(spark, d), "two boxes")


@query(_ranked("term = 'burden' OR starts_with(term, 'substan')", 20))
def lex_prefix(spark: SparkSession, d: str) -> DataFrame:
    ix = _documents(spark, d)
    return _first(L.score_terms(ix, dict.fromkeys(L.prefix_terms(ix, "burden substan"), 1)), 20)


@query(_ranked("levenshtein(term, 'tribumal') <= 1", 20))
def lex_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    ix = _documents(spark, d)
    return _first(L.score_terms(ix, dict.fromkeys(L.fuzzy_terms(ix, "tribumal", 1), 1)), 20)


@query(_WORDS + ", m AS (SELECT doc, list_contains(t, 'judge') AS must, list_contains(t, 'bank') AS bad, contains(' ' || list_aggregate(t, 'string_agg', ' ') || ' ', ' two boxes ') AS a, contains(' ' || list_aggregate(t, 'string_agg', ' '), ' farm') AS b FROM docs) SELECT doc, (1 + a::INT + b::INT)::DOUBLE AS score FROM m WHERE must AND NOT bad")
def lex_boolean(spark: SparkSession, d: str) -> DataFrame:
    tree = {"boolean": {"must": [{"term": "judge"}], "should": [{"phrase": "two boxes"}, {"prefix": "farm"}], "must_not": [{"term": "bank"}]}}
    return L.compound(_documents(spark, d), tree)


_STOPPED = "list_filter(regexp_extract_all({c}, '[\\p{L}\\p{N}]+'), lambda x: x NOT IN ({w}))"
_TITLE_WORDS, _TEXT_WORDS = (_STOPPED.replace("{c}", _NORMAL.format(c=c)).replace("{w}", ", ".join(f"'{w}'" for w in X.STOP_WORDS)) for c in ("COALESCE(seat, '')", "text"))
_BM25F = f"""WITH f AS (SELECT doc_id AS doc, 0 AS field, {_TITLE_WORDS} AS t FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, 1, {_TEXT_WORDS} FROM documents WHERE text IS NOT NULL),
a AS (SELECT field, AVG(len(t)) AS a FROM f GROUP BY 1), n AS (SELECT COUNT(*) // 2 AS n FROM f), w AS (SELECT doc, field, len(t) AS l, unnest(t) AS term FROM f),
tf AS (SELECT doc, field, term, any_value(l) AS l, COUNT(*) AS c FROM w WHERE term IN ('court', 'bellhaven', 'tribunal') GROUP BY 1, 2, 3), df AS (SELECT term, COUNT(DISTINCT doc) AS df FROM tf GROUP BY 1),
x AS (SELECT doc, term, SUM(CASE WHEN field = 0 THEN 2.0 ELSE 1.0 END::DOUBLE * c / (0.25::DOUBLE + 0.75::DOUBLE * l / a) ORDER BY field) AS tf FROM tf JOIN a USING (field) GROUP BY 1, 2)
SELECT doc, CAST(SUM(CAST(round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2) * 1e9) AS BIGINT)) AS BIGINT) AS score_nanos FROM x JOIN df USING (term), n GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""


def _titled(spark: SparkSession, d: str) -> L.Index:
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", "text", F.col("seat").alias("title"))
    return stored(spark, d, "titled", lambda: L.index(docs, "doc_id", ["title", "text"], stop=True))


@query(_BM25F)
def bm25f_topk(spark: SparkSession, d: str) -> DataFrame:
    got = L.bm25f(_titled(spark, d), {"title": 2_000_000, "text": 1_000_000}, "court of Bellhaven tribunal")
    return got.orderBy(F.desc("score_nanos"), "doc").limit(10)


@query(_BM25F.replace("SELECT doc, CAST(SUM(CAST(round(", "SELECT 'match' AS outcome, doc, string_agg(term || ':' || df || ':' || CAST(round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2) * 1e9) AS BIGINT), ',' ORDER BY term) AS terms, CAST(SUM(CAST(round(").replace("GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", "GROUP BY 2 ORDER BY 4 DESC, 2 LIMIT 10"))
def bm25f_retrieve(spark: SparkSession, d: str) -> DataFrame:
    """The best documents with the score of each term, or why there is none."""
    got = L.bm25f_retrieve(_titled(spark, d), {"title": 2_000_000, "text": 1_000_000}, "court of Bellhaven tribunal", 10)
    each = F.transform("terms", lambda t: F.concat_ws(":", t["term"], t["df"].cast("string"), t["score_nanos"].cast("string")))
    return got.select("outcome", "doc", F.array_join(each, ",").alias("terms"), "score_nanos")


@query()
def lex_stop_stem(spark: SparkSession, d: str) -> DataFrame:
    ix = _documents(spark, d, fold=True, stop=True, stemmed=True)
    return _first(L.bm25(ix, "the farmers selling boxes", k1=1.2, b=0.6), 10)


@query(_SCORED.format(where="term IN ('vector', 'graph', 'the')").replace("f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / a))", "f * 1.8 / (f + 0.8 * (0.6 + 0.4 * l / a)) * CASE term WHEN 'graph' THEN 2 ELSE 1 END"))
def lex_flat_scores(spark: SparkSession, d: str) -> DataFrame:
    """Terms given twice count twice."""
    return L.bm25(_requests(spark, d), "vector graph the graph", k1=0.8, b=0.4, distinct=False).select("doc", F.round("score", 9).alias("score"))


@query("WITH d AS (SELECT DISTINCT recall_id, query, mode FROM memory_recalls) SELECT COUNT(*) AS total, COUNT(*) FILTER (mode = 'lexical') AS eligible, COUNT(*) FILTER (mode = 'lexical' AND list_contains(regexp_extract_all(lower(query), '[a-z0-9]+'), 'graph')) AS matched FROM d")
def search_statistics(spark: SparkSession, d: str) -> DataFrame:
    every = table(spark, d, "memory_recalls").select("recall_id", "query", "mode").dropDuplicates(["recall_id"])
    eligible = every.filter("mode = 'lexical'")
    matched = L.bm25(_requests(spark, d), "graph").join(eligible.select(F.col("recall_id").alias("doc")), "doc", "left_semi")
    return S.statistics(every, "recall_id", eligible, matched)


def _flat(spark: SparkSession, d: str) -> L.Index:
    """Requests in chunks of four words, by the flat rule for tokens; a chunk is known by its request and place."""
    docs = table(spark, d, "memory_recalls").filter("query is not null").select("recall_id", "query").dropDuplicates(["recall_id"])
    words = F.filter(F.split(F.trim("query"), "\\s+"), lambda w: w != "")
    at = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(words) / 4).cast("int") - 1))
    chunks = docs.select("recall_id", F.posexplode(F.transform(at, lambda i: F.array_join(F.slice(words, i * 4 + 1, 4), " "))).alias("i", "chunk"))
    return stored(spark, d, "chunks", lambda: L.index(chunks.filter("chunk <> ''").select(F.concat_ws("/", F.col("recall_id").cast("string"), F.col("i").cast("string")).alias("id"), "chunk"), "id", "chunk", flat=True))


@query(r"""WITH q AS (SELECT DISTINCT recall_id, list_filter(regexp_split_to_array(trim(query), '\s+'), lambda w: w <> '') AS w FROM memory_recalls WHERE query IS NOT NULL),
docs AS (SELECT recall_id AS parent, i, regexp_extract_all(lower(array_to_string(w[i * 4 + 1:i * 4 + 4], ' ')), '[a-z0-9'']+') AS t FROM (SELECT recall_id, w, unnest(range(0, CAST(ceil(len(w) / 4.0) AS BIGINT))) AS i FROM q)),
s AS (SELECT COUNT(*) AS n, AVG(len(t)) AS a FROM docs), words AS (SELECT parent, i, len(t) AS l, unnest(t) AS term FROM docs), tf AS (SELECT parent, i, term, any_value(l) AS l, COUNT(*) AS f FROM words WHERE term IN ('graph', 'vector') GROUP BY 1, 2, 3), df AS (SELECT term, COUNT(*) AS df FROM tf GROUP BY 1),
c AS (SELECT parent, i, SUM(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 1.8 / (f + 0.8 * (0.6 + 0.4 * l / a)) * CASE term WHEN 'graph' THEN 2 ELSE 1 END ORDER BY term) AS score FROM tf JOIN df USING (term), s GROUP BY 1, 2)
SELECT parent, ROUND(MAX(score), 9) AS score FROM c GROUP BY 1""")
def chunk_rank(spark: SparkSession, d: str) -> DataFrame:
    """Requests ranked by their best chunk; a term given twice counts twice."""
    hits = L.bm25(_flat(spark, d), "graph vector graph", k1=0.8, b=0.4, distinct=False)
    best = L.best_chunk(hits, hits.select("doc", F.substring_index("doc", "/", 1).cast("bigint").alias("parent")))
    return best.select("parent", F.round("score", 9).alias("score"))


# fusion and what follows it
def _lexical_rank(spark: SparkSession, d: str) -> DataFrame:
    return S.with_rank(table(spark, d, "events").filter("event_type <> 'view'").select(F.col("event_id").alias("doc"), F.col("value").alias("score"), "user_id"), [F.desc("score"), F.col("doc")], 200)


def _vector_rank(spark: SparkSession, d: str) -> DataFrame:
    near = table(spark, d, "events").filter("event_type <> 'click'").select(F.col("event_id").alias("doc"), F.abs(F.col("value") - 300).alias("distance"))
    return S.with_rank(near, [F.col("distance"), F.col("doc")], 200)


_BRANCHES = "WITH l AS (SELECT event_id AS doc, value AS score, user_id, row_number() OVER (ORDER BY value DESC, event_id) AS r FROM events WHERE event_type <> 'view' QUALIFY r <= 200), v AS (SELECT event_id AS doc, abs(value - 300) AS distance, row_number() OVER (ORDER BY abs(value - 300), event_id) AS r FROM events WHERE event_type <> 'click' QUALIFY r <= 200)"


@query(_BRANCHES + " SELECT doc, ROUND(SUM(p), 9) AS score FROM (SELECT doc, 1.0::DOUBLE / (60 + r) AS p FROM l UNION ALL SELECT doc, 0.5::DOUBLE / (60 + r) FROM v) GROUP BY 1")
def fuse_rrf(spark: SparkSession, d: str) -> DataFrame:
    return S.rrf([(_lexical_rank(spark, d), 1.0), (_vector_rank(spark, d), 0.5)]).select("doc", F.round("score", 9).alias("score"))


@query(_BRANCHES + " SELECT doc, CAST(SUM(p) AS BIGINT) AS score FROM (SELECT doc, 1000000000 // (60 + r) AS p FROM l UNION ALL SELECT doc, 2000000000 // (60 + r) FROM v) GROUP BY 1")
def fuse_rrf_integer(spark: SparkSession, d: str) -> DataFrame:
    return S.rrf_nanos([(_lexical_rank(spark, d), 1), (_vector_rank(spark, d), 2)])


@query(_BRANCHES + " SELECT doc, ROUND(SUM(p), 9) AS score FROM (SELECT doc, score / MAX(score) OVER () AS p FROM l UNION ALL SELECT doc, 1.0 / (1 + distance) FROM v) GROUP BY 1")
def fuse_weighted(spark: SparkSession, d: str) -> DataFrame:
    return S.weighted(_lexical_rank(spark, d), _vector_rank(spark, d)).select("doc", F.round("score", 9).alias("score"))


@query(_BRANCHES + " SELECT doc, ROUND(SUM(p), 9) AS score FROM (SELECT doc, (score - MIN(score) OVER ()) / (MAX(score) OVER () - MIN(score) OVER ()) AS p FROM l UNION ALL SELECT doc, (MAX(distance) OVER () - distance) / (MAX(distance) OVER () - MIN(distance) OVER ()) FROM v) GROUP BY 1")
def fuse_relative(spark: SparkSession, d: str) -> DataFrame:
    return S.relative(_lexical_rank(spark, d), _vector_rank(spark, d)).select("doc", F.round("score", 9).alias("score"))


@query(_BRANCHES + " SELECT doc, row_number() OVER (ORDER BY CASE WHEN doc % 5 = 0 THEN doc % 7 END DESC NULLS LAST, CASE WHEN doc % 5 = 0 THEN doc END, r) AS rank FROM l")
def rerank(spark: SparkSession, d: str) -> DataFrame:
    hits = _lexical_rank(spark, d)
    return S.rerank(hits, hits.filter("doc % 5 = 0").select("doc", (F.col("doc") % 7).cast("double").alias("score"))).select("doc", "rank")


@query(_BRANCHES + " SELECT doc, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY r) AS n FROM l) WHERE n <= 2")
def dedupe_first_k(spark: SparkSession, d: str) -> DataFrame:
    return S.first_per_parent(_lexical_rank(spark, d), "user_id", 2).select("doc", "rank")


@query(_BRANCHES + ", m AS (SELECT *, (MAX(score) OVER () - score) / (MAX(score) OVER () - MIN(score) OVER ()) - (r - 1.0) / (COUNT(*) OVER () - 1) AS x, r = MAX(r) OVER () AS e FROM l), p AS (SELECT *, CASE WHEN x > lag(x) OVER (ORDER BY r) AND ((NOT e AND x > lead(x) OVER (ORDER BY r)) OR (e AND x > lag(x, 2) OVER (ORDER BY r))) THEN 1 ELSE 0 END AS peak FROM m) SELECT doc, r AS rank FROM (SELECT *, SUM(peak) OVER (ORDER BY r) AS c FROM p) WHERE c < 3")
def autocut(spark: SparkSession, d: str) -> DataFrame:
    return S.autocut(_lexical_rank(spark, d), 3).select("doc", "rank")


@query(_BRANCHES + ", s AS (SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1) SELECT doc, r AS rank FROM l JOIN s USING (user_id) WHERE event_type = 'purchase'")
def search_kv_filter(spark: SparkSession, d: str) -> DataFrame:
    """Hits whose key holds a given scalar in the keyspace."""
    state = K.last_write(table(spark, d, "events"), ["user_id"], "event_id", ["event_type"]).filter("event_type = 'purchase'")
    return _lexical_rank(spark, d).join(state, "user_id", "left_semi").select("doc", "rank")


@query(_BRANCHES + " SELECT doc, r AS rank FROM l WHERE r > 20 AND r <= 45")
def search_window(spark: SparkSession, d: str) -> DataFrame:
    return S.window(_lexical_rank(spark, d), 20, 25).select("doc", "rank")


@query(_BRANCHES + ", f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY r) = 1 AS f FROM l), h AS (SELECT *, f AND SUM(f::INT) OVER (ORDER BY r) <= 8 AS h FROM f) SELECT doc, row_number() OVER (ORDER BY h DESC, r) AS rank FROM h")
def session_cover(spark: SparkSession, d: str) -> DataFrame:
    return S.session_cover(_lexical_rank(spark, d), "user_id").select("doc", "rank")


@query(_BRANCHES + " SELECT doc, ROUND(SUM(p), 9) AS score, ROW_NUMBER() OVER (ORDER BY SUM(p) DESC, doc) AS rank FROM (SELECT doc, 1.0::DOUBLE / (60 + r) AS p FROM l UNION ALL SELECT doc, 1.0::DOUBLE / (60 + r) FROM v) GROUP BY 1 QUALIFY rank <= 10")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Two branches over the same documents, fused by rank."""
    e = table(spark, d, "events")
    near = e.filter("event_type <> 'click'").select(F.col("event_id").alias("doc"), F.abs(F.col("value") - 300).alias("distance"))
    scored = e.filter("event_type <> 'view'").select(F.col("event_id").alias("doc"), F.col("value").alias("score"))
    hits = S.compose(e, "event_id", S.Request(lexical=scored, vectors=[near], candidates=200)).hits
    return hits.select("doc", F.round("score", 9).alias("score"), "rank")


# a composed request: filter, lexical branch (ranks with gaps) and vector branch, fusion, first two per user, autocut, window
_COMPOSED = """WITH e AS (SELECT * FROM events WHERE user_id % 2 = 0), l AS (SELECT * FROM (SELECT event_id AS doc, row_number() OVER (ORDER BY value DESC, event_id) AS r FROM events WHERE event_type <> 'view' QUALIFY r <= 200) WHERE doc IN (SELECT event_id FROM e)),
v AS (SELECT event_id AS doc, row_number() OVER (ORDER BY abs(value - 300), event_id) AS r FROM e WHERE event_type <> 'click' QUALIFY r <= 200),
c AS (SELECT doc, SUM(p) AS score FROM (SELECT doc, 2.0::DOUBLE / (60 + r) AS p FROM l UNION ALL SELECT doc, 1.0::DOUBLE / (60 + r) FROM v) GROUP BY 1),
h AS (SELECT c.*, user_id, event_type, value, row_number() OVER (ORDER BY score DESC, doc) AS r FROM c JOIN events ON event_id = doc)"""
_EVEN = {"op": "in", "field": "parity", "value": [0]}


def _composed(spark: SparkSession, d: str, **more) -> S.Result:
    e = table(spark, d, "events").withColumn("parity", F.col("user_id") % 2)
    near = e.filter("event_type <> 'click'").select(F.col("event_id").alias("doc"), F.abs(F.col("value") - 300).alias("distance"))
    scored = e.filter("event_type <> 'view'").select(F.col("event_id").alias("doc"), F.col("value").alias("score"))
    return S.compose(e, "event_id", S.Request(lexical=scored, vectors=[near], weights=(2.0, 1.0), candidates=200, filter=_EVEN, parent="user_id", first_k=2, offset=3, limit=40, **more))


@query(_COMPOSED + ", k AS (SELECT *, row_number() OVER (ORDER BY r) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY r) AS i FROM h QUALIFY i <= 2)) SELECT doc, ROUND(score, 9) AS score, rank FROM k WHERE rank > 3 AND rank <= 43")
def search_composed(spark: SparkSession, d: str) -> DataFrame:
    return _composed(spark, d).hits.select("doc", F.round("score", 9).alias("score"), "rank")


@query(_COMPOSED + " SELECT event_type AS value, COUNT(*) AS n FROM h GROUP BY 1")
def search_facets(spark: SparkSession, d: str) -> DataFrame:
    """Facets describe the fused candidates, not the window."""
    return _composed(spark, d, facets=["event_type"]).facets["event_type"]


@query(_COMPOSED + " SELECT (SELECT COUNT(*) FROM events) AS total, (SELECT COUNT(*) FROM e) AS eligible, COUNT(*) AS matched FROM h")
def search_counts(spark: SparkSession, d: str) -> DataFrame:
    return _composed(spark, d).statistics


@query("SELECT event_id AS doc, 0.0::DOUBLE AS score, row_number() OVER (ORDER BY event_id) AS rank FROM events WHERE user_id % 2 = 0 QUALIFY rank <= 10")
def match_all(spark: SparkSession, d: str) -> DataFrame:
    """Without a branch every eligible document is a candidate."""
    e = table(spark, d, "events").withColumn("parity", F.col("user_id") % 2)
    return S.compose(e, "event_id", S.Request(filter=_EVEN)).hits.select("doc", "score", "rank")


@query(_BRANCHES + " SELECT doc, CAST(SUM(p) AS BIGINT) AS score, string_agg(b || ':' || r, ',' ORDER BY b) AS parts FROM (SELECT doc, 0 AS b, r, 1000000000 // (60 + r) AS p FROM l UNION ALL SELECT doc, 1, r, 2000000000 // (60 + r) FROM v) GROUP BY 1")
def fuse_explained(spark: SparkSession, d: str) -> DataFrame:
    got = S.rrf_nanos([(_lexical_rank(spark, d), 1), (_vector_rank(spark, d), 2)], explain=True)
    return got.select("doc", "score", F.array_join(F.transform("parts", lambda x: F.concat_ws(":", x["branch"].cast("string"), x["rank"].cast("string"))), ",").alias("parts"))


@query("SELECT memory_id FROM memory_store WHERE project IN ('fufjep_gisgom_nabzub', 'ｆｕｆｊｅｐ_ｇｉｓｇｏｍ_ｎａｂｚｕｂ', '_global') AND (expires_at_micros IS NULL OR expires_at_micros > 1750000000000000)")
def memory_scope(spark: SparkSession, d: str) -> DataFrame:
    """The project is stored in wide letters only."""
    return S.scoped(table(spark, d, "memory_store"), "fufjep_gisgom_nabzub", 1_750_000_000_000_000).select("memory_id")


_RECALL_TERMS = ("vector", "graph", "drops", "orphaned", "blobs")
_RECALL = r"""WITH once AS (SELECT DISTINCT ON (memory_id) memory_id, project, text, expires_at_micros FROM memory_store WHERE text IS NOT NULL ORDER BY memory_id, text),
docs AS (SELECT memory_id AS doc, COALESCE(project = '_global', false) AS g, expires_at_micros AS x, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM once), s AS (SELECT COUNT(*) AS n, AVG(len(t)) AS a FROM docs), w AS (SELECT doc, len(t) AS l, unnest(t) AS term FROM docs),
tf AS (SELECT doc, term, any_value(l) AS l, COUNT(*) AS f FROM w WHERE term IN ('vector', 'graph', 'drops', 'orphaned', 'blobs') GROUP BY 1, 2), df AS (SELECT term, COUNT(*) AS df FROM tf GROUP BY 1),
k AS (SELECT doc, SUM(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / a)) ORDER BY term) AS score FROM tf JOIN df USING (term), s GROUP BY 1),
r AS (SELECT CASE WHEN g THEN 'global' ELSE 'projects' END AS collection, doc, row_number() OVER (PARTITION BY g ORDER BY score DESC, doc) AS r FROM k JOIN docs USING (doc) WHERE x IS NULL OR x > 1750000000000000)
SELECT collection, doc, ROUND(1.0::DOUBLE / (60 + r), 9) AS score FROM r WHERE r <= 100 ORDER BY 3 DESC, collection, doc LIMIT 20"""


@query(_RECALL)
def memory_recall(spark: SparkSession, d: str) -> DataFrame:
    """Two collections, searched with live memories only and merged."""
    once = table(spark, d, "memory_store").filter("text is not null").groupBy("memory_id").agg(F.min_by(F.struct("project", "text", "expires_at_micros"), "text").alias("m")).select("memory_id", "m.*")
    scored = L.bm25(stored(spark, d, "memories", lambda: L.index(once, "memory_id", "text")), " ".join(_RECALL_TERMS))
    live = once.filter(K.visible(F.col("expires_at_micros"), 1_750_000_000_000_000)).withColumn("g", F.coalesce(F.col("project") == "_global", F.lit(False)))
    parts = {name: (scored, live.filter(test).select(F.col("memory_id").alias("doc"))) for name, test in (("global", F.col("g")), ("projects", ~F.col("g")))}
    return S.recall(parts, 20).withColumn("score", F.round("score", 9))


@query("SELECT COUNT(*) AS n, COUNT(DISTINCT COALESCE(project, '') || chr(0) || COALESCE(layer, '') || chr(0) || COALESCE(text, '')) AS ids FROM memory_store")
def content_identity(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "memory_store").select(S.content_id(["project", "layer", "text"]).alias("id"))
    return ids.groupBy("id").agg(F.count("*").alias("c")).agg(F.sum("c").alias("n"), F.count("*").alias("ids"))


# chunking, detection, text mining: no SQL form; held against plain Python in the tests
_RANGES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))


def _ranges(df: DataFrame, function) -> DataFrame:
    cut = X.spread(lambda t: [{"start": a, "stop": b} for a, b in (function(t) if t else [])], _RANGES)
    return df.select("doc_id", F.posexplode(cut("text")).alias("ordinal", "_c")).select("doc_id", "ordinal", "_c.start", "_c.stop")


@query("SELECT doc_id, CAST(i AS INTEGER) AS ordinal, CAST(i * 1920 AS INTEGER) AS start FROM (SELECT doc_id, octet_length(encode(text)) AS n, unnest(range(0, greatest(1, CAST(ceil((octet_length(encode(text)) - 128) / 1920.0) AS BIGINT)))) AS i FROM documents WHERE text IS NOT NULL AND length(text) = octet_length(encode(text)) AND text <> '')")
def chunk_starts(spark: SparkSession, d: str) -> DataFrame:
    """Starts of the fixed chunks of the texts in which every character is a byte."""
    ascii_ = table(spark, d, "documents").filter("length(text) = octet_length(text)")
    return _ranges(ascii_, lambda t: X.chunk_fixed(t, 2048, 128)).select("doc_id", "ordinal", "start")


@query()
def chunk_fixed(spark: SparkSession, d: str) -> DataFrame:
    return _ranges(table(spark, d, "documents"), lambda t: X.chunk_fixed(t, 2048, 128))


@query()
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    """Chunks as documents: id (a digest of parent, place and text), parent, ordinal, byte range and text."""
    cut = X.spread(lambda t: [{"start": a, "stop": b, "text": t.encode()[a:b].decode()} for a, b in (X.chunk_sentences(t, 1024, 2048) if t else [])], T.ArrayType(T.StructType([*_RANGES.elementType.fields, T.StructField("text", T.StringType())])))
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("parent"), F.posexplode(cut("text")).alias("ordinal", "c")).select("parent", "ordinal", "c.*")
    return rows.withColumn("chunk_id", F.sha2(F.concat_ws("\0", *[F.col(c).cast("string") for c in ("parent", "start", "stop", "text")]), 256))


@query()
def chunk_sentence(spark: SparkSession, d: str) -> DataFrame:
    return _ranges(table(spark, d, "documents"), lambda t: X.chunk_sentences(t, 1024, 2048))


_LABELLED = " OR ".join(f"contains(t, '{x}')" for x in X.PII_LABELS + X.HOMES)


@query(f"SELECT memory_id, {_LABELLED} AS labelled FROM (SELECT memory_id, lower(text) AS t FROM memory_store WHERE text IS NOT NULL)")
def pii_labels(spark: SparkSession, d: str) -> DataFrame:
    """Texts with a label or a folder of personal data."""
    kinds = X.spread(X.pii_kinds, T.ArrayType(T.StringType()))
    rows = table(spark, d, "memory_store").filter("text is not null")
    return rows.select("memory_id", F.arrays_overlap(kinds("text"), F.array(F.lit("label"), F.lit("home"))).alias("labelled"))


@query()
def pii_flags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "memory_store").select("memory_id", X.spread(X.pii_kinds, T.ArrayType(T.StringType()))("text").alias("kinds"))


_SECRET = "(" + " OR ".join(f"contains(lower(text), '{m}')" for m in X.SECRET_MARKS) + r""" OR len(list_filter(list_transform(regexp_split_to_array(text, '[\s"'']'), lambda w: regexp_replace(w, '^[^A-Za-z0-9_\-]+|[^A-Za-z0-9_\-]+$', '', 'g')),
lambda b: octet_length(encode(b)) BETWEEN 32 AND 512 AND regexp_matches(b, '[a-z]')::INT + regexp_matches(b, '[A-Z]')::INT + regexp_matches(b, '[0-9]')::INT + regexp_matches(b, '[_-]')::INT >= 3)) > 0)"""


@query(f"SELECT memory_id, COALESCE({_SECRET}, false) AS secret FROM memory_store")
def secret_flags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "memory_store").select("memory_id", X.spread(X.has_secret, T.BooleanType())("text").alias("secret"))


@query()
def capture_extract(spark: SparkSession, d: str) -> DataFrame:
    kind = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("line", T.StringType())]))
    found = X.spread(lambda t: [{"kind": k, "line": v} for k, v in X.captures(t)], kind)
    return table(spark, d, "memory_store").select("memory_id", F.explode(found("text")).alias("c")).select("memory_id", "c.kind", "c.line")


@query()
def highlight(spark: SparkSession, d: str) -> DataFrame:
    cut = X.spread(lambda t: X.highlights(t, ["tribunal", "judge"]), T.ArrayType(T.StringType()))
    return table(spark, d, "documents").filter("text is not null").select("doc_id", cut("text").alias("fragments"))


# evaluation
_RUN = "WITH run AS (SELECT request_id AS query, object_id AS doc, row_number() OVER (PARTITION BY request_id ORDER BY lexical DESC NULLS LAST, object_id) AS rank FROM (SELECT DISTINCT request_id, object_id, CASE WHEN isnan(lexical) THEN NULL ELSE lexical END AS lexical FROM hybrid_candidates)), j AS (SELECT query, doc, (doc % 3)::INT AS grade FROM run WHERE doc % 4 = 0)"


@query(_RUN + ", h AS (SELECT r.query, SUM(grade / log2(rank + 1)) AS dcg, COUNT(*) AS hit, MIN(rank) AS first FROM run r JOIN j USING (query, doc) WHERE rank <= 10 AND grade > 0 GROUP BY 1), i AS (SELECT query, SUM(grade / log2(k + 1)) FILTER (k <= 10) AS best, COUNT(*) AS p FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY grade DESC, doc) AS k FROM j WHERE grade > 0) GROUP BY 1) SELECT q.query, ROUND(COALESCE(dcg / best, 0), 9) AS ndcg, ROUND(COALESCE(hit / p, 0), 9) AS recall, ROUND(COALESCE(1.0 / first, 0), 9) AS mrr FROM (SELECT DISTINCT query FROM run) q LEFT JOIN h USING (query) LEFT JOIN i USING (query)")
def ir_metrics(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    h = table(spark, d, "hybrid_candidates").select("request_id", "object_id", F.when(~F.isnan("lexical"), F.col("lexical")).alias("lexical")).distinct()
    w = Window.partitionBy("request_id").orderBy(F.desc_nulls_last("lexical"), "object_id")
    run = h.select(F.col("request_id").alias("query"), F.col("object_id").alias("doc"), F.row_number().over(w).alias("rank"))
    judged = run.filter("doc % 4 = 0").select("query", "doc", (F.col("doc") % 3).cast("int").alias("grade"))
    got = E.ranking_metrics(run, judged)
    return got.select("query", *[F.round(c, 9).alias(c) for c in ("ndcg", "recall", "mrr")])


@query("SELECT ROUND(AVG(m), 6) AS macro, ROUND(SUM(s) / SUM(n), 6) AS micro FROM (SELECT user_id, AVG(value) AS m, SUM(value) AS s, COUNT(*) AS n FROM events GROUP BY 1)")
def macro_micro(spark: SparkSession, d: str) -> DataFrame:
    return E.macro_micro(table(spark, d, "events"), "user_id", "value").select(F.round("macro", 6).alias("macro"), F.round("micro", 6).alias("micro"))


# ingest
@query("SELECT object_id, MAX(version) AS version FROM product_documents GROUP BY 1")
def ingest_replace(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "product_documents").select("object_id", "version", "category")
    return ingest.replace_documents(docs.filter("version = 1"), docs.filter("version > 1"), "object_id", "version").select("object_id", "version")


@query("SELECT DISTINCT recall_id, query FROM memory_recalls")
def ingest_idempotent(spark: SparkSession, d: str) -> DataFrame:
    """The whole table is delivered to a store that holds the recalls of the first weeks: replays and new ones."""
    rows = ingest.digest(table(spark, d, "memory_recalls").select("recall_id", "query", "ingested_at"), "recall_id", ["query"])
    stored = rows.filter("ingested_at < timestamp_ntz'2025-02-05'").dropDuplicates(["recall_id"])
    return ingest.merge_documents(stored, rows, "recall_id").select("recall_id", "query")


@query("SELECT recall_id, query FROM (SELECT DISTINCT recall_id, query FROM memory_recalls) WHERE recall_id > 100 ORDER BY recall_id LIMIT 64")
def export_page(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "memory_recalls").select("recall_id", "query").dropDuplicates(["recall_id"])
    return R.page(rows, ["recall_id"], [100], 64)


@query("SELECT object_id, text FROM (SELECT DISTINCT object_id FROM product_documents WHERE object_id IS NOT NULL) i JOIN (SELECT object_id, any_value(text) AS text FROM product_documents p WHERE version = (SELECT MAX(version) FROM product_documents q WHERE q.object_id = p.object_id) GROUP BY 1) USING (object_id) WHERE object_id % 7 <> 0")
def ingest_delete(spark: SparkSession, d: str) -> DataFrame:
    """Documents are replaced by their newest version, and some are deleted."""
    docs = table(spark, d, "product_documents").select("object_id", "version", "text")
    newest = ingest.replace_documents(docs.limit(0), docs, "object_id", "version")
    return R.delete(newest, newest.filter("object_id % 7 = 0"), ["object_id"]).select("object_id", "text")


_CATALOG = "SELECT relation, \"column\", type, in_key, in_key AS required FROM (VALUES ('nation', 'n_nationkey', 'int', true), ('nation', 'n_name', 'string', false), ('nation', 'n_regionkey', 'int', false), ('region', 'r_regionkey', 'int', true), ('region', 'r_name', 'string', false)) t(relation, \"column\", type, in_key)"


@query(_CATALOG)
def catalog(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark, d).catalog().filter("relation in ('nation', 'region')")


_PLANS = {
    "SELECT * FROM orders WHERE o_orderkey = 5": "PrimaryKeyLookup(table=orders)",
    "SELECT * FROM orders WHERE o_orderkey = 5 AND o_totalprice > 3": "PrimaryKeyLookup(table=orders,residual=true)",
    "SELECT * FROM orders WHERE o_custkey = 5": "SecondaryIndexLookup(table=orders,index=by_customer)",
    "SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' LIMIT 9": "SecondaryIndexIntersection(table=orders,indexes=[by_priority,by_status],limit=9)",
    "SELECT * FROM orders WHERE o_orderkey > 5 LIMIT 3": "PrimaryKeyRangeScan(table=orders,limit=3)",
    "SELECT * FROM ledger WHERE tenant = 't-1' AND sequence_no > 4 LIMIT 3": "PrimaryKeyPrefixRangeScan(table=ledger,prefix_columns=1,range_column=sequence_no,limit=3)",
    "SELECT * FROM ledger WHERE tenant = 't-1' LIMIT 3": "PrimaryKeyPrefixScan(table=ledger,columns=1,limit=3)",
    "SELECT * FROM events WHERE value > 3 LIMIT 3": "SecondaryIndexRangeScan(table=events,index=by_value,limit=3)",
    "SELECT * FROM events WHERE event_type = 'view' AND value < 9 LIMIT 3": "SecondaryIndexPrefixRangeScan(table=events,index=by_type_value,prefix_columns=1,range_column=value,limit=3)",
    "SELECT * FROM part WHERE p_size IS NULL LIMIT 3": "PrimaryKeyScan(table=part,limit=3,residual=true)",
}


@query("SELECT * FROM (VALUES " + ", ".join("('" + q.replace("'", "''") + "', '" + p + "')" for q, p in _PLANS.items()) + ") t(statement, plan)")
def explain_path(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d)
    return spark.createDataFrame([(q, e.execute(f"EXPLAIN {q}").first()["plan"]) for q in _PLANS], "statement string, plan string")
