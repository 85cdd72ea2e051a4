import random
import re
from math import log

import pytest
from pyspark.sql import functions as F

from loomline.functions import text as X
from loomline.operators import documents as D
from loomline.operators import keyspace as K
from loomline.operators import lexical as L
from loomline.operators import relational as R
from loomline.operators import search as S
from loomline.plans import queries as Q
from loomline.plans.sql import Engine, SqlError
from loomline.sources import exports
from loomline.streaming import ingest


@pytest.fixture()
def engine(spark):
    e = Engine(spark)
    rows = [(1, "x", 10), (2, "x", None), (3, None, 5), (4, "y", -1)]
    e.register("m", spark.createDataFrame(rows, "id bigint, class string, score bigint"), ["id"])
    return e


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_null_rules(engine):
    assert rows(engine.execute("SELECT id FROM m WHERE class NOT IN ('x', NULL) LIMIT 9")) == []
    assert rows(engine.execute("SELECT COUNT(*) AS n, COUNT(score) AS p, SUM(score) AS s, AVG(score) AS a FROM m WHERE id > 100")) == [(0, 0, None, None)]
    assert rows(engine.execute("SELECT class, COUNT(*) AS n FROM m GROUP BY class LIMIT 2")) == [(None, 1), ("x", 2)]
    assert rows(engine.execute("SELECT id FROM m WHERE NOT class = 'x' LIMIT 9")) == [(4,)]


@pytest.mark.parametrize("a,b", [("score > 0 AND class = 'x'", "class = 'x' AND score > 0"), ("NOT (score > 0 OR class = 'x')", "NOT score > 0 AND NOT class = 'x'"), ("score BETWEEN 1 AND 9", "score >= 1 AND score <= 9")])
def test_metamorphic(engine, a, b):
    assert rows(engine.execute(f"SELECT id FROM m WHERE {a} LIMIT 9")) == rows(engine.execute(f"SELECT id FROM m WHERE {b} LIMIT 9"))


REFUSED = [
    ("SELECT id FROM m", "SQL001"), ("SELECT z FROM m LIMIT 1", "SQL004"), ("SELECT id FROM q LIMIT 1", "SQL017"), ("SELECT id AS a, score AS a FROM m LIMIT 1", "SQL005"), ("SELECT id FROM m WHERE class = 3", "SQL006"),
    ("SELECT id FROM m ORDER BY score LIMIT 1", "SQL008"), ("SELECT id FROM m WHERE id = ?", "SQL002"), ("SELECT id FROM m UNION SELECT 1", "SQL001"), ("SELECT DISTINCT class FROM m", "SQL001"), ("SELECT DISTINCT class FROM m WHERE id = 1", "SQL001"),
    ("SELECT id FROM m WHERE score > 1", "SQL001"), ("SELECT id FROM m WHERE id = 1 OR id = 2", "SQL001"), ("SELECT id FROM m WHERE NOT id = 1", "SQL001"), ("SELECT id FROM m WHERE score IN (1)", "SQL001"), ("SELECT COUNT(*) AS n, id FROM m", "SQL021"),
    ("SELECT id, ROW_NUMBER() OVER (ORDER BY score) AS r FROM m LIMIT 3", "SQL008"), ("SELECT id, ROW_NUMBER() OVER (ORDER BY id) AS r FROM m WHERE id = 1", "SQL001"), ("INSERT INTO m (id, id) VALUES (7, 7)", "SQL005"), ("INSERT INTO m VALUES ('a', 'x', 1)", "SQL006"),
    ("INSERT INTO m (id, none) VALUES (7, 7)", "SQL004"), ("UPDATE m SET id = 4 WHERE id = 1", "SQL013"), ("CREATE TABLE m (id BIGINT PRIMARY KEY)", "SQL010"), ("CREATE TABLE c (id BIGINT PRIMARY KEY, p BIGINT REFERENCES none (id))", "SQL017"), ("DROP INDEX none", "SQL010"),
]


@pytest.mark.parametrize("sql,kind", REFUSED)
def test_refusals(engine, sql, kind):
    with pytest.raises(SqlError) as e:
        engine.execute(sql)
    assert e.value.code == kind


def test_dml(spark):
    e = Engine(spark)
    e.execute("CREATE TABLE parents (id BIGINT PRIMARY KEY, balance BIGINT CHECK (balance >= 0))")
    e.execute("CREATE TABLE children (id BIGINT PRIMARY KEY, parent BIGINT REFERENCES parents (id))")
    assert e.execute("INSERT INTO parents (id, balance) VALUES (1, 5), (2, NULL)") == 2
    assert e.execute("INSERT INTO children VALUES (10, 1), (11, NULL)") == 2
    for sql in ("INSERT INTO parents VALUES (1, 9)", "INSERT INTO parents VALUES (3, -1)", "INSERT INTO children VALUES (12, 9)", "DELETE FROM parents WHERE id = 1", "UPDATE parents SET balance = -4 WHERE id = 2", "DROP TABLE parents"):
        with pytest.raises(SqlError):
            e.execute(sql)
    assert e.execute("UPDATE parents SET balance = 8 WHERE id = 2") == 1
    assert e.execute("DELETE FROM parents WHERE id = 7") == 0
    assert sorted(rows(e.execute("SELECT * FROM parents LIMIT 9"))) == [(1, 5), (2, 8)]
    e.execute("CREATE UNIQUE INDEX u ON parents (balance)")
    with pytest.raises(SqlError):
        e.execute("INSERT INTO parents VALUES (5, 8)")
    e.execute("ALTER TABLE children RENAME TO kids")
    assert rows(e.execute("SELECT id FROM kids WHERE id = 10")) == [(10,)]


def test_limit_is_not_needed_beside_an_equality(engine):
    assert rows(engine.execute("SELECT id FROM m WHERE score > 1 AND class = 'x'")) == [(1,)]
    assert rows(engine.execute("SELECT id FROM m WHERE (id = 2 AND class = 'x')")) == [(2,)]


def test_distinct(engine):
    assert rows(engine.execute("SELECT DISTINCT class FROM m LIMIT 9")) == [("x",), (None,), ("y",)]
    assert rows(engine.execute("SELECT DISTINCT class FROM m ORDER BY id DESC LIMIT 9")) == [("y",), (None,), ("x",)]
    assert rows(engine.execute("SELECT DISTINCT class FROM m LIMIT 1 OFFSET 1")) == [(None,)]


def test_not_null_and_types(spark):
    e = Engine(spark)
    e.execute("CREATE TABLE t (id BIGINT PRIMARY KEY, n TEXT NOT NULL, d DOUBLE, m DECIMAL(6, 2), day DATE, ok BOOLEAN, small TINYINT)")
    assert e.execute("INSERT INTO t (id, n, d, m, day, ok, small) VALUES (1, 'a', 2, 3, '2025-02-03', TRUE, -128)") == 1
    assert rows(e.execute("SELECT d, m, day FROM t WHERE id = 1"))[0][:1] == (2.0,)
    for sql, code in (("INSERT INTO t (id, n) VALUES (2, NULL)", "SQL007"), ("INSERT INTO t (id) VALUES (2)", "SQL007"), ("INSERT INTO t (id, n) VALUES (NULL, 'b')", "SQL007"), ("UPDATE t SET n = NULL WHERE id = 1", "SQL007"), ("INSERT INTO t (id, n, m) VALUES (2, 'b', 1.234)", "SQL006"),
                      ("INSERT INTO t (id, n, small) VALUES (2, 'b', 128)", "SQL006"), ("INSERT INTO t (id, n, day) VALUES (2, 'b', 'soon')", "SQL006"), ("INSERT INTO t (id, n, ok) VALUES (2, 'b', 1)", "SQL006"), ("UPDATE t SET d = 'x' WHERE id = 1", "SQL006"), ("INSERT INTO t (id, n) VALUES (1, 'b')", "SQL012")):
        with pytest.raises(SqlError) as error:
            e.execute(sql)
        assert error.value.code == code
    assert e.execute("UPDATE t SET d = 5, n = 'z' WHERE id = 1") == 1
    assert rows(e.execute("SELECT n, d FROM t WHERE id = 1")) == [("z", 5.0)]


def test_rename_keeps_references(spark):
    e = Engine(spark)
    e.execute("CREATE TABLE p (id BIGINT PRIMARY KEY)")
    e.execute("CREATE TABLE c (id BIGINT PRIMARY KEY, p BIGINT REFERENCES p (id))")
    e.execute("INSERT INTO p VALUES (1)")
    e.execute("INSERT INTO c VALUES (1, 1)")
    with pytest.raises(SqlError):
        e.execute("ALTER TABLE p RENAME TO c")
    e.execute("ALTER TABLE p RENAME TO pp")
    for sql, code in (("DELETE FROM pp WHERE id = 1", "SQL016"), ("INSERT INTO c VALUES (2, 9)", "SQL016"), ("DROP TABLE pp", "SQL016")):
        with pytest.raises(SqlError) as error:
            e.execute(sql)
        assert error.value.code == code
    assert e.execute("INSERT INTO c VALUES (2, 1)") == 1


def test_many_writes_do_not_grow_the_plan(spark):
    e = Engine(spark)
    e.execute("CREATE TABLE t (id BIGINT PRIMARY KEY)")
    for i in range(17):
        e.execute(f"INSERT INTO t VALUES ({i})")
    assert e.execute("SELECT COUNT(*) AS n FROM t").first()[0] == 17
    assert e.relation("t").df._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation") < 4


def test_budgets(engine):
    engine.budget = 2
    engine.register("o", engine.relation("m").df, ["id"])
    with pytest.raises(SqlError) as e:
        engine.execute("SELECT id FROM m LIMIT 1")
    assert e.value.code == "SQL019"
    assert rows(engine.execute("SELECT id FROM m WHERE id > 2 LIMIT 1")) == [(3,)]
    with pytest.raises(SqlError) as e:
        engine.execute("SELECT m.id AS a FROM m JOIN o ON m.id = o.id LIMIT 1")
    assert e.value.code == "SQL018"


def test_totals_under_a_budget_are_whole(spark, engine, tmp_path):
    engine.budget = 2
    assert rows(engine.execute("SELECT COUNT(*) AS n, SUM(score) AS s FROM m")) == [(4, 14)]
    assert rows(engine.execute("SELECT class, COUNT(*) AS n FROM m GROUP BY class LIMIT 9")) == [(None, 1), ("x", 2), ("y", 1)]
    spark.range(1_048_577).toDF("o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    assert rows(Q.scan_budget(spark, str(tmp_path))) == [(1_048_577,)]


def test_cursor(spark):
    df = spark.range(7)
    page, after = R.cursor_page(df, ["id"], None, 3)
    assert rows(page) == [(0,), (1,), (2,)] and after == [2]
    page, after = R.cursor_page(df, ["id"], [3], 3)
    assert rows(page) == [(4,), (5,), (6,)] and after is None


def test_row_comparison(spark):
    df = spark.createDataFrame([(1, None), (1, 2), (2, 0), (None, 5)], "a int, b int")
    after = R.after_row([F.col("a"), F.col("b")], [1, 1])
    assert [r[0] for r in df.select(after).collect()] == [None, True, True, None]


def test_like_has_no_escape(spark):
    df = spark.createDataFrame([("a\\xb",), ("a_b",)], "t string")
    assert df.filter(R.like(F.col("t"), "a\\_b")).count() == 1


def test_two_valued(spark):
    df = spark.createDataFrame([(1,), (None,), (2,)], "x int")
    assert df.filter(D.build_filter({"op": "not", "of": {"op": "eq", "field": "x", "value": 1}})).count() == 2


def test_partition_invariance(spark):
    docs = spark.createDataFrame([(i, f"rust storage {'engine ' * (i % 3)} term{i % 5}") for i in range(40)], "id int, text string")
    want = None
    for n in (1, 7, 16):
        got = sorted(rows(L.bm25(L.index(docs.repartition(n), "id", "text"), "engine rust term3")))
        want = want or got
        assert got == want


def test_compound_and_phrase(spark):
    docs = spark.createDataFrame([("p", "green glass bottle"), ("q", "green bottle glass bottle"), ("r", "paper bottles"), ("s", None), ("t", "")], "id string, text string")
    ix = L.index(docs, "id", "text")
    q = {"boolean": {"must": [{"term": "green"}], "should": [{"phrase": "glass bottle"}, {"prefix": "bott"}, {"fuzzy": {"term": "botle"}}, {"phrase": "green bottle"}], "must_not": [{"term": "paper"}]}}
    assert sorted(rows(L.compound(ix, q))) == [("p", 4.0), ("q", 5.0)]
    assert sorted(rows(L.compound(ix, {"boolean": {"must_not": [{"prefix": "gr"}]}}))) == [("r", 0.0), ("s", 0.0), ("t", 0.0)]
    assert sorted(rows(L.compound(ix, {"boolean": {"should": [{"term": "paper"}, {"term": "glass"}]}}))) == [("p", 1.0), ("q", 1.0), ("r", 1.0)]
    assert rows(L.phrase(ix, "bottle green")) == [] and rows(L.phrase(ix, "bottle glass bottle")) == [("q",)]
    assert rows(L.bm25(ix, "none")) == [] and rows(L.bm25(ix, " .,")) == [] and ix.counts()[0] == 5
    with pytest.raises(ValueError):
        L.expand(spark.range(70).select(F.format_string("t%02d", "id").alias("term")))


def test_index_has_one_analysis_and_filters_terms(spark):
    docs = spark.createDataFrame([(i, f"word{i % 9} common") for i in range(50)], "id int, text string")
    plan = L.bm25(L.index(docs, "id", "text"), "word3")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "PushedFilters" in plan and "In(term" in plan.replace("EqualTo(term", "In(term")


def test_stop_stem_index_against_plain_python(spark):
    texts = ["The farmers sold boxes, selling on", "a box of sells", None, "Café crème", "FARMER farmed the farm"]
    ix = L.index(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id", "text", fold=True, stop=True, stemmed=True)
    docs = [[t for t, _ in X.analyze(t, fold=True, stop=True, stemmed=True)] for t in texts]
    terms, mean = sorted({t for t, _ in X.analyze("the farmers selling boxes creme", fold=True, stop=True, stemmed=True)}), sum(map(len, docs)) / 5
    want = {}
    for i, doc in enumerate(docs):
        score = 0.0
        for t in terms:
            df, f = sum(t in d for d in docs), doc.count(t)
            score += log(1 + (5 - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.4 + 0.6 * len(doc) / mean)) if f else 0.0
        if score:
            want[i] = score
    got = {r["doc"]: r["score"] for r in L.bm25(ix, "the farmers selling boxes creme", b=0.6).collect()}
    assert got == pytest.approx(want) and set(got) == {0, 1, 3, 4}


def test_bm25f_explains_and_abstains(spark):
    docs = spark.createDataFrame([(1, "red barn", "a barn stands"), (2, None, "red red"), (3, "x", "")], "id int, title string, body string")
    ix = L.index(docs, "id", ["title", "body"])
    got = L.bm25f_retrieve(ix, {"title": 3_000_000, "body": 1_000_000}, "red barn", 5).collect()
    assert [r["doc"] for r in got] == [1, 2] and all(r["score_nanos"] == sum(t["score_nanos"] for t in r["terms"]) for r in got)
    assert {t["term"]: t["df"] for t in got[0]["terms"]} == {"barn": 1, "red": 2}
    none = L.bm25f_retrieve(ix, {"title": 1_000_000}, "barley", 5).collect()
    assert [(r["outcome"], r["doc"]) for r in none] == [("no_candidates", None)]


def test_facets_are_never_cut(spark):
    many = spark.range(10_001).withColumn("v", F.col("id"))
    with pytest.raises(ValueError):
        D.terms_facet(many, "v")
    assert D.terms_facet(many.filter("id > 0"), "v").count() == 10_000
    assert rows(D.terms_facet(many.filter("id > 0"), "v", 2)) == [(1, 1), (2, 1)]
    with pytest.raises(Exception, match="not finite"):
        D.metrics(spark.createDataFrame([(1.0,), (float("inf"),)], "x double"), "x").collect()


def documents(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", F.parse_json("t").alias("doc"))


def test_documents_of_all_types(spark):
    df = documents(spark, '{"a": 1}', '{"a": "1"}', '{"a": null}', "{}", '{"a": true}', '{"a": [1, "x"]}', '{"a": -3}', '{"a": "abc"}')
    find = lambda node: [r["id"] for r in df.filter(D.document_filter(node, "doc")).orderBy("id").collect()]
    leaf = lambda op, v: {"op": op, "path": "$.a", "value": v}
    assert find({"op": "exists", "path": "$.a"}) == [0, 1, 2, 4, 5, 6, 7]
    assert find(leaf("eq", 1)) == [0] and find(leaf("eq", "1")) == [1] and find(leaf("eq", None)) == [2] and find(leaf("eq", True)) == [4]
    assert find(leaf("ne", 1)) == [1, 2, 4, 5, 6, 7] and find({"op": "not", "of": leaf("eq", 1)}) == [1, 2, 3, 4, 5, 6, 7]
    assert find(leaf("lt", 1)) == [6] and find(leaf("ge", "1")) == [1, 7] and find(leaf("prefix", "a")) == [7]
    assert find(leaf("contains", "x")) == [5] and find(leaf("contains", 1)) == [5] and find(leaf("contains", "b")) == [7]
    groups = {r["g0"]: r["n"] for r in D.group_documents(df, "doc", ["$.a"]).collect()}
    assert groups["null"] == 1 and groups[None] == 1 and groups["1"] == 1 and groups['"1"'] == 1
    one = D.group_documents(df, "doc", [], extremes={"a": "$.a"}).first()
    assert one["n"] == 8 and one["a_min"]["kind"] == 2 and one["a_max"]["kind"] == 6
    with pytest.raises(Exception, match="whole numbers"):
        D.group_documents(df, "doc", [], sums={"s": "$.a"}).collect()
    assert D.group_documents(df.filter("id in (0, 2, 3, 6)"), "doc", [], sums={"s": "$.a"}).first()["s"] == -2
    assert D.group_documents(df.limit(0), "doc", [], sums={"s": "$.a"}).first()["s"] is None
    with pytest.raises(ValueError):
        D.group_documents(df, "doc", ["$.a"], maximum=3)


def test_document_query_pages(spark):
    df = documents(spark, '{"a": 2}', '{"a": "x"}', "{}", '{"a": 2}', '{"a": null}', '{"a": false}')
    for down, first in ((False, False), (True, True), (True, False), (False, True)):
        sort, seen, after = [("$.a", down, first)], [], None
        whole = [r["id"] for r in D.query_documents(df, "id", "doc", {"op": "all"}, sort, None, 99).collect()]
        while True:
            page = D.query_documents(df, "id", "doc", {"op": "all"}, sort, after, 2).collect()
            if not page:
                break
            seen += [r["id"] for r in page]
            after = [tuple(page[-1]["_s0"]) if page[-1]["_s0"] else None, page[-1]["id"]]
        assert seen == whole and sorted(seen) == list(range(6))
    assert [r["id"] for r in D.query_documents(df, "id", "doc", {"op": "all"}, [("$.a", False, False)], None, 9).collect()] == [5, 0, 3, 1, 2, 4]
    with pytest.raises(ValueError):
        D.query_documents(df.union(df), "id", "doc", {"op": "all"}, [], None, 9)


def test_autocut_at_the_last_hit(spark):
    """The last of five hits falls away: it is the first maximum, so four are kept."""
    cut = lambda scores, n: S.autocut(spark.createDataFrame([(i, float(x), i + 1) for i, x in enumerate(scores)], "doc int, score double, rank int"), n).count()
    assert cut([1.0, 0.98, 0.96, 0.94, 0.0], 1) == 4
    assert cut([1.0, 0.9, 0.2, 0.1, 0.0], 1) == 2 and cut([1.0, 0.9, 0.2, 0.1, 0.0], 2) == 5
    assert cut([1.0], 1) == 1 and cut([0.5, 0.5, 0.5], 1) == 3 and cut([1.0, 0.0], 1) == 2


def test_composed_request(spark):
    docs = spark.createDataFrame([(i, f"note {i} on Barns", "ab"[i % 2], i % 3) for i in range(12)], "id int, text string, kind string, grp int")
    lexical = docs.select(F.col("id").alias("doc"), (20.0 - F.col("id")).alias("score"))
    ask = lambda **more: S.compose(docs, "id", S.Request(lexical=lexical, filter={"op": "eq", "field": "kind", "value": "a"}, **more))
    got = ask(facets=["grp"], range_facets={"grp": [(0, 1), (None, None)]}, metrics=["grp"], limit=2, highlight=("text", ["barns"]))
    first = got.hits.orderBy("rank").collect()
    assert [(r["doc"], r["score"], r["rank"]) for r in first] == [(0, 1 / 61, 1), (2, 1 / 63, 2)]  # ranks of filtered hits leave gaps
    assert first[0]["fragments"] == ["note 0 on barns"]
    assert sorted(rows(got.facets["grp"])) == [(0, 2), (1, 2), (2, 2)] and rows(got.range_facets["grp"]) == [(0, 2), (1, 6)] and got.metrics["grp"].first()["n"] == 6
    assert rows(got.statistics) == [(12, 6, 6)]
    order = lambda r: [x["doc"] for x in r.hits.orderBy("rank").collect()]
    assert order(ask(parent="grp")) == [0, 2, 4] and order(ask(parent="grp", offset=1)) == [2, 4]
    assert order(ask(sort=[("grp", True, False)], limit=3)) == [2, 8, 4]
    assert order(ask(rerank=spark.createDataFrame([(8, 0.5), (4, 0.5), (3, 9.0)], "doc int, score double"), limit=3)) == [4, 8, 0]
    with pytest.raises(ValueError):
        ask(offset=1000, limit=100)
    with pytest.raises(ValueError):
        S.rerank(lexical, spark.range(300).select(F.col("id").alias("doc"), F.lit(1.0).alias("score")))


def test_recall_counts_live_documents_only(spark):
    scored = spark.createDataFrame([(1, 9.0), (2, 8.0), (3, 7.0)], "doc int, score double")
    live = spark.createDataFrame([(2,), (3,)], "doc int")
    got = rows(S.recall({"b": (scored, live), "a": (scored, live.filter("doc = 3"))}, 3))
    assert got == [("a", 3, 1 / 61), ("b", 2, 1 / 61), ("b", 3, 1 / 62)]


def test_enrich_only_while_the_text_is_the_same(spark):
    docs = spark.createDataFrame([(1, "x", None), (2, "y", None), (3, None, [9.0])], "id int, text string, vector array<double>")
    made = docs.select("id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), F.array(F.lit(1.0)).alias("vector")).withColumn("digest", F.when(F.col("id") == 2, F.lit("old")).otherwise(F.col("digest")))
    assert sorted((r["id"], r["vector"], r["enriched"]) for r in S.enrich(docs, made, "id").collect()) == [(1, [1.0], True), (2, None, False), (3, [1.0], True)]


def test_partitions_are_pruned_and_searched(spark):
    rnd = random.Random(5)
    data = [(i, [rnd.gauss(i % 6 * 4, 1), rnd.gauss(i % 3 * 4, 1)]) for i in range(600)]
    df = spark.createDataFrame(data, "id int, v array<double>")
    stored = S.partitioned(df, "id", "v", [data[i][1] for i in range(6)])
    hits = 0
    for _ in range(8):
        q = [rnd.uniform(-2, 22), rnd.uniform(-2, 10)]
        want = [i for _, i in sorted((sum((a - b) ** 2 for a, b in zip(v, q)), i) for i, v in data)[:5]]
        assert [r["doc"] for r in S.routed_topk(stored, q, 5).collect()] == want
        assert [r["doc"] for r in S.adaptive_topk(stored, q, 5, 600, 1).collect()] == want
        hits += len({r["doc"] for r in S.ann_topk(stored, q, 5, 3).collect()} & set(want))
    assert hits >= 36
    assert S.routed_topk(S.partitioned(df.limit(0), "id", "v", [[0.0, 0.0]]), [0.0, 0.0], 5).count() == 0


def test_scoped_project_in_any_spelling(spark):
    cases = [("ｐ１", None, True), ("p1", 5, False), ("p1", 7, True), ("_global", None, True), ("p2", None, False), (None, None, False)]
    df = spark.createDataFrame([(i, p, x) for i, (p, x, _) in enumerate(cases)], "id int, project string, expires_at_micros bigint")
    assert {r["id"] for r in S.scoped(df, "p1", 6).collect()} == {i for i, c in enumerate(cases) if c[2]}
    assert [S.branches_of(m, v) for m in ("lexical", "hybrid", "semantic") for v in (True, False)] == [(True, False), (True, False), (True, True), (True, False), (False, True), (True, False)]


def test_fusion_keeps_rank_gaps(spark):
    a = spark.createDataFrame([(2, 2)], "doc int, rank int")
    assert rows(S.rrf([(a, 1.0)])) == [(2, 1 / 62)]
    one = spark.createDataFrame([(1, 3.0)], "doc int, score double")
    near = spark.createDataFrame([], "doc int, distance double")
    assert rows(S.relative(one, near)) == [(1, 1.0)]


def test_abstain(spark):
    df = spark.createDataFrame([(1, 0.9), (2, 0.89)], "doc int, score double")
    assert S.abstain(df, "score", 0.5, 0.05).first()[0] == "ambiguous"
    assert S.abstain(df, "score", 0.95, 0.0).first()[0] == "below_threshold"
    assert S.abstain(df.limit(0), "score", 0.5, 0.0).first()[0] == "no_candidates"
    assert tuple(S.abstain(df, "score", 0.5, 0.001).first())[:2] == ("match", 1)


STEPS = [
    # key, op, arg, value, at -> changed, result
    ("s", "setxx", None, "a", 0, False, None), ("s", "set", None, "éx", 0, True, None), ("s", "setnx", None, "b", 0, False, None), ("s", "append", None, "ü", 0, True, "5"), ("s", "getrange", "0:1", None, 0, False, "é"),
    ("s", "getrange", "-2:-1", None, 0, False, "ü"), ("s", "getrange", "4:2", None, 0, False, ""), ("s", "setrange", "6", "z", 0, True, "7"), ("s", "get", None, None, 0, False, "éxü\0z"), ("s", "incrby", None, "1", 0, False, "not an integer"),
    ("s", "hset", "f", "1", 0, False, "wrongtype"), ("s", "expire", None, "5", 1, True, None), ("s", "ttl", None, None, 2, False, "3"), ("s", "get", None, None, 5, False, None), ("s", "ttl", None, None, 5, False, "missing"),
    ("n", "incrby", None, "7", 0, True, "7"), ("n", "incrby", None, str(2**63 - 1), 0, False, "overflow"), ("n", "get", None, None, 0, False, "7"), ("n", "set", None, "007", 0, True, None), ("n", "incrby", None, "1", 0, False, "not an integer"),
    ("h", "hsetnx", "f", "1", 0, False, "missing"), ("h", "create", "hash", None, 0, True, None), ("h", "hset", "f", "1", 0, True, "1"), ("h", "hset", "f", "2", 0, True, "0"), ("h", "hsetnx", "f", "3", 0, False, None), ("h", "hincrby", "f", "5", 0, True, "7"),
    ("h", "hset", "t", "text", 0, True, "1"), ("h", "hincrby", "t", "1", 0, False, "not an integer"), ("h", "hlen", None, None, 0, False, "2"), ("h", "hexpire", "t", "9", 1, True, None), ("h", "httl", "t", None, 2, False, "7"), ("h", "httl", "f", None, 2, False, "persistent"),
    ("h", "hlen", None, None, 9, False, "1"), ("h", "hget", "t", None, 9, False, None), ("h", "httl", "t", None, 9, False, "missing"), ("h", "hmset", '["a", "b"]', '["1", "2"]', 9, True, "2"), ("h", "hmset", '["a", "a"]', '["1", "2"]', 9, False, "duplicate field"),
    ("h", "hmget", '["b", "z", "b"]', None, 9, False, '["2", null, "2"]'), ("h", "hmdel", '["a", "z"]', None, 9, True, "1"), ("h", "drop", "list", None, 9, False, None), ("h", "drop", "hash", None, 9, True, None), ("h", "hlen", None, None, 9, False, "missing"),
    ("l", "lpush", None, "x", 0, False, "missing"), ("l", "create", "list", None, 0, True, None), ("l", "rpush", None, "b", 0, True, "1"), ("l", "lpush", None, "a", 0, True, "2"), ("l", "rpush", None, "c", 0, True, "3"), ("l", "lrange", "-2:9", None, 0, False, '["b", "c"]'),
    ("l", "rpop", None, None, 0, True, "c"), ("l", "lpop", None, None, 0, True, "a"), ("l", "lpop", None, None, 0, True, "b"), ("l", "lpop", None, None, 0, False, None), ("l", "llen", None, None, 0, False, "0"),
    ("t", "create", "set", None, 0, True, None), ("t", "sadd", None, "b", 0, True, None), ("t", "sadd", None, "a", 0, True, None), ("t", "sadd", None, "b", 0, False, None), ("t", "sadd", None, "é", 0, True, None), ("t", "smismember", None, '["a", "z"]', 0, False, "[1, 0]"),
    ("t", "srandmember", "2", "42", 0, False, None), ("t", "spop", None, "42", 0, True, None), ("t", "scard", None, None, 0, False, "2"), ("t", "srem", None, "zz", 0, False, None),
    ("z", "create", "zset", None, 0, True, None), ("z", "zadd", "b", "2", 0, True, None), ("z", "zadd", "a", "2", 0, True, None), ("z", "zadd", "c", "-0.0", 0, True, None), ("z", "zadd", "c", "0", 0, False, None), ("z", "zadd", "x", "nan", 0, False, "not a number"),
    ("z", "zrank", "b", None, 0, False, "2"), ("z", "zrevrank", "b", None, 0, False, "0"), ("z", "zadd", "b", "1", 0, True, None), ("z", "zpopmax", None, None, 0, True, "a=2.0"), ("z", "zpopmin", None, None, 0, True, "c=0.0"), ("z", "zincrby", "b", "inf", 0, False, "not a number"),
    ("z", "zincrby", "n", "1.5", 0, True, "1.5"), ("z", "zrem", "b", None, 0, True, None), ("z", "zcard", None, None, 0, False, "1"), ("z", "zpopmin", None, None, 0, True, "n=1.5"), ("z", "zpopmin", None, None, 0, False, None),
    ("x", "create", "stream", None, 0, True, None), ("x", "xadd", '["a"]', "1", 0, True, "1"), ("x", "xadd", '["a", "a"]', "1", 0, False, "duplicate field"), ("x", "xadd", "[]", None, 0, False, "no field"), ("x", "xadd", '["b"]', "1", 0, True, "2"), ("x", "xlen", None, None, 0, False, "2"),
]


def test_replay_step_by_step(spark):
    members = sorted(["a", "b", "é"], key=str.encode)
    first = K.splitmix64(42) % 3
    steps = [(*s[:5], s[5], {"srandmember": __import__("json").dumps([members[(first + i) % 3] for i in range(2)], ensure_ascii=False), "spop": members[first]}.get(s[1], s[6])) for s in STEPS]
    log = spark.createDataFrame([(s[0], i, *s[1:5]) for i, s in enumerate(steps)] + [(None, 999, "set", None, "x", 0)], "key string, seq bigint, op string, arg string, value string, at bigint")
    got = {r["seq"]: (r["changed"], r["result"]) for r in K.replay(log.repartition(5)).collect()}
    assert len(got) == len(steps)
    for i, s in enumerate(steps):
        assert got[i] == (s[5], s[6]), s


def test_sorted_set_pops_against_sorting(spark):
    rnd, z, plain = random.Random(3), K.Key(), {}
    z.apply("create", "zset", None, 0)
    for _ in range(2000):
        member, score, op = f"m{rnd.randrange(40)}", float(rnd.randrange(9)), rnd.choice(["zadd", "zadd", "zadd", "zrem", "zpopmin", "zpopmax"])
        if op == "zadd":
            plain[member] = score
            z.apply(op, member, str(score), 0)
        elif op == "zrem":
            assert z.apply(op, member, None, 0)[0] == (plain.pop(member, None) is not None)
        else:
            best = (min if op == "zpopmin" else max)(plain, key=lambda m: (plain[m], m.encode()), default=None)
            assert z.apply(op, None, None, 0) == ((True, f"{best}={plain.pop(best)!r}") if best else (False, None))


def test_bytes_of_a_range(spark):
    df = spark.createDataFrame([("éèàü-abc",), ("",), (None,)], "t string")
    got = lambda a, b: [r[0] for r in df.select(K.getrange(F.col("t"), a, b)).collect()]
    assert got(0, 3) == ["éè".encode(), b"", None] and got(-5, -1) == [b"\xbc-abc", b"", None] and got(0, 0)[0] == b"\xc3" and got(5, 2) == [b"", b"", None]


def test_sweep(spark):
    df = spark.createDataFrame([("a", 3), ("b", 2), ("c", 9), ("d", None), ("e", 3)], "k string, x bigint")
    assert rows(K.due(df, "x", 3, ["k"], 2).select("k")) == [("b",), ("a",)]
    assert sorted(r["k"] for r in K.sweep(df, "x", 3, ["k"], 2).collect()) == ["c", "d", "e"]


def test_scan_visits_expired_members(spark):
    df = spark.createDataFrame([(f"k{i}é"[: 3 if i % 2 else 2], 5 if i == 1 else None) for i in range(6)], "k string, x bigint")
    got = K.scan_match(df, ["k"], "k", b"k?*", None, 9, 4, "x", 5).collect()
    assert [(r["k"], r["match"], r["last"]) for r in got] == [("k0", True, False), ("k2", True, False), ("k3é", True, True)]
    assert [r["k"] for r in K.scan_match(df, ["k"], "k", "k3é".encode(), None, 9, 1, "x", 5).collect()] == ["k3é"]
    # a question mark is one byte, and the letter has two
    assert [r["k"] for r in K.scan_match(df, ["k"], "k", b"k5??", None, 9, 99).collect()] == ["k5é"] and not K.scan_match(df, ["k"], "k", b"k5?", None, 9, 99).collect()


def test_counter_overflow_on_the_way(spark):
    df = spark.createDataFrame([("a", 1, 2**63 - 1), ("a", 2, 1), ("a", 3, -1)], "k string, i int, d bigint")
    assert rows(K.counters(df, "k", "d")) == [("a", 2**63 - 1)]
    with pytest.raises(Exception, match="overflow"):
        K.counters(df, "k", "d", "i").collect()


def test_counter_overflow(spark):
    df = spark.createDataFrame([("a", 2**63 - 1), ("a", 1)], "k string, d bigint")
    with pytest.raises(Exception, match="overflow"):
        K.counters(df, "k", "d").collect()


def test_ingest(spark, tmp_path):
    base = ingest.digest(spark.createDataFrame([(1, "a")], "id int, t string"), "id", ["t"])
    again = ingest.digest(spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string"), "id", ["t"])
    assert ingest.merge_documents(base, again, "id").count() == 2
    with pytest.raises(ValueError):
        ingest.merge_documents(base, ingest.digest(spark.createDataFrame([(1, "z")], "id int, t string"), "id", ["t"]), "id").count()
    source = f"{tmp_path}/in"
    for i in range(3):
        spark.range(i * 5, i * 5 + 6).withColumn("ts", F.timestamp_seconds(F.col("id") * 60)).coalesce(1).write.mode("append").parquet(source)
    stream = ingest.stream_events(spark, source, spark.read.parquet(source).schema)
    for _ in range(2):  # run again: nothing is added
        ingest.run_batches(stream, f"{tmp_path}/out", f"{tmp_path}/c", "id").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").select("id").distinct().count() == 16
    q = ingest.windowed(stream, "ts", "5 minutes", "10 minutes", [], "id").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) from w").first()[0] == 18


def test_export_reader(spark, tmp_path):
    p = tmp_path / "e.json"
    p.write_text('{"id": "1", "properties": {"body": "x"}, "vectors": {"default": [1.0, 2.0]}}\n{"properties": {}}\n{"id": "2"}\n')
    assert sorted((r[0], r[1], r[3]) for r in exports.object_export(spark, str(p), "body").collect()) == [("1", "x", [1.0, 2.0])]
    page = tmp_path / "page.json"
    page.write_text('{"objects": [{"id": "00000000-0000-0000-0000-000000000000", "properties": {"body": "z"}},\n {"id": "a-1", "properties": {"body": "y", "more": 3}, "vector": [0.5]}, {"id": "a-1", "properties": {"body": "y"}, "vector": [0.5]}]}')
    assert [(r[0], r[1], r[3]) for r in exports.object_export(spark, str(page), "body", pages=True).collect()] == [("a-1", "y", [0.5])]


def test_batches_and_stream(spark, monkeypatch):
    empty = ingest.digest(spark.createDataFrame([], "id int, t string"), "id", ["t"])
    batch = lambda name, *rows: ingest.Batch(name, spark.createDataFrame(list(rows), "id int, t string"), "id", ["t"])
    c = ingest.Collection(empty, "id")
    s = ingest.Stream(c, 10_000, 2, 3)
    assert s.enqueue(batch("a", (1, "x"), (2, None))) == "enqueued" and s.enqueue(batch("a", (2, None), (1, "x"))) == "idempotent"
    with pytest.raises(ingest.Conflict):
        s.enqueue(batch("a", (1, "y")))
    assert c.status("a") == "unknown" and s.flush_next() == ("applied", 2) and c.status("a") == "committed" and s.flush_next() is None
    assert c.ingest(batch("a", (1, "x"), (2, None))) == ("replayed", 2) and c.documents.count() == 2
    for b in (batch("a", (9, "x")), batch("b", (1, "other"))):
        with pytest.raises(ingest.Conflict):
            c.ingest(b)
    assert s.enqueue(batch("c", (1, "clash"))) == "enqueued"
    with pytest.raises(ingest.Conflict):
        s.flush_next()
    assert len(s.queue) == 1 and c.documents.count() == 2  # a batch that fails stays
    s.enqueue(batch("d", (3, "z")))
    with pytest.raises(OverflowError):
        s.enqueue(batch("e", (4, "z")))
    with pytest.raises(ValueError):
        batch("f").measure
    monkeypatch.setattr(ingest, "MOST_DOCUMENTS", 1)
    with pytest.raises(ValueError):
        batch("g", (1, "x"), (2, "y")).measure
    c.replace(spark.createDataFrame([(2, "new")], "id int, t string"))
    assert c.delete(spark.createDataFrame([(1,), (1,), (77,)], "id int")) == 1
    assert [(r["id"], r["t"], r["digest"]) for r in c.documents.collect()] == [(2, "new", None)]


def test_flat_tokens(spark):
    docs = spark.createDataFrame([(1, "Don't STOP é o'clock"), (2, "")], "id int, text string")
    ix = L.index(docs, "id", "text", flat=True)
    assert {(r["term"], tuple(r["positions"])) for r in ix.postings.filter("term <> ''").collect()} == {("don't", (0,)), ("stop", (1,)), ("o'clock", (2,))}
    assert [r["doc"] for r in L.bm25(ix, "DON'T").collect()] == [1]


FOUND = "The judge, a dog and the farmer selling two boxes: an appellate tribunal, its letter, the burden of substantiation."


@pytest.fixture(scope="module")
def languages(spark, tmp_path_factory):
    """Documents that every text query finds, one per spelling of the language, one of another word, and one without a text."""
    d = str(tmp_path_factory.mktemp("languages"))
    docs = [(i, FOUND, lang) for i, lang in enumerate(["en", "EN", "en-x", None, "fr"])] + [(5, "autre chose", "fr"), (6, None, "en")]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string").write.parquet(f"{d}/documents.parquet")
    return d


@pytest.mark.parametrize("name", ["bm25_topk", "lex_and", "lex_min_match", "lex_phrase", "lex_prefix", "lex_fuzzy", "lex_boolean", "lex_stop_stem", "highlight"])
def test_all_languages(spark, languages, name):
    found = Q.queries()[name](spark, languages)
    found = found.filter(F.size("fragments") > 0).select("doc_id") if name == "highlight" else found.select("doc")
    assert {r[0] for r in found.collect()} == {0, 1, 2, 3, 4}


def test_statistics_of_all_languages(spark, languages):
    """Each of the 5 terms stands in 5 of 6 texts; counts and the mean length are those of all of them."""
    scores = {r["doc"]: r["score"] for r in Q.bm25_topk(spark, languages).collect()}
    length = len(re.findall("[A-Za-z]+", FOUND))
    mean = (5 * length + 2) / 6
    assert all(s == pytest.approx(5 * log(1 + 1.5 / 5.5) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * length / mean))) for s in scores.values())


def test_rank_of_the_whole_table(spark, data):
    """Every row is ranked among all orders of its customer, with ties."""
    every = [(r["o_orderkey"], r["o_custkey"], r["o_orderpriority"]) for r in spark.read.parquet(f"{data}/orders.parquet").collect()]
    want = [(k, 1 + sum(c == x and q < p for _, x, q in every)) for k, c, p in sorted(every)]
    assert sorted(rows(Q.queries()["win_rank_all"](spark, data))) == want


def test_idempotent_query_meets_stored_rows(spark, data, monkeypatch):
    """The batch replays stored documents and brings new ones, and a stored document of other bytes is noticed."""
    merge, met = ingest.merge_documents, []

    def spy(base, batch, key):
        met.append((base, batch))
        return merge(base, batch, key)

    monkeypatch.setattr(ingest, "merge_documents", spy)
    Q.ingest_idempotent(spark, data)
    base, batch = met[0]
    assert base.join(batch, "recall_id", "left_semi").count() > 0 and batch.join(base, "recall_id", "left_anti").count() > 0
    with pytest.raises(ValueError):
        merge(base.withColumn("digest", F.lit("other")), batch, "recall_id")
