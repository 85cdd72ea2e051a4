"""Every query with an oracle gives what DuckDB gives on the same tables."""

import decimal
import glob
import os

import pytest

duckdb = pytest.importorskip("duckdb")
from loomline.plans import queries as Q  # noqa: E402


def norm(v):
    return float(v) if isinstance(v, (int, decimal.Decimal)) and not isinstance(v, bool) else v


def key(row):
    return tuple((v is None, str(v)) for v in row)


@pytest.fixture(scope="module")
def db(data):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def compare(db, spark, data, name, query=None):
    df = (query or Q.queries()[name])(spark, data)
    names = sorted(df.columns)
    got = sorted((tuple(norm(r[n]) for n in names) for r in df.collect()), key=key)
    cursor = db.execute(Q.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    want = sorted((tuple(norm(r[columns.index(n)]) for n in names) for r in cursor.fetchall()), key=key)
    return got, want


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_oracle(db, spark, data, name):
    got, want = compare(db, spark, data, name)
    assert got == want


def test_negative_control(db, spark, data):
    """A wrong query is noticed."""
    got, want = compare(db, spark, data, "ks_zrange", lambda s, d: Q.ks_zrange(s, d).filter("rank < 9"))
    assert got != want


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_runs(spark, data, name):
    assert Q.queries()[name](spark, data).columns
    assert Q.queries()[name](spark, data).count() >= 0


def test_entry(monkeypatch):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    monkeypatch.setattr(e, "CORE", ("loomline.plans.none",))
    with pytest.raises(ModuleNotFoundError):
        e.queries()
