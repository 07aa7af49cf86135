"""Every query runs on the smallest tables, and agrees with its SQL where it has one."""

import os
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("GRIDWAKE_TEST_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")
CORE = [(n, f) for part in entry._parts() if ".llm." not in part.__name__ for n, f in part.QUERIES.items()]
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for file in os.listdir(FOLDER):
        path = f"{FOLDER}/{file}"
        con.execute(
            f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM "
            f"read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')"
        )
    return con


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19].removesuffix("T00:00:00")
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist"):
        v = v.tolist() if hasattr(v, "tolist") else v
        return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else plain(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return float(f"{float(v):.7g}")
    return str(v)


@pytest.fixture(scope="module")
def results(spark):
    """All queries' rows; small queries leave most cores idle, so several run at a time."""

    def run(item):
        name, query = item
        try:
            df = query(spark, FOLDER)
            return name, (sorted(df.columns), [r.asDict() for r in df.collect()])
        except Exception as e:  # the query's own test reports it
            return name, e

    with ThreadPoolExecutor(8) as pool:
        return dict(pool.map(run, CORE))


@pytest.mark.parametrize("name", [n for n, _ in CORE])
def test_query(results, duck, name):
    if isinstance(results[name], Exception):
        raise results[name]
    columns, rows = results[name]
    got = Counter(tuple(plain(r[c]) for c in columns) for r in rows)
    if name in SQL:
        relation = duck.sql(SQL[name])
        assert sorted(relation.columns) == columns
        at = [relation.columns.index(c) for c in columns]
        assert got == Counter(tuple(plain(r[i]) for i in at) for r in relation.fetchall())


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_sql_has_its_query():
    assert set(SQL) <= set(entry.queries())
