"""Every registered query of the library against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from quillspark.plans.registry import ORACLE_SQL, QUERIES
from quillspark.sources.tables import TABLES


@pytest.fixture(scope="module")
def db(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return str(v) if isinstance(v, bool) or not isinstance(v, int | float) else round(float(v), 5)


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, small, db, name):
    df = QUERIES[name](spark, small)
    cursor = db.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, cursor.fetchall())


def test_cuts_and_windows(spark, small):
    cuts = QUERIES["cuts_accepted"](spark, small).collect()
    by = {}
    for r in cuts:
        by.setdefault(r["user_id"], []).append(r["us"])
    assert cuts and all(b - a >= 6 * 3600 * 1_000_000 for v in by.values() for a, b in zip(sorted(v), sorted(v)[1:], strict=False))
    parts = QUERIES["chapters_dp"](spark, small).collect()
    assert parts and all(r["first"] <= r["last"] for r in parts)
    assert QUERIES["transcript_windows"](spark, small).count() > 0
    assert QUERIES["hamming_thin"](spark, small).count() > 0
