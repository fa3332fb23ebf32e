"""Every registered series query against its SQL in DuckDB."""

import os

import duckdb
import pytest

from stridelake.plans import everything as catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


def same(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 1e-5 * max(1, abs(a))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query(spark, db, name):
    got = catalog.QUERIES[name](spark, FOLDER)
    names = sorted(got.columns)
    key = lambda row: tuple((v is None, v if v is not None else 0) for v in row)
    rows = sorted((tuple(r[n] for n in names) for r in got.collect()), key=key)
    found = db.execute(catalog.ORACLE[name])
    columns = [c[0] for c in found.description]
    want = sorted((tuple(dict(zip(columns, r))[n] for n in names) for r in found.fetchall()), key=key)
    assert sorted(columns) == names
    assert len(rows) == len(want)
    assert all(same(a, b) for x, y in zip(rows, want) for a, b in zip(x, y))


PAIRED = ["sample_entropy", "approximate_entropy", "permutation_entropy", "nearest_neighbour", "lyapunov_wolf"]  # the SQL of lyapunov_rosenstein did not end in 50 s


@pytest.mark.parametrize("name", PAIRED)
def test_long_series(spark, tmp_path, name):
    """A recording of 1,200 samples beside short ones, against the same SQL."""
    c = duckdb.connect()
    c.execute("CREATE TABLE events AS SELECT * REPLACE ((CASE WHEN event_id % 5 > 0 THEN 1 ELSE 2 + event_id % 3 END)::BIGINT AS user_id) FROM '/root/testdata/sf0.01/events.parquet' ORDER BY event_id LIMIT 1500")
    c.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got = catalog.QUERIES[name](spark, str(tmp_path))
    found = c.execute(catalog.ORACLE[name])
    columns = [x[0] for x in found.description]
    rows, want = sorted(tuple(r[n] for n in columns) for r in got.collect()), sorted(found.fetchall())
    assert len(rows) == len(want)
    assert all(same(a, b) for x, y in zip(rows, want) for a, b in zip(x, y))
