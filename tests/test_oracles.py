"""Every catalog query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from pixelmill.plans import catalog_queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if v is None:
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, bool):
        return v
    try:
        x = float(v)
    except (TypeError, ValueError):
        return str(v)
    return None if math.isnan(x) else round(x, 6)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalog_queries.oracle_sql()))
def test_query_equals_sql(spark, con, sf_dir, name):
    df = catalog_queries.queries()[name](spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    want = con.sql(catalog_queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert got == rows(want.columns, want.fetchall())


def test_sizes_of_large_part_keys_equal_sql(spark, sf_dir, tmp_path):
    keys = [1, 1048, 1049, 1_073_741, 1_073_742, 1_199_999, 5_000_000_000]
    duckdb.sql(f"copy (select k as p_partkey, x.* exclude (p_partkey) from (select * from '{sf_dir}/part.parquet' limit 1) x, (select unnest({keys}) as k)) to '{tmp_path}/part.parquet' (format parquet)")
    df = catalog_queries.queries()["text_values"](spark, str(tmp_path))
    c = duckdb.connect()
    c.sql(f"create view part as select * from '{tmp_path}/part.parquet'")
    want = c.sql(catalog_queries.oracle_sql()["text_values"])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())
