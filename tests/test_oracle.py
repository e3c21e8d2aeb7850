"""Every query with an oracle must equal its DuckDB SQL (rows, column names, values)."""
import datetime
import decimal
import math

import pytest

import __spark_entry__ as entry

ORACLE = entry.oracle_sql()
QUERIES = entry.queries()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 9)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_matches_oracle(key, spark, sf, duck):
    sdf = QUERIES[key](spark, sf)
    srows = sdf.collect()
    res = duck.sql(ORACLE[key])
    assert sorted(sdf.columns) == sorted(res.columns)
    drows = res.fetchall()
    assert len(srows) == len(drows)
    assert _rows(sdf.columns, srows) == _rows(res.columns, drows)
