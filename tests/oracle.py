"""Compares a Spark result with DuckDB's, without regard to the order of rows."""

import datetime
import decimal
import math


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (float(f"{v:.9g}") if v else 0.0)
    if isinstance(v, decimal.Decimal):
        return plain(float(v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if hasattr(v, "asDict"):
        return plain(tuple(v))
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


def _key(row):
    return tuple((x is None, str(type(x)) if not isinstance(x, int | float) else "n", x if isinstance(x, int | float | str) else str(x)) for x in row)


def assert_same(df, relation):
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    at = [relation.columns.index(c) for c in columns]
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=_key)
    other = sorted((tuple(plain(r[i]) for i in at) for r in relation.fetchall()), key=_key)
    assert len(mine) == len(other)
    assert [p for p in zip(mine, other) if p[0] != p[1]][:3] == []
