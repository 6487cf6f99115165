"""Rows without order, numbers without their types."""

import math


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool) or isinstance(value, str):
        return value
    try:
        return int(value) if float(value) == int(value) else float(value)
    except (TypeError, ValueError):
        return str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


def same(df, con, sql):
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want = rows(rel.columns, rel.fetchall())
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(got) == len(want)
    assert got == want
