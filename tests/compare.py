"""Comparing a Spark result with a DuckDB one, as sets of rows with columns by name."""

import math


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    return v


def rows(columns, data):
    names = sorted(columns)
    at = [columns.index(n) for n in names]
    return names, sorted((tuple(plain(r[i]) for i in at) for r in data), key=repr)


def same(df, relation):
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(relation.columns, relation.fetchall())
