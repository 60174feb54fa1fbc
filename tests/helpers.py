"""What several test files use."""

from __future__ import annotations

import math

SMALL = "/root/testdata/sf0.001"


def rows_by_client(df):
    return {r["client_id"]: r.asDict() for r in df.collect()}


def same_rows(left, right):
    """Equal as multisets, up to the noise of floating sums."""
    assert sorted(left.columns) == sorted(right.columns)
    types = dict(left.dtypes)
    names = sorted(left.columns, key=lambda n: (types[n] == "double", n))

    def key(row):
        return [str(round(round(v, 9), 3) + 0.0) if isinstance(v, float) else str(v) for v in row]

    a, b = (sorted((tuple(r) for r in df.select(*names).collect()), key=key) for df in (left, right))
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for name, v, w in zip(names, x, y):
            same = math.isclose(v, w, rel_tol=1e-9, abs_tol=1e-9) if isinstance(v, float) and w is not None else v == w
            assert same, (name, x, y)
