"""Rows of a query and of its SQL as comparable multisets."""

from __future__ import annotations

import math
from collections import Counter


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, int):
        return float(v)
    if isinstance(v, list | tuple):
        return tuple(norm(x) for x in v)
    return v.isoformat().replace("+00:00", "") if hasattr(v, "isoformat") else str(v)


def same(df, duck, text: str) -> None:
    cols = sorted(df.columns)
    got = Counter(tuple(norm(x) for x in r) for r in df.select(*cols).collect())
    r = duck.execute(text)
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = Counter(tuple(norm(row[i]) for i in at) for row in r.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
