"""Holds queries against their SQL: same columns, same rows in any order."""

from __future__ import annotations

import math
import os
from collections import Counter

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x + 0.0)
    if isinstance(x, (list, tuple)):
        return repr([plain(y) for y in x])
    return repr(float(x)) if type(x).__name__ == "Decimal" else repr(x) if isinstance(x, (bool, str)) or x is None else repr(float(x)) if isinstance(x, int) else repr(x)


def differences(df, con, sql: str) -> list[str]:
    """What is wrong, in words; empty if all agrees."""
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} and {sorted(names)}"]
    order = sorted(names)
    a = Counter(tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in order]).collect())
    at = [names.index(c) for c in order]
    b = Counter(tuple(plain(r[k]) for k in at) for r in found.fetchall())
    if a == b:
        return []
    return [f"rows {sum(a.values())} and {sum(b.values())}", f"only here {list((a - b).items())[:3]}", f"only in SQL {list((b - a).items())[:3]}"]
