"""Compare a query with its SQL twin as the driver does: rows, names, order-free values."""

from __future__ import annotations

import math
from collections import Counter

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings traces replay cases tasks curriculum "
    "proposal_ledger candidate_pool selected_skillbank mix_targets pack_sizes"
).split()


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if hasattr(v, "tolist"):
        return _plain(v.tolist())
    if isinstance(v, dict):
        return tuple((k, _plain(x)) for k, x in v.items())
    if hasattr(v, "asDict"):
        return tuple((k, _plain(x)) for k, x in v.asDict().items())
    if hasattr(v, "tzinfo") and getattr(v, "tzinfo", None) is not None:
        import datetime

        return v.astimezone(datetime.timezone.utc).replace(tzinfo=None)
    if type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return v


def duck(sf_dir: str):
    import os

    import duckdb

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        path = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"create view {t} as select * from '{path}'")
    return con


def difference(df, sql: str, con) -> str:
    """Empty if equal, else what differs."""
    names = sorted(df.columns)
    mine = Counter(tuple(_plain(r[n]) for n in names) for r in df.collect())
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    if sorted(cols) != names:
        return f"columns {names} against {sorted(cols)}"
    at = [cols.index(n) for n in names]
    theirs = Counter(tuple(_plain(r[i]) for i in at) for r in res.fetchall())
    if mine == theirs:
        return ""
    return f"rows {sum(mine.values())} against {sum(theirs.values())}; only here {list((mine - theirs).items())[:4]}; only there {list((theirs - mine).items())[:4]}"
