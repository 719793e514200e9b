"""Run a registered query next to its oracle and compare the rows, regardless of order."""

import datetime
import math
import os

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, bool) or value is None:
        return repr(value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return repr({k: _plain(v) for k, v in value.items()})
    if isinstance(value, (list, tuple)):
        return repr([_plain(v) for v in value])
    return repr(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    """None if equal, else a short description of the difference."""
    got_names, got = df.columns, df.collect()
    result = con.execute(sql)
    want_names, want = [d[0] for d in result.description], result.fetchall()
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(got_names)} <> {sorted(want_names)}"
    a, b = rows_of(got_names, got), rows_of(want_names, want)
    if a == b:
        return None
    only_a, only_b = set(a) - set(b), set(b) - set(a)
    return f"{len(a)} rows vs {len(b)}; spark only {sorted(only_a)[:3]}; oracle only {sorted(only_b)[:3]}"


def sf_dir(scale="0.001"):
    return os.environ.get("TEST_SF_DIR", f"/root/testdata/sf{scale}")
