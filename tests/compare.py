"""Rows of a Spark query and of DuckDB SQL over the same tables, made comparable."""

import math
import os

import duckdb

from fleetlens.plans.adapters import TABLES


def connection(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    try:
        return round(float(value), 9) + 0.0 if not isinstance(value, str) else value
    except (TypeError, ValueError):
        return value


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(v[i]) for i in order) for v in values), key=repr)


def spark_rows(frame):
    return rows(frame.columns, frame.collect())


def duck_rows(con, sql):
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return rows(names, found.fetchall()), sorted(names)
