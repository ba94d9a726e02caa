"""Side-by-side run of a registered query and its SQL oracle."""

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def cell(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, decimal.Decimal):
        return ("decimal", value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return tuple(cell(v) for v in value)
    return value


def normal_form(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shaped = [tuple(cell(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(shaped, key=repr)


def difference(spark_df, con, sql) -> str | None:
    """None when both sides agree exactly, else a short description."""
    left = normal_form(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    result = con.execute(sql)
    right = normal_form([d[0] for d in result.description], result.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"rows {len(left[1])} != {len(right[1])}; first {left[1][:2]} | {right[1][:2]}"
    if not left[1]:
        return "no rows on either side"
    bad = [(a, b) for a, b in zip(left[1], right[1]) if repr(a) != repr(b)]
    if bad:
        return f"{len(bad)} of {len(left[1])} rows differ; columns {left[0]}; first {bad[0][0]} | {bad[0][1]}"
    return None
