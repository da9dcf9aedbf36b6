"""Run registered queries beside their SQL in DuckDB and compare all rows.

python tests/compare.py [folder] [name ...]
"""

import datetime
import decimal
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, (bytearray, bytes)):
        return bytes(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted(
        (tuple(plain(r[i]) for i in order) for r in rows), key=lambda t: repr(t)
    )


FAMILY = {
    "bigint": "BIGINT", "string": "VARCHAR", "int": "INTEGER", "double": "DOUBLE",
    "boolean": "BOOLEAN", "binary": "BLOB",
}


def compare(spark, con, name, queries, sql, folder):
    """(problem or None, rows, seconds)."""
    start = time.time()
    df = queries[name](spark, folder)
    got = df.collect()
    took = time.time() - start
    if name not in sql:
        return (None if got else "no rows"), len(got), took
    cursor = con.execute(sql[name])
    theirs = cursor.fetchall()
    names = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]) for d in cursor.description}
    a_names, a = rows_of(df.columns, got)
    b_names, b = rows_of(names, theirs)
    if a_names != b_names:
        return f"columns {a_names} != {b_names}", len(a), took
    if a != b:
        only_a = [r for r in a if r not in set(b)][:2]
        only_b = [r for r in b if r not in set(a)][:2]
        return f"rows {len(a)} vs {len(b)}; spark only {only_a}; sql only {only_b}", len(a), took
    if not a:
        return "both empty", 0, took
    kinds = dict(df.dtypes)
    odd = {c: (kinds[c], types[c]) for c in a_names if FAMILY.get(kinds[c]) != types[c]}
    return (f"types {odd}" if odd else None), len(a), took


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from tablekeeper.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
           "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in sys.argv[2:] or queries:
        if name not in queries:
            for full in queries:
                if full.startswith(name):
                    name = full
        try:
            problem, n, took = compare(spark, con, name, queries, sql, folder)
        except Exception as error:
            problem, n, took = f"{type(error).__name__}: {str(error)[:600]}", 0, 0
        bad += problem is not None
        mark = "ok  " if problem is None else "BAD "
        print(f"{mark} {name} rows={n} {took:.2f}s {'' if name in sql else '(rows only)'} {problem or ''}", flush=True)
    print(f"{len(queries)} queries, {len(sql)} with SQL, {bad} bad")
