"""Named queries, each with its check in plain SQL where one exists."""

QUERIES = {}
SQL = {}


def query(name, sql=None):
    """Register ``fn(spark, folder)`` under ``name``; ``sql`` is what DuckDB runs beside it."""

    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep
