"""Maintenance of keyed tables: every function returns the new table as a DataFrame."""

from functools import reduce

from pyspark.sql import functions as F


def _match(left, right, key):
    return reduce(lambda a, b: a & b, [left[k] == right[k] for k in key])


def upsert(table, updates, key, columns):
    """Insert new keys; on a known key take ``columns`` from the update, keep the rest.

    ``updates`` holds one row per key and the same columns as the table.
    """
    old = table.withColumn("_old", F.lit(True)).alias("t")
    new = updates.withColumn("_new", F.lit(True)).alias("u")
    joined = old.join(new, _match(table, updates, key), "full_outer")
    result = []
    for name in table.columns:
        before, after = F.col(f"t.{name}"), F.col(f"u.{name}")
        if name in key:
            value = F.coalesce(before, after)
        elif name in columns:
            value = F.when(F.col("u._new"), after).otherwise(before)
        else:
            value = F.when(F.col("t._old"), before).otherwise(after)
        result.append(value.alias(name))
    return joined.select(*result)


def insert_ignore(table, rows, key):
    """Add rows whose key is not in the table yet."""
    return table.unionByName(rows.join(table.select(*key), key, "left_anti").select(*table.columns))


def update_where(table, condition, **values):
    """Set columns in the rows that satisfy ``condition`` (NULL counts as no)."""
    hit = F.coalesce(condition, F.lit(False))
    return table.select(*[
        F.when(hit, values[name]).otherwise(F.col(name)).alias(name)
        if name in values else F.col(name)
        for name in table.columns
    ])


def delete_keys(table, keys, key):
    """Remove the rows whose key is listed."""
    return table.join(keys.select(*key), key, "left_anti").select(*table.columns)
