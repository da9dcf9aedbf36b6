"""Masking jobs over tables."""

import os
import re
from dataclasses import dataclass

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekeeper.errors import KeeperError
from tablekeeper.functions.masking import STRATEGIES, salt_key

IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")


@dataclass(frozen=True)
class MaskRule:
    table: str
    column: str
    strategy: str = "redact"
    value: str | None = None


def masking_key(salt=None):
    """Key of a salt; without one, a random key drawn once here, so that all rows agree."""
    return salt_key(os.urandom(32) if salt is None else salt)


def check_rules(rules, tables=None):
    """Reject bad rules before any job starts. ``tables`` maps names to DataFrames."""
    for rule in rules:
        if rule.strategy not in STRATEGIES:
            raise KeeperError(
                f"unknown masking strategy {rule.strategy!r}, expected one of {sorted(STRATEGIES)}"
            )
        for name in (rule.table, rule.column):
            if not IDENTIFIER.match(name):
                raise KeeperError(f"not a valid identifier in a masking rule: {name!r}")
        if tables is not None:
            if rule.table not in tables:
                raise KeeperError(f"masking rule names unknown table {rule.table!r}")
            if rule.column not in tables[rule.table].columns:
                raise KeeperError(f"table {rule.table!r} has no column {rule.column!r}")


def _fold(df, table, rules, key):
    """(rule, value before, value after) for each rule of a table, and the final columns."""
    current = {name: F.col(name) for name in df.columns}
    steps = []
    for rule in rules:
        if rule.table == table:
            before = current[rule.column]
            after = STRATEGIES[rule.strategy](before, key, rule.value)
            steps.append((rule, before, after))
            current[rule.column] = after
    return steps, current


def mask_table(df, table, rules, key):
    """Apply the rules of ``table`` in order; other columns pass through untouched."""
    check_rules([r for r in rules if r.table == table], {table: df})
    _, current = _fold(df, table, rules, key)
    return df.select(*[column.alias(name) for name, column in current.items()])


def _changed(df, table, rules, key, column):
    """Row with the number of distinct values of a column that the last of its rules changes."""
    values = df.select(column).distinct()
    steps, _ = _fold(values, table, rules, key)
    _, before, after = steps[-1]
    text = isinstance(df.schema[column].dataType, T.StringType)
    # a non-text value never equals its masked text
    changed = F.when(~after.eqNullSafe(before) if text else before.isNotNull(), before)
    # after an earlier rule, distinct values may have become equal
    number = F.count(changed) if len(steps) == 1 else F.countDistinct(changed)
    return values.agg(number.alias("n_masked")).select(F.lit(f"{table}.{column}").alias("masked_column"), "n_masked")


def masked_counts(tables, rules, key):
    """Distinct values changed per ``table.column``.

    Each column is read on its own and reduced to its distinct values before any is masked. Two rules on one
    column report the later rule's count.
    """
    check_rules(rules, tables)
    parts = None
    for table, df in tables.items():
        for column in dict.fromkeys(rule.column for rule in rules if rule.table == table):
            own = [rule for rule in rules if rule.table == table and rule.column == column]
            row = _changed(df, table, own, key, column)
            parts = row if parts is None else parts.unionByName(row)
    return parts


def sanitize(tables, rules, out, salt=None):
    """Write a masked copy of every table below ``out``; the sources are only read.

    Returns the counts per masked column. Tables without rules are copied unchanged.
    """
    if not rules:
        raise KeeperError("no masking rules given")
    if not out:
        raise KeeperError("no destination given")
    key = masking_key(salt)
    check_rules(rules, tables)
    for table, df in tables.items():
        mask_table(df, table, rules, key).write.mode("overwrite").parquet(f"{out}/{table}")
    return masked_counts(tables, rules, key)


def with_total(counts):
    """Counts plus one ``total`` row."""
    total = counts.agg(F.sum("n_masked").alias("n_masked")).select(
        F.lit("total").alias("masked_column"), "n_masked"
    )
    return counts.unionByName(total)


def join_rows(left, left_key, right, right_key):
    """Number of rows an inner join gives, from per-key counts (the join itself is never built).

    The number is a decimal: two keys with very many rows each make more than a bigint holds.
    """
    a = left.groupBy(F.col(left_key).cast("string").alias("k")).agg(F.count(F.lit(1)).alias("a"))
    b = right.groupBy(F.col(right_key).cast("string").alias("k")).agg(F.count(F.lit(1)).alias("b"))
    pairs = F.col("a").cast("decimal(19,0)") * F.col("b").cast("decimal(19,0)")
    total = F.sum(pairs.cast("decimal(38,0)"))
    return a.join(b, "k").agg(F.coalesce(total, F.lit(0).cast("decimal(38,0)")).alias("n"))


def join_safety(left, left_key, right, right_key, strategy, key):
    """One row: join size on raw and on masked keys, and masked values that merge raw ones."""
    mask = STRATEGIES[strategy]
    masked_left = left.select(mask(F.col(left_key), key).alias("m"))
    masked_right = right.select(mask(F.col(right_key), key).alias("m"))
    merged = (
        left.select(F.col(left_key).cast("string").alias("v"))
        .union(right.select(F.col(right_key).cast("string")))
        .filter(F.col("v").isNotNull())
        .distinct()
        .groupBy(mask(F.col("v"), key).alias("m"))
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.count(F.when(F.col("n") > 1, 1)).alias("merged_values"))
    )
    raw = join_rows(left, left_key, right, right_key).withColumnRenamed("n", "raw_join_rows")
    masked = join_rows(masked_left, "m", masked_right, "m").withColumnRenamed(
        "n", "masked_join_rows"
    )
    one = F.lit(1).alias("one")
    return (
        raw.select("*", one).join(masked.select("*", one), "one")
        .join(merged.select("*", one), "one")
        .select("raw_join_rows", "masked_join_rows", "merged_values")
    )
