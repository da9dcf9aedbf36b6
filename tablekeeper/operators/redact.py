"""Redaction jobs over text columns."""

from pyspark.sql import functions as F

from tablekeeper.functions.redaction import PATTERNS, redact, redact_secrets


def redact_text(df, column, secrets=()):
    """The table with one text column redacted; whole texts, other columns untouched."""
    return df.withColumn(column, redact(F.col(column), secrets))


def redaction_report(df, column, group, secrets=()):
    """Rows, changed rows and hits per pattern for each group.

    Each pattern is counted in the text the earlier ones leave; one column per step, so that no
    pattern runs twice over a text.
    """
    rows = df.select(*group, F.col(column).alias("_original"), F.col(column).alias("_text"))
    names = []
    for name, contained, pattern, replacement in PATTERNS:
        possible = F.col("_original").contains(contained)
        hits = F.when(possible, F.regexp_count("_text", F.lit(pattern))).otherwise(0)
        left = F.regexp_replace("_text", pattern, replacement)
        rows = rows.withColumn(name, hits).withColumn(
            "_text", F.when(F.col(name) > 0, left).otherwise(F.col("_text"))
        )
        names.append(name)
    changed = ~redact_secrets(F.col("_text"), secrets).eqNullSafe(F.col("_original"))
    return rows.withColumn("_changed", changed).groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(F.when(F.col("_changed"), 1)).alias("n_changed"),
        *[F.coalesce(F.sum(F.col(n).cast("bigint")), F.lit(0)).alias(n) for n in names],
    )
