"""Source tables and restore targets."""

from pyspark.sql import functions as F

from tablekeeper.errors import KeeperError


def read_table(spark, path):
    return spark.read.parquet(path)


def read_jdbc(spark, url, table, column, lower, upper, parts, **options):
    """A database table read in ``parts`` ranges of ``column``, each by its own task."""
    if parts < 1:
        raise KeeperError("parts must be positive")
    reader = spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=column, lowerBound=str(lower),
        upperBound=str(upper), numPartitions=str(parts), **options,
    )
    return reader.load()


def replace_table(df, path):
    """Replace the contents of a Parquet table."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)


def replace_jdbc(df, url, table, **options):
    """Replace the rows of a database table and keep its definition."""
    df.write.format("jdbc").mode("overwrite").options(
        url=url, dbtable=table, truncate="true", **options
    ).save()


def compression_for(profile_setting=None, default="gzip", disabled=False):
    """Codec of a sink: the profile's setting over the default; ``disabled`` beats both."""
    if disabled:
        return "none"
    if profile_setting is not None:
        return "gzip" if profile_setting else "none"
    return default


def write_lines(df, path, codec):
    """JSON lines, gzip-compressed or plain; readers detect the codec by themselves."""
    if codec not in ("gzip", "none"):
        raise KeeperError(f"unknown compression {codec!r}")
    df.write.mode("overwrite").option("compression", codec).json(path)


def file_codec():
    """Codec of the file a row was read from."""
    return F.when(F.col("_metadata.file_path").endswith(".gz"), "gzip").otherwise("none")
