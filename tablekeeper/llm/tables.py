"""Reading, staging and defaults shared by the operators."""

from pyspark.sql import functions as F

from tablekeeper.session import work_dir

#: White space of the word rules, as a class for Java's regular expressions.
SPACE = r"[\x20\x09-\x0D]"


def load(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def staged(df, name):
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text):
    """Array of the words of ``text``; empty where it is NULL."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def let(value, body):
    """``body(value)`` with ``value`` computed once, for use inside array expressions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tasks_for(df, per_task, least=1):
    """Partitions so that each gets about ``per_task`` rows of ``df``; costs a count."""
    return max(least, -(-df.count() // per_task))
