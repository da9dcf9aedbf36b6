"""Connected components of links between 64-bit ids, by alternating large and small stars."""

from pyspark.sql import functions as F

from tablekeeper.llm.tables import staged


def _large_star(edges):
    """Hang every node's larger neighbours on the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges):
    """Hang every node and its smaller neighbours on the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def components(links):
    """(``id``, ``component``) of every id that has links; the component is its smallest id.

    ``links`` has columns ``a`` and ``b``. The rounds, logarithmically many, end when the links are stars and
    no longer change. Each round is written to the shared folder. A hub's links are many narrow rows.
    """
    edges = links.where("a != b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, mark = staged(edges, "links"), None
    while True:
        seen = edges.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.hash("b", "a"))
        ).first()
        if seen == mark:
            break
        mark = seen
        edges = staged(_small_star(_large_star(edges).distinct()).distinct(), "links")
    tops = edges.select(F.col("b").alias("id")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        tops.withColumn("component", F.col("id")))
