"""Mixing sources to target weights with Efraimidis-Spirakis sampling.

Every source gets a budget in words from its weight. A budget beyond the size of the source takes complete
epochs first, then a weighted sample without replacement: each document draws the key ``-ln(u) / quality``,
``u`` being a hash of its id and the seed, and the smallest keys are taken while their sizes fit the rest.

Everything is DataFrame functions. Only the sums of sources and of stretches of keys go through windows; documents
are sorted within one stretch of their source, the one that holds the border. It is found by cutting the keys at
their quantiles again and again, so that it is small however the keys are spread, and a source of any size is never
one task's.

Defined results: NULL or blank texts have size 0 and are taken 0 words; a NULL source is a source of its own,
last in order; documents of size 0 are never sampled; equal keys are ordered by id, rows that repeat their id
follow each other in any order and have the same size if their text is the same; all sizes 0 give targets of 0; an
empty table gives no rows; other columns are ignored.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tablekeeper.llm.quality_rules import host_key
from tablekeeper.llm.tables import load, staged, words

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MOST_EPOCHS = 2
SEED = "mix-1"
#: Documents that one task sorts at most, keys that are equal aside, and stretches that a round cuts keys into.
RANGE_ROWS = 5_000
CUTS = 64


def quality(text):
    """Weight of a document from 0.1 to 1: the fewer symbols among its characters, the more."""
    whole = F.coalesce(text, F.lit(""))
    size = F.greatest(F.length(whole), F.lit(1))
    symbols = F.length(whole) - F.length(F.regexp_replace(whole, r"[#*$%&|<>]", ""))
    return F.greatest(F.lit(0.1), F.lit(1.0) - F.lit(10.0) * symbols / size)


def uniform(doc_id, seed=SEED):
    """Number strictly between 0 and 1 from the id: the first 52 bits of a digest."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))),
                              1, 13), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(1 << 52))


def targets(sources, weights=WEIGHTS, budget=BUDGET, most=MOST_EPOCHS):
    """Adds ``target`` to one row per source (``source``, ``source_size``).

    The sources in order weigh ``weights``, repeating. What a capped source leaves is shared by weight among
    the others: with the caps in order of size per weight, the capped ones are the first so many, and the
    level of the rest follows from running sums. Only this table of sources, a row each, is in one window.
    """
    in_order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    n = F.row_number().over(in_order) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), n % len(weights))
    everything = Window.partitionBy(F.lit(0))
    by_cap = Window.partitionBy(F.lit(0)).orderBy("ratio", "n").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    rows = sources.withColumn("n", n).withColumn("weight", weight).withColumn(
        "cap", F.lit(float(most)) * F.col("source_size")
    ).withColumn("ratio", F.col("cap") / F.col("weight"))
    total = F.lit(float(budget)) * F.sum("source_size").over(everything)
    # Level if exactly this source and those before it were capped.
    rest_weight = F.sum("weight").over(everything) - F.sum("weight").over(by_cap)
    rest = total - F.sum("cap").over(by_cap)
    sums = rows.withColumn("total", total).withColumn("rest", rest).withColumn("rest_weight", rest_weight) \
        .withColumn("all_weight", F.sum("weight").over(everything))
    before = Window.partitionBy(F.lit(0)).orderBy("ratio", "n")
    level = F.coalesce(F.lag("rest").over(before), F.col("total")) / F.coalesce(
        F.lag("rest_weight").over(before), F.col("all_weight"))
    # The first source whose cap is not below the level before it ends the capped ones.
    open_level = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "n", "level"))).over(everything)
    return sums.withColumn("level", level).withColumn("end", open_level).withColumn(
        "target", F.coalesce(F.least(F.col("cap"), F.col("end.level") * F.col("weight")), F.col("cap"))
    ).select("source", "source_size", "target", "n_rows")


def mix(docs, weights=WEIGHTS, budget=BUDGET, most=MOST_EPOCHS, seed=SEED, weight=None, carry=()):
    """``doc_id``, ``size``, ``source``, ``source_size``, ``target`` and ``taken`` of every row.

    ``weight`` is the quality column, by default ``quality(text)``. ``carry`` names small columns to keep.
    """
    weight = quality(F.col("text")) if weight is None else weight
    slim = staged(docs.select(
        "doc_id", "source", *carry, F.size(words(F.col("text"))).cast("long").alias("size"),
        host_key(F.col("source")).alias("_key"), uniform(F.col("doc_id"), seed).alias("_u"),
        F.greatest(weight, F.lit(1e-6)).alias("_w"),
    ), "mix").withColumn("_rank", -F.log("_u") / F.col("_w"))
    sums = slim.groupBy("_key").agg(
        F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    plan = staged(targets(sums, weights, budget, most).withColumn("_key", host_key(F.col("source"))).drop("source")
                  .withColumn("epochs", F.when(
                      F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))
                  ).otherwise(0).cast("long"))
                  .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-plan")
    rows = slim.join(plan, "_key")
    borders = _borders(slim.select("_key", "_rank", "size"), plan.select("_key", "rest", "n_rows")).select(
        F.col("_key").alias("_k"), "low", "high", "start")
    placed = rows.join(borders, F.col("_key") == F.col("_k"))
    at_border = (F.col("_rank") > F.col("low")) & (F.col("_rank") <= F.col("high"))
    inner = Window.partitionBy("_key").orderBy("_rank", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    inside = placed.where(at_border).withColumn(
        "once", (F.col("start") + F.sum("size").over(inner) <= F.col("rest")).cast("long"))
    others = placed.where(~at_border).withColumn("once", (F.col("_rank") <= F.col("low")).cast("long"))
    return inside.unionByName(others).select(
        "doc_id", *carry, "source", "size", "source_size", "target",
        (F.col("size") * (F.col("epochs") + F.col("once"))).alias("taken"),
    )


def _borders(rows, plan):
    """(``_key``, ``low``, ``high``, ``start``): the keys (low, high] among which a source's rest ends, and the words
    before them.

    All keys up to ``low`` are within the rest, none beyond ``high`` is. Each round cuts the keys between at their
    quantiles, whatever their distribution, and keeps the stretch in which the running sum passes the rest, until it
    holds ``RANGE_ROWS`` rows, or rows of one key only.
    """
    state = staged(plan.select(
        "_key", "rest", F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"),
        F.lit(0).cast("long").alias("start"), F.col("n_rows").alias("n"), (F.col("n_rows") > RANGE_ROWS).alias("open")),
        "mix-border")
    share = F.array(*[F.lit(k / CUTS) for k in range(1, CUTS)])
    while not state.where("open").isEmpty():
        inside = rows.join(state.where("open"), "_key").where("_rank > low AND _rank <= high")
        cuts = staged(inside.groupBy("_key").agg(F.array_distinct(
            F.percentile_approx("_rank", share, F.lit(20 * CUTS))).alias("cuts")), "mix-cuts")
        stretch = F.size(F.filter("cuts", lambda c: c < F.col("_rank")))
        known = F.struct("rest", "low", "high", "start", F.col("n").alias("before"), "cuts")
        sums = inside.join(cuts, "_key").groupBy("_key", stretch.alias("at")).agg(
            F.sum("size").alias("words"), F.count("*").alias("n"), F.any_value(known).alias("known"))
        so_far = Window.partitionBy("_key").orderBy("at")
        ends = sums.select("_key", "at", "words", "n", "known.*").withColumn(
            "end", F.col("start") + F.sum("words").over(so_far))
        # The first stretch that ends beyond the rest; without one, all keys are within it.
        last = F.struct("at", "rest", "low", "high", "before", "cuts", "n", (F.col("end") - F.col("words")).alias("start"))
        found = ends.groupBy("_key").agg(
            F.min(F.when(F.col("end") > F.col("rest"), last)).alias("x"),
            F.any_value("rest").alias("rest"), F.any_value("high").alias("high"), F.max("end").alias("end"))
        x = F.col("x")
        cut = lambda k: F.get(x["cuts"], k)
        moved = found.select(
            "_key", "rest", F.when(x.isNull(), F.col("high")).otherwise(F.coalesce(cut(x["at"] - 1), x["low"])).alias("low"),
            F.when(x.isNull(), F.col("high")).otherwise(F.coalesce(cut(x["at"]), x["high"])).alias("high"),
            F.when(x.isNull(), F.col("end")).otherwise(x["start"]).alias("start"),
            F.coalesce(x["n"], F.lit(0).cast("long")).alias("n"),
            F.coalesce((x["n"] > RANGE_ROWS) & (x["n"] < x["before"]), F.lit(False)).alias("open"))
        state = staged(state.where("NOT open").unionByName(moved), "mix-border")
    return state


def op3_mix_sources(spark, folder):
    """The contract's columns for all of ``documents``."""
    return mix(load(spark, folder, "documents")).drop("source")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
k AS (
  SELECT doc_id, source, size,
    -ln((CAST(('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) + 0.5::DOUBLE)
        / 4503599627370496.0::DOUBLE)
      / greatest(0.1::DOUBLE, 1.0::DOUBLE - 10.0::DOUBLE
        * (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g'))) / greatest(length(t), 1)) AS key
  FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source),
o AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w,
    2.0::DOUBLE * source_size AS cap FROM s),
lv AS (
  SELECT a.source,
    (1.5::DOUBLE * (SELECT sum(source_size) FROM o) - coalesce(sum(b.cap), 0))
      / ((SELECT sum(w) FROM o) - coalesce(sum(b.w), 0)) AS level, any_value(a.cap / a.w) AS ratio
  FROM o a LEFT JOIN o b ON b.cap / b.w < a.cap / a.w GROUP BY a.source),
fin AS (SELECT level FROM lv WHERE ratio >= level ORDER BY ratio LIMIT 1),
p AS (
  SELECT source, source_size, CAST(coalesce(least(cap, (SELECT level FROM fin) * w), cap) AS DOUBLE) AS target
  FROM o),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM p),
r AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
