"""Audit of how filters interact, by contractions of contingency tensors.

Every document gets one flag per filter. Documents are counted per part (source) and pattern of flags; the counts
of a part, of all its documents, of the good and of the toxic ones, make three tensors of 2 x 2 x 2 x 2 x 2, axis
by filter, index 0 for passed and 1 for failed. What a filter does at a step of an order is one einsum, with each
axis weighed by (1, 0) for passed, (0, 1) for failed or (1, 1) for all: filters applied earlier have passed, the own
one has passed or failed, later ones count in full.

Whether a text repeats that of a smaller id needs no join: rows are counted per digest, part, flags and id, then
per digest, part and flags with the smallest id and its count, and the smallest id of the whole table is taken
over these few rows of a digest. Each step aggregates before its exchange, so a text that very many rows share is
a few narrow rows per task. The tensors of a part are one row of at most 32 cells.

Defined results: NULL text counts as empty, which fails A and passes B to D; a NULL source is the part ''; a row
without id never repeats a smaller id and is none; rows of one id and text do not repeat each other; a
document has a label if any row of ``labels`` with its id has it; labels of other documents, NULL labels and other
columns are ignored; an empty table gives no rows.
"""

import itertools
import string

from pyspark.sql import Window
from pyspark.sql import functions as F

from tablekeeper.llm.tables import load, words

#: Letter of the filter that fails texts found under a smaller id; it is judged over the table.
REPEATED = "E"


def text_filters(text):
    """Failure conditions that need the text alone, by letter; ``text`` is never NULL."""
    tokens = words(text)
    return {
        "A": F.size(tokens) < 200,
        "B": 100 * F.size(F.array_distinct(tokens)) < 50 * F.size(tokens),
        "C": 100 * (F.length(text) - F.length(F.translate(text, string.ascii_uppercase, ""))) > 2 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def label_flags(labels):
    """(``doc_id``, ``good``, ``toxic``), one row for each id that has either."""
    return labels.where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"),
    )


def patterns(docs, labels, filters=text_filters):
    """(``part``, ``pattern``, ``n``, ``good``, ``toxic``): documents of a part by the filters they fail.

    Bit k of ``pattern`` belongs to the k-th filter in alphabetical order; ``REPEATED`` is the last one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    failed = filters(text)
    code = sum((F.when(failed[name], 1 << k).otherwise(0) for k, name in enumerate(sorted(failed))), F.lit(0))
    rows = docs.select(
        "doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"), code.alias("pattern"),
    ).join(label_flags(labels), "doc_id", "left").fillna(0, ["good", "toxic"])
    kind = ["digest", "part", "pattern", "good", "toxic"]
    by_id = rows.groupBy("doc_id", *kind).agg(F.count("*").alias("n"))
    by_kind = by_id.groupBy(*kind).agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("no_id"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least"),
    )
    smallest = by_kind.withColumn("smallest", F.min("least.doc_id").over(Window.partitionBy("digest")))
    first = F.col("no_id") + F.when(F.col("least.doc_id") == F.col("smallest"), F.col("least.n")).otherwise(0)
    split = smallest.select(
        "part", "good", "toxic", F.explode(F.array(
            F.struct(F.col("pattern"), first.alias("n")),
            F.struct((F.col("pattern") + (1 << len(failed))).alias("pattern"), (F.col("n") - first).alias("n")),
        )).alias("x"),
    )
    return split.where("x.n > 0").groupBy("part", "x.pattern").agg(
        F.sum("x.n").alias("n"), F.sum(F.col("x.n") * F.col("good")).alias("good"),
        F.sum(F.col("x.n") * F.col("toxic")).alias("toxic"),
    )


def contractions(tensors):
    """Function (earlier axes, own axis) -> counts for each tensor, by einsum; ``tensors`` has them on axis 0.

    The counts are kept, removed, failed, unique_fails, each an array with one number per tensor.
    """
    import numpy as np

    axes = "abcdefghijklmnop"[:tensors.ndim - 1]
    rule = "z" + axes + "," + ",".join(axes) + "->z"
    passed, failed, both = np.array([[1, 0], [0, 1], [1, 1]], np.int64)

    def of(earlier, own):
        def count(here, others):
            return np.einsum(rule, tensors, *[
                here if k == own else passed if k in earlier else others for k in range(len(axes))])

        return (count(passed, both), count(failed, both),
                np.einsum(rule, tensors, *[failed if k == own else both for k in range(len(axes))]),
                count(failed, passed))

    return of


def steps(tensors, names):
    """Rows of (order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    ``tensors`` are those of all, of the good and of the toxic documents. The contraction of a step depends on
    the set of filters applied before, not on their order, and is computed once for each set.
    """
    of, known = contractions(tensors), {}
    rows, total = [], dict.fromkeys(range(len(names)), 0)
    for order in itertools.permutations(range(len(names))):
        for step, own in enumerate(order):
            key = (frozenset(order[:step]), own)
            if key not in known:
                known[key] = of(*key)
            kept, removed, failed, unique = known[key]
            total[own] += int(removed[0])
            rows.append((order, step, own, int(kept[0]), int(removed[0]), int(failed[0] - removed[0]),
                         int(unique[0]), int(removed[1]), int(removed[2])))
    return [
        ("".join(names[k] for k in order), step + 1, *counts, total[own])
        for order, step, own, *counts in rows
    ]


COUNTS = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def audit(docs, labels, filters=text_filters):
    """One row per part, order of the filters and step."""
    names = sorted(filters(F.lit(""))) + [REPEATED]
    size = 1 << len(names)
    cells = patterns(docs, labels, filters).groupBy("part").agg(
        F.collect_list(F.struct("pattern", "n", "good", "toxic")).alias("cells"))  # at most one per pattern

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                flat = np.zeros((3, size), np.int64)
                for cell in row["cells"]:
                    flat[:, cell["pattern"]] = cell["n"], cell["good"], cell["toxic"]
                # Bit k is axis k: the last axis of a reshaped array is the lowest bit.
                tensors = flat.reshape(3, *[2] * len(names)).transpose(0, *range(len(names), 0, -1))
                found = list(zip(*steps(tensors, names)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * len(found[0]), pa.string()), pa.array(found[0], pa.string()),
                     pa.array(found[1], pa.int32()), *[pa.array(x, pa.int64()) for x in found[2:]]],
                    ["part", "filter_order", "step", *COUNTS])

    schema = "part string, filter_order string, step int, " + ", ".join(f"{name} long" for name in COUNTS)
    return cells.mapInArrow(run, schema)


def op13_filter_audit(spark, folder):
    """The contract's rows for all of ``documents``."""
    return audit(load(spark, folder, "documents"), load(spark, folder, "labels"))


OP13_SQL = r"""
WITH lab AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id),
d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
  FROM d LEFT JOIN lab USING (doc_id)),
p AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, CAST(i AS INTEGER) AS step, filter_order[i] AS own FROM o, range(1, 6) AS r(i)),
x AS (
  SELECT *, (SELECT min(strpos(filter_order, u)) FROM (SELECT unnest(string_split(fails, '')) AS u) WHERE u <> '') AS hit,
    strpos(fails, own) > 0 AS failed FROM p, s),
g AS (
  SELECT part, filter_order, step, own,
    CAST(sum(CASE WHEN hit IS NULL OR hit > step THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN hit = step THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN failed AND hit < step THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN fails = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN hit = step THEN good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN hit = step THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM x GROUP BY part, filter_order, step, own)
SELECT * EXCLUDE (own), CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM g
"""
