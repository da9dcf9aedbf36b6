"""Product codes of vectors, with the nearest entry found by LAESA pivots.

Every component x becomes the integer floor(256 * x), every vector is cut into equal consecutive parts, and each
part position has a codebook. A few entries of the first codebook stay the pivots of their position. The distances
of every part to its pivots are computed once and stored beside the integers. In each round the distances of the
entries to the pivots are added to them: by the triangle inequality the largest difference over the pivots bounds
the distance of part and entry from below. Entries are tried in the order of that bound, with exact integer
distances, until the bound passes the least distance found.

A round sends one row for each entry in use and task to an aggregate: the count and the sums of its parts. The
driver holds the codebooks alone (entries x dimension integers). All tasks work on blocks of ``BLOCK`` rows.

Defined results: a vector that is NULL, or holds a NULL, NaN or infinite component, is dropped, and so is an empty
one, one whose length is no multiple of the number of parts, and one whose length differs from that of the smallest
id among the rest; a NULL id counts as the largest, and rows of equal ids are ordered by their integers; repeated
rows each count and each get their row; fewer rows than entries make a smaller codebook; integers beyond
+-2^26 count as +-2^26; rows of NULL label are summed together; an empty table gives no rows; other columns are
ignored.
"""

import hashlib

from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from tablekeeper.llm.tables import load, staged

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
PIVOTS = 4
#: Integers are cut to this, so that distances and sums fit 64 bits.
LARGEST = 1 << 26
#: Rows that a task handles at once.
BLOCK = 2048
#: Relative slack of a bound against the rounding of its square roots.
SLACK = 1e-12


def usable(vectors, id_column, vector, label):
    """(``id``, ``label``, ``ints``) of the rows that are kept, before their length is looked at."""
    value = F.col(vector)
    x = lambda v: v.cast("double")
    ints = F.transform(value, lambda v: F.floor(F.least(F.greatest(
        x(v) * F.lit(float(SCALE)), F.lit(-float(LARGEST))), F.lit(float(LARGEST)))).cast("int"))
    fine = value.isNotNull() & F.forall(
        value, lambda v: v.isNotNull() & ~F.isnan(x(v)) & (F.abs(x(v)) != F.lit(float("inf"))))
    return vectors.where(F.coalesce(fine, F.lit(False))).select(
        F.col(id_column).alias("id"), F.col(label).alias("label"), ints.alias("ints"))


def squares(a, b):
    """Exact squared distances of all rows of ``a`` to all rows of ``b``."""
    import numpy as np

    out = np.zeros((len(a), len(b)), np.int64)
    for k in range(a.shape[1]):
        difference = a[:, k, None] - b[None, :, k]
        out += difference * difference
    return out


def choose_pivots(entries, n=PIVOTS):
    """Indexes of entries that lie far apart: the first one, then each time the one farthest from those chosen."""
    chosen = [0]
    distance = squares(entries, entries[:1])[:, 0]
    while len(chosen) < min(n, len(entries)):
        chosen.append(int(distance.argmax()))
        distance = distance.clip(max=squares(entries, entries[chosen[-1:]])[:, 0])
    return chosen


def nearest(block, near, entries, entry_near):
    """(index, squared distance, number of distances computed) of the nearest entry of each row of ``block``.

    ``near`` and ``entry_near`` hold the distances of rows and entries to the pivots. Of entries at the same
    distance the first counts.
    """
    import numpy as np

    low = np.zeros((len(block), len(entries)))
    for p in range(near.shape[1]):
        a, b = near[:, p, None], entry_near[None, :, p]
        np.maximum(low, np.abs(a - b) - SLACK * (a + b), out=low)
    low *= low * (1 - SLACK)
    order = np.argsort(low, axis=1, kind="stable")
    low = np.take_along_axis(low, order, axis=1)
    best = np.full(len(block), np.iinfo(np.int64).max, np.int64)
    index = np.zeros(len(block), np.int64)
    open_rows, tried = np.arange(len(block)), 0
    for k in range(len(entries)):
        open_rows = open_rows[low[open_rows, k] <= best[open_rows]]
        if not len(open_rows):
            break
        entry = order[open_rows, k]
        difference = block[open_rows] - entries[entry]
        distance = (difference * difference).sum(axis=1)
        tried += len(open_rows)
        better = (distance < best[open_rows]) | ((distance == best[open_rows]) & (entry < index[open_rows]))
        best[open_rows[better]], index[open_rows[better]] = distance[better], entry[better]
    return index, best, tried


def _matrix(column, width, dtype):
    import numpy as np

    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype).reshape(len(column), width)


def with_pivots(kept, codebooks, pivots):
    """``kept`` with ``near``: the squared distances of every part to the pivots of its position."""
    parts, _, width = codebooks.shape
    schema = kept.select("id", "label", "ints").schema.add("near", ArrayType(LongType()))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                rows = batch.slice(at, BLOCK)
                x = _matrix(rows.column("ints"), parts * width, np.int64)
                near = np.concatenate([
                    squares(x[:, p * width:(p + 1) * width], codebooks[p][pivots[p]]) for p in range(parts)
                ], axis=1)
                offsets = np.arange(0, near.size + 1, near.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(near.ravel()))],
                    ["id", "label", "ints", "near"])

    return kept.select("id", "label", "ints").mapInArrow(run, schema)


def _assigned(codebooks, pivots):
    """Function from an Arrow batch to (integers, indexes, squared distances) of its rows, block by block."""
    import numpy as np

    parts, _, width = codebooks.shape
    entry_near = [np.sqrt(squares(codebooks[p], pivots[p]).astype(np.float64)) for p in range(parts)]

    def run(batch):
        for at in range(0, batch.num_rows, BLOCK):
            rows = batch.slice(at, BLOCK)
            x = _matrix(rows.column("ints"), parts * width, np.int64)
            near = np.sqrt(_matrix(rows.column("near"), parts * pivots.shape[1], np.float64))
            found = [
                nearest(x[:, p * width:(p + 1) * width], near[:, p * pivots.shape[1]:(p + 1) * pivots.shape[1]],
                        codebooks[p], entry_near[p])
                for p in range(parts)
            ]
            yield rows, x, np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)

    return run


def moved(table, codebooks, pivots):
    """The codebooks after one round: every entry in use becomes the rounded-down mean of its parts."""
    import numpy as np

    parts, entries, width = codebooks.shape
    sums = [f"s{k}" for k in range(width)]

    def run(batches):
        import pyarrow as pa

        assign = _assigned(codebooks, pivots)
        total = np.zeros((parts * entries, width), np.int64)
        count = np.zeros(parts * entries, np.int64)
        for batch in batches:
            for _, x, index, _ in assign(batch):
                for p in range(parts):
                    np.add.at(total, p * entries + index[:, p], x[:, p * width:(p + 1) * width])
                    count += np.bincount(p * entries + index[:, p], minlength=parts * entries)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(count[used]), *(pa.array(total[used, k]) for k in range(width))],
            ["entry", "n", *sums])

    schema = ", ".join(f"{name} long" for name in ["entry", "n", *sums])
    rows = table.select("ints", "near").mapInArrow(run, schema).groupBy("entry").agg(
        *[F.sum(name).alias(name) for name in ["n", *sums]]).collect()
    out = codebooks.copy()
    for row in rows:
        out[row.entry // entries, row.entry % entries] = [row[name] // row.n for name in sums]
    return out


def assigned(table, codebooks, pivots):
    """``id``, ``label``, ``code`` and ``error`` of every row."""
    schema = table.select("id", "label").schema.add("code", "string").add("error", "long")

    def run(batches):
        import pyarrow as pa

        assign = _assigned(codebooks, pivots)
        for batch in batches:
            for rows, _, index, distance in assign(batch):
                codes = [bytes(line).hex() for line in index.astype("uint8")]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("id"), rows.column("label"), pa.array(codes, pa.string()),
                     pa.array(distance.sum(axis=1))], ["id", "label", "code", "error"])

    return table.mapInArrow(run, schema)


def codebook_digest(codebooks):
    """SHA-256 of all components in order, as decimal integers joined by commas."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def fit_codes(vectors, parts=PARTS, entries=ENTRIES, rounds=ROUNDS, pivots=PIVOTS,
              id_column="vec_id", vector="embedding", label="label"):
    """(codes, codebooks): ``id``, ``label``, ``code``, ``error`` of every kept row, and the final codebooks.

    ``entries`` is 256 at most, as an index is two hex digits. The codebooks are an array of part, entry and
    position, None if no row is kept.
    """
    import numpy as np

    kept = usable(vectors, id_column, vector, label).where((F.size("ints") > 0) & (F.size("ints") % parts == 0))
    order = [F.col("id").asc_nulls_last(), F.size("ints"), "ints"]
    first = kept.orderBy(*order).select(F.size("ints").alias("n")).limit(1).collect()
    if not first:
        return kept.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), None
    kept = kept.where(F.size("ints") == first[0].n)
    seeds = np.array([r.ints for r in kept.orderBy(*order).select("ints").limit(entries).collect()], np.int64)
    codebooks = np.ascontiguousarray(seeds.reshape(len(seeds), parts, -1).transpose(1, 0, 2))
    chosen = [choose_pivots(codebooks[p], pivots) for p in range(parts)]
    points = np.stack([codebooks[p][chosen[p]] for p in range(parts)])
    table = staged(with_pivots(kept, codebooks, chosen), "vector-parts")
    for _ in range(rounds):
        codebooks = moved(table, codebooks, points)
    return assigned(table, codebooks, points), codebooks


def op11_vector_codes(spark, folder):
    """The contract's columns for all of ``embeddings``."""
    codes, codebooks = fit_codes(load(spark, folder, "embeddings"))
    codes = staged(codes, "vector-codes")
    # Read back, so that a label of very many rows can be split by the join.
    by_label = staged(codes.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors").select(
        F.col("label").alias("of"), "label_error")
    return codes.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("id").alias("vec_id"), "code", "error", "label_error",
        F.lit(None if codebooks is None else codebook_digest(codebooks)).cast("string").alias("codebooks_sha256"))


def _sql_round(k):
    return f"""
dist{k} AS (
  SELECT rn, p, e, sum((x - c) * (x - c)) AS d FROM parts JOIN book{k} USING (p, j) GROUP BY rn, p, e),
near{k} AS (SELECT rn, p, e, d FROM dist{k} QUALIFY row_number() OVER (PARTITION BY rn, p ORDER BY d, e) = 1),
"""


def _sql_moved(k):
    return f"""
mean{k} AS (
  SELECT p, e, j, CAST(floor(sum(x) / count(*)) AS BIGINT) AS c FROM parts JOIN near{k} USING (rn, p)
  GROUP BY p, e, j),
book{k + 1} AS (
  SELECT p, e, j, coalesce(mean{k}.c, book{k}.c) AS c FROM book{k} LEFT JOIN mean{k} USING (p, e, j)),
"""


OP11_SQL = """
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS rn, vec_id, label, embedding, len(embedding) // 16 AS width
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (
  SELECT rn, i // width AS p, i % width AS j, CAST(floor(256 * CAST(embedding[i + 1] AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT *, unnest(range(len(embedding))) AS i FROM kept)),
book0 AS (SELECT p, rn AS e, j, x AS c FROM parts WHERE rn < 64),
""" + "".join(_sql_round(k) + _sql_moved(k) for k in range(ROUNDS)) + _sql_round(ROUNDS) + f"""
coded AS (
  SELECT rn, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM near{ROUNDS} GROUP BY rn),
digest AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, j)) AS s FROM book{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  s AS codebooks_sha256
FROM coded JOIN kept USING (rn), digest
"""
