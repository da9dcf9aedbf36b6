"""Rows under their digest: buckets, trees of checksums, and changes found through both.

An indexed table has two 64-bit digests of each row and the bucket that the first one falls in. Rows are stored by
bucket, sorted by digest. Where few rows change between two versions, that is found from digests alone; whole rows
move only where a digest changed, which a bitmap of bounded size tells without an exchange. Where so many change
that the bitmap would let most rows through, all rows move at once. Digests are made again after an exchange of whole
rows instead of moving with them.

A tree holds, for every bucket, the number of rows and the sums of their digests, and the same for groups of
``FANOUT`` nodes up to one root. Sums do not depend on the order of rows, and follow a change by adding its rows.
"""

from decimal import Decimal

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekeeper.errors import KeeperError
from tablekeeper.functions.bitmaps import bitmap_of, may_hold, share_held
from tablekeeper.session import checkpoint

CHANGE = "_change"
DIGEST = ["__d1", "__d2"]
BUCKET = "__bucket"
PLACE = "__place"
OWN = [*DIGEST, BUCKET, PLACE]
BUCKETS = 32
FANOUT = 8
#: A tree has fewer than twice as many nodes.
MOST_BUCKETS = 1 << 16
SUMS = ["row_count", "sum1", "sum2"]
#: Digests fall in so many classes; those of one class in ``SLICE`` tell how much of a table has changed.
CLASSES = 4096
SLICE = 64
#: Rows that one task is given to compare.
ROWS_PER_TASK = 1 << 19
#: Rows of columns of these types are equal just where their digests are.
FLAT = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType, T.FloatType, T.DoubleType,
        T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType)
TREE_SCHEMA = "level int, node int, row_count bigint, sum1 decimal(38,0), sum2 decimal(38,0)"


def plain_columns(df):
    return [c for c in df.columns if c not in (*OWN, CHANGE)]


def _digests(df):
    """The two digests of the plain columns."""
    values = []
    for name in sorted(plain_columns(df)):
        kind = df.schema[name].dataType
        if isinstance(kind, (T.StructType, T.ArrayType)):
            # hashes of nested values would pass over NULLs inside
            values.append(F.to_json(F.struct(name), {"ignoreNullFields": "false"}))
        else:
            values += [F.col(name), F.col(name).isNull()]
    return [F.xxhash64(F.lit(seed), *values).alias(name) for seed, name in zip((1, 2), DIGEST)]


def with_digest(df, buckets=BUCKETS):
    """``df`` with its digests and bucket. NULLs count by their place."""
    return df.select("*", *_digests(df)).withColumn(BUCKET, F.pmod(DIGEST[0], F.lit(buckets)).cast("int"))


def write_indexed(rows, path):
    """Write indexed rows by bucket. A bucket of very many rows is spread over several files."""
    placed = rows.drop(*DIGEST).hint("rebalance", BUCKET)
    _write_placed(placed.select("*", *_digests(placed)), path)


def _write_placed(rows, path):
    rows.sortWithinPartitions(BUCKET, *DIGEST).write.partitionBy(BUCKET).parquet(path)


def read_indexed(spark, path, schema, buckets=None):
    """Indexed rows of one folder, ``schema`` being that of the plain columns (and the change); ``buckets`` are
    those to read."""
    whole = T.StructType(list(schema.fields))
    for name in DIGEST:
        whole = whole.add(name, T.LongType())
    rows = spark.read.schema(whole.add(BUCKET, T.IntegerType())).parquet(path)
    return rows if buckets is None else rows.where(F.col(BUCKET).isin(list(buckets)))


# --- trees ---------------------------------------------------------------------------------------

def leaves(rows, weight=None):
    """Checksums per bucket of indexed rows; each counts as often as ``weight`` says."""
    weight = F.lit(1) if weight is None else weight
    wide = [(F.col(d).cast("decimal(20,0)") * weight.cast("decimal(18,0)")) for d in DIGEST]
    return rows.groupBy(F.col(BUCKET).alias("node")).agg(
        F.sum(weight).cast("bigint").alias("row_count"),
        *[F.sum(w).cast("decimal(38,0)").alias(name) for w, name in zip(wide, SUMS[1:])])


def depth_of(buckets):
    """Level of the leaves; the root has level 0."""
    depth = 0
    while FANOUT ** depth < buckets:
        depth += 1
    return depth


def tree_of(leaf_rows, buckets):
    """The tree over leaves: {(level, node): (rows, sum1, sum2)} without nodes of zeros.

    It is on the driver: ``buckets`` is at most ``MOST_BUCKETS``. ``leaf_rows`` may have a bucket more than once.
    """
    if not 0 < buckets <= MOST_BUCKETS:
        raise KeeperError(f"a table has 1 to {MOST_BUCKETS} buckets")
    depth, tree = depth_of(buckets), {}
    for node, *sums in leaf_rows.select("node", *SUMS).collect():
        for level in range(depth, -1, -1):
            before = tree.get((level, node), (0, 0, 0))
            tree[level, node] = tuple(int(a) + int(b) for a, b in zip(before, sums))
            node //= FANOUT
    return {at: sums for at, sums in tree.items() if any(sums)}


def tree_rows(spark, tree):
    return spark.createDataFrame([(*at, n, Decimal(a), Decimal(b)) for at, (n, a, b) in sorted(tree.items())], TREE_SCHEMA)


def read_tree(rows):
    """The tree of rows that ``tree_rows`` made."""
    return {(level, node): (n, int(a), int(b)) for level, node, n, a, b in rows.select("level", "node", *SUMS).collect()}


def root_of(tree):
    """(rows, sum1, sum2) of a tree; zeros if it is empty."""
    return tree.get((0, 0), (0, 0, 0))


def differing_buckets(left, right, buckets):
    """Buckets whose checksums differ, found from the root down: below equal nodes nothing is looked at."""
    depth, differ = depth_of(buckets), [0]
    for level in range(depth + 1):
        if level:
            differ = [node * FANOUT + k for node in differ for k in range(FANOUT)]
        differ = [node for node in differ if left.get((level, node)) != right.get((level, node))]
    return differ


# --- changes -------------------------------------------------------------------------------------

def _touch(digests):
    """Condition that holds for all rows of these digests, and for few others."""
    numbers = digests.select(DIGEST[0])
    return may_hold(bitmap_of(numbers, numbers.count()), F.col(DIGEST[0]))


def _is_flat(rows):
    kinds = [rows.schema[c].dataType for c in plain_columns(rows)]
    return all(isinstance(kind, FLAT) or kind == T.StringType() for kind in kinds)


def summed(rows, place=()):
    """One row per digest with the sum of its changes, where that is not zero. Flat rows are combined as they are;
    ``place`` has columns that equal rows share, by which flat ones have been exchanged already."""
    plain = plain_columns(rows)
    change = F.sum(CHANGE).alias(CHANGE)
    if not _is_flat(rows):
        row = F.struct(*plain, BUCKET)
        return rows.groupBy(*DIGEST).agg(change, F.any_value(row).alias("_row")).where(
            F.col(CHANGE) != 0).select("_row.*", *DIGEST, CHANGE)
    # keys lose the sign of -0.0, so one of the values goes with them
    signed = [c for c in plain if isinstance(rows.schema[c].dataType, (T.FloatType, T.DoubleType))]
    one = rows.groupBy(*place, *plain, BUCKET).agg(change, *[F.max(c).alias(f"__of_{c}") for c in signed]).where(
        F.col(CHANGE) != 0)
    one = one.select(*[F.col(f"__of_{c}").alias(c) if c in signed else c for c in plain], BUCKET, CHANGE)
    return one.select(*plain, BUCKET, *_digests(one), CHANGE)


def _class():
    return F.pmod(DIGEST[1], F.lit(CLASSES)).cast("int")


def _survey(both):
    """(rows, buckets, whether few rows change, classes that rows of very many copies make large).

    Few rows change if a bitmap of their digests would keep back half of all rows.
    """
    inside = _class() < CLASSES // SLICE
    per_digest = both.groupBy(_class().alias("at"), *[F.when(inside, F.col(d)).alias(d) for d in DIGEST]).agg(
        F.sum(CHANGE).alias(CHANGE), F.count(F.lit(1)).alias("rows"), F.max(BUCKET).alias(BUCKET))
    moved = F.when((F.col("at") < CLASSES // SLICE) & (F.col(CHANGE) != 0), F.col("rows"))
    found = per_digest.groupBy("at").agg(
        F.sum("rows").alias("rows"), F.count(moved).alias("digests"), F.sum(moved).alias("moved"),
        F.max(BUCKET).alias("last")).collect()  # CLASSES rows at most
    rows = sum(r["rows"] for r in found)
    part = sum(r["rows"] for r in found if r["at"] < CLASSES // SLICE)
    moved = sum(r["moved"] or 0 for r in found)
    through = moved + (part - moved) * share_held(SLICE * sum(r["digests"] for r in found))
    large = [r["at"] for r in found if r["rows"] > max(ROWS_PER_TASK, 4 * rows / CLASSES)]
    return rows, 1 + max([0, *(r["last"] for r in found)]), 2 * through <= part, large


def _changes(old, new):
    """(changes, whether they are in place by bucket)."""
    both = new.unionByName(old.withColumn(CHANGE, -F.col(CHANGE)))
    rows, buckets, few, large = _survey(both)
    if few:
        moved = checkpoint(both.select(*DIGEST, CHANGE).groupBy(*DIGEST).agg(
            F.sum(CHANGE).alias(CHANGE)).where(F.col(CHANGE) != 0))
        return summed(both.where(_touch(moved))), False
    if not _is_flat(both):
        return summed(both), False
    tasks = -(-rows // ROWS_PER_TASK)
    pieces = -(-tasks // buckets)  # of a bucket
    tasks = pieces * buckets if pieces > 1 else tasks
    at = F.pmod(F.col(BUCKET) * pieces + F.pmod(DIGEST[1], F.lit(pieces)), F.lit(tasks)).cast("int")
    placed = (both.where(~_class().isin(large)) if large else both).withColumn(PLACE, at).drop(*DIGEST)
    found = summed(placed.repartitionById(tasks, PLACE), [PLACE])
    if large:  # copies are combined before the exchange
        found = found.unionByName(summed(both.where(_class().isin(large))).repartition(BUCKET))
    return found, True


def changes(old, new):
    """Indexed rows whose number of copies differs, with the change from old to new.

    Both sides have a ``_change`` with their copies. Where few rows change, digests are exchanged, combined before, and
    whole rows only where their digest may have changed; else whole rows, once.
    """
    return _changes(old, new)[0]


def write_changes(old, new, path):
    """Write the changes by bucket."""
    rows, placed = _changes(old, new)
    (_write_placed if placed else write_indexed)(rows, path)


def apply_deltas(base, deltas):
    """(rows that no delta touches, touched rows with their copies): both indexed, the first without exchange."""
    touch = _touch(deltas)
    met = base.where(touch).withColumn(CHANGE, F.lit(1).cast("bigint"))
    return base.where(~touch), summed(met.unionByName(deltas.select(*met.columns)))
