"""Content cut into fixed blocks, kept once per profile under their hash.

Block tables carry ``profile, run_id, run_seq, idx, hash, n_bytes``; the bytes (``data``) join only
where they are written or put together again.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tablekeeper.errors import KeeperError
from tablekeeper.functions.ordering import running
from tablekeeper.session import checkpoint
from tablekeeper.sources.artifacts import CHUNK_SIZE, read_ranges, scan_file_blocks
from tablekeeper.sources.files import delete_files, exists

ALGORITHM = "sha256"
MANIFEST_VERSION = 1
PLACE = ["run_id", "idx"]
HASHES_PER_ROW = 1 << 16
BLOCKS_PER_PART = 64
USES_PER_TASK = 1024


def chunk(artifacts, size=CHUNK_SIZE, with_data=False):
    """Blocks of the ``content`` column; the last block is short, empty content has none."""
    length = F.octet_length("content")
    last = F.call_function("div", length - F.lit(1), F.lit(size)).cast("int")
    # only the block numbers are exploded: each row then takes its own slice of the content
    placed = artifacts.filter(length > 0).withColumn("idx", F.explode(F.sequence(F.lit(0), last)))
    data = F.substring("content", F.col("idx") * size + 1, F.lit(size))
    keep = [c for c in artifacts.columns if c != "content"]
    blocks = placed.select(*keep, F.col("idx").cast("bigint").alias("idx"), data.alias("data"))
    columns = [*keep, "idx", F.sha2("data", 256).alias("hash"),
               F.octet_length("data").cast("bigint").alias("n_bytes")]
    return blocks.select(*columns, "data") if with_data else blocks.select(*columns)


def first_blocks(blocks, store=None):
    """Where each hash is seen first in its profile (run order, then block order).

    Hashes already in the store are left out: their blocks are all reused.
    """
    firsts = blocks.groupBy("profile", "hash").agg(
        F.min(F.struct("run_seq", "run_id", "idx")).alias("f"), F.min("n_bytes").alias("n_bytes")
    )
    if store is not None:
        firsts = firsts.join(store.select("profile", "hash"), ["profile", "hash"], "left_anti")
    return firsts.select("profile", "hash", "f.run_id", "f.idx", "n_bytes")


def classify(blocks, store=None):
    """Blocks with ``is_new``.

    The first places join back on the unique (run, block) key, so a block repeated very often does
    not gather in one task. The content is read and hashed once.
    """
    blocks = checkpoint(blocks)
    new = first_blocks(blocks, store).select("profile", *PLACE, F.lit(True).alias("_new"))
    return (
        blocks.join(new, ["profile", *PLACE], "left")
        .withColumn("is_new", F.coalesce("_new", F.lit(False))).drop("_new")
    )


def run_summary(blocks, store=None):
    """Blocks, new and reused blocks and bytes per run. The content is read and hashed once."""
    blocks = checkpoint(blocks)
    totals = blocks.groupBy("profile", "run_id").agg(
        F.count(F.lit(1)).alias("count"), F.sum("n_bytes").alias("total_bytes")
    )
    new = first_blocks(blocks, store).groupBy("profile", "run_id").agg(
        F.count(F.lit(1)).alias("_new")
    )
    fresh = F.coalesce("_new", F.lit(0))
    return totals.join(new, ["profile", "run_id"], "left").select(
        "profile", "run_id", "count", fresh.alias("new"), (F.col("count") - fresh).alias("reused"),
        "total_bytes",
    )


def dedup_ratio(summary):
    """Share of reused blocks per profile."""
    return summary.groupBy("profile").agg(
        F.sum("count").alias("blocks"), F.sum("reused").alias("reused"),
        (F.sum("reused") / F.sum("count")).alias("ratio"),
    )


def dedup_over_time(blocks):
    """What each run added: its bytes, those not kept before, and the share of bytes spared up to it.

    Runs come in the order of ``run_seq`` within their profile.
    """
    blocks = checkpoint(blocks)
    key = ["profile", "run_seq", "run_id"]
    totals = blocks.groupBy(*key).agg(F.sum("n_bytes").alias("total_bytes"))
    fresh = first_blocks(blocks).groupBy("profile", "run_id").agg(F.sum("n_bytes").alias("_new"))
    runs = totals.join(fresh, ["profile", "run_id"], "left").withColumn(
        "new_bytes", F.coalesce("_new", F.lit(0).cast("bigint"))).drop("_new")
    summed = running(runs, ["profile"], ["run_seq", "run_id"], {
        "all_bytes": ("sum", "total_bytes", True), "kept_bytes": ("sum", "new_bytes", True)})
    return summed.select(
        "profile", "run_id", "total_bytes", "new_bytes", "all_bytes", "kept_bytes",
        (1 - F.col("kept_bytes") / F.col("all_bytes")).alias("spared"))


# --- store ---------------------------------------------------------------------------------------

STORE_SCHEMA = "prefix string, hash string, n_bytes bigint, data binary, profile string"


def read_store(spark, path):
    """Kept blocks; none before the first append."""
    if not exists(spark, path):
        return spark.createDataFrame([], STORE_SCHEMA)
    # the schema keeps profiles such as "007" as they are
    return spark.read.schema(STORE_SCHEMA).parquet(path)


def _known(spark, path, store):
    """The given store, else what is at ``path``, None before the first append."""
    if store is None and exists(spark, path):
        return read_store(spark, path)
    return store


def append_store(blocks, path, store=None):
    """Write each missing block once (``blocks`` with data); blocks already kept stay as they are.

    Two appends at the same time may both write a block; readers take one of the copies.

    Which blocks are missing comes from hashes alone; the content then joins on its unique place. Spark
    broadcasts the missing ones where their size allows, and no bytes are shuffled then.
    """
    store = _known(blocks.sparkSession, path, store)
    new = checkpoint(first_blocks(blocks.drop("data"), store))
    data = blocks.select("profile", *PLACE, "data")
    _write_store(data.join(new, ["profile", *PLACE]), path)


def append_files(spark, files, path, profile, size=CHUNK_SIZE, store=None):
    """Keep the blocks of files under one profile; returns the block table of the files.

    The first pass only hashes. The second reads just the byte ranges of missing blocks.
    """
    blocks = checkpoint(
        scan_file_blocks(spark, files, size).withColumn("profile", F.lit(profile))
        .withColumnRenamed("path", "run_id").withColumn("run_seq", F.col("run_id"))
    )
    new = first_blocks(blocks, _known(spark, path, store)).withColumnRenamed("run_id", "path")
    data = read_ranges(new.select("path", "idx", "n_bytes"), size, with_data=True)
    _write_store(data.withColumn("profile", F.lit(profile)), path)
    return blocks


def _write_store(rows, path):
    rows = rows.select(
        "profile", F.substring("hash", 1, 2).alias("prefix"), "hash", "n_bytes", "data"
    )
    _by_hash(rows).write.mode("append").partitionBy("profile").parquet(path)


def _by_hash(rows):
    """Rows spread for writing: rebalancing splits large profiles and merges small pieces.

    Files are sorted by hash, so lookups skip row groups by their bounds.
    """
    return rows.hint("rebalance", "profile", "prefix").sortWithinPartitions("profile", "hash")


def list_store(store):
    """All kept hashes, each once; the bytes are not read."""
    return store.select("profile", "hash", "n_bytes").distinct()


def held(hashes, store):
    """The given (profile, hash) rows that the store holds."""
    return hashes.join(store.select("profile", "hash"), ["profile", "hash"], "left_semi")


def referenced(manifests):
    """Hashes that surviving manifests need."""
    return manifests.select("profile", "hash").distinct()


def missing_blocks(manifests, store):
    """Referenced hashes that the store does not hold."""
    return referenced(manifests).join(store.select("profile", "hash"), ["profile", "hash"], "left_anti")


def garbage(store, manifests):
    """Kept blocks that no manifest references."""
    return list_store(store).join(referenced(manifests), ["profile", "hash"], "left_anti")


def collect_garbage(spark, path, manifests):
    """Remove unreferenced blocks from the store at ``path``; returns how many.

    Only files that hold garbage are touched. Their other blocks are written to new files first, then the
    old files go. Readers take one copy of a block, so the store is complete at every moment, also after
    a crash in between, and a repeated call finishes the work. Files of an append that runs meanwhile are
    not touched; its manifests must be among ``manifests`` if it reuses blocks that were garbage.
    """
    if not exists(spark, path):
        return 0
    placed = read_store(spark, path).withColumn("_file", F.col("_metadata.file_path"))
    gone = checkpoint(
        placed.select("profile", "hash", "_file").join(referenced(manifests), ["profile", "hash"], "left_anti")
    )
    removed = gone.select("profile", "hash").distinct().count()
    if not removed:
        return 0
    touched = gone.select("profile", "_file").distinct()
    survivors = placed.join(touched, ["profile", "_file"], "left_semi").join(
        gone.select("profile", "hash"), ["profile", "hash"], "left_anti"
    )
    _write_store(survivors, path)
    delete_files(spark, touched.select("_file"))
    return removed


# --- manifests -----------------------------------------------------------------------------------

def manifest_rows(blocks, size=CHUNK_SIZE, hashes_per_row=HASHES_PER_ROW):
    """Manifest of each run: its hashes in order.

    A run with more than ``hashes_per_row`` blocks gets several rows, numbered by ``part``.
    """
    part = F.call_function("div", F.col("idx"), F.lit(hashes_per_row))
    grouped = blocks.groupBy("profile", "run_id", part.alias("part")).agg(
        F.sum("n_bytes").alias("total_bytes"),
        F.sort_array(F.collect_list(F.struct("idx", "hash")))["hash"].alias("hashes"),
    )
    return grouped.select(
        "profile", "run_id", "part",
        F.lit(MANIFEST_VERSION).cast("bigint").alias("version"), F.lit(ALGORITHM).alias("algorithm"),
        F.lit(size).cast("bigint").alias("chunk_size"), "total_bytes", "hashes",
        (F.col("part") * hashes_per_row).alias("first_idx"),
    )


def explode_manifests(manifests):
    """(profile, run_id, idx, hash) of manifest rows."""
    return manifests.select(
        "profile", "run_id", "first_idx", F.posexplode("hashes").alias("pos", "hash")
    ).select("profile", "run_id", (F.col("first_idx") + F.col("pos")).alias("idx"), "hash")


# --- reassembly ----------------------------------------------------------------------------------

def ordered_blocks(manifests, store, uses_per_task=USES_PER_TASK):
    """Blocks of the manifests with their bytes (``data`` NULL where the store lacks one).

    A block that very many places use (say, of zeros) is copied once per ``uses_per_task`` of them,
    so no task has to hand out all its copies.
    """
    key = ["profile", "hash"]
    uses = manifests.groupBy(*key).agg(F.count(F.lit(1)).alias("_uses"))
    copies = F.ceil(F.col("_uses") / F.lit(uses_per_task)).cast("bigint").alias("_copies")
    popular = uses.filter(F.col("_uses") > uses_per_task).select(*key, copies)
    many = F.coalesce("_copies", F.lit(1).cast("bigint"))
    wanted = manifests.join(popular, key, "left").withColumn(
        "_copy", F.pmod(F.xxhash64(*PLACE), many)
    ).drop("_copies")
    # damaged copies do not count as kept
    kept = store.select(*key, "data").filter(F.sha2("data", 256) == F.col("hash")).join(popular, key, "left")
    kept = kept.select(
        *key, "data", F.explode(F.sequence(F.lit(0).cast("bigint"), many - 1)).alias("_copy")
    )
    # one of the copies that a block may have; the window shares the exchange and the order of the join
    one = Window.partitionBy(*key, "_copy").orderBy("_copy")
    kept = kept.withColumn("_nth", F.row_number().over(one)).filter("_nth = 1").drop("_nth")
    return wanted.join(kept, [*key, "_copy"], "left").drop("_copy")


def check_restorable(manifests, store, runs=None):
    """Raise when a block is missing or a wanted run has no blocks at all."""
    lost = missing_blocks(manifests, store).limit(1).collect()
    if lost:
        raise KeeperError(f"block missing from the store: {lost[0]['hash']}")
    if runs is not None:
        empty = runs.join(manifests.select("run_id").distinct(), "run_id", "left_anti")
        empty = empty.limit(1).collect()
        if empty:
            raise KeeperError(f"nothing to reassemble for run {empty[0]['run_id']}")


def reassemble(manifests, store, blocks_per_part=BLOCKS_PER_PART, uses_per_task=USES_PER_TASK):
    """Content of each run as consecutive parts of at most ``blocks_per_part`` blocks.

    One row never holds more than one part, however large the artifact. A part with a missing block
    fails the job.
    """
    part = F.call_function("div", F.col("idx"), F.lit(blocks_per_part))
    found = ordered_blocks(manifests, store, uses_per_task).withColumn(
        "data",
        F.when(F.col("data").isNotNull(), F.col("data")).otherwise(
            F.raise_error(F.concat(F.lit("block missing from the store: "), F.col("hash")))
            .cast("binary")
        ),
    )
    pieces = F.sort_array(F.collect_list(F.struct("idx", "data")))
    # a string is its bytes here; joining them copies each byte once
    texts = F.transform(pieces["data"], lambda piece: piece.cast("string"))
    whole = F.array_join(texts, "").cast("binary")
    return found.groupBy("profile", "run_id", part.alias("part")).agg(whole.alias("content"))
