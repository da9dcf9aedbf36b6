"""Queries over blocks, the block store and chunk manifests."""

from pyspark.sql import functions as F

from tablekeeper.functions.ordering import newest_per_group
from tablekeeper.operators import chunks, retention
from tablekeeper.plans.fixtures import ARTIFACTS, AS_OF_MS, CHUNK, artifacts
from tablekeeper.plans.registry import query
from tablekeeper.session import work_dir
from tablekeeper.sources import catalogue, event_log, files, restored_files
from tablekeeper.sources.artifacts import scan_file_blocks

KEPT_RUNS = 20


def _blocks(spark, folder, with_data=False):
    return chunks.chunk(artifacts(spark, folder), CHUNK, with_data)


@query("chunk_blocks", f"WITH {ARTIFACTS} SELECT * FROM blocks")
def chunk_blocks(spark, folder):
    return _blocks(spark, folder)


@query("chunk_new_reused", f"""WITH {ARTIFACTS}
SELECT b.*, f.place IS NOT NULL AS is_new FROM blocks b
LEFT JOIN firsts f ON f.profile = b.profile AND f.hash = b.hash
  AND f.place = run_seq * 1000000 + idx""")
def chunk_new_reused(spark, folder):
    return chunks.classify(_blocks(spark, folder))


SUMMARY = f"""{ARTIFACTS},
summary AS (
  SELECT b.profile, run_id, count(*) AS count, count(f.place) AS new,
    count(*) - count(f.place) AS reused, CAST(sum(b.n_bytes) AS BIGINT) AS total_bytes
  FROM blocks b LEFT JOIN firsts f ON f.profile = b.profile AND f.hash = b.hash
    AND f.place = run_seq * 1000000 + idx
  GROUP BY b.profile, run_id
)"""


@query("chunk_run_summary", f"WITH {SUMMARY} SELECT * FROM summary")
def chunk_run_summary(spark, folder):
    return chunks.run_summary(_blocks(spark, folder))


@query("chunk_dedup_ratio", f"""WITH {SUMMARY}
SELECT profile, CAST(sum(count) AS BIGINT) AS blocks, CAST(sum(reused) AS BIGINT) AS reused,
  sum(reused) / sum(count) AS ratio FROM summary GROUP BY profile""")
def chunk_dedup_ratio(spark, folder):
    return chunks.dedup_ratio(chunks.run_summary(_blocks(spark, folder)))


@query("chunk_dedup_over_time", f"""WITH {ARTIFACTS},
per AS (
  SELECT b.profile, b.run_id, b.run_seq, CAST(sum(b.n_bytes) AS BIGINT) AS total_bytes,
    CAST(coalesce(sum(b.n_bytes) FILTER (b.first), 0) AS BIGINT) AS new_bytes
  FROM (SELECT *, row_number() OVER (PARTITION BY profile, hash ORDER BY run_seq, run_id, idx) = 1 AS first FROM blocks) b
  GROUP BY b.profile, b.run_id, b.run_seq),
s AS (
  SELECT profile, run_id, total_bytes, new_bytes,
    CAST(sum(total_bytes) OVER w AS BIGINT) AS all_bytes, CAST(sum(new_bytes) OVER w AS BIGINT) AS kept_bytes
  FROM per WINDOW w AS (PARTITION BY profile ORDER BY run_seq, run_id ROWS UNBOUNDED PRECEDING))
SELECT *, 1 - kept_bytes / all_bytes AS spared FROM s""")
def chunk_dedup_over_time(spark, folder):
    return chunks.dedup_over_time(_blocks(spark, folder))


def _stored(spark, folder):
    """Store filled in two steps: texts of one language first, then all texts."""
    path = work_dir(spark, "store")
    all_blocks = _blocks(spark, folder, with_data=True)
    english = artifacts(spark, folder).join(
        spark.read.parquet(f"{folder}/documents.parquet")
        .filter(F.col("lang") == "en").select(F.col("doc_id").alias("run_id")),
        "run_id", "left_semi",
    )
    chunks.append_store(chunks.chunk(english, CHUNK, with_data=True), path)
    chunks.append_store(all_blocks, path, chunks.read_store(spark, path))
    return path


@query("chunk_store_append", f"""WITH {ARTIFACTS}
SELECT profile, hash, n_bytes, substr(hash, 1, 2) AS prefix FROM firsts""")
def chunk_store_append(spark, folder):
    store = chunks.read_store(spark, _stored(spark, folder))
    checked = store.filter(F.sha2("data", 256) == F.col("hash"))
    return checked.select("profile", "hash", "n_bytes", "prefix")


@query("chunk_store_held", f"""WITH {ARTIFACTS}
SELECT DISTINCT b.profile, b.hash FROM blocks b
JOIN (SELECT DISTINCT source AS profile, sha256(text) AS hash FROM documents) d
  ON d.profile = b.profile AND d.hash = b.hash""")
def chunk_store_held(spark, folder):
    whole = artifacts(spark, folder).select("profile", F.sha2("content", 256).alias("hash"))
    return chunks.held(whole.distinct(), chunks.list_store(_blocks(spark, folder)))


def _manifests(spark, folder):
    return chunks.manifest_rows(_blocks(spark, folder), CHUNK, hashes_per_row=8)


MANIFESTS = f"""{ARTIFACTS},
manifests AS (
  SELECT profile, run_id, idx // 8 AS part, CAST(1 AS BIGINT) AS version, 'sha256' AS algorithm,
    CAST({CHUNK} AS BIGINT) AS chunk_size, CAST(sum(n_bytes) AS BIGINT) AS total_bytes,
    string_agg(hash, ',' ORDER BY idx) AS hashes, (idx // 8) * 8 AS first_idx
  FROM blocks GROUP BY profile, run_id, idx // 8
)"""


@query("chunk_manifest_write", f"WITH {MANIFESTS} SELECT * FROM manifests")
def chunk_manifest_write(spark, folder):
    path = work_dir(spark, "manifests")
    rows = _manifests(spark, folder)
    rows.write.json(path)
    read = spark.read.schema(rows.schema).json(path)
    return read.withColumn("hashes", F.array_join("hashes", ","))


@query("chunk_manifest_explode", f"WITH {ARTIFACTS} SELECT profile, run_id, idx, hash FROM blocks")
def chunk_manifest_explode(spark, folder):
    return chunks.explode_manifests(_manifests(spark, folder))


PART = 4


@query("chunk_reassemble", f"""WITH {ARTIFACTS}
SELECT run_id, idx // {PART} AS part, CAST(sum(n_bytes) AS BIGINT) AS n_bytes,
  sha256(a.content[(idx // {PART}) * {PART * CHUNK} + 1 :
    least((idx // {PART} + 1) * {PART * CHUNK}, octet_length(a.content))]) AS digest
FROM blocks b JOIN artifacts a USING (run_id) GROUP BY run_id, idx // {PART}, a.content""")
def chunk_reassemble(spark, folder):
    store = chunks.read_store(spark, _stored(spark, folder))
    manifests = chunks.explode_manifests(_manifests(spark, folder))
    chunks.check_restorable(manifests, store)
    return chunks.reassemble(manifests, store, PART).select(
        "run_id", "part", F.octet_length("content").cast("bigint").alias("n_bytes"),
        F.sha2("content", 256).alias("digest"),
    )


def _surviving(spark, folder):
    """Manifests left when each profile keeps its newest runs."""
    runs = artifacts(spark, folder).select("profile", "run_id", "run_seq")
    kept = newest_per_group(
        runs, ["profile"], [F.desc("run_seq"), F.desc("run_id")], KEPT_RUNS, ["run_id"]
    )
    exploded = chunks.explode_manifests(_manifests(spark, folder))
    return exploded.join(kept.select("run_id"), "run_id", "left_semi")


SURVIVING = f"""{ARTIFACTS},
kept AS (SELECT run_id FROM artifacts QUALIFY row_number() OVER (PARTITION BY profile
  ORDER BY run_seq DESC) <= {KEPT_RUNS}),
needed AS (SELECT DISTINCT profile, hash FROM blocks WHERE run_id IN (SELECT run_id FROM kept))"""


@query("chunk_referenced", f"WITH {SURVIVING} SELECT profile, hash FROM needed")
def chunk_referenced(spark, folder):
    return chunks.referenced(_surviving(spark, folder))


@query("chunk_garbage", f"""WITH {SURVIVING}
SELECT profile, hash, n_bytes FROM firsts f
WHERE NOT EXISTS (SELECT 1 FROM needed n WHERE n.profile = f.profile AND n.hash = f.hash)""")
def chunk_garbage(spark, folder):
    store = chunks.first_blocks(_blocks(spark, folder))
    return chunks.garbage(store, _surviving(spark, folder))


@query("chunk_garbage_collect", f"""WITH {SURVIVING}
SELECT profile, hash, n_bytes, (SELECT count(*) FROM firsts) - (SELECT count(*) FROM needed)
  AS removed
FROM firsts JOIN needed USING (profile, hash)""")
def chunk_garbage_collect(spark, folder):
    path = _stored(spark, folder)
    removed = chunks.collect_garbage(spark, path, _surviving(spark, folder))
    left = chunks.list_store(chunks.read_store(spark, path))
    return left.withColumn("removed", F.lit(removed).cast("bigint"))


@query("retention_apply_store", f"""WITH {SURVIVING},
gone AS (SELECT profile, count(*) AS runs_deleted FROM artifacts
  WHERE run_id NOT IN (SELECT run_id FROM kept) GROUP BY profile),
dead AS (SELECT profile, count(*) AS chunks_deleted FROM firsts f
  WHERE NOT EXISTS (SELECT 1 FROM needed n WHERE n.profile = f.profile AND n.hash = f.hash) GROUP BY profile)
SELECT profile, hash, n_bytes, coalesce(runs_deleted, 0) AS runs_deleted,
  coalesce(chunks_deleted, 0) AS chunks_deleted
FROM firsts JOIN needed USING (profile, hash) LEFT JOIN gone USING (profile) LEFT JOIN dead USING (profile)""")
def retention_apply_store(spark, folder):
    """Delete old runs, log them, collect their blocks; blocks left beside what the log says per profile."""
    store, root, log = _stored(spark, folder), work_dir(spark, "catalog"), work_dir(spark, "log")
    files.publish(artifacts(spark, folder).select(
        "run_id", "profile", F.col("run_seq").alias("finished_ms"), F.lit(0).cast("bigint").alias("mtime_ms")), root)
    profiles = files.current(spark, root).select("profile").distinct()
    policies = retention.resolve_policies(profiles, [], {"keep_last": KEPT_RUNS})
    retention.apply_retention(
        spark, root, policies, ["profile"], AS_OF_MS, log, "00:00:00 2024-01-31", store,
        chunks.explode_manifests(_manifests(spark, folder)))
    lost = F.get_json_object("payload_json", "$.chunks_deleted").cast("bigint")
    logged = event_log.scan_events(spark, log).groupBy(F.col("payload.profile").alias("profile")).agg(
        F.count(F.when(F.col("event") == "retention.deleted", 1)).alias("runs_deleted"),
        F.coalesce(F.sum(F.when(F.col("event") == "retention.chunks_gc", lost)), F.lit(0)).alias("chunks_deleted"),
    )
    left = chunks.list_store(chunks.read_store(spark, store)).join(logged, "profile", "left")
    return left.fillna(0, ["runs_deleted", "chunks_deleted"])


@query("chunk_missing", f"""WITH {SURVIVING}
SELECT profile, hash FROM firsts f
WHERE NOT EXISTS (SELECT 1 FROM needed n WHERE n.profile = f.profile AND n.hash = f.hash)""")
def chunk_missing(spark, folder):
    # all manifests against a store that only holds the surviving runs' blocks
    return chunks.missing_blocks(
        chunks.explode_manifests(_manifests(spark, folder)), _surviving(spark, folder)
    )


# --- files ---------------------------------------------------------------------------------------

FILE_BLOCK, FILE_PART = 16 << 10, 4
FILES = """file_texts AS (
  SELECT coalesce(source, 'none') AS profile, doc_id % 16 AS part,
    encode(string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id)) AS content
  FROM documents GROUP BY ALL
)"""


def _name():
    """Partition folders of a file."""
    return F.regexp_extract("path", r"(profile=[^/]+/part=[^/]+)/", 1).alias("name")


def text_files(spark, folder):
    """A folder with one file for every source and remainder of the document ids: the texts by id."""
    root = work_dir(spark, "files")
    rows = spark.read.parquet(f"{folder}/documents.parquet").select(
        F.coalesce("source", F.lit("none")).alias("profile"), (F.col("doc_id") % 16).alias("part"), "doc_id",
        F.coalesce("text", F.lit("")).alias("text"),
    )
    rows.repartition("profile", "part").sortWithinPartitions("profile", "part", "doc_id").drop(
        "doc_id").write.partitionBy("profile", "part").text(root)
    return root


@query("artifact_file_store", f"""WITH {FILES},
parts AS (SELECT profile, part, octet_length(content) AS size, unnest(range(0, octet_length(content),
  {FILE_BLOCK * FILE_PART})) AS pos, content FROM file_texts)
SELECT 'profile=' || profile || '/part=' || part AS name, pos // {FILE_BLOCK * FILE_PART} AS nth,
  sha256(content[pos + 1 : least(pos + {FILE_BLOCK * FILE_PART}, size)]) AS digest FROM parts""")
def artifact_file_store(spark, folder):
    """Files kept as blocks and put together again."""
    path = work_dir(spark, "store")
    blocks = chunks.append_files(spark, f"{text_files(spark, folder)}/*/*/*.txt", path, "files", FILE_BLOCK)
    parts = chunks.reassemble(blocks, chunks.read_store(spark, path), FILE_PART)
    return parts.withColumnRenamed("run_id", "path").select(
        _name(), F.col("part").alias("nth"), F.sha2("content", 256).alias("digest"))


@query("artifact_files_restored", f"""WITH {FILES},
parts AS (SELECT profile, part, octet_length(content) AS size, unnest(range(0, octet_length(content),
  {FILE_BLOCK * FILE_PART})) AS pos, content FROM file_texts)
SELECT 'profile=' || profile || '/part=' || part AS name, pos // {FILE_BLOCK * FILE_PART} AS nth,
  least({FILE_BLOCK * FILE_PART}, size - pos) AS length,
  sha256(content[pos + 1 : least(pos + {FILE_BLOCK * FILE_PART}, size)]) AS digest FROM parts""")
def artifact_files_restored(spark, folder):
    """Kept files put together again as ordered part files, and these read back."""
    path, target = work_dir(spark, "store"), work_dir(spark, "restored")
    blocks = chunks.append_files(spark, f"{text_files(spark, folder)}/*/*/*.txt", path, "files", FILE_BLOCK)
    parts = chunks.reassemble(blocks, chunks.read_store(spark, path), FILE_PART)
    restored_files.write_parts(parts, target)
    files_ = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(target)
    run = F.url_decode(F.regexp_extract("path", r"([^/]+)/part-[0-9]+$", 1))
    return files_.select(
        F.regexp_extract(run, r"(profile=[^/]+/part=[^/]+)/", 1).alias("name"),
        F.regexp_extract("path", r"part-([0-9]+)$", 1).cast("bigint").alias("nth"), "length",
        F.sha2("content", 256).alias("digest"))


@query("run_folder_scan", """SELECT 's' || s_suppkey AS run_id, 'p ' || s_nationkey AS profile, 'table' AS db_type,
  'full' AS backup_type, CAST(s_suppkey AS BIGINT) AS duration_ms, 'full run of s' || s_suppkey AS run_dir,
  'full run of s' || s_suppkey = (SELECT 'full run of s' || max(s_suppkey) FROM supplier) AS found FROM supplier""")
def run_folder_scan(spark, folder):
    """Manifests written as ``<profile>/<run>/manifest.json`` and scanned, the last supplier's found by its folder."""
    root = work_dir(spark, "runs")
    key = F.col("s_suppkey")
    runs = spark.read.parquet(f"{folder}/supplier.parquet").select(
        F.concat(F.lit("s"), key).alias("run_id"), F.concat(F.lit("p "), "s_nationkey").alias("profile"),
        F.concat(F.lit("full run of s"), key).alias("run_dir"), F.lit("table").alias("db_type"),
        F.lit("full").alias("backup_type"), F.lit("12:00:00 2024-01-01").alias("finished_at"),
        key.cast("bigint").alias("duration_ms"))
    for _ in range(2):  # the second call finds every manifest in its place
        catalogue.write_run_folders(runs, root)
    catalog = catalogue.scan_run_folders(spark, root)
    last = runs.agg(F.max_by("run_dir", F.col("duration_ms"))).first()[0]
    found = catalogue.find_run(catalog, catalog.where(F.col("run_dir").endswith(f"/{last}") | F.col(
        "run_dir").endswith("/" + last.replace(" ", "%20"))).first()["run_dir"]).select("run_id").first()[0]
    name = F.url_decode(F.regexp_extract("run_dir", r"([^/]+)$", 1))
    return catalog.select("run_id", "profile", "db_type", "backup_type", "duration_ms", name.alias("run_dir"),
                          (F.col("run_id") == found).alias("found"))


@query("artifact_file_blocks", f"""WITH {FILES},
cut AS (SELECT profile, part, octet_length(content) AS size,
  unnest(range(0, octet_length(content), {FILE_BLOCK})) AS pos, content FROM file_texts)
SELECT 'profile=' || profile || '/part=' || part AS name, pos // {FILE_BLOCK} AS idx,
  sha256(content[pos + 1 : least(pos + {FILE_BLOCK}, size)]) AS hash, least({FILE_BLOCK}, size - pos) AS n_bytes
FROM cut""")
def artifact_file_blocks(spark, folder):
    """Blocks of files, read by byte range."""
    blocks = scan_file_blocks(
        spark, f"{text_files(spark, folder)}/*/*/*.txt", size=FILE_BLOCK, bytes_per_task=1 << 20)
    return blocks.select(_name(), "idx", "hash", "n_bytes")
