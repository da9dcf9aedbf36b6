"""Run manifests: write them, and scan a folder of them into a catalogue."""

import itertools
import re
import uuid

from pyarrow.fs import FileType
from pyspark.sql import functions as F

from tablekeeper.functions.timestamps import parse_timestamp
from tablekeeper.sources import files
from tablekeeper.sources.artifacts import _locate as locate

MANIFEST_SCHEMA = (
    "run_id string, profile string, db_type string, backup_type string, started_at string, "
    "finished_at string, duration_ms bigint, artifact_path string, compression string, "
    "source map<string, string>, metadata map<string, string>, parent_run_id string, "
    "chain array<string>"
)
PLAIN_NAME = re.compile(r"[A-Za-z0-9_.-]+\Z")
FIELDS = [
    "run_id", "profile", "db_type", "backup_type", "started_at", "finished_at", "duration_ms",
    "artifact_path", "compression", "source", "metadata", "parent_run_id", "chain",
]


def artifact_path(root, profile, run_dir, name):
    """Final place of an artifact: a local path, or a URI when the root is one."""
    return F.concat_ws("/", F.lit(root.rstrip("/")), profile, run_dir, name)


def write_manifests(runs, root):
    """Append run manifests as JSON lines, one folder per profile."""
    record = F.to_json(F.struct(*[n for n in FIELDS if n in runs.columns])).alias("value")
    runs.select("profile", record).write.mode("append").partitionBy("profile").text(root)


def write_run_folders(runs, root, name="manifest.json"):
    """Write each run's manifest as ``<root>/<profile>/<run_dir>/<name>``; a manifest that is there stays.

    Tasks write the texts below a hidden folder and rename each into its place; one task has all rows of a folder.
    What a call that was cut off left in its hidden folder is not read.
    """
    spark = runs.sparkSession
    record = F.to_json(F.struct(*[n for n in FIELDS if n in runs.columns])).alias("value")
    hidden = f"{root.rstrip('/')}/.writing-{uuid.uuid4().hex}"
    places, places_hidden = files.qualified(spark, root), files.qualified(spark, hidden)
    rows = runs.select(
        _folder_name("profile").alias("profile"), _folder_name("run_dir").alias("run"), record,
        F.monotonically_increasing_id().alias("_at"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartition(parts, "profile", "run").sortWithinPartitions("profile", "run", "_at").drop("_at")
    placed.foreachPartition(_placing(places, places_hidden, name))
    files.delete_paths(spark, [hidden])


def _folder_name(column):
    """A value as the name of a folder, as Spark names folders of a partition without one."""
    text = F.col(column).cast("string")
    return F.when(text != "", text).otherwise("__HIVE_DEFAULT_PARTITION__")


def _placing(root, hidden, name):
    def place(rows):
        system, top = locate(root)
        _, own = locate(hidden)
        for (profile, run), lines in itertools.groupby(rows, key=lambda r: (r["profile"], r["run"])):
            folder, part = f"{top}/{profile}/{run}", f"{own}/{uuid.uuid4().hex}"
            if system.get_file_info(f"{folder}/{name}").type != FileType.NotFound:
                continue
            for path in (own, folder):
                system.create_dir(path, recursive=True)
            with system.open_output_stream(part) as out:
                for line in lines:
                    out.write(f"{line['value']}\n".encode())
            system.move(part, f"{folder}/{name}")

    return place


def _catalogue(lines):
    """Catalogue rows of manifest texts; anything unreadable is left out."""
    parsed = lines.filter(F.json_object_keys("value").isNotNull()).withColumn(
        "m", F.from_json("value", MANIFEST_SCHEMA)
    )
    finished = parse_timestamp(F.col("m.finished_at"))
    rows = parsed.select(
        "m.*", "manifest_path", "mtime_ms", F.unix_millis(finished).alias("finished_ms")
    )
    return rows.filter(F.col("finished_ms").isNotNull())


def _lines(spark, path, whole, **options):
    if not files.found(spark, path):
        return spark.createDataFrame([], "value string, manifest_path string, mtime_ms bigint")
    return spark.read.options(**options).text(path, wholetext=whole).select(
        "value",
        F.col("_metadata.file_path").alias("manifest_path"),
        F.unix_millis("_metadata.file_modification_time").alias("mtime_ms"),
    )


def scan_manifests(spark, root, profiles=None):
    """Catalogue of the manifests below ``root`` written by ``write_manifests``; empty before the first."""
    path = root
    if profiles and all(PLAIN_NAME.match(p) for p in profiles):
        # only the folders asked for are listed
        path = f"{root}/profile={{{','.join(profiles)}}}"
    rows = _catalogue(_lines(spark, path, False, recursiveFileLookup="true"))
    return _only(rows, profiles)


def _decoded(name):
    """A folder name out of a file path, which escapes some characters."""
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def _folders(profiles):
    """Glob of profile folders. Names that a glob would read otherwise are looked for among all."""
    plain = profiles and all(PLAIN_NAME.match(p) for p in profiles)
    return "{" + ",".join(profiles) + "}" if plain else "*"


def _only(rows, profiles):
    return rows if profiles is None else rows.filter(F.col("profile").isin(list(profiles)))


def scan_run_folders(spark, root, profiles=None):
    """Catalogue of ``<profile>/<run>/manifest.json`` files below ``root`` (local, HDFS or S3A)."""
    rows = _catalogue(_lines(spark, f"{root}/{_folders(profiles)}/*/manifest.json", True))
    folder = F.regexp_extract("manifest_path", r"^(.*)/manifest\.json$", 1)
    named = rows.withColumn("run_dir", folder).withColumn("profile", _decoded(F.regexp_extract("run_dir", r"([^/]+)/[^/]+$", 1)))
    return _only(named, profiles)


def scan_chunk_files(spark, root, profiles=None):
    """Manifest rows of ``<profile>/<run>/chunks.json`` files; unreadable ones are left out."""
    files = spark.read.text(f"{root}/{_folders(profiles)}/*/chunks.json", wholetext=True)
    path = F.col("_metadata.file_path")
    schema = (
        "version bigint, algorithm string, chunk_size bigint, total_bytes bigint, "
        "hashes array<string>"
    )
    parsed = files.select(
        _decoded(F.regexp_extract(path, r"([^/]+)/[^/]+/chunks\.json$", 1)).alias("profile"),
        F.regexp_extract(path, r"([^/]+)/chunks\.json$", 1).alias("run_id"),
        F.lit(0).cast("bigint").alias("part"),
        F.from_json("value", schema).alias("m"),
    )
    rows = parsed.filter(F.col("m.hashes").isNotNull()).select(
        "profile", "run_id", "part", "m.*", F.lit(0).cast("bigint").alias("first_idx")
    )
    return _only(rows, profiles)


def find_run(catalog, text):
    """Catalogue rows of a run given by id, run folder or manifest path."""
    wanted = text.rstrip("/")
    hit = F.col("run_id") == wanted
    for column in ("run_dir", "manifest_path", "artifact_path"):
        if column in catalog.columns:
            hit = hit | F.coalesce(F.col(column) == wanted, F.lit(False))
    return catalog.filter(hit)
