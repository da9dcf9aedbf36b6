import hashlib

import pytest
from pyspark.sql import functions as F

from tablekeeper.errors import KeeperError
from tablekeeper.operators import chunks
from tablekeeper.sources import catalogue, restored_files
from tablekeeper.sources.artifacts import read_artifacts, scan_file_blocks
from tablekeeper.sources.catalogue import scan_chunk_files


def artifact(spark, *contents, profile="p"):
    rows = [(i, profile, i, bytearray(c)) for i, c in enumerate(contents)]
    return spark.createDataFrame(rows, "run_id int, profile string, run_seq int, content binary")


def test_sizes_and_hashes(spark):
    data = b"hello world" * 1000
    rows = chunks.chunk(artifact(spark, data, b"", b"x" * 4096), 4096).orderBy("run_id", "idx").collect()
    pieces = [data[i : i + 4096] for i in range(0, len(data), 4096)]
    assert [(r.hash, r.n_bytes) for r in rows if r.run_id == 0] == [
        (hashlib.sha256(p).hexdigest(), len(p)) for p in pieces
    ]
    assert [r for r in rows if r.run_id == 1] == []
    assert [(r.idx, r.n_bytes) for r in rows if r.run_id == 2] == [(0, 4096)]


def test_second_pass_is_all_reused(spark):
    data = b"hello world" * 10000
    rows = chunks.run_summary(chunks.chunk(artifact(spark, data, data), 4096)).orderBy("run_id").collect()
    assert rows[0].total_bytes == len(data) and rows[0].new >= 1
    assert (rows[1].new, rows[1].reused) == (0, rows[1]["count"])


def test_repeats_inside_one_file_and_profiles_apart(spark):
    zeros = b"\0" * 4096 * 5
    both = artifact(spark, zeros).unionAll(artifact(spark, zeros, profile="q"))
    blocks = chunks.classify(chunks.chunk(both, 4096))
    assert {(r.profile, r.idx) for r in blocks.filter("is_new").collect()} == {("p", 0), ("q", 0)}


def test_known_store_makes_everything_reused(spark):
    blocks = chunks.chunk(artifact(spark, b"a" * 9000), 4096)
    assert chunks.classify(blocks, chunks.list_store(blocks)).filter("is_new").count() == 0


def test_store_garbage_and_restore(spark, tmp_path):
    path = str(tmp_path / "store")
    a, b = b"alpha" * 5000, b"bravo" * 5000
    blocks = chunks.chunk(artifact(spark, a, b), 4096, with_data=True)
    chunks.append_store(blocks, path)
    size = chunks.read_store(spark, path).count()
    chunks.append_store(blocks, path, chunks.read_store(spark, path))
    assert chunks.read_store(spark, path).count() == size == blocks.select("hash").distinct().count()

    manifests = chunks.explode_manifests(chunks.manifest_rows(blocks.drop("data"), 4096, 2))
    kept = manifests.filter("run_id = 1")
    want = {r.hash for r in kept.collect()}
    removed = chunks.collect_garbage(spark, path, kept)
    store = chunks.read_store(spark, path)
    assert {r.hash for r in store.collect()} == want and removed == size - len(want)
    assert chunks.collect_garbage(spark, path, kept) == 0

    parts = chunks.reassemble(kept, store, 2).orderBy("part").collect()
    assert b"".join(bytes(r.content) for r in parts) == b
    assert len(parts) == -(-len(kept.collect()) // 2)
    with pytest.raises(KeeperError):
        chunks.check_restorable(manifests, store)
    with pytest.raises(Exception, match="block missing"):
        chunks.reassemble(manifests, store).collect()
    assert chunks.missing_blocks(manifests, store).count() == removed


def test_profile_that_is_all_garbage(spark, tmp_path):
    path = str(tmp_path / "store")
    both = artifact(spark, b"one" * 3000, profile="007").unionAll(
        artifact(spark, b"two" * 3000, profile="a/b:c"))
    blocks = chunks.chunk(both, 4096, with_data=True)
    chunks.append_store(blocks, path)
    chunks.collect_garbage(spark, path, blocks.filter("profile = '007'").select("profile", "hash"))
    left = chunks.read_store(spark, path)
    assert {r.profile for r in left.collect()} == {"007"}


def test_empty_run_cannot_be_restored(spark):
    blocks = chunks.chunk(artifact(spark, b"x"), 4096, with_data=True)
    store = blocks.select("profile", "hash", "data")
    runs = spark.createDataFrame([(0,), (9,)], "run_id int")
    with pytest.raises(KeeperError, match="nothing to reassemble"):
        chunks.check_restorable(blocks.select("profile", "run_id", "idx", "hash"), store, runs)


def test_files_by_range_equal_whole_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(bytes(range(256)) * 100)
    (tmp_path / "b.bin").write_bytes(b"")
    (tmp_path / "c d.bin").write_bytes(b"z" * 5000)
    whole = read_artifacts(spark, f"{tmp_path}/*.bin").withColumnRenamed("path", "run_id")
    want = chunks.chunk(whole.drop("length"), 4096, with_data=True)
    got = scan_file_blocks(spark, f"{tmp_path}/*.bin", 4096, with_data=True, bytes_per_task=8000)
    assert got.rdd.getNumPartitions() == 4

    def rows(df, name):
        return sorted((r[name].split("/")[-1].replace("%20", " "), r.idx, r.hash, r.n_bytes, bytes(r.data))
                      for r in df.collect())

    assert rows(got, "path") == rows(want, "run_id")


def test_chunk_files_of_run_folders(spark, tmp_path):
    good = '{"version": 1, "algorithm": "sha256", "chunk_size": 4, "total_bytes": 6, "hashes": ["aa", "bb"]}'
    for run, text in {"r1": good, "r2": '{"version": 1}', "r3": "{cut"}.items():
        folder = tmp_path / "p" / run
        folder.mkdir(parents=True)
        (folder / "chunks.json").write_text(text)
    rows = chunks.explode_manifests(scan_chunk_files(spark, str(tmp_path))).collect()
    assert sorted((r.profile, r.run_id, r.idx, r.hash) for r in rows) == [
        ("p", "r1", 0, "aa"), ("p", "r1", 1, "bb")
    ]


def test_hot_block_does_not_meet_itself(spark):
    """A third of all blocks share one hash; only one of them is new."""
    df = spark.range(3000).select(
        F.col("id").alias("run_id"), F.lit("p").alias("profile"), F.col("id").alias("run_seq"),
        F.when(F.col("id") % 3 == 0, F.lit("zero")).otherwise(F.col("id").cast("string")).cast("binary").alias("content"),
    )
    summary = chunks.run_summary(chunks.chunk(df, 4096)).agg(F.sum("new"), F.sum("reused")).first()
    assert tuple(summary) == (2001, 999)


def test_popular_block_is_copied(spark):
    """Many runs that use one block come back whole when its uses are split."""
    zeros = b"\0" * 8
    many = [zeros * 3 + bytes([i]) * 5 for i in range(40)]
    blocks = chunks.chunk(artifact(spark, *many), 8, with_data=True)
    store = blocks.dropDuplicates(["profile", "hash"])
    manifests = blocks.select("profile", "run_id", "idx", "hash")
    parts = chunks.reassemble(manifests, store, 100, uses_per_task=7).orderBy("run_id").collect()
    assert [bytes(r.content) for r in parts] == many


def test_files_go_to_the_store_once(spark, tmp_path):
    files, path = tmp_path / "files", str(tmp_path / "store")
    files.mkdir()
    (files / "a.bin").write_bytes(b"a" * 4096 + b"b" * 100)
    (files / "b.bin").write_bytes(b"a" * 8192)
    blocks = chunks.append_files(spark, f"{files}/*", path, "p", 4096)
    assert blocks.count() == 4 and chunks.read_store(spark, path).count() == 2
    (files / "c.bin").write_bytes(b"c" * 4097 + b"")
    blocks = chunks.append_files(spark, f"{files}/*", path, "p", 4096, chunks.read_store(spark, path))
    store = chunks.read_store(spark, path)
    assert store.count() == 4
    whole = chunks.reassemble(blocks, store).orderBy("run_id").collect()
    assert [bytes(r.content) for r in whole] == [
        (files / n).read_bytes() for n in ("a.bin", "b.bin", "c.bin")]


def test_block_kept_twice_or_damaged(spark, tmp_path):
    path = str(tmp_path / "store")
    data = b"".join(bytes([i]) * 256 for i in range(200, 240))
    blocks = chunks.chunk(artifact(spark, data), 4096, with_data=True)
    chunks.append_store(blocks, path)
    n = chunks.read_store(spark, path).count()
    chunks.append_store(blocks, path)  # a repeated append finds everything there
    assert chunks.read_store(spark, path).count() == n
    chunks._write_store(blocks, path)  # two appends at the same time
    damaged = blocks.withColumn("data", F.lit(b"?"))
    chunks._write_store(damaged, path)
    store = chunks.read_store(spark, path)
    assert store.count() == 3 * n and chunks.list_store(store).count() == n
    manifests = blocks.select("profile", "run_id", "idx", "hash")
    assert [bytes(r.content) for r in chunks.reassemble(manifests, store).collect()] == [data]
    with pytest.raises(Exception, match="block missing"):
        chunks.reassemble(manifests, store.filter(F.octet_length("data") == 1)).collect()


def test_garbage_collection_that_stops_before_deleting(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    blocks = chunks.chunk(artifact(spark, b"a" * 4096 + b"b" * 4096, b"c" * 5000), 4096, with_data=True)
    chunks.append_store(blocks, path)
    kept = blocks.filter("run_id = 0").select("profile", "run_id", "idx", "hash")
    with monkeypatch.context() as patch:
        patch.setattr(chunks, "delete_files", lambda *args: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            chunks.collect_garbage(spark, path, kept)
    whole = lambda: [bytes(r.content) for r in chunks.reassemble(kept, chunks.read_store(spark, path)).collect()]
    assert whole() == [b"a" * 4096 + b"b" * 4096]
    assert chunks.collect_garbage(spark, path, kept) == 2
    assert whole() == [b"a" * 4096 + b"b" * 4096]
    assert chunks.list_store(chunks.read_store(spark, path)).count() == 2


def test_chunk_files_of_some_profiles(spark, tmp_path):
    good = '{"version": 1, "algorithm": "sha256", "chunk_size": 4, "total_bytes": 6, "hashes": ["aa"]}'
    for name in ("p", "q[1]", "r s"):
        folder = tmp_path / name / "r1"
        folder.mkdir(parents=True)
        (folder / "chunks.json").write_text(good)
    root = str(tmp_path)
    assert [r.profile for r in scan_chunk_files(spark, root, ["q[1]"]).collect()] == ["q[1]"]
    assert [r.profile for r in scan_chunk_files(spark, root, ["r s"]).collect()] == ["r s"]
    assert [r.profile for r in scan_chunk_files(spark, root, ["p"]).collect()] == ["p"]
    assert scan_chunk_files(spark, root, []).collect() == []


def test_part_files_are_checked_and_appear_at_once(spark, tmp_path):
    target = str(tmp_path / "out")
    schema = "run_id string, part long, content binary, hash string"
    good = [(run, n, bytearray(f"{run}{n}".encode()), hashlib.sha256(f"{run}{n}".encode()).hexdigest())
            for run in ("a", "dir/b c%") for n in range(12)]
    restored_files.write_parts(spark.createDataFrame(good, schema).repartition(5), target)
    files_ = sorted(p for p in (tmp_path / "out").rglob("part-*"))
    assert [p.read_bytes() for p in files_] == [bytes(r[2]) for r in good]
    assert files_[10].name == "part-0000000010"
    damaged = good[:-1] + [(*good[-1][:3], "0" * 64)]
    for path, overwrite in ((str(tmp_path / "other"), False), (target, True)):
        with pytest.raises(Exception, match="damaged"):
            restored_files.write_parts(spark.createDataFrame(damaged, schema).repartition(5), path, overwrite)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out"]  # nothing of the aborted writes is left
    assert [p.read_bytes() for p in sorted((tmp_path / "out").rglob("part-*"))] == [bytes(r[2]) for r in good]
    with pytest.raises(Exception, match="exists"):
        restored_files.write_parts(spark.createDataFrame(good[:1], schema), target)
    restored_files.write_parts(spark.createDataFrame(good[:1], schema), target, overwrite=True)
    assert len(list((tmp_path / "out").rglob("part-*"))) == 1


def test_run_folders_are_written_by_tasks(spark, tmp_path, monkeypatch):
    """What the driver does does not grow with the runs; names are those of partition folders, unescaped."""
    client, calls = spark._sc._gateway._gateway_client, []
    send = client.send_command

    def counting(command, *args, **kw):
        calls.extend([1] * (not command.startswith("m\n")))  # apart from objects let go
        return send(command, *args, **kw)

    monkeypatch.setattr(client, "send_command", counting)
    counts = {}
    for n in (5, 200):
        for again in (False, True):  # one call writes, the other finds all in place
            calls.clear()
            catalogue.write_run_folders(spark.range(n).selectExpr(
                "'r' || id AS run_id", "'p' || id % 3 AS profile", "'d ' || id AS run_dir",
                "'10:00:00 2024-01-01' AS finished_at"), str(tmp_path / f"n{n}"))
            counts[n, again] = len(calls)
    assert all(abs(counts[5, again] - counts[200, again]) < 50 for again in (False, True)), counts
    assert len(list((tmp_path / "n200").glob("p*/d */manifest.json"))) == 200
    odd = [("a", None, "x"), ("b", "", "y"), ("c", "50%", "a=b#c+d"), ("d", "p", None), ("e", "p q", "twice"),
           ("e", "p q", "twice")]
    frame = spark.createDataFrame(
        [(*r, "10:00:00 2024-01-01") for r in odd], "run_id string, profile string, run_dir string, finished_at string")
    catalogue.write_run_folders(frame, str(tmp_path / "odd"))
    none = "__HIVE_DEFAULT_PARTITION__"
    assert {str(p.relative_to(tmp_path / "odd").parent) for p in (tmp_path / "odd").rglob("manifest.json")} == {
        f"{none}/x", f"{none}/y", "50%/a=b#c+d", f"p/{none}", "p q/twice"}
    got = catalogue.scan_run_folders(spark, str(tmp_path / "odd")).collect()
    assert sorted((r.run_id, r.profile) for r in got) == [
        ("a", none), ("b", none), ("c", "50%"), ("d", "p"), ("e", "p q")]
    assert [p.name for p in (tmp_path / "odd").iterdir() if p.name.startswith(".")] == []


def test_run_folders(spark, tmp_path):
    root = str(tmp_path / "runs")
    runs = [(f"r{n}", p, f"2024_r{n}", "10:00:00 2024-01-01") for p in ("a b", "c%d") for n in range(3)]
    frame = spark.createDataFrame(runs, "run_id string, profile string, run_dir string, finished_at string")
    catalogue.write_run_folders(frame, root)
    for checksum in (tmp_path / "runs").rglob(".*.crc"):
        checksum.unlink()
    (tmp_path / "runs" / "a b" / "2024_r0" / "manifest.json").write_text(
        '{"run_id": "kept", "finished_at": "10:00:00 2024-01-01"}')
    (tmp_path / "runs" / "a b" / "broken").mkdir()
    (tmp_path / "runs" / "a b" / "broken" / "manifest.json").write_text("{")
    catalogue.write_run_folders(frame, root)  # manifests in their place stay
    got = {(r.profile, r.run_id) for r in catalogue.scan_run_folders(spark, root).collect()}
    assert got == {("a b", "kept")} | {(p, r) for r, p, _, _ in runs} - {("a b", "r0")}
    assert sorted(p.name for p in (tmp_path / "runs").iterdir()) == ["a b", "c%d"]
    catalog = catalogue.scan_run_folders(spark, root, ["c%d"])
    assert catalog.count() == 3
    folder = catalog.where("run_id = 'r1'").first()
    assert [r.run_id for r in catalogue.find_run(catalog, folder.run_dir + "/").collect()] == ["r1"]
    assert [r.run_id for r in catalogue.find_run(catalog, folder.manifest_path).collect()] == ["r1"]
    assert catalogue.find_run(catalog, "nothing").count() == 0
