"""Folders and files through the cluster's own file system."""

from pyspark.sql import functions as F


def _file_system(spark, path):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark, path):
    folder, system = _file_system(spark, path)
    return system.exists(folder)


def qualified(spark, path):
    """The path with its file system, as tasks find it without Spark's settings."""
    folder, system = _file_system(spark, path)
    return system.makeQualified(folder).toString()


def found(spark, pattern):
    """Whether any file or folder matches a path that may be a glob."""
    folder, system = _file_system(spark, pattern)
    return bool(system.globStatus(folder))


def complete(spark, path):
    """Whether the write of the folder at ``path`` finished."""
    return exists(spark, f"{path}/_SUCCESS")


def names(spark, root):
    """Sorted names of what lies in a folder; none if it is absent."""
    folder, system = _file_system(spark, root)
    return sorted(f.getPath().getName() for f in system.listStatus(folder)) if system.exists(folder) else []


def mark(spark, path):
    """Create an empty file."""
    file, system = _file_system(spark, path)
    system.create(file, True).close()


def write_text(spark, path, text):
    """Write a small file that appears whole or not at all."""
    part, system = _file_system(spark, f"{path}.part")
    stream = system.create(part, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    target, _ = _file_system(spark, path)
    system.delete(target, False)
    system.rename(part, target)


def read_text(spark, path):
    file, system = _file_system(spark, path)
    stream = system.open(file)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def complete_versions(spark, root):
    """Numbers of the ``version=`` folders whose write finished."""
    pattern, system = _file_system(spark, f"{root}/version=*/_SUCCESS")
    found = system.globStatus(pattern) or []
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)


def publish(df, root):
    """Write ``df`` as the next version of the table at ``root``.

    Readers keep the old version until the new one is complete, so a table may be rebuilt from
    itself.
    """
    versions = complete_versions(df.sparkSession, root)
    path = f"{root}/version={(versions[-1] if versions else 0) + 1:010d}"
    df.write.mode("overwrite").parquet(path)
    return path


def current(spark, root):
    """Newest complete version of a published table, None before the first."""
    versions = complete_versions(spark, root)
    return spark.read.parquet(f"{root}/version={versions[-1]:010d}") if versions else None


def delete_files(spark, paths):
    """Delete the files named in the one column of ``paths``, written as ``_metadata.file_path`` has them."""
    conf = spark._jsc.hadoopConfiguration()
    new_path, new_uri = spark._jvm.org.apache.hadoop.fs.Path, spark._jvm.java.net.URI
    # names only, one partition of the list at a time
    for row in paths.toLocalIterator():
        path = new_path(new_uri(row[0]))
        path.getFileSystem(conf).delete(path, False)


def delete_folders(spark, paths):
    """Delete the folders named in the one column of ``paths``; absent ones are passed over."""
    for row in paths.toLocalIterator():
        folder, system = _file_system(spark, row[0])
        system.delete(folder, True)


def delete_paths(spark, paths):
    """Delete a few folders given by name; absent ones are passed over."""
    for path in paths:
        folder, system = _file_system(spark, path)
        system.delete(folder, True)


def inventory(spark, root):
    """Files and bytes per profile below ``root``; file contents are never read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .load(root).select("path", "length")
    )
    profile = F.regexp_extract("path", r"/profile=([^/]+)/", 1)
    return files.groupBy(profile.alias("profile")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes")
    )
