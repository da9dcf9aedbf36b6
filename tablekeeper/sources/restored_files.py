"""Restored artifacts as ordered part files: ``<path>/<run>/part-0000000000``, ...

A Spark data source for writing rows of (``run_id``, ``part``, ``content``, ``hash``). Every task checks the
SHA-256 of a part and writes it below a hidden folder beside the target, first under a name of its own and then
under the part's, so that a task that runs again replaces what it left. The folder takes the target's place in one
step when all tasks are done; after an abort nothing of it is left.
"""

import hashlib
import uuid
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tablekeeper.errors import KeeperError
from tablekeeper.sources.artifacts import _locate

FORMAT = "restored_files"


@dataclass
class _Done(WriterCommitMessage):
    files: int


class RestoredFiles(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return "run_id string, part bigint, content binary, hash string"

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], overwrite)


class _Writer(DataSourceWriter):
    def __init__(self, path, overwrite):
        path = path.rstrip("/")
        self.path, self.overwrite = path if ":" in path else f"file:{path}", overwrite
        above, name = self.path.rsplit("/", 1)
        self.staging = f"{above}/.{name}-{uuid.uuid4().hex}"

    def write(self, iterator):
        system, root = _locate(self.staging)
        system.create_dir(root, recursive=True)
        files = 0
        for row in iterator:
            if hashlib.sha256(row["content"]).hexdigest() != row["hash"]:
                raise KeeperError(f"part {row['part']} of run {row['run_id']} is damaged")
            folder = f"{root}/{quote(row['run_id'], safe='')}"
            system.create_dir(folder, recursive=True)
            own = f"{folder}/.{uuid.uuid4().hex}"
            with system.open_output_stream(own) as out:
                out.write(row["content"])
            system.move(own, f"{folder}/part-{row['part']:010d}")
            files += 1
        return _Done(files)

    def commit(self, messages):
        system, staged = _locate(self.staging)
        _, target = _locate(self.path)
        system.create_dir(staged, recursive=True)  # no task wrote anything
        if system.get_file_info(target).type.name != "NotFound":
            if not self.overwrite:
                self.abort(messages)
                raise KeeperError(f"{self.path} exists")
            system.delete_dir(target)
        system.move(staged, target)

    def abort(self, messages):
        system, staged = _locate(self.staging)
        if system.get_file_info(staged).type.name != "NotFound":
            system.delete_dir(staged)


def write_parts(parts, path, overwrite=False):
    """Write reassembled parts (``run_id``, ``part``, ``content``) with the hashes that they must have."""
    parts.sparkSession.dataSource.register(RestoredFiles)
    rows = parts.selectExpr(
        "CAST(run_id AS string) run_id", "CAST(part AS bigint) part", "content",
        "hash" if "hash" in parts.columns else "sha2(content, 256) AS hash")
    rows.write.format(FORMAT).mode("overwrite" if overwrite else "append").option("path", path).save()
