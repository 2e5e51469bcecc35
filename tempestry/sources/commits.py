"""A folder of files that jobs add to as a whole or not at all: what the library's own sinks share.

    data/<job>/<attempt>/...        files of a task's attempt
    entries/<job>/<attempt>.json    a line for each thing in them, with what a reader asks before it opens a file
    commits/<version>-<job>.json    the attempts of a job that count

A job is there once its commit is, a file written in one go. Files that no commit names are not: an aborted job deletes
its folders, and a commit those of lost attempts. Of equal names the one of the latest version counts. Paths are those
of pyarrow's file systems; s3a is its s3. Other schemes are refused when a job begins.
"""

from __future__ import annotations

import json
import re
import uuid

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or an absolute path, and the path in it."""
    uri = re.sub(r"^file:/(?!/)", "file:///", re.sub(r"^s3[an]://", "s3://", uri))
    return fs.FileSystem.from_uri(uri)


class Folder:
    def __init__(self, uri: str):
        self.uri = uri.rstrip("/")
        self.files, self.path = file_system(self.uri)

    def put(self, name: str, data: bytes) -> None:
        path = f"{self.path}/{name}"
        self.files.create_dir(path.rpartition("/")[0], recursive=True)
        with self.files.open_output_stream(path) as out:
            out.write(data)

    def names(self, below: str) -> list[str]:
        found = self.files.get_file_info(fs.FileSelector(f"{self.path}/{below}", allow_not_found=True))
        return sorted(p.path.rpartition("/")[2] for p in found)

    def delete(self, below: str) -> None:
        path = f"{self.path}/{below}"
        if self.files.get_file_info(path).type == fs.FileType.Directory:
            self.files.delete_dir(path)

    def get(self, name: str) -> bytes:
        with self.files.open_input_file(f"{self.path}/{name}") as file:
            return file.read()

    def commits(self) -> list[tuple[int, dict]]:
        return [(int(name.partition("-")[0]), json.loads(self.get(f"commits/{name}"))) for name in self.names("commits")]

    def entries(self) -> list[dict]:
        """The entries that count, of each name the latest; for the planner of a scan, as a listing of files is."""
        latest: dict[str, dict] = {}
        for version, commit in self.commits():
            for attempt in commit["attempts"]:
                for line in self.get(f"entries/{commit['job']}/{attempt}.json").splitlines():
                    entry = json.loads(line)
                    latest[entry["name"]] = entry | {"version": version}
        return [latest[name] for name in sorted(latest)]


class AttemptMessage(WriterCommitMessage):
    def __init__(self, attempt: str):
        self.attempt = attempt


class CommittingWriter(DataSourceArrowWriter):
    """Subclasses give each task's files by files(batches): a name, the bytes, and entries with a name each."""

    def __init__(self, uri: str):
        self.uri, self.job = uri, uuid.uuid4().hex
        Folder(uri)

    def files(self, batches):  # noqa: ANN001, ANN201
        raise NotImplementedError

    def write(self, iterator):  # noqa: ANN001, ANN201
        folder, context = Folder(self.uri), TaskContext.get()
        attempt = f"{context.partitionId()}-{context.taskAttemptId()}"
        lines = []
        for name, data, entries in self.files(iterator):
            path = f"data/{self.job}/{attempt}/{name}"
            folder.put(path, data)
            lines += [json.dumps({"bytes": len(data)} | entry | {"path": path}) for entry in entries]
        if lines:
            folder.put(f"entries/{self.job}/{attempt}.json", "\n".join(lines).encode())
        return AttemptMessage(attempt if lines else "")

    def commit(self, messages: list) -> None:
        """Lost attempts go first, so that nothing is left of them once the commit is there."""
        folder, kept = Folder(self.uri), sorted(m.attempt for m in messages if m is not None and m.attempt)
        for attempt in folder.names(f"data/{self.job}"):
            if attempt not in kept:
                folder.delete(f"data/{self.job}/{attempt}")
        if kept:
            version = max((v for v, _ in folder.commits()), default=0) + 1
            folder.put(f"commits/{version:08d}-{self.job}.json", json.dumps({"job": self.job, "attempts": kept}).encode())

    def abort(self, messages: list) -> None:
        folder = Folder(self.uri)
        for below in ("data", "entries"):
            folder.delete(f"{below}/{self.job}")


def manifest(spark: SparkSession, uri: str, schema: str) -> DataFrame:
    """The entries that count as rows: name, path, bytes, version and the fields of schema; empty if nothing is there."""
    folder = Folder(uri)
    paths = [f"{folder.uri}/entries/{c['job']}/{a}.json" for _, c in folder.commits() for a in c["attempts"]]
    versions = {c["job"]: v for v, c in folder.commits()}
    fields = f"name string, path string, bytes long, {schema}"
    if not paths:
        return spark.createDataFrame([], f"{fields}, version long")
    jobs = spark.createDataFrame(list(versions.items()), "job string, version long")  # a row for each commit
    rows = spark.read.schema(fields).json(paths).withColumn("job", F.split("path", "/")[1]).join(F.broadcast(jobs), "job").drop("job")
    return rows.groupBy("name").agg(F.max_by(F.struct("*"), "version").alias("x")).select("x.*")
