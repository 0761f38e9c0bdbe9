"""A sink for finished files: every task stages and verifies its own, and one rename publishes a whole batch or nothing."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Rows of a manifest that a task holds before it writes them down.
MANIFEST_ROWS = 10_000
MANIFEST = pa.schema([("name", pa.string()), ("path", pa.string()), ("n_bytes", pa.int64()), ("sha256", pa.string()), ("error", pa.string())])


class PublishError(ValueError):
    """A file may not be published."""


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (pafs.LocalFileSystem(), path.rstrip("/")) if "://" not in path else pafs.FileSystem.from_uri(path.rstrip("/"))


def _checked(name: str | None) -> str:
    if not name or "/" in name or "\\" in name or name[0] in "._":
        raise PublishError(f"not a name for a published file: {name!r}")
    return name


@dataclass
class Staged(WriterCommitMessage):
    """What a task has staged."""

    part: str
    files: int
    n_bytes: int


class FileBatchWriter(DataSourceWriter):
    """Writes rows of name, content and passed as files.

    A task stages its files in a folder that no other attempt uses, reads each back and compares digests, and writes its part of
    the manifest. The commit, on the driver, takes away what attempts without a commit message left, and renames the batch into
    place; messages are one small record a task, whatever the number of files. An abort removes the staged batch.
    """

    def __init__(self, path: str, failures: str, source: str | None, columns: list[str]):
        if failures not in ("abort", "skip"):
            raise PublishError("failures are 'abort' or 'skip'")
        missing = {"name", "content", "passed"} - set(columns)
        if missing:
            raise PublishError(f"columns are missing: {sorted(missing)}")
        fs, root = file_system(path)
        if source is not None and (fs, root) == file_system(source):
            raise PublishError("the destination is the source")
        self.path, self.failures, self.batch = path, failures, uuid.uuid4().hex

    def _staging(self) -> tuple[pafs.FileSystem, str, str]:
        fs, root = file_system(self.path)
        return fs, f"{root}/_staging-{self.batch}", f"{root}/batch-{self.batch}"

    def write(self, iterator: Iterator[Row]) -> Staged:
        fs, staging, _ = self._staging()
        context = TaskContext.get()
        part = f"part-{context.partitionId():06d}-{context.taskAttemptId()}"
        fs.create_dir(f"{staging}/files/{part}", recursive=True)
        fs.create_dir(f"{staging}/manifest", recursive=True)
        seen: set[str] = set()
        rows, total = [], 0
        with fs.open_output_stream(f"{staging}/manifest/{part}.parquet") as out, pq.ParquetWriter(out, MANIFEST) as manifest:

            def flush() -> None:
                manifest.write_table(pa.Table.from_pylist(rows, MANIFEST))
                rows.clear()

            for row in iterator:
                error = None if row["passed"] and row["content"] is not None else "verification failed"
                if error is None:
                    name = _checked(row["name"])
                    if name in seen:
                        raise PublishError(f"{name} comes twice")
                    seen.add(name)
                    path = f"files/{part}/{name}"
                    n, digest = self._stage(fs, f"{staging}/{path}", bytes(row["content"]))
                    total += n
                    rows.append({"name": name, "path": f"batch-{self.batch}/{path}", "n_bytes": n, "sha256": digest, "error": None})
                elif self.failures == "abort":
                    raise PublishError(f"{row['name']}: {error}")
                else:
                    rows.append({"name": row["name"], "path": None, "n_bytes": None, "sha256": None, "error": error})
                if len(rows) >= MANIFEST_ROWS:
                    flush()
            flush()
        return Staged(part, len(seen), total)

    @staticmethod
    def _stage(fs: pafs.FileSystem, path: str, content: bytes) -> tuple[int, str]:
        with fs.open_output_stream(path) as out:
            out.write(content)
        digest = hashlib.sha256(content).hexdigest()
        back = hashlib.sha256()
        with fs.open_input_stream(path) as stored:
            while chunk := stored.read(1 << 20):
                back.update(chunk)
        if back.hexdigest() != digest:
            raise PublishError(f"{path} does not hold what was written")
        return len(content), digest

    def commit(self, messages: list[Staged | None]) -> None:
        fs, staging, place = self._staging()
        kept = {m.part for m in messages if m is not None}
        for folder in ("files", "manifest"):
            fs.create_dir(f"{staging}/{folder}", recursive=True)
            for found in fs.get_file_info(pafs.FileSelector(f"{staging}/{folder}")):
                if found.base_name.removesuffix(".parquet") not in kept:
                    fs.delete_dir(found.path) if found.type == pafs.FileType.Directory else fs.delete_file(found.path)
        if not kept:
            pq.write_table(MANIFEST.empty_table(), f"{staging}/manifest/part-none.parquet", filesystem=fs)
        fs.move(staging, place)

    def abort(self, messages: list[Staged | None]) -> None:
        fs, staging, _ = self._staging()
        if fs.get_file_info(staging).type == pafs.FileType.Directory:
            fs.delete_dir(staging)


class VerifiedFiles(DataSource):
    """Format verified_files: df.write.format("verified_files").mode("append").option("failures", "abort").save(path)."""

    @classmethod
    def name(cls) -> str:
        return "verified_files"

    def schema(self) -> str:
        return "name string, content binary, passed boolean"

    def writer(self, schema: StructType, overwrite: bool) -> FileBatchWriter:
        if overwrite:
            raise PublishError("published files are never overwritten: append a batch")
        return FileBatchWriter(self.options["path"], self.options.get("failures", "abort"), self.options.get("source"), schema.fieldNames())


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """What is published under a path: name, path (below it), n_bytes, sha256, and the error of files that were left out."""
    return spark.read.parquet(f"{path}/batch-*/manifest")


def publish(files: DataFrame, path: str, failures: str = "abort", source: str | None = None, tasks: int | None = None) -> None:
    """Publishes files (name, content, passed; other columns are not read) under a path as one batch.

    A file whose content is null or which has not passed makes the whole batch fail and leaves nothing behind; with
    failures='skip' it is named in the manifest and left out. Names must be plain file names, each once in the whole batch; null and
    repeated names fail. No files make a batch with an empty manifest. `source` is a folder that must not be written to. A rename
    is one step on HDFS and mounted file systems; on object stores without one, readers should wait for the manifest.

    A task gets its files in batches of rows, however large these are: `tasks` (else those of a shuffle) should grow with the files.
    """
    files = files.select("name", "content", F.coalesce("passed", F.lit(False)).alias("passed"))
    spark = files.sparkSession
    spark.dataSource.register(VerifiedFiles)
    # Rows of a name meet in one task, which refuses the second one.
    dealt = files.repartition(tasks, "name") if tasks else files.repartition("name")
    writer = dealt.write.format("verified_files").mode("append").option("failures", failures)
    (writer.option("source", source) if source else writer).save(path)


def publish_cleaned(cleaned: DataFrame, names: DataFrame, path: str, failures: str = "skip") -> None:
    """Publishes cleaned copies (file_id, content, error) under the names (file_id, name) that they are to have."""
    publish(cleaned.join(names, "file_id").select("name", "content", F.col("error").isNull().alias("passed")), path, failures)
