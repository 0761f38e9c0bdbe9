"""A source for published files that opens only what is asked for, and stops when nothing more is."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith
from pyspark.sql.types import StructType

from ..lineage import scratch
from .publish import PublishError, file_system, manifest

#: Bits of a filter of wanted digests for each of them, and at most; beyond that it lets more files through, and loses none.
BITS_EACH, MOST_BITS = 12, 1 << 24
#: Stretches of eight hexadecimal digits of a digest, each of which sets one bit.
STRETCHES = 4
#: A batch of rows is handed over when it holds so many bytes.
BATCH_BYTES = 8 << 20
SCHEMA = pa.schema([("name", pa.string()), ("n_bytes", pa.int64()), ("sha256", pa.string()), ("content", pa.binary())])
#: The columns that the manifest tells without opening a file.
TOLD = ("name", "n_bytes", "sha256")


def write_digest_filter(wanted: DataFrame, path: str) -> int:
    """A Bloom filter of the digests in wanted.sha256, summed up by Spark and written under a path; returns its bits.

    Digests are evenly spread, so their own digits are the hashes. Nulls are not wanted.
    """
    digests = wanted.select("sha256").where("sha256 is not null").distinct()
    bits = min(MOST_BITS, max(1024, 1 << (BITS_EACH * digests.count()).bit_length()))
    places = F.array(*[F.conv(F.substring("sha256", 1 + 8 * i, 8), 16, 10).cast("long") % bits for i in range(STRETCHES)])
    rows = digests.select(F.explode(places).alias("place")).groupBy(F.expr("place div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("bits"))
    rows.coalesce(1).write.parquet(path)  # at most MOST_BITS / 64 rows
    return bits


class DigestFilter:
    """What write_digest_filter has written, in memory: MOST_BITS / 8 bytes at most."""

    def __init__(self, path: str, bits: int):
        fs, place = file_system(path)
        told = pads.dataset(place, filesystem=fs, format="parquet", schema=pa.schema([("word", pa.int64()), ("bits", pa.int64())])).to_table()
        self.words = np.zeros(bits // 64, dtype=np.int64)
        self.words[told["word"].to_numpy()] = told["bits"].to_numpy()
        self.bits = bits

    def may_hold(self, digest: str) -> bool:
        places = (int(digest[8 * i : 8 * i + 8], 16) % self.bits for i in range(STRETCHES))
        return all(int(self.words[p // 64]) >> (p % 64) & 1 for p in places)


@dataclass
class ManifestPart(InputPartition):
    """One task's part of a batch: a file of the manifest, below the root."""

    path: str


class PublishedReader(DataSourceReader):
    """Reads the manifest, one file of it in a task, and opens the files that pass what is known of them.

    `wanted` names a filter of digests and its bits. With `once` a task opens one file of each digest.
    """

    def __init__(self, path: str, wanted: tuple[str, int] | None, once: bool):
        self.path, self.wanted, self.once = path, wanted, once
        self.conditions: list[tuple[str, str, object]] = []
        self.names: frozenset[str] | None = None

    def partitions(self) -> list[ManifestPart]:
        """One for each part of each batch; the manifest's rows are not read here."""
        fs, root = file_system(self.path)
        batches = [x.path for x in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if x.base_name.startswith("batch-")]
        return [ManifestPart(x.path) for batch in sorted(batches) for x in fs.get_file_info(pafs.FileSelector(f"{batch}/manifest")) if x.base_name.endswith(".parquet")] or [ManifestPart("")]

    def _told(self) -> pc.Expression:
        compare = {"=": "__eq__", ">": "__gt__", ">=": "__ge__", "<": "__lt__", "<=": "__le__"}
        out = pc.field("path").is_valid()
        for column, how, value in self.conditions:
            field = pc.field(column)
            if how == "in":
                out &= field.isin(value)
            elif how == "starts":
                out &= pc.starts_with(field, pattern=value)
            else:
                out &= getattr(field, compare[how])(pc.scalar(value))
        return out

    def read(self, partition: ManifestPart) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, root = file_system(self.path)
        may_hold = DigestFilter(*self.wanted).may_hold if self.wanted else lambda digest: True
        outstanding = None if self.names is None else set(self.names)
        seen: set[str] = set()
        rows, held = [], 0
        for batch in pads.dataset(partition.path, filesystem=fs, format="parquet").scanner(filter=self._told(), batch_readahead=1).to_batches():
            for row in batch.to_pylist():
                if outstanding is not None:
                    outstanding.discard(row["name"])
                if not may_hold(row["sha256"]) or row["sha256"] in seen:
                    continue
                if self.once:
                    seen.add(row["sha256"])
                with fs.open_input_stream(f"{root}/{row['path']}") as stored:
                    content = stored.read()
                if hashlib.sha256(content).hexdigest() != row["sha256"]:
                    raise PublishError(f"{row['path']} does not hold what was published")
                rows.append({"name": row["name"], "n_bytes": row["n_bytes"], "sha256": row["sha256"], "content": content})
                held += len(content)
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, SCHEMA)
                    rows, held = [], 0
            if outstanding is not None and not outstanding:  # a name stands once in a batch
                break
        if rows:
            yield pa.RecordBatch.from_pylist(rows, SCHEMA)


class FilteringReader(PublishedReader):
    """The reader with conditions that Spark hands down, where the session allows that."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        signs = {EqualTo: "=", In: "in", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", StringStartsWith: "starts"}
        for given in filters:
            if type(given) in signs and len(given.attribute) == 1 and given.attribute[0] in TOLD and given.value is not None:
                how, column = signs[type(given)], given.attribute[0]
                value = [v for v in given.value if v is not None] if how == "in" else given.value
                self.conditions.append((column, how, value))
                if column == "name" and how in ("=", "in"):
                    names = frozenset([value] if how == "=" else value)
                    self.names = names if self.names is None else self.names & names
            yield given  # Spark looks again at the few rows that are left


class PublishedFiles(DataSource):
    """Format published_files: name, n_bytes, sha256 and content of what was published under a path."""

    @classmethod
    def name(cls) -> str:
        return "published_files"

    def schema(self) -> str:
        return "name string, n_bytes long, sha256 string, content binary"

    def reader(self, schema: StructType) -> PublishedReader:
        wanted = (self.options["wanted"], int(self.options["bits"])) if "wanted" in self.options else None
        kind = FilteringReader if self.options.get("filters", "false") == "true" else PublishedReader
        return kind(self.options["path"], wanted, self.options.get("once", "false") == "true")


def read_published(spark: SparkSession, path: str, wanted: DataFrame | None = None, once: bool = False) -> DataFrame:
    """Published files: name, n_bytes, sha256, content; every content is held against its digest.

    `wanted` (a column sha256; others are not read) limits the result to these digests, nulls and repeats not counting: a
    Bloom filter of them keeps other files from being opened, and a join takes out what it lets through by chance, so any number of
    digests can be wanted. With `once` one file of each digest comes, the first by name. Comparisons of name, n_bytes and sha256 with
    constants are handed down where spark.sql.python.filterPushdown.enabled is true; a task that has seen all names that are asked
    for reads no further. Nothing published, or nothing wanted, gives an empty result.
    """
    spark.dataSource.register(PublishedFiles)
    reader = spark.read.format("published_files").option("once", str(once).lower())
    if not once and spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") == "true":
        reader = reader.option("filters", "true")
    if wanted is not None:
        place = scratch(spark, "wanted")
        reader = reader.option("bits", write_digest_filter(wanted, place)).option("wanted", place)
    files = reader.load(path)
    if wanted is not None:
        files = files.join(wanted.select("sha256").distinct(), "sha256", "left_semi")
    if once:
        # Which file a task opened says nothing of the name: the manifest does.
        names = manifest(spark, path).where("path is not null").groupBy("sha256").agg(F.min("name").alias("name"))
        files = files.drop("name").dropDuplicates(["sha256"]).join(names, "sha256")
    return files.select("name", "n_bytes", "sha256", "content")
