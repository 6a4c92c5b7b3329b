"""WARC files as a Spark data source: `df.write.format("warc")` and `spark.read.format("warc")`.

A task writes the column `record`, whole WARC records, as gzip members of one file `part-<n>-<job>.warc.gz`.
Files stand in a hidden folder until all tasks have ended and the driver moves them to their place, so lost and
repeated tasks leave nothing behind. Reading makes a partition per `.warc` or `.warc.gz` file and holds one
record at a time. Paths are those that `pyarrow.fs` knows, and must be shared by all executors.

Defined cases: a partition without rows writes no file; null records are skipped; an empty table writes an
empty folder, which reads as no rows; with mode overwrite the folder's older WARC files go when the new ones
are there; a file that ends inside a record fails the read, with its name.
"""

from __future__ import annotations

import gzip
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

SCHEMA = "file string, headers map<string,string>, block binary"
ENDINGS = (".warc", ".warc.gz")


@dataclass
class Written(WriterCommitMessage):
    """A file that a task has written; no name if it had no rows."""

    name: str | None


class WarcFile(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


def place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path.replace("file:///", "/") if path.startswith("file:///") else path)


def warc_files(path: str) -> list[str]:
    """The WARC files of a folder, or the file itself, as paths of the file system."""
    system, root = place(path)
    if system.get_file_info(root).type == fs.FileType.File:
        return [root]
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.base_name.endswith(ENDINGS))


def records_of(stream: io.BufferedIOBase, name: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a stream of uncompressed WARC bytes."""
    while line := stream.readline():
        if not line.strip():
            continue  # the empty lines behind a record
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{name}: no WARC record begins with {line[:40]!r}")
        headers: dict[str, str] = {}
        last = None
        while (line := stream.readline()).strip():
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if text[0] in " \t" and last:
                headers[last] += " " + text.strip()  # a folded line
            elif ":" in text:
                last, value = (x.strip() for x in text.split(":", 1))
                headers[last] = value
        size = int(headers.get("Content-Length", 0))
        block = stream.read(size)
        if len(block) < size:
            raise ValueError(f"{name} ends inside a record")
        yield headers, block


class WarcReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[WarcFile]:
        return [WarcFile(f) for f in warc_files(self.path)]

    def read(self, partition: WarcFile | None) -> Iterator[tuple]:
        if partition is None:  # a folder without files
            return
        system, _ = place(self.path)
        with system.open_input_stream(partition.path, compression=None) as raw:
            stream = gzip.GzipFile(fileobj=raw) if partition.path.endswith(".gz") else raw
            for headers, block in records_of(io.BufferedReader(stream), partition.path):
                yield partition.path, headers, block


class WarcWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def folder(self) -> tuple[fs.FileSystem, str, str]:
        system, root = place(self.path)
        return system, root, f"{root}/_writing-{self.job}"

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        system, _, hidden = self.folder()
        name, out = uuid.uuid4().hex, None
        try:
            for row in rows:
                if row["record"] is not None:
                    if out is None:
                        system.create_dir(hidden)
                        out = system.open_output_stream(f"{hidden}/{name}", compression=None)
                    out.write(gzip.compress(bytes(row["record"]), 6, mtime=0))
        finally:
            if out is not None:
                out.close()
        return Written(name if out is not None else None)

    def commit(self, messages: list[Written | None]) -> None:
        system, root, hidden = self.folder()
        old = warc_files(self.path) if self.overwrite else []
        system.create_dir(root)
        names = [m.name for m in messages if m is not None and m.name]
        for n, name in enumerate(names):
            system.move(f"{hidden}/{name}", f"{root}/part-{n:05}-{self.job}.warc.gz")
        for path in old:
            system.delete_file(path)
        if names:
            system.delete_dir(hidden)

    def abort(self, messages: list[Written | None]) -> None:
        system, _, hidden = self.folder()
        if system.get_file_info(hidden).type == fs.FileType.Directory:
            system.delete_dir(hidden)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


def write_warc(records: DataFrame, path: str, mode: str = "append") -> None:
    """Store the column `record`: one `.warc.gz` file per partition that has rows."""
    records.sparkSession.dataSource.register(WarcSource)
    records.select("record").write.format("warc").mode(mode).save(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, headers, block) of every record of the WARC files of a folder."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").load(path)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """The response records of WARC files, as `warc.derive` takes them."""
    header = lambda name: F.col("headers")[name]
    return read_warc(spark, path).filter(header("WARC-Type") == "response").select(
        header("WARC-Record-ID").alias("record_id"),
        header("WARC-Target-URI").alias("target_uri"),
        header("WARC-Date").alias("date"),
        header("WARC-IP-Address").alias("ip"),
        "headers",
        "block",
        header("WARC-Payload-Digest").alias("payload_digest"),
        header("WARC-Block-Digest").alias("block_digest"),
    )
