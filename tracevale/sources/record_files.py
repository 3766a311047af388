"""Records as files, one JSON file an id, as a data source that is read and written like any other.

    spark.read.format("record_files").option("kind", "screens").load(root)
    df.write.format("record_files").option("kind", "screens").mode("append").save(root)

Both have the columns (id, value); `value` is the record as JSON. A file is named by its id, with `_` for `:`, under
`records/<kind>`. A write puts its files aside, in folders of bounded size, and moves them in place folder by folder when all its
tasks have ended; if one fails, nothing is there. Reading goes by file names, in order; a folder that isn't there is an empty
table. The driver deals names out to tasks by ranges of a sample, and of each name keeps what a compressed list takes (5 to 12
bytes). Paths may be of any file system that pyarrow opens, and must be seen by the driver and all executors; only local ones
are listed file by file, pyarrow lists others at once.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .records import schema

#: Files of a task that reads, on average, and of a folder of a write; names in the sample, at most; bytes of names that are compressed together.
FILES = 2_000
SAMPLE = 1 << 16
PIECE = 1 << 13


def folder(root: str, kind: str) -> tuple[fs.FileSystem, str]:
    """Where the records of a kind lie; a kind that leads out of the records is refused."""
    path = PurePosixPath(kind)
    if not kind or path.is_absolute() or ".." in path.parts:
        raise ValueError(f"not a kind within the records: {kind!r}")
    files, at = fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")
    return files, f"{at}/records/{path}"


def file_name(record_id: str) -> str:
    if "/" in record_id or record_id in ("", ".", ".."):
        raise ValueError(f"not an id for a file: {record_id!r}")
    return f"{record_id.replace(':', '_')}.json"


def names_in(files: fs.FileSystem, at: str) -> Iterator[str]:
    """Names of a folder's records, in no order."""
    if not isinstance(files, fs.LocalFileSystem):
        found = files.get_file_info(fs.FileSelector(at, allow_not_found=True))
        yield from (f.base_name for f in found if f.type == fs.FileType.File and f.base_name.endswith(".json"))
    elif os.path.isdir(at):
        with os.scandir(at) as found:
            yield from (f.name for f in found if f.name.endswith(".json") and f.is_file())


def bounds(names: Iterator[str]) -> list[str]:
    """Names at which ranges of about FILES names begin, but the first; exact for up to SAMPLE names, else from a sample by hashes."""
    sample, n, below = [], 0, 1 << 32
    for name in names:
        n += 1
        if zlib.crc32(name.encode()) < below:
            sample.append(name)
        if len(sample) > SAMPLE:
            below //= 2
            sample = [x for x in sample if zlib.crc32(x.encode()) < below]
    sample.sort()
    ranges = -(-n // FILES)
    return sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []


@dataclass
class Chunk(InputPartition):
    """The files of a range of names: compressed lists of names, separated by what no name has."""

    pieces: list[bytes]

    def names(self) -> list[str]:
        return sorted(name for piece in self.pieces for name in zlib.decompress(piece).decode().split("/"))


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: folders of an attempt, numbered from 0."""

    own: str
    folders: int


class _Reader(DataSourceReader):
    def __init__(self, root: str, kind: str):
        self.root, self.kind = root, kind

    def partitions(self) -> list[Chunk]:
        where = folder(self.root, self.kind)
        starts = bounds(names_in(*where))
        open_, pieces = [bytearray() for _ in range(len(starts) + 1)], [[] for _ in range(len(starts) + 1)]
        for name in names_in(*where):
            i = bisect_right(starts, name)
            open_[i] += b"/" + name.encode()
            if len(open_[i]) > PIECE:
                pieces[i].append(zlib.compress(open_[i][1:]))
                open_[i].clear()
        return [Chunk(own + [zlib.compress(rest[1:])] if rest else own) for own, rest in zip(pieces, open_, strict=True)]

    def read(self, partition: Chunk) -> Iterator[tuple]:
        files, at = folder(self.root, self.kind)
        for name in partition.names():
            with files.open_input_stream(f"{at}/{name}") as stream:
                text = stream.read().decode()
            yield json.loads(text).get("id"), text


class _Writer(DataSourceWriter):
    def __init__(self, root: str, kind: str):
        self.root, self.kind = root, kind
        self.aside = f".writing-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> Written:
        files, at = folder(self.root, self.kind)
        own = f"{self.aside}/{uuid.uuid4().hex}"  # of this attempt: one that is lost leaves no folder that counts
        n = 0
        for n, row in enumerate(rows, 1):
            into = f"{at}/{own}/{(n - 1) // FILES}"
            if n % FILES == 1 or FILES == 1:
                files.create_dir(into)
            with files.open_output_stream(f"{into}/{file_name(row['id'])}") as out:
                out.write(json.dumps(json.loads(row["value"]), indent=2, ensure_ascii=False).encode())
        return Written(own, -(-n // FILES))

    def commit(self, messages: list[Written | None]) -> None:
        files, at = folder(self.root, self.kind)
        for message in filter(None, messages):
            for i in range(message.folders):
                into = f"{at}/{message.own}/{i}"
                for name in list(names_in(files, into)):
                    files.move(f"{into}/{name}", f"{at}/{name}")
        files.create_dir(at)  # of no records, too
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        files, at = folder(self.root, self.kind)
        if files.get_file_info(f"{at}/{self.aside}").type != fs.FileType.NotFound:
            files.delete_dir(f"{at}/{self.aside}")


class RecordFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "record_files"

    def schema(self) -> str:
        return "id string, value string"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], self.options["kind"])

    def writer(self, schema, overwrite: bool) -> _Writer:
        folder(self.options["path"], self.options["kind"])
        return _Writer(self.options["path"], self.options["kind"])


def read(spark: SparkSession, root: str, kind: str, strict: bool = True) -> DataFrame:
    """The records of a kind, in the order of their files; with `strict`, a file that isn't one is an error."""
    spark.dataSource.register(RecordFiles)
    raw = spark.read.format("record_files").option("kind", kind).load(root)
    return raw.select(F.from_json("value", schema(kind), {"mode": "FAILFAST" if strict else "PERMISSIVE"}).alias("r")).select("r.*")


def save(records: DataFrame, root: str, kind: str, order: str = "run_id") -> None:
    """Write records, one file an id; of several with one id, that with the greatest `order` stays, and files that are there are replaced."""
    from ..operators.graph import merge_latest

    records.sparkSession.dataSource.register(RecordFiles)
    once = merge_latest(records, ["id"], order) if order in records.columns else records.dropDuplicates(["id"])
    once.select("id", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.format("record_files").option("kind", kind).mode("append").save(root)


def counts(spark: SparkSession, root: str, kinds: list[str]) -> dict[str, int]:
    """How many records each kind has."""
    spark.dataSource.register(RecordFiles)
    return {k: spark.read.format("record_files").option("kind", k).load(root).count() for k in sorted(kinds)}
