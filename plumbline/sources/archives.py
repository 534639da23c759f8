"""Members of archives as a partitioned source of lines.

A partition is one member, or a range of one that lies uncompressed in its
archive, so an archive of any size is read by as many tasks as it has members
and ranges.  Only directories are read to plan: a zip's at its end, a tar's
headers.  Members are streamed; no task holds one.
"""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

#: Bytes of an uncompressed member that one task reads, and of lines in one batch.
SPLIT, BATCH = 64 << 20, 4 << 20
SCHEMA = "archive string, member string, start long, line string"


@dataclass
class Part(InputPartition):
    """A range of an archive's bytes, or (stop None) a whole compressed member."""

    archive: str
    member: str
    start: int
    stop: int | None
    base: int = 0
    size: int = 0

    def __init__(self, archive, member, start, stop, base=0, size=0):
        super().__init__((archive, member, start))
        self.archive, self.member, self.start, self.stop, self.base, self.size = archive, member, start, stop, base, size


def _open(path: str):
    system, at = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    return system.open_input_file(at)


def _listed(path: str) -> list[str]:
    """The archives at a path: itself, or those of a folder by name."""
    system, at = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    info = system.get_file_info(at)
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    if info.type == fs.FileType.Directory:
        found = system.get_file_info(fs.FileSelector(at, recursive=True))
        return sorted(prefix + f.path for f in found if f.type == fs.FileType.File and f.path.lower().endswith((".zip", ".tar", ".tar.gz", ".tgz")))
    return [path]


def _members(path: str) -> Iterator[tuple[str, int | None, int]]:
    """(name, where its bytes lie if they are plain, size) of an archive's files."""
    with _open(path) as raw:
        if path.lower().endswith(".zip"):
            for m in zipfile.ZipFile(raw).infolist():
                if not m.is_dir():
                    at = None
                    if m.compress_type == zipfile.ZIP_STORED and not m.flag_bits & 1:
                        raw.seek(m.header_offset + 26)
                        name, extra = (int.from_bytes(raw.read(2), "little") for _ in range(2))
                        at = m.header_offset + 30 + name + extra
                    yield m.filename, at, m.file_size
        else:
            plain = path.lower().endswith(".tar")
            with tarfile.open(fileobj=raw, mode="r:" if plain else "r|gz") as t:
                for m in t:
                    if m.isfile():
                        yield m.name, m.offset_data if plain and not m.issparse() else None, m.size


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.pattern, self.split = options["path"], options.get("pattern", "*"), int(options.get("split", SPLIT))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Conditions on archive and member leave partitions out; Spark still tests all."""
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith)) and f.attribute in (("member",), ("archive",)):
                self.filters.append(f)
            yield f

    def _wanted(self, archive: str, member: str) -> bool:
        for f in self.filters:
            have = member if f.attribute == ("member",) else archive
            if isinstance(f, EqualTo) and have != f.value or isinstance(f, In) and have not in f.value or isinstance(f, StringStartsWith) and not have.startswith(f.value):
                return False
        return fnmatch(member, self.pattern)

    def partitions(self) -> list[InputPartition]:
        out = []
        for archive in _listed(self.path):
            for member, at, size in _members(archive):
                if self._wanted(archive, member):
                    if at is None:
                        out.append(Part(archive, member, 0, None))
                    else:
                        out += [Part(archive, member, a, min(a + self.split, size), at, size) for a in range(0, max(size, 1), self.split)]
        return out or [Part("", "", 0, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        lines, starts, size = [], [], 0
        for start, line in _lines(partition):
            lines.append(line.decode("utf-8", "replace").rstrip("\r"))
            starts.append(start)
            size += len(line)
            if size >= BATCH:
                yield _batch(partition, starts, lines)
                lines, starts, size = [], [], 0
        if lines:
            yield _batch(partition, starts, lines)


def _batch(p: Part, starts: list[int], lines: list[str]) -> pa.RecordBatch:
    n = len(lines)
    return pa.RecordBatch.from_arrays([pa.array([p.archive] * n), pa.array([p.member] * n), pa.array(starts, pa.int64()), pa.array(lines, pa.string())], ["archive", "member", "start", "line"])


def _lines(p: Part) -> Iterator[tuple[int, bytes]]:
    """(first byte in the member, line) of the lines that begin in a part, without their ends."""
    with _open(p.archive) as raw:
        if p.stop is None:
            if p.archive.lower().endswith(".zip"):
                with zipfile.ZipFile(raw).open(p.member) as f:
                    yield from _split(f, 0, None)
                return
            with tarfile.open(fileobj=raw, mode="r|gz") as t:
                for m in t:
                    if m.name == p.member and m.isfile():
                        yield from _split(t.extractfile(m), 0, None)
                        return
            return
        # a line belongs to the part in which it begins: one that begins before this part is skipped
        begin = p.start
        raw.seek(p.base + max(0, begin - 1))
        f = io.BufferedReader(_Limited(raw, p.size - max(0, begin - 1)), 1 << 20)
        if begin:
            begin += len(f.readline()) - 1
        yield from _split(f, begin, p.stop)


def _split(f, at: int, stop: int | None) -> Iterator[tuple[int, bytes]]:
    while stop is None or at < stop:
        line = f.readline()
        if not line:
            return
        yield at, line.removesuffix(b"\n")
        at += len(line)


class _Limited(io.RawIOBase):
    """The next so many bytes of a file."""

    def __init__(self, raw, size: int):
        self.raw, self.left = raw, size

    def readable(self) -> bool:
        return True

    def readinto(self, b) -> int:
        got = self.raw.read(min(len(b), self.left)) if self.left > 0 else b""
        b[: len(got)] = got
        self.left -= len(got)
        return len(got)


class ArchiveSource(DataSource):
    """spark.read.format("archive").load(path): (archive, member, start, line); options pattern (of members) and split (bytes)."""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(dict(self.options))


def archive_lines(spark: SparkSession, path: str, pattern: str = "*", split: int = SPLIT) -> DataFrame:
    """(archive, member, start, line) of the members that match, by their names in the archives at a path that driver and executors can open."""
    spark.dataSource.register(ArchiveSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("archive").option("pattern", pattern).option("split", str(split)).load(path)


def records_of(lines: DataFrame, schema: str, keep: DataFrame | None = None, key: str = "user_id") -> DataFrame:
    """JSON lines as columns; keep: only those whose key is in it, found out from the key alone before a record is parsed whole.

    Keys are few next to lines, but not bounded, so the join is left to Spark's own sizes.
    """
    d = lines if keep is None else lines.withColumn("_key", F.get_json_object("line", f"$.{key}"))
    if keep is not None:
        d = d.join(keep.select(F.col(key).cast("string").alias("_key")).distinct(), "_key", "left_semi")
    return d.select("archive", "member", F.from_json("line", schema).alias("x")).where("x IS NOT NULL").select("archive", "member", "x.*")
