"""ZIP archives of station files as a data source: a partition for every few members, read by their place in the central directory.

The driver reads central directories only. A task opens its archive, goes to the members of its partition, and gives their lines in
bounded batches; a member is read twice, once to learn its encoding and whether it is whole, once for its lines, so that nothing of a damaged
member is given but the reason. What can't be read is a row with ``error``: an archive, or one member of it.

Paths are those of pyarrow's file systems (local, s3://, gs://, hdfs://). For stores that only Spark reads there is ``lines_of_archives``, which
takes archives as binary rows, cuts them into their members' bytes and deals these out.
"""

from __future__ import annotations

import codecs
import io
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "archive string, name string, no int, line string, error string"
#: Bytes of members, unpacked, that make a partition; a larger member is one alone.
PARTITION_BYTES = 8 << 20
#: Lines of a batch, bytes read at once.
LINES, CHUNK = 10_000, 1 << 20
#: What reading a damaged, encrypted or unknown member raises.
UNREADABLE = (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError, OSError, ValueError, struct.error)
LOCAL_HEADER = struct.Struct("<4s5H3I2H")


def _chunks(held) -> Iterator[bytes]:
    while part := held.read(CHUNK):
        yield part


def _encoding(chunks: Iterator[bytes]) -> str:
    """UTF-8 if the whole member is, else Latin-1; reads to the end, where the checksum is compared."""
    decoder, name = codecs.getincrementaldecoder("utf-8")(), "utf-8"
    last = b""
    for last in chunks:
        if name == "utf-8":
            try:
                decoder.decode(last)
            except UnicodeDecodeError:
                name = "latin-1"
    if name == "utf-8":
        try:
            decoder.decode(b"", final=True)
        except UnicodeDecodeError:
            name = "latin-1"
    return name


def _lines(chunks: Iterator[bytes], encoding: str) -> Iterator[str]:
    """Lines as str.splitlines cuts them, with one chunk and the line begun held."""
    decoder, begun = codecs.getincrementaldecoder(encoding)(), ""
    for chunk in chunks:
        text = begun + decoder.decode(chunk)
        # a carriage return at the end may have its line feed in the next chunk
        held = text.splitlines(keepends=True)
        begun = held.pop() if held and (held[-1].splitlines()[0] == held[-1] or held[-1].endswith("\r")) else ""
        for line in held:
            yield line.splitlines()[0]
    yield from (begun + decoder.decode(b"", final=True)).splitlines()


def _batches(archive: str, name: str, opened) -> Iterator[tuple]:
    """Columns of a member's rows; one row with error if it can't be read. ``opened`` gives a new reader of the member's bytes."""
    try:
        with opened() as held:
            encoding = _encoding(_chunks(held))
    except UNREADABLE as e:
        yield [archive], [name], [None], [None], [f"{type(e).__name__}: {e}"]
        return
    with opened() as held:
        no, rows = 0, []
        for line in _lines(_chunks(held), encoding):
            rows.append(line)
            if len(rows) == LINES:
                yield [archive] * LINES, [name] * LINES, list(range(no, no + LINES)), rows, [None] * LINES
                no, rows = no + LINES, []
        if rows:
            yield [archive] * len(rows), [name] * len(rows), list(range(no, no + len(rows))), rows, [None] * len(rows)


def _arrow(columns: tuple):
    import pyarrow as pa

    kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["archive", "name", "no", "line", "error"])


def _wanted(info: zipfile.ZipInfo) -> bool:
    return info.filename.lower().endswith(".csv")


@dataclass
class Members(InputPartition):
    """Members of an archive by their number in the central directory; none and an error if that can't be read."""

    archive: str
    numbers: tuple[int, ...] = ()
    error: str | None = None


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.pattern = options["path"], options.get("pattern", "*.zip")
        self.size = int(options.get("partitionBytes", PARTITION_BYTES))

    def _open(self, path: str):
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        return system, at

    def _archives(self) -> list[str]:
        from pyarrow import fs

        system, at = self._open(self.path)
        if system.get_file_info(at).type == fs.FileType.File:
            return [self.path]
        found = system.get_file_info(fs.FileSelector(at, recursive=True))
        prefix = self.path[: len(self.path) - len(at)] if self.path.endswith(at) else ""
        return sorted(f"{prefix}{f.path}" for f in found if f.type == fs.FileType.File and fnmatch(f.base_name, self.pattern))

    def partitions(self) -> list[InputPartition]:
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(16) as pool:
            return [p for ps in pool.map(self._members, self._archives()) for p in ps] or [Members("")]

    def _members(self, archive: str) -> list[Members]:
        system, at = self._open(archive)
        try:
            with system.open_input_file(at) as f, zipfile.ZipFile(f) as z:
                listed = [(k, i.file_size) for k, i in enumerate(z.infolist()) if _wanted(i)]
        except UNREADABLE as e:
            return [Members(archive, (), f"{type(e).__name__}: {e}")]
        out, held, size = [], [], 0
        for k, n in listed:
            if held and size + n > self.size:
                out, held, size = [*out, Members(archive, tuple(held))], [], 0
            held, size = [*held, k], size + n
        return [*out, Members(archive, tuple(held))] if held else out

    def read(self, partition: Members) -> Iterator:
        if partition.error:
            yield _arrow(([partition.archive], [None], [None], [None], [partition.error]))
        if not partition.numbers:
            return
        system, at = self._open(partition.archive)
        with system.open_input_file(at) as f, zipfile.ZipFile(f) as z:
            listed = z.infolist()
            for k in partition.numbers:
                for columns in _batches(partition.archive, listed[k].filename, lambda k=k: z.open(listed[k])):
                    yield _arrow(columns)


class StationArchives(DataSource):
    """``spark.read.format("station_archives").load(path)``: the lines of the CSV files in all ZIP archives below a path.

    Options: ``pattern`` of the archives' names, ``partitionBytes`` of unpacked members that make a partition.
    """

    @classmethod
    def name(cls) -> str:
        return "station_archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)


def archive_lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """(archive, name, no, line, error): the lines of all CSV files in the ZIP archives below a path; UTF-8, else Latin-1."""
    spark.dataSource.register(StationArchives)
    return spark.read.format("station_archives").options(**options).load(path)


def lines_of_archives(archives: DataFrame) -> DataFrame:
    """The same of archives as rows (path, content), for stores that only Spark reads (``spark.read.format("binaryFile")``).

    One task cuts an archive into its members' packed bytes, without unpacking; the members are then dealt out.
    """

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names, kinds = ["archive", "name", "packed", "error"], [pa.string(), pa.string(), pa.binary(), pa.string()]
        row = lambda *values: pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)
        for b in batches:
            for archive, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    listed = zipfile.ZipFile(io.BytesIO(content or b"")).infolist()
                except UNREADABLE as e:
                    yield row(archive, None, None, f"{type(e).__name__}: {e}")
                    continue
                for info in filter(_wanted, listed):
                    try:
                        yield row(archive, info.filename, _alone(content, info), None)
                    except UNREADABLE as e:
                        yield row(archive, info.filename, None, f"{type(e).__name__}: {e}")

    def unpack(batches: Iterator) -> Iterator:
        for b in batches:
            for archive, name, packed, error in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if error:
                    yield _arrow(([archive], [name], [None], [None], [error]))
                    continue
                with zipfile.ZipFile(io.BytesIO(packed)) as z:
                    for columns in _batches(archive, name, lambda z=z: z.open(z.infolist()[0])):
                        yield _arrow(columns)

    members = archives.select("path", "content").mapInArrow(cut, "archive string, name string, packed binary, error string")
    return members.repartition("archive", "name").mapInArrow(unpack, SCHEMA)


def _alone(content: bytes, info: zipfile.ZipInfo) -> bytes:
    """An archive with this member only, its bytes as they were packed."""
    fields = LOCAL_HEADER.unpack_from(content, info.header_offset)
    if fields[0] != b"PK\x03\x04":
        raise zipfile.BadZipFile("no local header where the directory says")
    begin = info.header_offset + LOCAL_HEADER.size + fields[9] + fields[10]
    name = info.filename.encode("utf-8")
    flags, sizes = info.flag_bits & ~0x8 | 0x800, (info.CRC, info.compress_size, info.file_size)
    if max(sizes[1:]) >= 0xFFFFFFFF:
        raise NotImplementedError("members over 4 GB are read by path")
    head = LOCAL_HEADER.pack(b"PK\x03\x04", info.extract_version, flags, info.compress_type, 0, 0x21, *sizes, len(name), 0) + name
    body = content[begin : begin + info.compress_size]
    entry = struct.pack("<4s6H3I5H2I", b"PK\x01\x02", 20, info.extract_version, flags, info.compress_type, 0, 0x21, *sizes, len(name), 0, 0, 0, 0, 0, 0) + name
    end = struct.pack("<4s4H2IH", b"PK\x05\x06", 0, 0, 1, 1, len(entry), len(head) + len(body), 0)
    return head + body + entry + end


def failures(lines: DataFrame, period: str = r"(\d{4})[^/]*$") -> DataFrame:
    """(period, archive, name, reason) of what couldn't be read; the period stands in the archive's name. Without a name it is the whole archive."""
    bad = lines.where("error is not null").select(F.regexp_extract("archive", period, 1).alias("period"), F.regexp_extract("archive", r"([^/]*)$", 1).alias("archive"), "name", F.col("error").alias("reason"))
    return bad.distinct()


def ledger(lines: DataFrame, expected: DataFrame, period: str = r"(\d{4})[^/]*$") -> DataFrame:
    """The failure ledger: (period, archive, name, state, reason) of expected periods without an archive, archives and members that can't be read.

    ``expected`` has one column of periods. A period whose archive can't be read isn't absent.
    """
    bad = failures(lines, period)
    seen = lines.select(F.regexp_extract("archive", period, 1).alias("period")).distinct()
    absent = expected.select(F.col(expected.columns[0]).cast("string").alias("period")).distinct().join(seen, "period", "left_anti")
    absent = absent.select("period", *[F.lit(None).cast("string").alias(c) for c in ("archive", "name")], F.lit("absent").alias("state"), F.lit("no archive").alias("reason"))
    return absent.unionByName(bad.withColumn("state", F.when(F.col("name").isNull(), "archive").otherwise("member")).select("period", "archive", "name", "state", "reason"))
