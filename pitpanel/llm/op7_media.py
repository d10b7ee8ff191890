"""Media columns in archives, read by a custom Spark data source.

``write_archives`` turns each text's UTF-8 bytes, padded with zeros to rows of 64, into
a lossless 8-bit greyscale PNG and appends it to a tar archive; every task writes its own
archives into one directory of the shared storage, and beside each an index of its
members (id, offset, length, checksum). An archive appears under its name, which tells the
number of its members, only when it is whole; a repeated task leaves what is there.

``ArchiveSource`` plans partitions as byte ranges of the archives in a directory: from
the list of files alone, so the plan doesn't grow with the members. The numbers of members
have to add up to what was written, so no lost archive goes unnoticed. A partition reads
those members whose offset lies in its range and streams them in Arrow batches of bounded
size. Each member is read by its own offset and checked; a failure reopens the file and
tries that member again, and only that one.

``features`` decodes the stored samples and describes them.

Defined results: a null text is an empty one, of one row of zeros; ids can be null or
repeated, each row is a member of its own; an empty table gives no archive and no rows;
other columns are left out. Equal texts have equal files, checksums and features. A text of
any length is one member, and is held whole, with its samples, while it is written or read.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import time
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pitpanel.llm.common import id_and_text, new_path

ROW = 64
#: An archive is closed beyond so many bytes; a partition reads so many; a batch holds so many.
ARCHIVE_BYTES = 256_000_000
RANGE_BYTES = 16_000_000
BATCH_BYTES = 8_000_000
TRIES = 4
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def png_chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(raw: bytes) -> bytes:
    """A greyscale PNG, ROW samples wide, of bytes padded to a positive multiple of ROW."""
    rows = max(1, -(-len(raw) // ROW))
    samples = np.zeros((rows, ROW), np.uint8)
    samples.reshape(-1)[: len(raw)] = np.frombuffer(raw, np.uint8)
    lines = np.zeros((rows, ROW + 1), np.uint8)  # each line begins with filter type 0
    lines[:, 1:] = samples
    head = struct.pack(">IIBBBBB", ROW, rows, 8, 0, 0, 0, 0)
    note = b"n_bytes\0" + str(len(raw)).encode()
    return SIGNATURE + png_chunk(b"IHDR", head) + png_chunk(b"tEXt", note) + png_chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + png_chunk(b"IEND", b"")


def decode_png(media: bytes) -> tuple[bytes, int]:
    """The samples of such a PNG and the number of bytes before padding."""
    if media[:8] != SIGNATURE:
        raise ValueError("no PNG")
    at, parts, width, n = 8, [], 0, 0
    while at < len(media):
        (size,) = struct.unpack_from(">I", media, at)
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(kind + data):
            raise ValueError("a PNG chunk is damaged")
        if kind == b"IHDR":
            (width,) = struct.unpack_from(">I", data)
        elif kind == b"tEXt":
            n = int(data.partition(b"\0")[2])
        elif kind == b"IDAT":
            parts.append(data)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(-1, width + 1)
    return lines[:, 1:].tobytes(), n


class ArchiveWriter:
    """One tar archive and its index, written aside and then moved to their names."""

    def __init__(self, folder: str, name: str, aside: str):
        self.fs, self.root = pafs.FileSystem.from_uri(folder)
        self.name, self.aside = name, f"{self.root}/_{name}-{aside}"
        self.fs.create_dir(self.root, recursive=True)
        self.out = self.fs.open_output_stream(f"{self.aside}.tar")
        self.size, self.rows = 0, []

    def add(self, media: bytes) -> None:
        info = tarfile.TarInfo(f"{self.name}/{len(self.rows):08d}.png")
        info.size = len(media)
        head = info.tobuf(tarfile.GNU_FORMAT)
        self.rows.append((self.size + len(head), len(media), zlib.crc32(media)))
        body = head + media + bytes(-len(media) % 512)
        self.out.write(body)
        self.size += len(body)

    def close(self, ids: pa.Array) -> None:
        self.out.write(bytes(1024))
        self.out.close()
        index = pa.table([ids, *(pa.array([r[k] for r in self.rows], pa.int64()) for k in range(3))], names=["doc_id", "offset", "length", "crc"])
        with self.fs.open_output_stream(f"{self.aside}.idx") as out, pa.ipc.new_file(out, index.schema) as sink:
            sink.write_table(index)
        for kind in ("idx", "tar"):  # the archive last: a reader sees it only with its index
            to = f"{self.root}/{self.name}-{len(self.rows)}.{kind}"
            # Another attempt at this task has written the same bytes: they stay, ours go.
            if self.fs.get_file_info(to).type == pafs.FileType.NotFound:
                self.fs.move(f"{self.aside}.{kind}", to)
            else:
                self.fs.delete_file(f"{self.aside}.{kind}")


def write_archives(docs: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> tuple[int, int]:
    """Write ``doc_id, text`` rows to archives in ``folder``; numbers of archives and members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, writer, held = TaskContext.get(), 0, None, []
        done = []

        def close() -> None:
            writer.close(pa.concat_arrays(held))
            done.append(len(writer.rows))

        for batch in batches:
            ids, begin = batch.column(0), 0
            for k, text in enumerate(batch.column(1)):
                if writer is None:
                    writer = ArchiveWriter(folder, f"part-{task.partitionId():06d}-{number:04d}", str(task.taskAttemptId()))
                    number += 1
                writer.add(encode_png((text.as_py() or "").encode()))
                if writer.size > archive_bytes:
                    held.append(ids.slice(begin, k + 1 - begin))
                    close()
                    writer, held, begin = None, [], k + 1
            if writer is not None and begin < len(ids):
                held.append(ids.slice(begin))
        if writer is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([len(done)], pa.int64()), pa.array([sum(done)], pa.int64())], names=["archives", "members"])

    made = docs.mapInArrow(run, "archives bigint, members bigint").agg(F.sum("archives"), F.sum("members")).first()
    fs, root = pafs.FileSystem.from_uri(folder)
    for info in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
        if info.base_name.startswith("_"):  # of attempts that failed
            fs.delete_file(info.path)
    return made[0] or 0, made[1] or 0


class ByteRange(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


class MemberReader:
    """Reads members of one archive by offset, each with tries of its own."""

    def __init__(self, fs: pafs.FileSystem, path: str, tries: int):
        self.fs, self.path, self.tries, self.file = fs, path, tries, None

    def read(self, offset: int, length: int, crc: int) -> bytes:
        for k in range(self.tries):
            try:
                if self.file is None:
                    self.file = self.fs.open_input_file(self.path)
                data = self.file.read_at(length, offset)
                if len(data) == length and zlib.crc32(data) == crc:
                    return data
                why = "its checksum differs"
            except OSError as e:
                why = str(e)
            self.file = None
            time.sleep(0.05 * 2**k)
        raise OSError(f"member at {offset} of {self.path} can't be read: {why}")


def members_of(path: str) -> int:
    """How many members an archive has, by its name."""
    return int(path.removesuffix(".tar").rpartition("-")[2])


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.batch_bytes = int(options.get("batchbytes", BATCH_BYTES))
        self.tries = int(options.get("tries", TRIES))
        self.members = options.get("members")
        self.names = [f.name for f in schema]

    def partitions(self) -> list[InputPartition]:
        fs, root = pafs.FileSystem.from_uri(self.folder)
        out, members = [], 0
        for info in sorted(fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)), key=lambda x: x.path):
            if info.base_name.endswith(".tar") and not info.base_name.startswith("_"):
                out += [ByteRange(info.path, at, at + self.range_bytes) for at in range(0, info.size, self.range_bytes)]
                members += members_of(info.path)
        if self.members is not None and members != int(self.members):
            raise OSError(f"the archives in {self.folder} have {members} members and not {self.members}")
        return out or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = pafs.FileSystem.from_uri(self.folder)
        with fs.open_input_file(f"{partition.path[:-4]}.idx") as source:
            index = pa.ipc.open_file(source).read_all()
        if len(index) != members_of(partition.path):
            raise OSError(f"the index of {partition.path} has {len(index)} members")
        offsets = index.column("offset").to_numpy()
        first, last = np.searchsorted(offsets, [partition.start, partition.end])
        rows = index.slice(first, last - first).combine_chunks()
        reader = MemberReader(fs, partition.path, self.tries)
        begin, held, size = 0, [], 0

        def batch(end: int) -> pa.RecordBatch:
            part = rows.slice(begin, end - begin)
            ids = part.column("doc_id").combine_chunks()
            ids = ids if isinstance(ids, pa.Array) else pa.concat_arrays(ids.chunks)
            where = pa.array([partition.path] * len(part))
            at = pa.array(part.column("offset").to_numpy(), pa.int64())
            return pa.RecordBatch.from_arrays([ids, where, at, pa.array(held, pa.binary())], names=["doc_id", "archive", "offset", "media"])

        members = zip(*(rows.column(c).to_pylist() for c in ("offset", "length", "crc")))
        for k, (offset, length, crc) in enumerate(members):
            held.append(reader.read(offset, length, crc))
            size += length
            if size >= self.batch_bytes:
                yield batch(k + 1)
                begin, held, size = k + 1, [], 0
        if held:
            yield batch(len(rows))


class ArchiveSource(DataSource):
    """``spark.read.format("png_archive").schema(...).load(folder)``: the members of a directory."""

    @classmethod
    def name(cls) -> str:
        return "png_archive"

    def schema(self) -> str:
        return "doc_id bigint, archive string, offset bigint, media binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options, schema)


def read_archives(spark: SparkSession, folder: str, id_type: str = "bigint", **options) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("png_archive").schema(f"doc_id {id_type}, archive string, offset bigint, media binary").options(**options).load(folder)


def describe(samples: bytes) -> str:
    """Sum, sum of squares, sum of steps, peak, and counts in four ranges of the samples."""
    x = np.frombuffer(samples, np.uint8)
    wide = x.astype(np.int64)
    parts = [wide.sum(), (wide * wide).sum(), np.abs(np.diff(wide)).sum(), wide.max(), *np.bincount(x >> 6, minlength=4)]
    return "-".join(map(str, map(int, parts)))


def features(media: DataFrame) -> DataFrame:
    """What is stored, decoded and described: a row for each row with a column media."""
    kind = media.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def one(stored: bytes) -> tuple:
        payload, n = decode_png(stored)
        return (
            n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]),
            len(stored), hashlib.sha256(stored).hexdigest(), describe(payload),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], names=names)

    return media.select("doc_id", "media").mapInArrow(run, schema)


def store_and_describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Store every text in archives of the shared folder, read them back, and describe them."""
    docs = id_and_text(docs, id_col, text_col)
    folder = folder or new_path(docs.sparkSession, "media")
    _, members = write_archives(docs, folder)
    return features(read_archives(docs.sparkSession, folder, docs.schema["doc_id"].dataType.simpleString(), members=str(members)))


def tar_members(data: bytes) -> list[bytes]:
    """The members of an archive by the standard library, for tests."""
    with tarfile.open(fileobj=io.BytesIO(data)) as tar:
        return [tar.extractfile(m).read() for m in tar.getmembers()]
