"""BAM files by a Python data source. A file is a chain of gzip members; records are unpacked batch by batch into Arrow.

A member cannot be entered in the middle of a record, so a file is one partition; a directory of files is read side by side. For
large single files, convert once to Parquet with ``spark.read.format("helix_bam").load(path).write.parquet(...)``."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from helixloom.sources.schemas import READ

BASES, OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
_NUMBERS = {"c": "b", "C": "B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}


def inflate(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The contents of concatenated gzip members."""
    member, rest = zlib.decompressobj(31), b""
    while data := rest or stream.read(size):
        out = member.decompress(data)
        rest = member.unused_data
        if member.eof:
            member = zlib.decompressobj(31)
        if out:
            yield out


class _Bytes:
    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.buffer, self.at = chunks, b"", 0

    def take(self, n: int) -> bytes:
        while len(self.buffer) - self.at < n:
            more = next(self.chunks, None)
            if more is None:
                return b""
            self.buffer, self.at = self.buffer[self.at :] + more, 0
        self.at += n
        return self.buffer[self.at - n : self.at]

    def number(self) -> int:
        return struct.unpack("<i", self.take(4))[0]


def _tags(data: bytes, at: int) -> dict[str, str]:
    out = {}
    while at < len(data):
        name, kind, at = data[at : at + 2].decode(), chr(data[at + 2]), at + 3
        if kind == "A":
            value, at = chr(data[at]), at + 1
        elif kind in "ZH":
            end = data.index(0, at)
            value, at = data[at:end].decode(), end + 1
        elif kind == "B":
            each, n = _NUMBERS[chr(data[at])], struct.unpack_from("<i", data, at + 1)[0]
            width = struct.calcsize(each)
            value = ",".join([chr(data[at]), *(f"{x:g}" for (x,) in struct.iter_unpack(each, data[at + 5 : at + 5 + n * width]))])
            at += 5 + n * width
        else:
            (value,), at = struct.unpack_from(_NUMBERS[kind], data, at), at + struct.calcsize(_NUMBERS[kind])
        out[name] = str(value)
    return out


def records(stream) -> Iterator[tuple]:
    """Rows of READ from an open BAM stream."""
    b = _Bytes(inflate(stream))
    if b.take(4) != b"BAM\x01":
        raise ValueError("not a BAM file")
    b.take(b.number())
    contigs = []
    for _ in range(b.number()):
        contigs.append(b.take(b.number())[:-1].decode())
        b.take(4)
    name = lambda i: contigs[i] if i >= 0 else None
    while head := b.take(4):
        data = b.take(struct.unpack("<i", head)[0])
        ref, pos, l_name, mq, _, n_op, flag, l_seq, next_ref, next_pos, tlen = struct.unpack_from("<iiBBHHHiiii", data)
        at = 32 + l_name
        cigar = "".join(f"{x >> 4}{OPS[x & 15]}" for x in struct.unpack_from(f"<{n_op}I", data, at)) or None
        at += 4 * n_op
        packed = data[at : at + (l_seq + 1) // 2]
        seq = "".join(BASES[x >> 4] + BASES[x & 15] for x in packed)[:l_seq] or None
        at += len(packed)
        qual = None if not l_seq or data[at] == 255 else bytes(x + 33 for x in data[at : at + l_seq]).decode()
        yield (data[32 : 31 + l_name].decode(), flag, name(ref), pos, mq, cigar, name(next_ref), next_pos, tlen, seq, qual, _tags(data, at + l_seq))


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "helix_bam"

    def schema(self) -> str:
        return READ

    def reader(self, schema) -> DataSourceReader:
        return BamReader(self.options["path"])


class BamReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def _files(self):
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        info = system.get_file_info(at)
        if info.type == fs.FileType.Directory:
            return system, sorted(f.path for f in system.get_file_info(fs.FileSelector(at)) if f.path.endswith(".bam"))
        return system, [at]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self._files()[1]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        system, _ = self._files()
        with system.open_input_stream(partition.value, compression=None) as stream:
            yield from records(stream)


def bam(spark: SparkSession, path: str):
    spark.dataSource.register(BamSource)
    return spark.read.format("helix_bam").load(path)
