"""Sequence files as a data source of Spark: spark.read.format("fastx").load(path).

Partitions are planned from the sizes of files.  Plain files are cut at any byte, and
blocked gzip files at any block; each partition begins with the first record whose line
starts inside it.  Other compressed files are read by one task each.
"""

from __future__ import annotations

import fnmatch
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .fastx import LOOKED_AT, first_record

SCHEMA = "sample_id string, seq_id string, sequence string, qual string"
#: Bytes of a partition, of a read, and of sequence that make up a batch.
SPLIT, STEP, BATCH = 32 << 20, 1 << 20, 4 << 20
#: Endings of file names, without that of gzip, and the start of a block of blocked gzip.
FASTQ, FASTA = (".fq", ".fastq"), (".fa", ".fasta", ".fna")
BLOCK, SIZE_TAG = b"\x1f\x8b\x08\x04", b"BC\x02\x00"
END = 1 << 62


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if re.match(r"^[a-z0-9+.-]+:/", path) else (pafs.LocalFileSystem(), path)


def _listed(path: str) -> list[tuple[str, int]]:
    """(path, size) of the files of a folder, a pattern, or one file, with the path in the form given."""
    top = re.split(r"[*?\[]", path)[0].rpartition("/")[0] if re.search(r"[*?\[]", path) else path
    fs, base = _opened(top)
    form, plain = top[: len(top) - len(base)] if top.endswith(base) else "", base + path[len(top) :]
    info = fs.get_file_info(base)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    files = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(base, recursive=True))
    found = sorted((f.path, f.size) for f in files if f.is_file and (base == plain or fnmatch.fnmatch(f.path, plain)) and not f.base_name.startswith(("_", ".")))
    return [(form + p, n) for p, n in found]


def _kind(path: str) -> str:
    name = path.lower().removesuffix(".gz")
    if name.endswith(FASTQ):
        return "fastq"
    if name.endswith(FASTA):
        return "fasta"
    raise ValueError(f"unknown kind of sequence file: {path}")


def _block_size(head: bytes) -> int:
    """The size of the block of blocked gzip that begins with these 18 bytes, 0 if none does."""
    at = head[:4] == BLOCK and head[12:16] == SIZE_TAG
    return int.from_bytes(head[16:18], "little") + 1 if at and len(head) == 18 else 0


@dataclass
class Part(InputPartition):
    path: str
    start: int
    end: int
    blocked: bool


def _pieces(file: pa.NativeFile, part: Part) -> Iterator[tuple[int | None, bytes]]:
    """Text from a partition's start to the end of the file, in pieces; of blocked gzip with the place of the block."""
    if not part.path.lower().endswith(".gz"):
        file.seek(part.start)
        while piece := file.read(STEP):
            yield None, piece
    elif part.blocked:
        at, size = part.start, file.size()
        if at:  # a block starts where its size leads to another one, or to the end
            while at < size:
                file.seek(at)
                window = file.read(STEP + 18)
                places = (m.start() for m in re.finditer(re.escape(BLOCK), window[:STEP + 3]))
                found = next((p for p in places if (n := _block_size(window[p : p + 18])) and _leads_on(file, at + p + n, size)), None)
                if found is not None:
                    at += found
                    break
                at += STEP
        while at < size:
            file.seek(at)
            n = _block_size(file.read(18))
            if not n:
                raise ValueError(f"{part.path}: no block at {at}")
            file.seek(at)
            yield at, zlib.decompress(file.read(n), 31)
            at += n
    else:
        unzip = zlib.decompressobj(31)
        while piece := file.read(STEP):
            while piece:
                yield 0, unzip.decompress(piece)
                piece = unzip.unused_data
                if unzip.eof:  # the next member
                    unzip = zlib.decompressobj(31)


def _leads_on(file: pa.NativeFile, at: int, size: int) -> bool:
    file.seek(min(at, size))
    return at == size or bool(_block_size(file.read(18)))


def _lines(file: pa.NativeFile, part: Part) -> Iterator[tuple[int, str]]:
    """Lines, each with the place of the line feed before it: its byte, or the start of its block; -1 at the start of a file."""
    mark, rest, skip, at = -1, b"", part.start > 0, part.start
    for place, piece in _pieces(file, part):
        *whole, last = piece.split(b"\n")
        for line in whole:
            if not skip:
                yield mark, (rest + line).rstrip(b"\r").decode()
            at += len(line)
            mark, rest, skip = at if place is None else place, b"", False
            at += 1
        rest += last
        at += len(last)
    if rest and not skip:
        yield mark, rest.rstrip(b"\r").decode()


def _fasta(lines: Iterator[tuple[int, str]], part: Part) -> Iterator[tuple[str, str, None]]:
    head, seq = None, []
    for mark, line in lines:
        if line.startswith(">"):
            if head is not None:
                yield head, "".join(seq), None
            head, seq = None, []
            if mark >= part.end:
                return
            head = line[1:]
        elif head is None and mark >= part.end:
            return
        elif head is not None:
            seq.append("".join(line.split()))
    if head is not None:
        yield head, "".join(seq), None


def _fastq(lines: Iterator[tuple[int, str]], part: Part) -> Iterator[tuple[str, str, str]]:
    given = ((mark, line.strip()) for mark, line in lines if line.strip())
    first = []
    for x in given if part.start else ():
        first.append(x)
        if len(first) == LOOKED_AT:
            break
    held = first[first_record([line for _, line in first]) :]
    while True:
        while len(held) < 4 and (x := next(given, None)):
            held.append(x)
        if not held or held[0][0] >= part.end:
            return
        own, held = [line for _, line in held[:4]], held[4:]
        own += [""] * (4 - len(own))
        yield own[0].removeprefix("@"), own[1], own[3]


class FastxReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.names = [f.name for f in schema.fields]
        if unknown := set(self.names) - {x.split()[0] for x in SCHEMA.split(", ")}:
            raise ValueError(f"no such columns: {sorted(unknown)}")
        if "path" not in options:
            raise ValueError("fastx needs a path")
        self.paths, self.split = options["path"].split(","), int(options.get("splitbytes", options.get("splitBytes", SPLIT)))

    def partitions(self) -> list[Part]:
        out = []
        for path, size in (x for p in self.paths for x in _listed(p.strip())):
            _kind(path)
            blocked = False
            if path.lower().endswith(".gz"):
                fs, plain = _opened(path)
                with fs.open_input_file(plain) as f:
                    blocked = bool(_block_size(f.read(18)))
            starts = range(0, max(1, size), self.split) if blocked or not path.lower().endswith(".gz") else range(1)
            out += [Part(path, a, a + self.split if a + self.split < size and len(starts) > 1 else END, blocked) for a in starts]
        return out

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        fs, plain = _opened(partition.path)
        stem = re.sub(r"\.gz$", "", partition.path.rpartition("/")[2])
        make = _fastq if _kind(partition.path) == "fastq" else _fasta
        rows: list[tuple] = []

        def given() -> pa.RecordBatch:
            made = {"sample_id": lambda: [stem] * len(rows), "seq_id": lambda: [r[0].split(None, 1)[0] if r[0][:1].strip() else "" for r in rows], "sequence": lambda: [r[1].upper() for r in rows], "qual": lambda: [r[2] for r in rows]}
            return pa.RecordBatch.from_arrays([pa.array(made[c](), pa.string()) for c in self.names], names=self.names)

        with fs.open_input_file(plain) as f:
            size = 0
            for row in make(_lines(f, partition), partition):
                rows.append(row)
                size += len(row[1]) + 64
                if size >= BATCH:
                    yield given()
                    rows, size = [], 0
            if rows:
                yield given()


class FastxSource(DataSource):
    """FASTA and FASTQ files: a path, or several with commas, of files, folders or patterns, in any file system that Arrow knows.

    Options: splitBytes, the bytes of a partition.  A schema of some of the columns makes
    those alone.  Endings tell the kinds of files; blank lines of FASTQ don't count.
    """

    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FastxReader:
        return FastxReader(self.options, schema)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(FastxSource)
