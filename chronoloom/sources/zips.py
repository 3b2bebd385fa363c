"""A sink for ZIP archives: every task writes a member of its own, the commit joins them into one archive.

``register`` it, then ``df.write.format("zip_csv").option("name", "features").mode("overwrite").save(folder)``: the archive is ``folder/features.zip`` with
members ``features-00000.csv`` ... in the order of partitions, each a CSV with a header that ``readers.read_table`` reads back. A task compresses its rows as a
part file beside it; commit copies the compressed parts, as they are, behind each other and moves the archive to its place last; abort leaves the
old archive and no parts. Folders are paths that driver and executors share.
"""

from __future__ import annotations

import csv
import io
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes of text that a task compresses at a time.
PIECE = 1 << 20
# The ZIP format's headers (with 64-bit sizes), for members that are compressed by deflate.
_LOCAL, _CENTRAL, _END64, _LOCATE64, _END = b"PK\x03\x04", b"PK\x01\x02", b"PK\x06\x06", b"PK\x06\x07", b"PK\x05\x06"
_DATE = (44 << 9) | (1 << 5) | 1


@dataclass
class Part(WriterCommitMessage):
    """A task's compressed part."""

    partition: int
    path: str
    rows: int
    crc: int
    size: int
    packed: int


def _text(value: Any) -> Any:
    if value is None:
        return ""
    return value.isoformat(sep=" ") if hasattr(value, "isoformat") else str(value).lower() if isinstance(value, bool) else value


class ZipWriter(DataSourceWriter):
    def __init__(self, folder: str, name: str, schema: StructType, overwrite: bool) -> None:
        self.folder, self.name, self.columns, self.overwrite = folder.removeprefix("file://").removeprefix("file:"), name, schema.names, overwrite
        self.target = os.path.join(self.folder, f"{name}.zip")
        self.parts = os.path.join(self.folder, f".{name}-{uuid.uuid4().hex}")
        if os.path.exists(self.target) and not overwrite:
            raise FileExistsError(self.target)

    def write(self, iterator: Iterator[Any]) -> Part:
        from pyspark import TaskContext

        context = TaskContext.get()
        os.makedirs(self.parts, exist_ok=True)
        path = os.path.join(self.parts, f"{context.partitionId():05d}-{context.taskAttemptId()}")
        packer, buffer, crc, size, packed, rows = zlib.compressobj(6, zlib.DEFLATED, -15), io.StringIO(), 0, 0, 0, 0
        lines = csv.writer(buffer)
        lines.writerow(self.columns)
        with open(path, "wb") as out:

            def flush() -> None:
                nonlocal crc, size, packed
                raw = buffer.getvalue().encode()
                buffer.seek(0)
                buffer.truncate()
                crc, size = zlib.crc32(raw, crc), size + len(raw)
                packed += out.write(packer.compress(raw))

            for row in iterator:
                lines.writerow(map(_text, row))
                rows += 1
                if buffer.tell() > PIECE:
                    flush()
            flush()
            packed += out.write(packer.flush())
        return Part(context.partitionId(), path, rows, crc, size, packed)

    def _members(self, messages: list[Part | None]) -> list[tuple[bytes, Part]]:
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        some = [p for p in parts if p.rows] or parts[:1]
        return [(f"{self.name}-{k:05d}.csv".encode(), p) for k, p in enumerate(some)]

    def commit(self, messages: list[Part | None]) -> None:
        os.makedirs(self.folder, exist_ok=True)
        new, index = f"{self.parts}.zip", []
        with open(new, "wb") as out:
            for name, p in self._members(messages):
                at = out.tell()
                sizes = struct.pack("<HHQQ", 1, 16, p.size, p.packed)
                out.write(_LOCAL + struct.pack("<HHHHHIIIHH", 45, 0x800, 8, 0, _DATE, p.crc, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(sizes)) + name + sizes)
                with open(p.path, "rb") as part:
                    while piece := part.read(PIECE):
                        out.write(piece)
                far = struct.pack("<HHQQQ", 1, 24, p.size, p.packed, at)
                index.append(_CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0x800, 8, 0, _DATE, p.crc, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(far), 0, 0, 0, 0, 0xFFFFFFFF) + name + far)
            start = out.tell()
            out.writelines(index)
            end = out.tell()
            out.write(_END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, len(index), len(index), end - start, start))
            out.write(_LOCATE64 + struct.pack("<IQI", 0, end, 1))
            out.write(_END + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))
        os.replace(new, self.target)
        self._clean()

    def abort(self, messages: list[Part | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        for left in [os.path.join(self.parts, f) for f in (os.listdir(self.parts) if os.path.isdir(self.parts) else ())] + [f"{self.parts}.zip"]:
            if os.path.exists(left):
                os.remove(left)
        if os.path.isdir(self.parts):
            os.rmdir(self.parts)


class ZipSource(DataSource):
    """Write only; options: ``path`` (a folder), ``name`` (of the archive and its members)."""

    @classmethod
    def name(cls) -> str:
        return "zip_csv"

    def writer(self, schema: StructType, overwrite: bool) -> ZipWriter:
        return ZipWriter(self.options["path"], self.options.get("name", "table"), schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ZipSource)
