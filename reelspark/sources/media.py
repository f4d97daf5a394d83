"""Frames of WAV files that may be larger than a task: a data source that deals byte ranges of files."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from reelspark.sources.blobs import FRAME
from reelspark.sources.publish import opened

FRAMES = "key string, frame_no bigint, samples bigint, content binary"
_FRAMES = pa.schema([("key", pa.string()), ("frame_no", pa.int64()), ("samples", pa.int64()), ("content", pa.binary())])

#: Frames that are read at a time, 640 KB, and returned at a time, at most twice as many.
BLOCK = 1024


def sound_data(file: BinaryIO, size: int) -> tuple[int, int] | None:
    """Start and length in bytes of the samples of a WAV file of 16 kHz, one channel, 16 bits, uncompressed,
    found by walking its chunks; None for other files and for ones without a whole sample. A data chunk that
    promises more than the file has ends with the file."""
    if size < 12:
        return None
    riff, _, wave = struct.unpack("<4sI4s", file.read(12))
    if (riff, wave) != (b"RIFF", b"WAVE"):
        return None
    at, right = 12, False
    while at + 8 <= size:
        file.seek(at)
        name, length = struct.unpack("<4sI", file.read(8))
        if name == b"fmt " and min(length, size - at - 8) >= 16:
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", file.read(16))
            right = (kind, channels, rate, bits) == (1, 1, 16_000, 16)
        elif name == b"data":
            samples = min(length, size - at - 8) // 2
            return (at + 8, 2 * samples) if right and samples else None
        at += 8 + length + (length & 1)
    return None


@dataclass
class Ranges(InputPartition):
    """(path, size, first byte, byte behind the last) of the stretches of one task."""

    pieces: list[tuple[str, int, int, int]]


#: Tasks that a folder is dealt to, unless a task would have more than MOST bytes, or less than a range.
TASKS = 256
MOST = 64 << 20


class RangeReader(DataSourceReader):
    def __init__(self, folder: str, split: int) -> None:
        self.folder, self.split = folder, split

    def partitions(self) -> list[Ranges]:
        """Stretches of ranges of ``split`` bytes, as many in a task as TASKS and MOST tell; small files share a task."""
        fs, root = opened(self.folder)
        found = sorted((f.path, f.size) for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_")))
        most = max(self.split, min(MOST, sum(size for _, size in found) // TASKS))
        out: list[Ranges] = []
        room = 0
        for path, size in found:
            lo = 0
            while lo < size:
                if room < min(self.split, size - lo):
                    out.append(Ranges([]))
                    room = most
                hi = size if size - lo <= room else lo + room // self.split * self.split
                out[-1].pieces.append((path, size, lo, hi))
                room -= hi - lo
                lo = hi
        return out or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        """A frame belongs to the range that has its first byte, and is read whole from there."""
        fs, root = opened(self.folder)
        step = 2 * FRAME
        rows: list[tuple[str, int, int, bytes]] = []

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _FRAMES.types, strict=True)], schema=_FRAMES)

        for path, size, begin, end in partition.pieces:
            key = path[len(root.rstrip("/")) + 1 :]
            with fs.open_input_file(path) as file:
                span = sound_data(file, size)
                if span is None:
                    continue
                start, length = span
                for lo in range(begin, end, self.split):
                    first, behind = (max(0, -((start - x) // step)) for x in (lo, min(end, lo + self.split)))
                    behind = min(behind, -(-length // step))
                    for at in range(first, behind, BLOCK):
                        file.seek(start + at * step)
                        data = file.read(min(min(BLOCK, behind - at) * step, length - at * step))
                        for k in range(0, len(data), step):
                            content = data[k : k + step]
                            rows.append((key, at + k // step, len(content) // 2, content))
                        if len(rows) >= BLOCK:
                            yield told()
                            rows.clear()
        if rows:
            yield told()


class WavRanges(DataSource):
    """``spark.read.format("wav_ranges").option("split", bytes).load(folder)``: FRAMES of the WAV files below it."""

    @classmethod
    def name(cls) -> str:
        return "wav_ranges"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema) -> RangeReader:
        split = int(self.options.get("split", 64 << 20))
        if split < 1:
            raise ValueError("split must be positive")
        return RangeReader(self.options["path"], split)


def ranged_frames(spark: SparkSession, folder: str, split: int = 64 << 20) -> DataFrame:
    """FRAMES of FRAME samples, the last of a file shorter; other files give none, as does an empty folder."""
    spark.dataSource.register(WavRanges)
    return spark.read.format("wav_ranges").option("split", split).load(folder)
