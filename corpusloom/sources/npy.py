"""``.npy`` matrices as a source of rows, read in ranges of bytes.

``spark.read.format("npy").load(path)`` plans from the header alone: a file is cut into ranges of whole rows, and a task seeks to its own. Paths are those of any file system that Arrow opens.
"""

from __future__ import annotations

import ast
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAGIC = b"\x93NUMPY"
#: Bytes of a partition and rows of a batch.
RANGE_BYTES, BATCH_ROWS = 32 << 20, 4096


@dataclass(frozen=True)
class Header:
    """Where the rows of a matrix begin, their number and length, and the type of their values."""

    start: int
    rows: int
    columns: int
    kind: str

    @property
    def row_bytes(self) -> int:
        return self.columns * np.dtype(self.kind).itemsize


def parse_header(data: bytes) -> Header:
    """The header at the beginning of a file; ValueError if it is none, or not of a two-dimensional matrix of numbers stored row by row."""
    try:
        if data[:6] != MAGIC or data[6] not in (1, 2, 3):
            raise ValueError("not an npy file")
        wide = data[6] > 1
        size = struct.unpack("<I" if wide else "<H", data[8 : 12 if wide else 10])[0]
        start = (12 if wide else 10) + size
        if start > len(data):
            raise ValueError("the header breaks off")
        found = ast.literal_eval(data[start - size : start].decode("utf-8"))
        shape, kind = found["shape"], np.dtype(found["descr"])
        if found["fortran_order"] or len(shape) != 2 or kind.kind not in "fiu" or min(shape) < 0:
            raise ValueError(f"no matrix of numbers stored row by row: {found}")
        return Header(start, int(shape[0]), int(shape[1]), kind.str)
    except (SyntaxError, KeyError, TypeError, IndexError, UnicodeDecodeError, struct.error) as error:
        raise ValueError(f"a broken npy header: {error}") from error


def arrow_path(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path within it; ValueError where Arrow knows none."""
    if path.startswith("file:/"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    try:
        return fs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, OSError) as error:
        raise ValueError(f"Arrow cannot open {path}: {error}") from error


def read_header(path: str) -> Header:
    """The header of a file, which must hold all rows that it names."""
    system, inner = arrow_path(path)
    try:
        with system.open_input_file(inner) as file:
            header = parse_header(file.read(1 << 16))
            if file.size() < header.start + header.rows * header.row_bytes:
                raise ValueError("the file breaks off")
            return header
    except OSError as error:
        raise ValueError(f"cannot read {path}: {error}") from error


def matrix_batches(rows: np.ndarray, first: int) -> Iterator[pa.RecordBatch]:
    """``index, embedding`` of rows; null for those with missing values."""
    for at in range(0, len(rows), BATCH_ROWS):
        part = rows[at : at + BATCH_ROWS].astype(np.float32)
        flat = pa.array(np.ascontiguousarray(part).ravel())
        lists = pa.FixedSizeListArray.from_arrays(flat, part.shape[1]).cast(pa.list_(pa.float32())) if part.shape[1] else pa.array([[]] * len(part), pa.list_(pa.float32()))
        lists = pc.if_else(pa.array(~np.isnan(part).any(axis=1)), lists, pa.scalar(None, lists.type))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(first + at, first + at + len(part))), lists], ["index", "embedding"])


class NpyReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def partitions(self) -> list[InputPartition]:
        header = read_header(self.path)
        step = max(1, self.range_bytes // max(1, header.row_bytes))
        return [InputPartition((header, at, min(header.rows, at + step))) for at in range(0, header.rows, step)] or [InputPartition((header, 0, 0))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        header, at, stop = partition.value
        system, inner = arrow_path(self.path)
        with system.open_input_file(inner) as file:
            for first in range(at, stop, BATCH_ROWS):
                rows = min(stop, first + BATCH_ROWS) - first
                data = file.read_at(rows * header.row_bytes, header.start + first * header.row_bytes)
                yield from matrix_batches(np.frombuffer(data, header.kind).reshape(rows, header.columns), first)


class NpyDataSource(DataSource):
    """``index bigint, embedding array<float>`` of one file; option ``rangeBytes`` is the size of a partition."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "index bigint, embedding array<float>"

    def reader(self, schema) -> NpyReader:
        return NpyReader(self.options["path"], int(self.options.get("rangeBytes", RANGE_BYTES)))
