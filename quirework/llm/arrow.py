"""Arrow helpers shared by the text operators.

Every operator here reads named columns only: further columns of the input,
whatever their names, are dropped before Python sees a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quirework.session import ship


def map_batches(df: DataFrame, columns: list[str], fn: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """Apply ``fn`` to Arrow batches of ``columns``; it returns name -> values."""
    names = [part.strip().split(" ")[0] for part in _top_level(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            out = fn(batch)
            arrays = [v if isinstance(v, pa.Array) else pa.array(v) for v in (out[n] for n in names)]
            if arrays and len(arrays[0]):
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    ship(df.sparkSession)
    return df.select(*columns).mapInArrow(run, schema)


def map_groups(df: DataFrame, keys: list[str], order: list[str], columns: list[str], fn: Callable[[tuple, dict[str, list]], list[tuple]], schema: str) -> DataFrame:
    """Apply ``fn`` to the rows of each group, in ``order``; it gets the key and name -> values of ``columns`` and returns rows.

    Groups follow one another in a stream of Arrow batches, so a task holds one
    group at a time and a small one costs next to nothing.
    """
    kinds = pa.schema([(name, _ARROW[kind]) for name, kind in (part.strip().split(" ") for part in schema.split(","))])

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, k.type) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        values: dict[str, list] = {}
        out: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(c).to_pylist() for c in columns]
            named = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            edges = [0, *(i for i in range(1, len(named)) if named[i] != named[i - 1]), len(named)]
            for a, b in zip(edges, edges[1:], strict=False):
                if named[a] != key:
                    if key is not None:
                        out += fn(key, values)
                    key, values = named[a], {c: [] for c in columns}
                for c, v in zip(columns, new, strict=True):
                    values[c] += v[a:b]
            if len(out) > 10_000:
                yield emit(out)
                out = []
        if key is not None:
            out += fn(key, values)
        if out:
            yield emit(out)

    ship(df.sparkSession)
    names = list(dict.fromkeys([*keys, *order, *columns]))
    return df.select(*names).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def _top_level(schema: str) -> list[str]:
    parts, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += c in "<("
        depth -= c in ">)"
        if c == "," and depth == 0:
            parts.append(schema[start:i])
            start = i + 1
    return [*parts, schema[start:]]


def string_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array end to end, and n+1 offsets into them; null is empty."""
    if array.null_count:
        array = array.fill_null("")
    width = np.int64 if pa.types.is_large_string(array.type) else np.int32
    _, offsets, data = array.buffers()
    n = len(array)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, width)[array.offset : array.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def code_points(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of a string array end to end, and n+1 offsets into them."""
    data, offsets = string_bytes(array)
    if not len(data):
        return np.empty(0, np.uint32), offsets
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) == len(data):
        return points, offsets
    starts = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=starts[1:])
    return points, starts[offsets]


def strings(points: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The inverse of ``code_points``, without a call per row."""
    data = points.astype("<u4", copy=False).tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    ends = np.zeros(len(points) + 1, np.int64)
    np.cumsum(width, out=ends[1:])
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(ends[offsets].tobytes()), pa.py_buffer(data)).cast(pa.string())


def row_counts(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each row."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
