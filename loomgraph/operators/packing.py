"""Numbers packed for travel: differences or whole values, byte by byte, compressed; and edge tables kept that way."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.sources.shared import checkpointed

#: Rows that a task packs at once, and rows of a batch that leaves again.
CHUNK, BATCH = 1 << 20, 1 << 17


def _planes(x: np.ndarray) -> tuple[int, bytes]:
    """How many low bytes are in use, and those, plane by plane, compressed; of unsigned numbers."""
    used = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
    if not used:
        return 0, b""
    raw = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :used].T)
    return used, pa.compress(raw.tobytes(), codec="zstd", asbytes=True)


def _zigzag(x: np.ndarray) -> np.ndarray:
    return ((x << 1) ^ (x >> 63)).view(np.uint64)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of longs (by their differences), unsigned longs (as they are) and doubles (as whole numbers or millionths, where they are) as one string of bytes."""
    out = [struct.pack("<B", len(arrays))]
    for x in arrays:
        if x.dtype == np.uint64:
            kind, coded = 0, x
        elif x.dtype == np.float64:
            kind, coded = 4, x.view(np.uint64)
            for k, scale in ((2, 1.0), (3, 1e6)):
                whole = np.rint(x * scale)
                if len(x) and np.abs(whole).max() < 2**53 and (whole / scale == x).all():
                    kind, coded = k, _zigzag(whole.astype(np.int64))
                    break
        else:
            x = x.astype(np.int64)
            kind, coded = 1, _zigzag(np.diff(x, prepend=np.int64(0)))
        used, body = _planes(coded)
        out += [struct.pack("<BBQQ", kind, used, len(x), len(body)), body]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    count, at, out = data[0], 1, []
    for _ in range(count):
        kind, used, n, size = struct.unpack_from("<BBQQ", data, at)
        at += 18
        wide = np.zeros((n, 8), np.uint8)
        if used:
            raw = pa.decompress(data[at : at + size], decompressed_size=n * used, codec="zstd", asbytes=True)
            wide[:, :used] = np.frombuffer(raw, np.uint8).reshape(used, n).T
        at += size
        x = wide.reshape(-1).view("<u8")
        if kind in (1, 2, 3):
            x = (x >> np.uint64(1)).view(np.int64) ^ -(x & np.uint64(1)).view(np.int64)
        out.append(np.cumsum(x, dtype=np.int64) if kind == 1 else x.astype(np.float64) if kind == 2 else x / 1e6 if kind == 3 else x.view(np.float64) if kind == 4 else x)
    return out


def coded(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Places of values that are all among the known, sorted ones."""
    low, span = (int(known[0]), int(known[-1]) - int(known[0]) + 1) if len(known) else (0, 1)
    if span <= 1 << 25:
        places = np.zeros(span, np.int64)
        places[known - low] = np.arange(len(known))
        return places[values - low]
    return np.searchsorted(known, values)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    if len(values):
        low, span = int(values.min()), int(values.max()) - int(values.min()) + 1
        if span <= 1 << 25:
            there = np.zeros(span, bool)
            there[values - low] = True
            return np.flatnonzero(there) + low
    return np.unique(values)


def pack_arcs(s: np.ndarray, t: np.ndarray, *carried: np.ndarray) -> bytes:
    """Arcs that are sorted by s and t: their ends as places among those that occur."""
    from_, to = distinct(s), distinct(t)
    return pack(from_, to, coded(s, from_), coded(t, to), *carried)


def unpack_arcs(data: bytes) -> list[np.ndarray]:
    from_, to, s, t, *carried = unpack(data)
    return [from_[s], to[t], *carried]


def batched(batches):
    """Columns of about CHUNK rows."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            n += batch.num_rows
        if n >= CHUNK:
            yield [np.concatenate(c) for c in zip(*held)]
            held, n = [], 0
    if n:
        yield [np.concatenate(c) for c in zip(*held)]


def is_kept(df: DataFrame) -> bool:
    """Whether df is a checkpoint, or is unpacked from one."""
    plan = df._jdf.queryExecution().analyzed()
    kind = plan.getClass().getSimpleName()
    if kind == "LogicalRDD":
        return True
    while kind in ("Project", "MapInArrow", "SubqueryAlias"):
        plan = plan.child()
        kind = plan.getClass().getSimpleName()
    return kind == "LogicalRDD" and "__packed" in list(plan.schema().fieldNames())


def kept(edges: DataFrame) -> DataFrame:
    """Edges for several uses: computed once and kept in the shared folder, packed where ends are numbers and what they carry are doubles."""
    kinds = [f.dataType.simpleString() for f in edges.schema]
    if is_kept(edges):
        return edges
    if kinds[:2] not in (["bigint", "bigint"], ["int", "int"]) or set(kinds[2:]) - {"double"}:
        return checkpointed(edges)
    names = edges.columns

    def put(batches):
        for columns in batched(map(known, batches)):
            order = np.lexsort((columns[1], columns[0]))
            columns = [c[order].astype(np.int64 if k < 2 else np.float64 if k < len(names) else np.uint64) for k, c in enumerate(columns)]
            some = all(c.all() for c in columns[len(names) :])
            yield pa.RecordBatch.from_arrays([pa.array([pack_arcs(*columns[: len(names) if some else None])], pa.binary())], ["__packed"])

    def known(batch):
        """With whether each value is there."""
        return pa.RecordBatch.from_arrays([*(c.fill_null(0) for c in batch.columns), *(c.is_valid() for c in batch.columns)], [str(k) for k in range(2 * len(names))])

    def take(batches):
        for batch in batches:
            for body in batch.column(0):
                columns = unpack_arcs(body.as_py())
                columns, there = columns[: len(names)], [c == 0 for c in columns[len(names) :]] or [None] * len(names)
                for k in range(0, len(columns[0]), BATCH):
                    part = slice(k, k + BATCH)
                    yield pa.RecordBatch.from_arrays([pa.array(c[part], pa.int32() if kind == "int" else None, mask=None if m is None else m[part]) for c, kind, m in zip(columns, kinds, there)], names)

    return checkpointed(edges.mapInArrow(put, "__packed binary")).mapInArrow(take, edges.schema)
