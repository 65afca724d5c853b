"""Folders of .npy matrices with ids and paths beside them, as a Spark data source, and look-ups of single values in them.

A folder holds files in threes: `vectors_K.npy` (rows x columns), `ids_K.npy` (a long for each row) and `paths_K.txt`
(a line for each row), K being the same for all three; ids and paths may be missing. The files are numpy's own: numpy
reads what is written here, and what numpy wrote is read here. Rows are numbered through the files in order of name.

    spark.dataSource.register(NpySource)
    df.write.format("npy").mode("append").save(folder)     # id, path, vec
    spark.read.format("npy").load(folder)                  # row, id, path, vec

Reading is split by rows, and a task seeks to its first byte. Writing keeps one file's rows in memory at a time, under a
name of its own, and the files get their names when all tasks are done; a task that is lost leaves nothing that counts.
Folders are paths or URIs of a file system that pyarrow opens.

Defined results: a null id or path is 0 or empty beside a row that has one, missing sidecars give nulls. Matrices of one
folder need equal widths; a vector of another length than the first of its file is an error, as is a null. Empty
frames write no files, and a folder without files has no rows.
"""

from __future__ import annotations

import bisect
import io
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import DoubleType, StructField, StructType

#: Bytes of a matrix in one file that is written, one read task and one Arrow batch.
FILE_BYTES, TASK_BYTES, BATCH_BYTES = 32 << 20, 32 << 20, 4 << 20
HEADER_BYTES = 4096


def _open(folder: str):
    """The file system and the path of a folder."""
    from pyarrow import fs

    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder)
    return fs.LocalFileSystem(), folder


def _names(system, path: str) -> list[str]:
    from pyarrow import fs

    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted(f.base_name for f in found if f.is_file)


@dataclass
class Matrix:
    """A .npy file: where its rows begin and what they are."""

    path: str
    rows: int
    columns: int
    dtype: np.dtype
    begin: int

    @property
    def row_bytes(self) -> int:
        return self.columns * self.dtype.itemsize


def header(system, path: str) -> Matrix:
    with system.open_input_file(path) as f:
        head = io.BytesIO(f.read(HEADER_BYTES))
    version = np.lib.format.read_magic(head)
    shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(head)
    if fortran and len(shape) > 1 or dtype.hasobject:
        raise ValueError(f"{path}: rows of numbers are read, not columns or objects")
    return Matrix(path, shape[0], int(np.prod(shape[1:], dtype=np.int64)), dtype, head.tell())


def read_rows(system, matrix: Matrix, first: int, n: int) -> np.ndarray:
    """These rows alone."""
    with system.open_input_file(matrix.path) as f:
        data = f.read_at(n * matrix.row_bytes, matrix.begin + first * matrix.row_bytes)
    return np.frombuffer(data, dtype=matrix.dtype).reshape(n, matrix.columns)


def matrices(folder: str) -> list[tuple[Matrix, int]]:
    """Each matrix of a folder, and the number of its first row."""
    system, path = _open(folder)
    found, first = [], 0
    for name in _names(system, path):
        if name.startswith("vectors_") and name.endswith(".npy"):
            found.append((header(system, posixpath.join(path, name)), first))
            first += found[-1][0].rows
    return found


@dataclass
class _Rows(InputPartition):
    matrix: Matrix
    first: int  # of the file
    n: int
    number: int  # of the first row, in the folder


class NpyReader(DataSourceReader):
    def __init__(self, folder: str, schema, task_bytes: int):
        self.folder, self.kinds, self.task_bytes, self.wanted = folder, schema, task_bytes, None

    def partitions(self):
        parts = []
        found = matrices(self.folder)
        if self.wanted is not None:
            starts = [first for _, first in found]
            for row in sorted(r for r in self.wanted if r is not None and 0 <= r):
                k = bisect.bisect_right(starts, row) - 1
                if k >= 0 and row - starts[k] < found[k][0].rows:
                    parts.append(_Rows(found[k][0], row - starts[k], 1, row))
        else:
            for matrix, number in found:
                some = max(1, self.task_bytes // max(1, matrix.row_bytes))
                parts += [_Rows(matrix, at, min(some, matrix.rows - at), number + at) for at in range(0, matrix.rows, some)]
        return parts or [_Rows(Matrix("", 0, 0, np.dtype("f8"), 0), 0, 0, 0)]

    def read(self, part: _Rows) -> Iterator[pa.RecordBatch]:
        system, _ = _open(self.folder)
        matrix = part.matrix
        if not part.n:
            return
        kind = pa.float32() if matrix.dtype == np.float32 and "array<float>" in self.kinds else pa.float64()
        ids = paths = None
        base, name = posixpath.split(matrix.path)
        key = name.removeprefix("vectors_").removesuffix(".npy")
        beside = set(_names(system, base))
        if f"ids_{key}.npy" in beside:
            ids = header(system, posixpath.join(base, f"ids_{key}.npy"))
        if f"paths_{key}.txt" in beside:
            paths = _lines(system, posixpath.join(base, f"paths_{key}.txt"), part.first)
        some = max(1, BATCH_BYTES // max(1, matrix.row_bytes))
        for at in range(0, part.n, some):
            n = min(some, part.n - at)
            values = read_rows(system, matrix, part.first + at, n)
            vec = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * matrix.columns, pa.int32()), pa.array(values.reshape(-1), kind))
            id_values = pa.nulls(n, pa.int64()) if ids is None else pa.array(read_rows(system, ids, part.first + at, n)[:, 0], pa.int64())
            path_values = pa.nulls(n, pa.string()) if paths is None else pa.array([next(paths, "") for _ in range(n)], pa.string())
            rows = pa.array(np.arange(part.number + at, part.number + at + n), pa.int64())
            yield pa.RecordBatch.from_arrays([rows, id_values, path_values, vec], ["row", "id", "path", "vec"])


class FilteredNpyReader(NpyReader):
    """With filters on row numbers pushed down, which a session must allow (spark.sql.python.filterPushdown.enabled)."""

    def pushFilters(self, filters: list[Filter]):
        """Numbers of rows become byte ranges."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and tuple(f.attribute) == ("row",):
                rows = set(f.value if isinstance(f, In) else [f.value])
                self.wanted = rows if self.wanted is None else self.wanted & rows
            else:
                yield f


def _lines(system, path: str, first: int) -> Iterator[str]:
    """The lines from this one on; earlier ones are passed over, a piece at a time."""
    with system.open_input_stream(path) as f:
        text = io.TextIOWrapper(f, encoding="utf-8", newline="\n")
        for k, line in enumerate(text):
            if k >= first:
                yield line.removesuffix("\n")


@dataclass
class _Written(WriterCommitMessage):
    task: int
    names: list[str]


class NpyWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, overwrite: bool, dtype: str, file_bytes: int):
        self.folder, self.overwrite, self.dtype, self.file_bytes = folder, overwrite, np.dtype(dtype), file_bytes

    def write(self, batches) -> _Written:
        from pyspark import TaskContext

        system, path = _open(self.folder)
        system.create_dir(path, recursive=True)
        names: list[str] = []
        held: list[tuple[np.ndarray, np.ndarray, list[str]]] = []
        size, width = 0, None

        def put() -> None:
            nonlocal held, size, width
            name = f"_{uuid.uuid4().hex}"
            arrays = {"vectors": np.concatenate([h[0] for h in held]), "ids": np.concatenate([h[1] for h in held])}
            for kind, array in arrays.items():
                with system.open_output_stream(posixpath.join(path, f"{name}.{kind}")) as f:
                    np.lib.format.write_array_header_1_0(f, {"descr": np.lib.format.dtype_to_descr(array.dtype), "fortran_order": False, "shape": array.shape})
                    f.write(np.ascontiguousarray(array).data)
            with system.open_output_stream(posixpath.join(path, f"{name}.paths")) as f:
                f.write("".join(f"{p}\n" for h in held for p in h[2]).encode())
            names.append(name)
            held, size, width = [], 0, None

        for batch in batches:
            if not batch.num_rows:
                continue
            vec = batch.column(batch.schema.get_field_index("vec"))
            lengths = np.diff(vec.offsets.to_numpy())
            if vec.null_count or len(set(lengths)) > 1 or width not in (None, lengths[0]):
                raise ValueError("vectors of one file need equal lengths and no nulls")
            width = lengths[0]
            values = vec.flatten().to_numpy(zero_copy_only=False).astype(self.dtype).reshape(-1, width)
            column = lambda name: batch.column(batch.schema.get_field_index(name)).to_pylist() if name in batch.schema.names else [None] * batch.num_rows
            ids = np.array([0 if x is None else x for x in column("id")], dtype=np.int64)
            paths = [" ".join((x or "").splitlines()) for x in column("path")]
            some = max(1, self.file_bytes // max(1, int(width) * self.dtype.itemsize))
            for at in range(0, len(values), some):
                part = slice(at, at + some)
                held.append((values[part], ids[part], paths[part]))
                size += held[-1][0].nbytes
                if size >= self.file_bytes:
                    put()
                    width = lengths[0]
        if held:
            put()
        return _Written(TaskContext.get().partitionId(), names)

    def commit(self, messages) -> None:
        """Names in the order of tasks; with overwrite, what was there goes. Files of lost tasks go too."""
        system, path = _open(self.folder)
        system.create_dir(path, recursive=True)
        old = [n for n in _names(system, path) if n.split("_")[0] in ("vectors", "ids", "paths")]
        batch = 1 + max((int(n.split("_")[1].split("-")[0]) for n in old if n.startswith("vectors_") and n.split("_")[1].split("-")[0].isdigit()), default=-1)
        if self.overwrite:
            for name in old:
                system.delete_file(posixpath.join(path, name))
        number = 0
        for message in sorted((m for m in messages if m is not None), key=lambda m: m.task):
            for name in message.names:
                key = f"{batch:05d}-{number:06d}"
                for kind, final in (("ids", f"ids_{key}.npy"), ("paths", f"paths_{key}.txt"), ("vectors", f"vectors_{key}.npy")):  # the matrix last
                    system.move(posixpath.join(path, f"{name}.{kind}"), posixpath.join(path, final))
                number += 1
        self._clear(system, path)

    def abort(self, messages) -> None:
        self._clear(*_open(self.folder))

    def _clear(self, system, path: str) -> None:
        for name in _names(system, path):
            if name.startswith("_") and name.rsplit(".", 1)[-1] in ("vectors", "ids", "paths"):
                system.delete_file(posixpath.join(path, name))


class NpySource(DataSource):
    """Options: dtype (of what is written, float32 unless given), task_bytes, file_bytes, pushdown (true: filters on row numbers read only those rows)."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        found = matrices(self.options["path"])
        kind = "float" if found and all(m.dtype == np.float32 for m, _ in found) else "double"
        return f"row long, id long, path string, vec array<{kind}>"

    def reader(self, schema) -> NpyReader:
        kind = FilteredNpyReader if self.options.get("pushdown", "false") == "true" else NpyReader
        return kind(self.options["path"], schema.simpleString(), int(self.options.get("task_bytes", TASK_BYTES)))

    def writer(self, schema, overwrite: bool) -> NpyWriter:
        return NpyWriter(self.options["path"], overwrite, self.options.get("dtype", "float32"), int(self.options.get("file_bytes", FILE_BYTES)))


def points(places: DataFrame, folder: str, row: str = "row", column: str = "column") -> DataFrame:
    """places with value: the number in this row and column of the folder's matrices, null where there is none.

    A task sorts a batch of places by row and reads their bytes alone, those of one row at once.
    """
    found = places.sparkSession.sparkContext.broadcast(matrices(folder))  # a few numbers for each file
    names = places.columns

    def look(batches):
        system, _ = _open(folder)
        starts = [first for _, first in found.value]
        for batch in batches:
            rows, columns = (batch.column(names.index(c)).to_pylist() for c in (row, column))
            out: list[float | None] = [None] * len(rows)
            open_file, k, held, values = None, -1, None, None
            for at in sorted((i for i in range(len(rows)) if rows[i] is not None and columns[i] is not None), key=lambda i: rows[i]):
                here = bisect.bisect_right(starts, rows[at]) - 1
                if here < 0:
                    continue
                matrix, first = found.value[here]
                if rows[at] - first >= matrix.rows or not 0 <= columns[at] < matrix.columns:
                    continue
                if here != k:
                    if open_file is not None:
                        open_file.close()
                    open_file, k, held = system.open_input_file(matrix.path), here, None
                if held != rows[at]:
                    held = rows[at]
                    values = np.frombuffer(open_file.read_at(matrix.row_bytes, matrix.begin + (held - first) * matrix.row_bytes), dtype=matrix.dtype)
                out[at] = float(values[columns[at]])
            if open_file is not None:
                open_file.close()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*names, "value"])

    return places.mapInArrow(look, StructType([*places.schema.fields, StructField("value", DoubleType())]))


def describe(folder: str) -> str:
    """The files' shapes as JSON, for logs."""
    return json.dumps([{"file": posixpath.basename(m.path), "rows": m.rows, "columns": m.columns, "dtype": m.dtype.str} for m, _ in matrices(folder)])
