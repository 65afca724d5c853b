"""Files that numpy reads, and files that numpy wrote."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.sources import npy


@pytest.fixture
def source(spark):
    spark.dataSource.register(npy.NpySource)
    return spark


def test_round_trip(source, tmp_path):
    spark, folder = source, str(tmp_path / "m")
    m = np.random.default_rng(1).normal(size=(700, 5)).astype(np.float32)
    rows = [(i * 3, None if i == 4 else f"/a é/{i}", m[i].tolist()) for i in range(700)]
    frame = spark.createDataFrame(rows, "id long, path string, vec array<float>").repartition(3)
    frame.write.format("npy").option("file_bytes", 2000).mode("append").save(folder)
    keys = sorted(n[8:-4] for n in os.listdir(folder) if n.startswith("vectors_"))
    assert len(keys) > 3 and not [n for n in os.listdir(folder) if n.startswith("_")]
    read = {}
    for k in keys:  # by numpy
        ids, values = np.load(f"{folder}/ids_{k}.npy"), np.load(f"{folder}/vectors_{k}.npy")
        assert values.dtype == np.float32 and len(ids) == len(values)
        read |= dict(zip(ids.tolist(), zip(values.tolist(), open(f"{folder}/paths_{k}.txt").read().split("\n"))))
    assert read == {i: (v, p or "") for i, p, v in rows}
    back = spark.read.format("npy").option("task_bytes", 200).load(folder)
    assert back.schema.simpleString() == "struct<row:bigint,id:bigint,path:string,vec:array<float>>" and back.rdd.getNumPartitions() > len(keys)
    got = back.collect()
    assert sorted(r.row for r in got) == list(range(700)) and {r.id: (r.vec, r.path) for r in got} == read
    frame.limit(10).write.format("npy").mode("append").save(folder)
    assert spark.read.format("npy").load(folder).count() == 710
    frame.limit(10).write.format("npy").option("dtype", "float64").mode("overwrite").save(folder)
    again = spark.read.format("npy").load(folder)
    assert again.count() == 10 and "array<double>" in again.schema.simpleString()


def test_files_of_numpy(source, tmp_path):
    """Without sidecars, in both formats; empty folders and empty frames."""
    spark, folder = source, str(tmp_path)
    first, second = np.arange(12.0).reshape(4, 3), np.arange(100, 106.0).reshape(2, 3)
    np.save(f"{folder}/vectors_2007.npy", first)
    np.save(f"{folder}/vectors_2008.npy", second.astype(np.float32))
    np.save(f"{folder}/ids_2008.npy", np.array([7, 9]))
    got = sorted(map(tuple, spark.read.format("npy").load(folder).collect()))
    assert got == [(i, None, None, first[i].tolist()) for i in range(4)] + [(4 + i, (7, 9)[i], None, second[i].tolist()) for i in range(2)]
    assert spark.read.format("npy").load(str(tmp_path / "none")).count() == 0
    spark.createDataFrame([], "id long, vec array<float>").write.format("npy").mode("append").save(str(tmp_path / "empty"))
    assert spark.read.format("npy").load(str(tmp_path / "empty")).count() == 0


def test_failed_writes_leave_nothing(source, tmp_path):
    folder = str(tmp_path / "m")
    bad = source.createDataFrame([(k, [1.0] * (3 if k < 90 else 2)) for k in range(100)], "id long, vec array<float>").repartition(2)
    with pytest.raises(Exception, match="equal lengths"):
        bad.write.format("npy").mode("append").save(folder)
    assert not [n for n in os.listdir(folder) if not n.startswith(".")]


def test_points_read_their_rows_alone(source, tmp_path, monkeypatch):
    spark, folder = source, str(tmp_path)
    m = np.random.default_rng(2).normal(size=(50, 8))
    np.save(f"{folder}/vectors_a.npy", m[:30])
    np.save(f"{folder}/vectors_b.npy", m[30:].astype(np.float32))
    asked = [(i, j) for i in range(0, 55, 3) for j in (0, 7, 8)] + [(None, 1), (1, None), (-1, 0), (3, 2), (3, 2)]
    frame = spark.createDataFrame(asked, "row long, column int")
    got = {(r["row"], r["column"]): r["value"] for r in npy.points(frame, folder).collect()}
    for i, j in asked:
        inside = i is not None and j is not None and 0 <= i < 50 and j < 8
        assert got[i, j] == (pytest.approx(m[i, j], rel=1e-6) if inside else None)
    assert npy.points(frame, folder).count() == len(asked)
    reader = npy.FilteredNpyReader(folder, "array<double>", 1 << 20)
    assert list(reader.pushFilters([npy.In(("row",), (3, 31, 99)), npy.EqualTo(("id",), 4)])) == [npy.EqualTo(("id",), 4)]
    assert [(p.number, p.n, os.path.basename(p.matrix.path)) for p in reader.partitions()] == [(3, 1, "vectors_a.npy"), (31, 1, "vectors_b.npy")]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    assert [r.row for r in spark.read.format("npy").option("pushdown", "true").load(folder).filter(F.col("row").isin(3, 31, 99)).collect()] == [3, 31]
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
