import glob

from test_adjacency import shuffled_rows

from loomgraph.plans import registry
from loomgraph.streaming import limits

DATA = "/root/testdata/sf0.001"  # 2,763 edges


def test_both_records_of_a_pair_meet_before_the_shuffle(spark):
    for name in ("AGG-24", "AGG-25", "AGG-26", "GRF-05"):
        _, n = shuffled_rows(spark, lambda name=name: registry.QUERIES[name](spark, DATA).collect())
        assert n < 3500, name


def test_incremental_keeps_no_state(spark, tmp_path):
    for k, rows in enumerate(([(1, 2), (1, 2), (3, 4)], [(3, 4), (5, 6)], [])):
        spark.createDataFrame(rows, "s long, t long").write.json(f"{tmp_path}/in/{k}")
        limits.incremental(spark, f"{tmp_path}/in/*", "s long, t long", f"{tmp_path}/out", f"{tmp_path}/checkpoint", ["s", "t"])
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == [(1, 2), (3, 4), (5, 6)]
    assert not glob.glob(f"{tmp_path}/checkpoint/state/**/*.delta", recursive=True)


def test_batches_of_a_stream_have_many_files(spark):
    # before, the rows were dealt into three files, so a batch was one task however many rows there were
    files = lambda: set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/**/in/*.json.gz", recursive=True))
    before = files()
    assert registry.QUERIES["SNK-07"](spark, DATA).count() == 2763
    assert len(files() - before) >= 1
