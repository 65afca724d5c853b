"""What travels and what waits: packed edges, searches without a row for an edge, ranks that are not made, windows by running sums."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loomgraph.operators import graph as g
from loomgraph.operators import models, packing, triads, vectors
from loomgraph.operators.search import Search, forest
from loomgraph.streaming import limits


def test_arrays_come_back():
    rng = np.random.default_rng(1)
    for x in (np.zeros(0, np.int64), np.array([-(2**63), 2**63 - 1, 0, -7]), rng.integers(0, 2**64 - 1, 50, dtype=np.uint64), np.array([0.5, 1e300, np.nan, -np.inf]), np.round(rng.random(99), 6), rng.random(9), np.array([1.0, 5.0, -2.0])):
        (y,) = packing.unpack(packing.pack(x))
        assert y.dtype == x.dtype and np.array_equal(x, y, equal_nan=x.dtype == np.float64)


def test_edges_are_kept_packed(spark):
    rows = [(a, b, None if (a + b) % 97 == 0 else round(1 / (a + b), 6)) for a in range(300) for b in range(a + 1, 300)]
    edges = spark.createDataFrame(rows, "a long, b long, sim double").repartition(3)
    kept = packing.kept(edges)
    assert packing.is_kept(kept) and packing.kept(kept) is kept and packing.is_kept(kept.select("a", "b"))
    assert sorted(map(tuple, kept.collect()), key=lambda r: r[:2]) == rows
    cells = Search(edges).cells
    assert cells.agg(F.sum(F.length("body"))).first()[0] < 3 * len(rows)
    assert forest(edges.repartition(4)).count() <= 4 * 300


def test_random_graph_needs_no_shuffle_of_edges(spark):
    e = g.random_graph(spark, 3000, 200_000, seed=5)
    r = g.ordered_pairs(e, 3000).first()
    assert r.n_pairs == 200_000 == e.distinct().count() and r.simple and r.apart
    twice = g.ordered_pairs(e.unionAll(e), 3000).first()
    assert not twice.apart
    low = e.filter("b < 1500").count() / 200_000  # a quarter of all pairs
    assert abs(low - 0.25) < 0.005


def test_discord_without_ranks(spark):
    rng = random.Random(2)
    rows = [(a, b, round(rng.choice([0.3, 0.4, rng.uniform(0.25, 0.5)]), 6), rng.choice(["Yes", "No"])) for a in range(40) for b in range(a + 1, 40) if rng.random() < 0.8]
    sims = {}
    for a, b, s, _ in rows:
        sims.setdefault(a, []).append(s)
        sims.setdefault(b, []).append(s)
    ranked = [(a, b, s, j, 1 + sum(x > s for x in sims[a])) for a, b, s, j in rows]
    want = {(r.a, r.b): r.kind for r in triads.discordant(spark.createDataFrame(ranked, "a long, b long, similarity double, judgment string, rank int"), 5, 0.3, 9, 0.4).collect()}
    edges = spark.createDataFrame(rows, "a long, b long, sim double, judgment string")
    found = triads.discordant_edges(edges, 5, 0.3, 9, 0.4)
    assert {(r.a, r.b): r.kind for r in found.collect() if r.kind} == want and set(want.values()) == {"FP", "FN"}
    old = triads.with_discord(triads.triads(edges), found.filter("kind is not null"))
    assert sorted(map(tuple, triads.discordant_triads(found).collect())) == sorted(map(tuple, old.select("A", "B", "C", "kind", "n_hits", "hits").collect()))


def test_limits_by_running_sums(spark):
    """No frame slides over a dense window's rows; waits are those of a scan."""
    rng = random.Random(8)
    rows = [(k, float(rng.randrange(0, 200)), rng.randint(1, 9), k % 2) for k in range(300)]
    log = spark.createDataFrame(rows, "id int, s double, tokens int, who int").withColumn("ts", F.timestamp_seconds("s"))
    for key in (None, "who"):
        out = limits.replay(log, 10, 5, 30, key=key)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "RangeFrame" in plan and "RangeFrame, -" not in plan
        for r in out.collect():
            near = [(s, t) for k, s, t, who in rows if 0 <= r.s - s <= 10 and (key is None or who == r.who)]
            assert (r.n_recent, r.t_recent) == (len(near) - 1, sum(t for _, t in near) - r.tokens)
            assert r.wait_s == (0 if r.allowed else max(0.1, 10 - (r.s - min(s for s, _ in near))))


def test_pictures_are_spread(spark):
    from loomgraph.plans import image_queries

    assert image_queries.pictures(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions")) > 1


ODD = [
    '{"similarity": "Yes", "confidence": 4, "reason": "same handle, é"}',
    '{ "similarity":"No","confidence": 0,  "reason":"" }',
    '{"similarity": "", "confidence": 1, "reason": "x"}',
    'Answer: {"similarity": "Yes", "confidence": 2, "reason": "x"} done',
    '```json\n{"similarity": "No",\n 12\n "confidence": 3,\n "reason": "y",}\n```',
    '{"similarity": "Yes", "confidence": "5", "reason": "x"}',
    '{"similarity": "Yes", "confidence": 2.5, "reason": "x"}',
    '{"similarity": "Yes", "confidence": 007, "reason": "x"}',
    '{"similarity": "Yes", "confidence": 99999999999, "reason": "x"}',
    '{"similarity": null, "confidence": 2, "reason": "x"}',
    '{"similarity": "Yes", "reason": "x"}',
    '{"confidence": 2, "reason": "x", "similarity": "No"}',
    '{"similarity": "Yes", "confidence": 2, "reason": "a \\"b\\" {c} \\u00e9"}',
    '{"similarity": "Yes", "confidence": 2, "reason": "x"',
    '{"similarity": "Yes", "confidence": 2, "reason": "x", "similarity": "No"}',
    "no JSON",
    "",
]


def test_plain_answers_are_read_beside_the_model(spark):
    """Verdicts are those of the tolerant reader, whatever the answer."""
    pairs = spark.createDataFrame([(k, str(k), "b") for k in range(2 * len(ODD) + 1)], "k int, left string, right string").repartition(2)

    def factory():
        return lambda x, y, prompt: ODD[int(x) % len(ODD)] if int(x) < 2 * len(ODD) else 1 / 0

    old = models.verdicts(models.judge(pairs, factory)).select("k", "similarity", "confidence", "reason")
    new = models.judge_verdicts(pairs, factory, keep=["k"])
    assert new.columns == old.columns and new.dtypes == old.dtypes
    assert sorted(map(tuple, new.collect())) == sorted(map(tuple, old.collect()))


def test_a_judge_of_batches_is_asked_once_a_batch(spark):
    class Judge(models.MockJudge):
        calls = 0

        def many(self, left, right, prompt):
            Judge.calls += 1
            answers, errors = super().many(left, right, prompt)
            return pa.array([f"{Judge.calls} {x}" if x else None for x in answers.to_pylist()], pa.string()), errors

        def __call__(self, left, right, prompt):
            return f"alone {super().__call__(left, right, prompt)}"

    pairs = spark.createDataFrame([(f"i{k}", f"i{k * 7}") for k in range(500)] + [(None, "é")], "left string, right string").coalesce(1)
    alone = models.judge(pairs, lambda: lambda *x: models.MockJudge(4)(*x), "p").collect()
    for tries in (1, 3):
        rows = models.judge(pairs, lambda: Judge(4), "p", tries=tries).collect()
        assert {r.raw.split(" ", 1)[0] for r in rows if r.raw} == {"1"}
        assert [(r.left, r.raw and r.raw.split(" ", 1)[1], r.error) for r in rows] == [(r.left, r.raw, r.error) for r in alone]
    assert 0 < sum(r.error == "RuntimeError: no answer" for r in alone) < 400
    read = models.judge_verdicts(pairs, lambda: models.MockJudge(4), "p")
    assert sorted(map(str, read.collect())) == sorted(map(str, models.verdicts(models.judge(pairs, lambda: models.MockJudge(4), "p")).drop("raw", "error").collect()))


def test_tiles_are_dealt_in_turn(spark):
    """No task gets many of the few tiles; all pairs are there once, as are those at the threshold after rounding."""
    rng = np.random.default_rng(3)
    m = rng.normal(size=(512, 8))
    m /= np.linalg.norm(m, axis=1)[:, None]
    v = spark.createDataFrame([("x", k, [float(c) for c in m[k]]) for k in range(512)], "type string, pid long, vec array<double>")
    edges = vectors.similarity_edges(v, -2.0, rows=64).withColumn("p", F.spark_partition_id())
    sizes = [r["count"] for r in edges.groupBy("p").count().collect()]
    assert sum(sizes) == 512 * 511 // 2 == edges.select("a", "b").distinct().count()
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < 1.5 * sum(sizes) / len(sizes)
    sims = np.round(m @ m.T, 3)
    edge = float(sims[3, 400])
    found = {(r.a, r.b) for r in vectors.similarity_edges(v, edge, digits=3, rows=64).collect()}
    assert (3, 400) in found and found == {(a, b) for a, b in zip(*np.nonzero(sims >= edge)) if a < b}
