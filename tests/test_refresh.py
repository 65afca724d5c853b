"""Clustering that follows random changes equals that of a full run."""

import random

from loomgraph.operators import graph as g
from loomgraph.operators.refresh import GraphState


def test_random_changes(spark, tmp_path):
    rng = random.Random(7)
    folder = str(tmp_path / "state")
    held: set = set()
    frame = lambda e: spark.createDataFrame(list(e), "a long, b long")
    assert GraphState(spark, folder).clustering().count() == 0 and GraphState(spark, folder).version == -1
    for turn in range(4):
        added = [(rng.randrange(25), rng.randrange(25)) for _ in range(60 if turn == 0 else 15)]
        removed = rng.sample(sorted(held), min(len(held), 12)) + [(b, a) for a, b in rng.sample(sorted(held), min(len(held), 3))] + [(77, 78)]
        state = GraphState(spark, folder)
        if turn == 1:  # parts of a run that was lost
            frame([(1, 2)]).selectExpr("a", "b", "1 AS sign").write.parquet(f"{folder}/edges/version=1")
        assert state.change(frame(added), frame(removed)) == turn
        plus = {tuple(sorted(e)) for e in added if e[0] != e[1]}
        held = (held - {tuple(sorted(e)) for e in removed}) | plus
        full = frame(held)
        state = GraphState(spark, folder)
        assert {tuple(r) for r in state.edges().collect()} == held
        assert sorted(map(tuple, state.triangles().collect())) == sorted(map(tuple, g.triangles(full).collect()))
        assert sorted(map(tuple, state.clustering().collect())) == sorted(map(tuple, g.clustering(full).collect()))
    before = sorted(map(tuple, state.clustering().collect()))
    assert state.compact() == 4 and len(state._log("edges").inputFiles()) <= len(spark.read.parquet(f"{folder}/edges/version=4").inputFiles())
    assert sorted(map(tuple, state.clustering().collect())) == before
    small = state.change(frame([(90, 91)]))
    assert spark.read.parquet(f"{folder}/nodes/version={small}").count() == 2  # as much as changed
    assert GraphState(spark, folder).clustering().filter("node in (90, 91)").count() == 2
    assert state.change() == small + 1
