"""Tiles read blocks where they are kept, scores and ranks come from tiles, and line enhancement has all its modes."""

import itertools
import random

import numpy as np
import pytest
from test_adjacency import shuffled_rows

from loomgraph.operators import adjacency, images, triads
from loomgraph.operators import graph as g


def shuffled_bytes(spark, action):
    """Bytes that the stages of an action write to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    of = lambda found: {found.apply(k).stageId(): found.apply(k).shuffleWriteBytes() for k in range(found.size())}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    before = of(stages())
    out = action()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return out, sum(n for stage, n in of(stages()).items() if stage not in before)


def test_arcs_travel_once_however_many_tiles(spark, monkeypatch):
    rng = random.Random(4)
    edges = g.kept(spark.createDataFrame(sorted({tuple(sorted(rng.sample(range(1000), 2))) for _ in range(150_000)}), "a long, b long"))
    rows = []
    for nodes in (1000, 125):  # one block, and eight
        monkeypatch.setattr(adjacency, "NODES", nodes)
        rows.append(shuffled_bytes(spark, lambda: sorted(map(tuple, adjacency.partner_spread(edges).collect()))))
    (one, n), (many, m) = rows
    assert one == many and m < 2 * n


def quads(nbrs, *abc):
    return len(set.intersection(*(nbrs[x] for x in abc)))


@pytest.mark.parametrize("name", [lambda n: n, lambda n: f"n{n:03}"])
@pytest.mark.parametrize("nodes, wedges", [(40, 1 << 19), (14, 3)])
def test_neighbours_of_all_three_are_counted_in_tiles(spark, monkeypatch, name, nodes, wedges):
    monkeypatch.setattr(adjacency, "NODES", nodes)
    monkeypatch.setattr(adjacency, "WEDGES", wedges)
    rng = random.Random(7)
    linked = {tuple(name(x) for x in sorted(rng.sample(range(36), 2))): round(0.5 + rng.random() / 2, 6) for _ in range(300)}
    kind = "string" if isinstance(name(0), str) else "long"
    edges = spark.createDataFrame([(*p, s) for p, s in linked.items()], f"a {kind}, b {kind}, sim double")
    nbrs = {}
    for a, b in linked:
        nbrs.setdefault(a, set()).add(b)
        nbrs.setdefault(b, set()).add(a)
    want = []
    for x, y, z in itertools.combinations(sorted(nbrs), 3):
        if {y, z} <= nbrs[x] and z in nbrs[y]:
            want.append((x, y, z, linked[x, y], linked[y, z], linked[x, z], min(len(nbrs[n]) for n in (x, y, z)), quads(nbrs, x, y, z)))
    got = adjacency.cornered(edges).select("x", "y", "z", "sim_xy", "sim_yz", "sim_xz", "least_deg", "common").collect()
    assert sorted(map(tuple, got)) == want and any(w[-1] for w in want)


def test_scores_shuffle_no_triads(spark):
    clique = spark.createDataFrame([(a, b, 0.5) for a, b in itertools.combinations(range(40), 2)], "a long, b long, sim double")
    rows, n = shuffled_rows(spark, lambda: triads.scored(clique).filter("s4 = round(37 / 37, 6)").count())
    assert rows == 9880 and n < 2000


def test_ranks_of_edges_come_from_the_graph(spark):
    rng = np.random.default_rng(3)
    pairs = [(a, b, float(np.round(rng.random(), 1))) for a, b in itertools.combinations(range(30), 2) if rng.random() < 0.6]
    edges = spark.createDataFrame(pairs, "a long, b long, sim double")
    of = {n: [s for a, b, s in pairs if n in (a, b)] for n in range(30)}
    got = {(r.a, r.b, r.sim): r["rank"] for r in adjacency.ranked_edges(edges).collect()}
    assert got == {(a, b, s): 1 + sum(x > s for x in of[a]) for a, b, s in pairs}


def test_line_enhancement_has_all_modes(spark):
    from loomgraph.plans.registry import QUERIES

    assert QUERIES["IMG-06"](spark, "/root/testdata/sf0.001").columns == ["path", "none", "dilation", "closing", "gaussian"]

    def dark(marks, mode, level=0):
        p = np.full((9, 9, 3), 255, np.uint8)
        p[tuple(zip(*marks))] = level
        return sorted(map(tuple, np.argwhere(images.enhance_lines(p, mode) == 0).tolist()))

    line = [(4, k) for k in range(9)]
    assert dark(line, "none") == line and dark(line, "dilation") == [(r, k) for r in (3, 4, 5) for k in range(9)]
    assert dark([(4, 4)], "gaussian") == []  # a dot is blurred away: (0.4987)^2 of it stays
    double = sorted(line + [(5, k) for k in range(9)])
    assert dark(double, "gaussian") == double  # 0.727 of each of the two stays
    assert dark([(4, 2), (4, 4)], "closing") == [(4, 2), (4, 3), (4, 4)]
    assert dark([(0, 4)], "closing") == []  # nothing is marked outside, as in binary_closing
    assert dark([(4, 4)], "none", (0, 0, 255)) == [(4, 4)] and not dark([(4, 4)], "none", (0, 255, 0))  # by luminance


def test_verdicts_are_not_made_distinct_by_a_shuffle(spark):
    yes = [(a, b, "Yes") for a in range(30) for b in range(30, 60)]
    no = [(a, b, "No") for a, b in itertools.combinations(range(62), 2) if (a < 30) == (b < 30)]
    both = [(0, 1, "Yes"), (5, 7, "Unknown")]
    rows, n = shuffled_rows(spark, lambda: g.violations(spark.createDataFrame(yes + no + no + both, "a long, b long, judgment string")).collect())
    assert sorted(map(tuple, rows)) == [(a, b) for a, b, _ in no if b < 60 and (a, b) != (0, 1)] and n < 500


def test_ranked_rows_carry_their_order_once(spark):
    rng = random.Random(5)
    rows = [(a, b, c, rng.choice([0.0, 0.25, 0.5]), float(a + b)) for a, b, c in itertools.combinations(range(12), 3)]
    scores = spark.createDataFrame(rows, "A long, B long, C long, confidence double, s_AB double").repartition(3)
    out = triads.ranked(scores)
    assert out.columns == ["A", "B", "C", "confidence", "s_AB", "rank"] and out.schema["confidence"].dataType == scores.schema["confidence"].dataType
    want = sorted(rows, key=lambda r: (-r[3], r[:3]))
    assert sorted(map(tuple, out.collect()), key=lambda r: r[-1]) == [(*r, k) for k, r in enumerate(want, 1)]
