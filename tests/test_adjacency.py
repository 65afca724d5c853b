import itertools
import random

import pytest

from loomgraph.operators import adjacency, triads
from loomgraph.operators import graph as g


def shuffled_rows(spark, action):
    """Rows that the stages of an action write to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    of = lambda found: {found.apply(k).stageId(): found.apply(k).shuffleWriteRecords() for k in range(found.size())}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    before = of(stages())
    out = action()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return out, sum(n for stage, n in of(stages()).items() if stage not in before)


@pytest.mark.parametrize("name", [lambda n: n, lambda n: n * 10**12 - 5 * 10**12, lambda n: f"n{n:03}"])
@pytest.mark.parametrize("nodes, wedges", [(8, 1 << 19), (8192, 3), (5, 2)])
def test_products_over_tiles(spark, monkeypatch, name, nodes, wedges):
    monkeypatch.setattr(adjacency, "NODES", nodes)
    monkeypatch.setattr(adjacency, "WEDGES", wedges)
    rng = random.Random(nodes)
    pairs = sorted({tuple(sorted((rng.randrange(24), rng.randrange(24)))) for _ in range(90)} | {(0, k) for k in range(1, 24)})
    linked = {(name(a), name(b)): round(rng.random(), 6) for a, b in pairs if a != b}
    edges = spark.createDataFrame([(*p, s) for p, s in linked.items()], f"a {'string' if isinstance(name(0), str) else 'long'}, b {'string' if isinstance(name(0), str) else 'long'}, sim double")
    nbrs = {}
    for a, b in linked:
        nbrs.setdefault(a, set()).add(b)
        nbrs.setdefault(b, set()).add(a)
    shared = {(a, b): len(nbrs[a] & nbrs[b]) for a, b in itertools.combinations(sorted(nbrs), 2)}
    got = {(r.a, r.b): (r.partners, r.linked) for r in adjacency.partner_pairs(edges).collect()}
    assert got == {p: (n, p in linked) for p, n in shared.items() if n or p in linked}
    spread = {}
    for p, n in shared.items():
        if n or p in linked:
            spread[p in linked, n] = spread.get((p in linked, n), 0) + 1
    assert {(r.linked, r.partners): r.pairs for r in adjacency.partner_spread(edges).collect()} == spread
    assert {(r.a, r.b): r.partners for r in adjacency.linked_pairs(edges).collect()} == {p: shared[p] for p in linked}
    found = [(x, y, z) for x, y, z in itertools.combinations(sorted(nbrs), 3) if {y, z} <= nbrs[x] and z in nbrs[y]]
    corners = adjacency.corners(edges, ("sim",)).collect()
    assert sorted((r.x, r.y, r.z, r.sim_xy, r.sim_yz, r.sim_xz) for r in corners) == [(x, y, z, linked[x, y], linked[y, z], linked[x, z]) for x, y, z in found]
    of_nodes = {n: sum(n in t for t in found) for n in nbrs}
    assert {r.node: r.tri for r in adjacency.triangles_of_nodes(edges).collect()} == {n: k for n, k in of_nodes.items() if k}


def test_pairs_and_triads_are_not_shuffled(spark):
    star = spark.createDataFrame([(0, k) for k in range(1, 400)], "a long, b long")
    rows, n = shuffled_rows(spark, lambda: g.shared_partners(star).collect())
    assert sorted(map(tuple, rows)) == [("edge", 0, 399), ("other", 1, 399 * 398 // 2)] and n < 4000
    clique = spark.createDataFrame([(a, b, 0.5) for a, b in itertools.combinations(range(50), 2)], "a long, b long, sim double")
    t, n = shuffled_rows(spark, lambda: triads.clustering_scores(clique).count())
    assert t == 19600 and n < 8000
    t, n = shuffled_rows(spark, lambda: triads.geometric(triads.triads(clique)).filter("s1 = 0.5").count())
    assert t == 19600 and n < 4000


def test_weighted_degrees(spark):
    star = spark.createDataFrame([(0, k) for k in range(1, 400)], "a long, b long")
    (rows, n) = shuffled_rows(spark, lambda: g.weighted_degrees(star, [0.5, 1.0]).collect())
    assert n < 4000 and {(r.alpha, r.gwdegree) for r in rows} == {(r.alpha, r.gwdegree) for r in g.weighted_statistics(star, [0.5, 1.0]).collect()}


def test_violations_look_up_pairs_in_tiles(spark):
    yes = [(a, b, "Yes") for a in range(30) for b in range(30, 60)]
    no = [(a, b, "No") for a, b in itertools.combinations(range(62), 2) if (a < 30) == (b < 30)]
    rows, n = shuffled_rows(spark, lambda: g.violations(spark.createDataFrame(yes + no, "a long, b long, judgment string")).collect())
    assert sorted(map(tuple, rows)) == [(a, b) for a, b, _ in no if b < 60] and n < 9000


def test_reciprocity_of_repeated_arcs_and_loops(spark):
    arcs = spark.createDataFrame([(1, 2), (1, 2), (2, 1), (3, 4), (5, 5), (None, 1)], "u long, v long")
    assert g.reciprocity(arcs).first()["reciprocity"] == round(4 / 6, 6)
