"""Searches by bitmaps, sketches, small world and the pruned similarity join, against plain Python."""

import math
import random
from collections import deque

import numpy as np
import pytest

from loomgraph.operators import graph as g
from loomgraph.operators import vectors


def neighbours(edges):
    adj = {}
    for a, b in edges:
        adj.setdefault(a, set()).add(b)
        adj.setdefault(b, set()).add(a)
    return adj


def reach(adj, s):
    dist, queue = {s: 0}, deque([s])
    while queue:
        x = queue.popleft()
        for y in adj[x]:
            if y not in dist:
                dist[y] = dist[x] + 1
                queue.append(y)
    return dist


def some_edges(n, m, seed):
    rng = random.Random(seed)
    return sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)})


def test_many_sources_share_rows(spark):
    """More sources than one row holds, two components and a long chain."""
    edges = some_edges(150, 220, 1) + [(1000 + k, 1001 + k) for k in range(12)]
    adj = neighbours(edges)
    e = spark.createDataFrame(edges, "a long, b long")
    got = {(r.source, r.node): r.dist for r in g.distances(e, spark.createDataFrame([(n,) for n in adj], "node long")).collect()}
    assert got == {(s, n): d for s in adj for n, d in reach(adj, s).items()}
    for layer in g.frontiers(e, spark.createDataFrame([(n,) for n in list(adj)[:70]], "node long")):
        assert layer.count() <= 2 * len(adj)
    assert g.distances(e, e.select(e.a.alias("node")).limit(0)).count() == 0


def test_betweenness_of_many_sources(spark):
    edges = some_edges(90, 160, 4)
    adj = neighbours(edges)
    score = dict.fromkeys(adj, 0.0)
    for s in adj:
        dist = reach(adj, s)
        order = sorted(dist, key=dist.get)
        paths, share = dict.fromkeys(order, 0), dict.fromkeys(order, 0.0)
        paths[s] = 1
        for x in order:
            for y in adj[x]:
                if dist[y] == dist[x] + 1:
                    paths[y] += paths[x]
        for x in reversed(order):
            for y in adj[x]:
                if dist[y] == dist[x] + 1:
                    share[x] += paths[x] / paths[y] * (1 + share[y])
            if x != s:
                score[x] += share[x]
    n = len(adj)
    got = {r.node: r.betweenness for r in g.betweenness(spark.createDataFrame(edges, "a long, b long"), 500).collect()}
    assert got == pytest.approx({k: x / ((n - 1) * (n - 2)) for k, x in score.items()}, abs=1e-9)


def test_sketched_paths(spark):
    edges = some_edges(400, 900, 2)
    adj = neighbours(edges)
    lengths = [d for s in adj for d in reach(adj, s).values() if d]
    r = g.sketched_paths(spark.createDataFrame(edges, "a long, b long")).first()
    assert abs(r.n_nodes / len(adj) - 1) < 0.02 and abs(r.n_pairs / len(lengths) - 1) < 0.02 and abs(r.avg_path / np.mean(lengths) - 1) < 0.02
    assert r.diameter == max(lengths)


def test_small_world(spark):
    ring = sorted({tuple(sorted((k, (k + step) % 60))) for k in range(60) for step in (1, 2, 3)} | {(0, 30), (7, 44)})
    edges = ring + [(100, 101)]
    e = spark.createDataFrame(edges, "a long, b long")
    adj = neighbours(edges)
    mean = lambda a: np.mean([d for s in a for d in reach(a, s).values() if d])
    lcc = {k: v for k, v in adj.items() if k < 100}
    closed = sum(1 for x in adj for y in adj[x] for z in adj[x] if y < z and z in adj[y])
    triples = sum(len(v) * (len(v) - 1) // 2 for v in adj.values())
    c, path, c_er = closed / triples, mean(lcc), 2 * len(ring) / (60 * 59)
    r = g.small_world(e, samples=2).first()
    random_lengths = [mean(neighbours([tuple(x) for x in g.random_graph(spark, 60, len(ring), seed=s).collect()])) for s in (42, 43)]
    assert (r.n_lcc, r.m_lcc) == (60, len(ring)) and (r.c, r.l, r.c_er) == pytest.approx((c, path, c_er), abs=1e-6)
    assert (r.l_er, r.l_er_std) == pytest.approx((np.mean(random_lengths), np.std(random_lengths)), abs=2e-6)
    assert r["lambda"] == pytest.approx(c / c_er, abs=1e-4) and r["gamma"] == pytest.approx(path / r.l_er, abs=1e-4) and r.sigma == pytest.approx(r["lambda"] / r["gamma"], abs=1e-4) and r.small_world
    plain = g.small_world(e, samples=0).first()
    assert plain.l_er == plain.l_er_analytic == pytest.approx(math.log(60) / math.log(2 * len(ring) / 60), abs=1e-6) and plain.l_er_std == 0


def test_similarity_join_skips_far_blocks(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 24))
    m = np.repeat(centres, 30, axis=0) + rng.normal(size=(360, 24)) * 0.15
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    kinds = ["x" if k % 3 else "y" for k in range(360)]
    v = spark.createDataFrame([(kinds[i], i, x.tolist()) for i, x in enumerate(m)], "type string, pid long, vec array<double>")
    s = np.round(m @ m.T, 6)
    for threshold in (0.97, 0.9, 0.2, -1.0):
        got = sorted((r["type"], r["a"], r["b"], r["sim"]) for r in vectors.similarity_edges(v, threshold, rows=8).collect())
        assert got == sorted((kinds[i], i, j, s[i, j]) for i in range(360) for j in range(i + 1, 360) if kinds[i] == kinds[j] and s[i, j] >= threshold)
    near = {r["type"]: r for r in vectors.pruned_pairs(v, 0.9, rows=8).collect()}
    assert set(near) == {"x", "y"} and all(r.n_near < r.n_pairs / 2 for r in near.values())
    assert all(r.n_near == r.n_pairs for r in vectors.pruned_pairs(v, -1.0, rows=8).collect())
    assert vectors.similarity_edges(v.limit(0), 0.5).count() == 0
