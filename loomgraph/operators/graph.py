"""Graphs as edge tables (a < b): degrees, triangles, clustering, components, paths, exponential-model statistics.

Triangles and shared partners come from products of the adjacency matrix over tiles, searches from sampled sources
from packed tiles (`search`). Components are a loop over ever fewer edges with checkpoints in the shared folder.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from loomgraph.operators import adjacency
from loomgraph.operators.packing import BATCH, batched, kept
from loomgraph.operators.search import Search, forest
from loomgraph.sources.shared import checkpointed, reused


def simple_graph(arcs: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    return arcs.filter(F.col(u) != F.col(v)).select(F.least(u, v).alias("a"), F.greatest(u, v).alias("b")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("node"), F.col("b").alias("nbr")).unionAll(edges.select(F.col("b").alias("node"), F.col("a").alias("nbr")))


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("node").agg(F.count(F.lit(1)).alias("deg"))


def arc_degrees(arcs: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """node, out_deg, in_deg with multiplicity, deg of the simple graph."""
    ends = arcs.select(F.col(u).alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(arcs.select(F.col(v).alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    counted = ends.groupBy("node").agg(F.sum("o").alias("out_deg"), F.sum("i").alias("in_deg"))
    return counted.join(degrees(simple_graph(arcs, u, v)), "node", "left").na.fill({"deg": 0})


def dense(rows: DataFrame, column: str, keep: list[str] | None = None) -> DataFrame:
    """The column, what is kept, and id: the 0-based place by the column. Sorted by range partitions; only their sizes meet in one place."""
    kept = [column, *[c for c in keep or [] if c != column]]
    placed = rows.select(*kept).repartitionByRange(column).sortWithinPartitions(column).withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id())
    placed = checkpointed(placed)
    sizes = placed.groupBy("__p").agg(F.count(F.lit(1)).alias("n"), F.min("__m").alias("first"))
    before = sizes.select("__p", "first", (F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    return placed.join(F.broadcast(before), "__p").select(*kept, (F.col("before") + F.col("__m") - F.col("first")).alias("id"))  # one row a partition


def oriented(edges: DataFrame) -> DataFrame:
    """s, t: every edge from its end of lower degree, so no node starts more than the square root of twice the edges."""
    deg = degrees(edges)
    e = edges.select("a", "b").join(deg.select(F.col("node").alias("a"), F.col("deg").alias("da")), "a").join(deg.select(F.col("node").alias("b"), F.col("deg").alias("db")), "b")
    up = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    return e.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("s"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("t"))


def kth_similarities(edges: DataFrame, most: int, sim: str = "sim") -> DataFrame:
    """node, sims: the highest similarities of a node's edges, falling, `most` at most. A task passes on no more for each node."""

    def cut(node, sims):
        order = np.lexsort((-sims, node))
        node, sims = node[order], sims[order]
        first = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else np.zeros(0, np.int64)
        place = np.arange(len(node)) - np.repeat(first, np.diff(np.append(first, len(node))))
        return node[place < most], sims[place < most]

    def run(batches):
        node, sims = np.zeros(0, np.int64), np.zeros(0)
        for a, b, s in batched(batches):
            node, sims = cut(np.concatenate([node, a, b]), np.concatenate([sims, s, s]))
        first = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(node)), pa.int32()), pa.array(sims))
        for k in range(0, len(first), BATCH):
            yield pa.RecordBatch.from_arrays([pa.array(node[first[k : k + BATCH]]), lists[k : k + BATCH]], ["node", "sims"])

    found = edges.select(F.col("a").cast("long"), F.col("b").cast("long"), F.col(sim).cast("double")).mapInArrow(run, "node long, sims array<double>")
    return found.groupBy("node").agg(F.slice(F.sort_array(F.flatten(F.collect_list("sims")), asc=False), 1, most).alias("sims"))


def looked_up(small: DataFrame, most: int = 1 << 20) -> DataFrame:
    """A table of nodes for look-ups: broadcast if it has few rows, which is checked."""
    small = reused(small)
    return F.broadcast(small) if small.count() <= most else small


def triangles(edges: DataFrame) -> DataFrame:
    """x < y < z."""
    return adjacency.corners(edges)


def triangles_by_cliques(edges: DataFrame) -> DataFrame:
    """The same, by intersecting what both ends of every edge lead to; hubs lead to few nodes, as edges are oriented."""
    return adjacency.corners(edges)


def partner_counts(edges: DataFrame, block: int = 1000, together: int = 1 << 21) -> DataFrame:
    """a < b, partners: how many neighbours two nodes share, of those that share any; tasks put out rows of `together` at most.

    The square of the adjacency matrix over tiles, see `adjacency`; a hub is added up in pieces there, of any `block`.
    """
    return adjacency.partner_pairs(edges, together).filter("partners > 0").select("a", "b", "partners")


def node_triangles(edges: DataFrame, tri: DataFrame | None = None) -> DataFrame:
    if tri is None:
        return adjacency.triangles_of_nodes(edges)
    return tri.select(F.explode(F.array("x", "y", "z")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("tri"))


def transitivity(edges: DataFrame) -> DataFrame:
    """n_triangles, n_triples, transitivity."""
    edges = kept(edges.select("a", "b"))
    t = node_triangles(edges).agg((F.coalesce(F.sum("tri"), F.lit(0)) / 3).cast("long").alias("n_triangles"))
    d = degrees(edges).agg(F.coalesce(F.sum((F.col("deg") * (F.col("deg") - 1) / 2).cast("long")), F.lit(0)).alias("n_triples"))
    return t.join(d).select("n_triangles", "n_triples", F.round(F.when(F.col("n_triples") > 0, 3 * F.col("n_triangles") / F.col("n_triples")).otherwise(0.0), 6).alias("transitivity"))


def reciprocity(arcs: DataFrame) -> DataFrame:
    """Share of the arcs, repeated ones too, whose opposite is there; a pair's arcs both ways are counted together."""
    up = F.count_if(F.col("u") < F.col("v")).alias("up")
    low, high = (F.when(F.col("u") <= F.col("v"), F.col(x)).when(F.col("u") > F.col("v"), F.col(y)) for x, y in ("uv", "vu"))  # null where an end is
    counted = arcs.groupBy(low.alias("a"), high.alias("b")).agg(up, F.count(F.lit(1)).alias("n"))
    answered = F.when((F.col("a") == F.col("b")) | ((F.col("up") > 0) & (F.col("up") < F.col("n"))), F.col("n")).otherwise(0)
    return counted.agg(F.round(F.sum(answered) / F.sum("n"), 6).alias("reciprocity"))


def clustering(edges: DataFrame, tri: DataFrame | None = None, of_nodes: DataFrame | None = None) -> DataFrame:
    """node, deg, tri, cc; 0 for nodes of fewer than two neighbours. of_nodes are the triangles of each node, where they are known."""
    edges = kept(edges.select("a", "b"))
    d = degrees(edges).join(node_triangles(edges, tri) if of_nodes is None else of_nodes, "node", "left").na.fill({"tri": 0})
    return d.withColumn("cc", F.when(F.col("deg") < 2, 0.0).otherwise(2 * F.col("tri") / (F.col("deg") * (F.col("deg") - 1))))


def common_neighbours(edges: DataFrame, tri: DataFrame | None = None) -> DataFrame:
    """a, b, cn of every edge."""
    if tri is None:
        return adjacency.linked_pairs(edges).withColumnRenamed("partners", "cn")
    edges = reused(edges)
    sides = F.array(F.struct(F.col("x").alias("a"), F.col("y").alias("b")), F.struct(F.col("x").alias("a"), F.col("z").alias("b")), F.struct(F.col("y").alias("a"), F.col("z").alias("b")))
    counted = tri.select(F.explode(sides).alias("e")).groupBy(F.col("e.a").alias("a"), F.col("e.b").alias("b")).agg(F.count(F.lit(1)).alias("cn"))
    return edges.select("a", "b").join(counted, ["a", "b"], "left").na.fill({"cn": 0})


def density(edges: DataFrame) -> DataFrame:
    """Both definitions: of pairs, and of ordered pairs."""
    edges = kept(edges.select("a", "b"))
    n = degrees(edges).agg(F.count(F.lit(1)).alias("n_nodes"))
    m = edges.agg(F.count(F.lit(1)).alias("n_edges"))
    return n.join(m).select("n_nodes", "n_edges", F.round(2 * F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1)), 8).alias("density"), F.round(F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1)), 8).alias("density_ordered"))


def components(edges: DataFrame) -> DataFrame:
    """node, component: the least node of its component.

    Each round contracts every node into the least of its neighbourhood in the order of a hash, followed twice; chains
    and stars alike shrink by a constant share, so there are few rounds. They start from a forest of what each task has.
    """
    kind = edges.schema["a"].dataType
    e = forest(edges).select(*[F.col(c).cast(kind) for c in "ab"]) if isinstance(kind, IntegralType) else edges.select("a", "b")
    e = checkpointed(e.filter("a <> b").distinct())
    roots = None
    while not e.isEmpty():
        order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
        near = checkpointed(both_ways(e).groupBy("node").agg(F.min(order("nbr")).alias("m")).select("node", F.least("m", order("node"))["n"].alias("component")))
        twice = near.select(F.col("node").alias("component"), F.col("component").alias("onward"))
        step = checkpointed(near.join(twice, "component", "left").select("node", F.coalesce("onward", "component").alias("component")))
        if roots is None:
            roots = step
        else:
            on = step.select(F.col("node").alias("component"), F.col("component").alias("onward"))
            roots = checkpointed(roots.join(on, "component", "left").select("node", F.coalesce("onward", "component").alias("component")))
        ra, rb = step.select(F.col("node").alias("a"), F.col("component").alias("ra")), step.select(F.col("node").alias("b"), F.col("component").alias("rb"))
        e = checkpointed(e.join(ra, "a").join(rb, "b").filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if roots is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    # a root need not be the least node: name components by that
    least = roots.groupBy("component").agg(F.min("node").alias("least"))
    return roots.join(least, "component").select("node", F.col("least").alias("component"))


def largest_component(edges: DataFrame) -> DataFrame:
    """node; of equal sizes the component with the least node."""
    c = components(edges)
    best = c.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return c.join(best, "component").select("node")


def sampled(nodes: DataFrame, k: int) -> DataFrame:
    """k nodes by the order of a hash."""
    return nodes.orderBy(F.md5(F.col("node").cast("string")), "node").limit(k)


def _numbered(sources: DataFrame) -> DataFrame:
    """node, chunk, bit of each source: 64 sources a chunk. Sources are few."""
    place = F.row_number().over(Window.orderBy(F.md5(F.col("node").cast("string")), "node")) - 1
    return sources.select("node", F.floor(place / 64).cast("int").alias("chunk"), F.pmod(place, F.lit(64)).cast("int").alias("bit"))


def frontiers(edges: DataFrame, sources: DataFrame):
    """The layers of a breadth-first search from all sources at once, as (node, chunk, bits): the sources at that distance.

    64 sources share a row, so a layer has at most a row for each node and chunk; see `search`.
    """
    own = F.col("node").cast(edges.schema["a"].dataType)
    found = Search(edges.select("a", "b").unionAll(sources.select(own.alias("a"), own.alias("b"))))  # sources without edges are there too
    for layer in found.layers(_numbered(sources)):
        yield found.rows(layer)


def distances(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """source, node, dist of all that the sources reach."""
    numbers = _numbered(sources).select(F.col("node").alias("source"), "chunk", "bit")
    each = F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.expr("bits").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0))
    out = None
    for dist, layer in enumerate(frontiers(edges, sources)):
        rows = layer.select("node", "chunk", each.alias("bit"), F.lit(dist).alias("dist"))
        out = rows if out is None else out.unionAll(rows)
    if out is None:
        return numbers.select("source", F.col("source").alias("node"), F.lit(0).alias("dist"))
    return out.join(numbers, ["chunk", "bit"]).select("source", "node", "dist")


def average_path(edges: DataFrame, k: int = 500, inside: bool = True) -> DataFrame:
    """n_sources, n_pairs, avg_path of k sampled sources in the largest component, or in the whole graph."""
    edges = kept(edges.select("a", "b"))
    nodes = largest_component(edges) if inside else degrees(edges).select("node")
    sources = checkpointed(sampled(nodes, k))  # what they reach is their component
    found = [layer.agg(F.sum("found")).first()[0] for layer in Search(edges).layers(_numbered(sources))][1:]
    steps = sum(dist * n for dist, n in enumerate(found, 1))
    one = edges.sparkSession.createDataFrame([(sources.count(), sum(found), steps)], "n_sources long, n_pairs long, steps long")
    return one.select("n_sources", "n_pairs", F.round(F.col("steps") / F.nullif("n_pairs", F.lit(0)), 6).alias("avg_path"))


def sketched_paths(edges: DataFrame, precision: int = 12) -> DataFrame:
    """n_nodes, n_pairs, diameter, avg_path over all reachable pairs, estimated from one distinct-count sketch a node.

    A node's sketch after d rounds counts the nodes within d steps; a round merges the sketches of neighbours, until none
    grows. Memory is a sketch of 2^precision bytes a node, whatever the number of pairs.
    """
    nbrs = reused(both_ways(edges))
    own = nbrs.select("node").distinct()
    balls = checkpointed(own.groupBy("node").agg(F.hll_sketch_agg("node", F.lit(precision)).alias("ball")))
    sizes = [balls.agg(F.sum(F.hll_sketch_estimate("ball"))).first()[0] or 0]
    n = sizes[0]
    while len(sizes) == 1 or sizes[-1] > sizes[-2]:
        heard = nbrs.join(balls.select(F.col("node").alias("nbr"), "ball"), "nbr").select("node", "ball").unionAll(balls)
        balls = checkpointed(heard.groupBy("node").agg(F.hll_union_agg("ball", F.lit(False)).alias("ball")))
        sizes.append(max(sizes[-1], balls.agg(F.sum(F.hll_sketch_estimate("ball"))).first()[0] or 0))
    steps = sum(d * (after - before) for d, (before, after) in enumerate(zip(sizes, sizes[1:]), 1))
    pairs = sizes[-1] - n
    return edges.sparkSession.createDataFrame([(n, pairs, len(sizes) - 2, round(steps / pairs, 6) if pairs else None)], "n_nodes long, n_pairs long, diameter int, avg_path double")


def betweenness(edges: DataFrame, k: int = 200, scale: str = "standard") -> DataFrame:
    """node, betweenness, estimated from k sampled sources by one breadth-first pass out and one back.

    Rows hold 64 sources each. scale `double` divides by k however many nodes there are, and has a factor of 2;
    `standard` is the usual one for undirected graphs.
    """
    edges = kept(edges.select("a", "b"))
    nodes = checkpointed(degrees(edges).select("node"))
    n = nodes.count()
    picked = checkpointed(sampled(nodes, k))
    n_sources = picked.count()
    found = Search(edges)
    total = found.shares(list(found.layers(_numbered(picked), paths=True)))
    total = nodes.select("node", F.lit(0.0).alias("share")) if total is None else total
    factor = (n / k) * 2 / ((n - 1) * (n - 2)) if scale == "double" else (n / n_sources) / ((n - 1) * (n - 2))
    return nodes.join(total, "node", "left").select("node", F.round(F.coalesce("share", F.lit(0.0)) * factor, 10).alias("betweenness"))


#: Edges that a stretch of a random graph has on average.
STRETCH = 1 << 16


def random_graph(spark, n: int, m: int, seed: int = 42) -> DataFrame:
    """m distinct edges between n nodes, uniformly. Pairs are numbered and their numbers cut into stretches of equal length.

    How many edges each stretch has follows from halving: a hypergeometric draw for each half, which the driver makes as
    there are few stretches. A task draws the numbers of its stretches without repetition, so nothing is shuffled.
    Edges of a stretch stand together, by b and then a.
    """
    total = n * (n - 1) // 2
    m = min(m, total)
    stretches = max(1, -(-m // STRETCH))
    bounds = [total * k // stretches for k in range(stretches + 1)]
    rng = np.random.default_rng([seed, n, m])
    counts = _halved(rng, bounds, 0, stretches, m)
    rows = [(k, bounds[k], bounds[k + 1] - bounds[k], c) for k, c in enumerate(counts)]

    def draw(batches):
        for batch in batches:
            for k, first, length, count in zip(*(c.to_pylist() for c in batch.columns)):
                own = np.random.default_rng([seed, n, m, k])
                numbers = first + _distinct_below(own, length, count)
                # the pair a < b of a number: b is the largest integer with b (b - 1) / 2 <= number
                b = ((1 + np.sqrt(1 + 8 * numbers.astype(np.float64))) / 2).astype(np.int64)
                b -= b * (b - 1) // 2 > numbers
                b += b * (b + 1) // 2 <= numbers
                yield pa.RecordBatch.from_arrays([pa.array(numbers - b * (b - 1) // 2), pa.array(b)], ["a", "b"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    planned = spark.createDataFrame(rows, "k long, first long, length long, count long").repartitionByRange(min(parts, stretches), "k").sortWithinPartitions("k")
    return planned.mapInArrow(draw, "a long, b long")


def ordered_pairs(pairs: DataFrame, n: int) -> DataFrame:
    """n_pairs, simple, apart, one row: how many pairs a < b there are, whether all lie in 0 to n - 1 as they should, and whether they are seen to differ.

    That is where a task has them rising by b and then a, and tasks have ranges that do not meet; what comes together are
    the ends of the ranges.
    """

    def run(batches):
        count, simple, rising, low, high = 0, True, True, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            first, last = (int(b[0]), int(a[0])), (int(b[-1]), int(a[-1]))
            rising &= (high is None or high < first) and bool(((b[1:] > b[:-1]) | ((b[1:] == b[:-1]) & (a[1:] > a[:-1]))).all())
            simple &= bool(((a >= 0) & (a < b) & (b < n)).all())
            count, low, high = count + len(a), low or first, last
        if count:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (count, simple, rising, *low, *high)], ["n", "simple", "rising", "b0", "a0", "b1", "a1"])

    ranges = pairs.select("a", "b").mapInArrow(run, "n long, simple boolean, rising boolean, b0 long, a0 long, b1 long, a1 long")
    before = F.lag(F.struct("b1", "a1")).over(Window.orderBy("b0", "a0"))  # a row for each task
    apart = F.col("rising") & F.coalesce(before < F.struct(F.col("b0").alias("b1"), F.col("a0").alias("a1")), F.lit(True))
    return ranges.withColumn("apart", apart).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"), F.coalesce(F.min("simple"), F.lit(True)).alias("simple"), F.coalesce(F.min("apart"), F.lit(True)).alias("apart"))


def _halved(rng, bounds: list[int], low: int, high: int, m: int) -> list[int]:
    """How many of m numbers, drawn from those between the bounds without repetition, lie in each stretch."""
    if high - low == 1:
        return [m]
    middle = (low + high) // 2
    left = _hypergeometric(rng, bounds[middle] - bounds[low], bounds[high] - bounds[middle], m)
    return _halved(rng, bounds, low, middle, left) + _halved(rng, bounds, middle, high, m - left)


def _hypergeometric(rng, good: int, bad: int, m: int) -> int:
    """numpy takes populations under 10^9; beyond, where the draw is as good as normal, its normal approximation."""
    if max(good, bad) < 10**9:
        return int(rng.hypergeometric(good, bad, m)) if m else 0
    total = good + bad
    spread = math.sqrt(m * (good / total) * (bad / total) * max(0, total - m) / (total - 1))
    return min(max(round(rng.normal(m * good / total, spread)), m - bad, 0), good, m)


def _distinct_below(rng, length: int, count: int) -> np.ndarray:
    """count different numbers below length, sorted; drawn until there are enough, or those left out are."""
    if 2 * count > length:
        out = np.ones(length, bool)
        out[_distinct_below(rng, length, length - count)] = False
        return np.flatnonzero(out)
    found = np.zeros(0, np.int64)
    while len(found) < count:
        found = np.union1d(found, rng.integers(0, length, count - len(found)))
    return found


SMALL_WORLD = "n_lcc long, m_lcc long, c double, l double, c_er double, l_er double, l_er_std double, l_er_analytic double, lambda double, gamma double, sigma double, small_world boolean"


def small_world(edges: DataFrame, samples: int = 5, k: int = 500, random_k: int = 100) -> DataFrame:
    """Clustering and path length against random graphs, one row.

    lambda is the transitivity over that of a random graph, which is the density of the largest component; gamma is the
    average path of k sources in that component over the mean of as many random graphs of its nodes and edges, from
    random_k sources each; sigma is lambda / gamma. Small world: sigma above 1 and gamma under 2. Without samples, the
    random path length is ln(nodes) / ln(mean degree), and its spread 0.
    """
    edges = kept(edges.select("a", "b"))
    spark = edges.sparkSession
    lcc = looked_up(largest_component(edges))
    n, m = lcc.count(), edges.join(lcc.select(F.col("node").alias("a")), "a", "left_semi").count()
    c, path = transitivity(edges).first()["transitivity"], average_path(edges, k).first()["avg_path"]
    c_er, mean_degree = (2 * m / (n * (n - 1)) if n > 1 else 0.0), (2 * m / n if n else 1.0)
    analytic = math.log(n) / math.log(mean_degree) if mean_degree > 1 else math.inf
    lengths = [average_path(random_graph(spark, n, m, seed=42 + s), random_k, inside=False).first()["avg_path"] for s in range(samples)]
    l_er = sum(lengths) / len(lengths) if lengths else analytic
    spread = math.sqrt(sum((x - l_er) ** 2 for x in lengths) / len(lengths)) if lengths else 0.0
    lam = c / c_er if c_er > 0 else math.inf
    gamma = path / l_er if path is not None and 0 < l_er < math.inf else math.inf
    sigma = lam / gamma if 0 < gamma < math.inf else math.inf
    digits = lambda x: None if x is None else round(float(x), 6)
    return spark.createDataFrame([(n, m, digits(c), digits(path), digits(c_er), digits(l_er), digits(spread), digits(analytic), digits(lam), digits(gamma), digits(sigma), sigma > 1 and gamma < 2)], SMALL_WORLD)


def two_paths(edges: DataFrame) -> DataFrame:
    """Directed two-paths, over both directions of each edge."""
    d = degrees(edges).select(F.col("node").alias("nbr"), "deg")
    return both_ways(edges).join(d, "nbr").agg(F.sum(F.col("deg") - 1).alias("two_paths"))


def shared_partners(edges: DataFrame) -> DataFrame:
    """kind (edge or other), partners, pairs: pairs by number of shared neighbours; pairs without any are left out of `other`."""
    kind = F.when(F.col("linked"), "edge").otherwise("other").alias("kind")
    return adjacency.partner_spread(edges).select(kind, "partners", "pairs")


def _weighted(rows: DataFrame, alphas: list[float], *kinds: str) -> DataFrame:
    """alpha and, of each kind, the sum of n * exp(-alpha * k) over rows of kind, k, n."""
    a = rows.sparkSession.createDataFrame([(float(x),) for x in alphas], "alpha double")
    value = lambda kind: F.round(F.sum(F.when(F.col("kind") == kind, F.col("n") * F.exp(-F.col("alpha") * F.col("k"))).otherwise(0.0)), 6).alias(kind)
    return rows.join(F.broadcast(a)).groupBy("alpha").agg(*map(value, kinds))  # a handful of alphas


def _by_degree(edges: DataFrame) -> DataFrame:
    return degrees(edges).groupBy(F.col("deg").alias("k")).agg(F.count(F.lit(1)).alias("n")).select("k", "n", F.lit("gwdegree").alias("kind"))


def weighted_degrees(edges: DataFrame, alphas: list[float]) -> DataFrame:
    """alpha, gwdegree: what weighted_statistics has of it, from degrees alone."""
    return _weighted(_by_degree(edges), alphas, "gwdegree")


def weighted_statistics(edges: DataFrame, alphas: list[float]) -> DataFrame:
    """alpha, gwdegree, gwesp, gwdsp: sums of exp(-alpha * k) over degrees and shared partners."""
    edges = kept(edges.select("a", "b"))
    sp = shared_partners(edges).select(F.col("partners").alias("k"), F.col("pairs").alias("n"), F.when(F.col("kind") == "edge", "gwesp").otherwise("gwdsp").alias("kind"))
    return _weighted(_by_degree(edges).unionAll(sp), alphas, "gwdegree", "gwesp", "gwdsp")


def distribution(values: DataFrame, column: str = "deg") -> DataFrame:
    """k, n, pdf, ccdf (share of values of k or more); one row per distinct value."""
    counted = values.groupBy(F.col(column).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    up = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return counted.select("k", "n", F.round(F.col("n") / total, 8).alias("pdf"), F.round(F.sum("n").over(up) / total, 8).alias("ccdf"))


def one_hop(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges among some nodes and all their neighbours."""
    near = both_ways(edges).join(nodes.select("node"), "node", "left_semi").select(F.col("nbr").alias("node")).unionAll(nodes.select("node")).distinct()
    return edges.join(near.select(F.col("node").alias("a")), "a", "left_semi").join(near.select(F.col("node").alias("b")), "b", "left_semi")


def homophily(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """cu, cv, n, share: symmetric class matrix of undirected edges; the diagonal counts an edge once."""
    e = edges.join(classes.select(F.col("node").alias("a"), F.col("cls").alias("ca")), "a", "left").join(classes.select(F.col("node").alias("b"), F.col("cls").alias("cb")), "b", "left").na.fill({"ca": "Unknown", "cb": "Unknown"})
    cells = e.select(F.col("ca").alias("cu"), F.col("cb").alias("cv")).unionAll(e.filter("ca <> cb").select(F.col("cb").alias("cu"), F.col("ca").alias("cv")))
    n = cells.groupBy("cu", "cv").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("cu")), 6))


def open_pairs(edges: DataFrame) -> DataFrame:
    """a < b, partners: pairs with common neighbours that are no edges."""
    return adjacency.partner_pairs(edges).filter("not linked").select("a", "b", "partners")


def violations(verdicts: DataFrame) -> DataFrame:
    """a, b of pairs judged No whose ends are both Yes-linked to a third node.

    The No pairs travel with the arcs of the Yes pairs, and are looked up in the product of each tile; repeated verdicts do
    no harm there, so none is shuffled to make them distinct. A pair that is also judged Yes is left out.
    """
    return adjacency.closing_pairs(verdicts.filter("judgment in ('Yes', 'No')").select("a", "b", F.when(F.col("judgment") == "No", 1.0).otherwise(0.0).alias("asked")))
