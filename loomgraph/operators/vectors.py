"""Exact retrieval over vectors: ranks of given targets, top-k, similarity edges, class overlap.

Blocks of queries meet blocks of vectors. Two back ends give the same numbers: `block` multiplies them in numpy, `sql`
in column expressions; neither makes a row for a query and a candidate. Ranks are counted, never sorted for: the rank
of a target is one more than the number of candidates above it, summed over blocks.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.values import dot, unit
from loomgraph.sources.shared import reused

BLOCK_ROWS = 1024
#: Vectors that blocks are formed around, at most; they are broadcast.
PIVOTS = 256
#: Blocks along one side of a tile, at most: with 1,024 vectors of 64 doubles each, 32 MB.
TILE = 64


def first_vectors(vectors: DataFrame, order: list[str]) -> DataFrame:
    """One vector per (type, pid): the first."""
    from loomgraph.operators.pairs import first_record

    return first_record(vectors, ["type", "pid"], order)


def normalised(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("vec", unit(F.col("vec")))


def pair_similarity(pairs: DataFrame, vectors: DataFrame, digits: int = 6) -> DataFrame:
    """source, target, type, similarity of pairs whose ends both have a vector of a type."""
    a = vectors.select("type", F.col("pid").alias("source"), F.col("vec").alias("va"))
    b = vectors.select("type", F.col("pid").alias("target"), F.col("vec").alias("vb"))
    return pairs.join(a, "source").join(b, ["type", "target"]).select("source", "target", "type", F.round(dot(F.col("va"), F.col("vb")), digits).alias("similarity"))


def _matrix(lists) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def _near_pivots(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """type, pid, vec, pivot (the nearest of these), angle to it."""
    known = vectors.sparkSession.sparkContext.broadcast(pivots)  # PIVOTS at most

    def place(batches):
        for batch in batches:
            m = _matrix(batch.column(2))
            cosines = m @ known.value.T if len(m) else np.zeros((0, 1))
            best = cosines.argmax(axis=1)
            angles = np.arccos(np.clip(cosines[np.arange(len(m)), best], -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.int32()), pa.array(angles, pa.float64())], ["type", "pid", "vec", "pivot", "angle"])

    return vectors.select("type", "pid", "vec").mapInArrow(place, "type string, pid long, vec array<double>, pivot int, angle double")


def _pivots(vectors: DataFrame, rows: int) -> np.ndarray | None:
    """Vectors of the first ids by a hash; none if there would be one block."""
    n = min(PIVOTS, vectors.count() // rows)
    if n < 2:
        return None
    return np.array([r.vec for r in vectors.select("pid", "vec").orderBy(F.md5(F.col("pid").cast("string")), "pid").limit(n).collect()], dtype=np.float64)


def _blocks(vectors: DataFrame, rows: int, pivots: np.ndarray | None = None) -> DataFrame:
    """type, block, pivot, radius, ids, vecs: whole vectors packed into blocks of about rows vectors of one pivot; a pivot's blocks have numbers in a row."""
    if pivots is None:
        near = vectors.select("type", "pid", "vec", F.lit(0).alias("pivot"), F.lit(math.pi).alias("angle"))
    else:
        near = reused(_near_pivots(vectors, pivots))
    sizes = near.groupBy("type", "pivot").agg(F.ceil(F.count(F.lit(1)) / rows).alias("parts"))
    so_far = Window.partitionBy("type").orderBy("pivot")  # PIVOTS rows at most
    places = sizes.withColumn("first", F.sum("parts").over(so_far) - F.col("parts"))
    block = (F.col("first") + F.pmod(F.xxhash64("pid"), F.col("parts"))).cast("int")
    packed = near.join(places, ["type", "pivot"]).groupBy("type", block.alias("block"))
    return packed.agg(F.first("pivot").alias("pivot"), F.max("angle").alias("radius"), F.collect_list(F.struct("pid", "vec")).alias("x")).select("type", "block", "pivot", "radius", F.col("x.pid").alias("ids"), F.col("x.vec").alias("vecs"))


def _block_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """type, i, j: all pairs of numbers of blocks of a type."""
    ends = right.groupBy("type").agg(F.max("block").alias("last"))
    return left.select("type", F.col("block").alias("i")).join(ends, "type").select("type", "i", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("j"))


def near_blocks(blocks: DataFrame, pivots: np.ndarray | None, threshold: float, digits: int = 6) -> DataFrame:
    """type, i <= j: pairs of blocks that may hold vectors with a rounded cosine of at least the threshold.

    Angles obey the triangle inequality: two blocks are no nearer than the angle of their pivots less both radii.
    Tables of TILE blocks meet, not blocks, and what is shuffled are their numbers, pivots and radii.
    """
    if pivots is None:
        return _block_pairs(blocks, blocks).filter("i <= j")
    known = blocks.sparkSession.sparkContext.broadcast(np.arccos(np.clip(pivots @ pivots.T, -1, 1)))  # PIVOTS x PIVOTS
    reach = math.acos(max(-1.0, min(1.0, threshold - 10.0**-digits))) + 1e-6
    tile = (F.col("block") / TILE).cast("int").alias("block")
    tables = blocks.groupBy("type", tile).agg(F.collect_list(F.struct(F.col("block").alias("n"), "pivot", "radius")).alias("x"))
    tables = reused(tables.select("type", "block", F.col("x.n").alias("n"), F.col("x.pivot").alias("p"), F.col("x.radius").alias("r")))
    pairs = _block_pairs(tables, tables).filter("i <= j").repartition(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "type", "i", "j")
    both = pairs.join(tables.select("type", F.col("block").alias("i"), F.col("n").alias("na"), F.col("p").alias("pa"), F.col("r").alias("ra")), ["type", "i"])
    both = both.join(tables.select("type", F.col("block").alias("j"), F.col("n").alias("nb"), F.col("p").alias("pb"), F.col("r").alias("rb")), ["type", "j"])

    def compare(batches):
        for batch in batches:
            for kind, *lists in zip(*(batch.column(c) for c in range(7))):
                na, p, ra, nb, q, rb = (x.values.to_numpy(zero_copy_only=False) for x in lists)
                apart = known.value[np.ix_(p, q)] - ra[:, None] - rb[None, :]
                i, j = np.nonzero((apart <= reach) & (na[:, None] <= nb[None, :]))
                yield pa.RecordBatch.from_arrays([pa.array([kind.as_py()] * len(i), pa.string()), pa.array(na[i], pa.int32()), pa.array(nb[j], pa.int32())], ["type", "i", "j"])

    return both.select("type", "na", "pa", "ra", "nb", "pb", "rb").mapInArrow(compare, "type string, i int, j int")


def _tiled(left: DataFrame, right: DataFrame, pairs: DataFrame, meet, schema: str) -> DataFrame:
    """What meet(type, left block, right block) gives for these pairs (type, i, j); blocks are (number, ids, matrix, extra).

    A tile is the unit of work: a block travels once for each tile, not once for each pair, and a task holds the left
    blocks of one tile and a single right one. Tiles have up to TILE blocks along a side, fewer where that would leave
    tasks without any. They are numbered and dealt in turn, as a hash of so few leaves some tasks with many.
    """
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    along = [1 + (b.agg(F.max("block")).first()[0] or 0) for b in (left, right)]
    tile = max(1, min(TILE, math.isqrt(along[0] * along[1] // (2 * parts))))
    numbers = pairs.select("type", "i", "j", (F.col("i") / tile).cast("int").alias("ti"), (F.col("j") / tile).cast("int").alias("tj"))
    extra = lambda f: F.col("extra") if "extra" in f.columns else F.lit(None).cast("string").alias("extra")
    lefts = numbers.select("type", "ti", "tj", F.col("i").alias("block"), F.lit(None).cast("array<int>").alias("wanted")).distinct()
    rights = numbers.groupBy("type", "ti", "tj", F.col("j").alias("block")).agg(F.collect_list("i").alias("wanted"))
    rows = [
        f.join(b.select("type", "block", "ids", "vecs", extra(b)), ["type", "block"]).select("type", "ti", "tj", F.lit(side).alias("side"), "block", "wanted", "ids", "vecs", "extra")
        for side, f, b in ((0, lefts, left), (1, rights, right))
    ]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        tile, held = None, {}
        for batch in batches:
            for kind, ti, tj, side, number, wanted, ids, vecs, more in zip(*batch.columns):
                here = (kind.as_py(), ti.as_py(), tj.as_py())
                if here != tile:
                    tile, held = here, {}
                block = (number.as_py(), ids.values.to_numpy(zero_copy_only=False), _matrix(vecs.values), more.as_py())
                if not side.as_py():
                    held[block[0]] = block
                    continue
                for i in wanted.as_py():
                    if i in held:
                        yield pa.RecordBatch.from_arrays(meet(here[0], held[i], block), names)

    # tiles of blocks with themselves lie on one side of the diagonal
    place = F.col("tj") * (F.col("tj") + 1) / 2 + F.col("ti") if left is right else F.col("ti") * F.lit(-(-along[1] // tile)) + F.col("tj")
    dealt = F.pmod(place.cast("long") + F.pmod(F.xxhash64("type"), F.lit(parts)), F.lit(parts)).cast("int")
    return rows[0].unionAll(rows[1]).repartitionById(parts, dealt).sortWithinPartitions("type", "ti", "tj", "side", "block").mapInArrow(run, schema)


def similarity_edges(vectors: DataFrame, threshold: float, digits: int = 6, rows: int = BLOCK_ROWS) -> DataFrame:
    """type, a < b, sim of all pairs of a type with a rounded cosine of at least the threshold; vectors are unit.

    Vectors are put into blocks by the nearest of PIVOTS pivots, and pairs of blocks that are too far apart for the
    threshold are never made.
    """
    pivots = _pivots(vectors, rows)
    blocks = reused(_blocks(vectors, rows, pivots))

    def meet(kind, left, right):
        i, ids_a, ma, _ = left
        j, ids_b, mb, _ = right
        sims = (ma @ mb.T).ravel()
        at = np.flatnonzero(sims >= threshold - 10.0**-digits)  # only what may reach the threshold is rounded
        sims = np.round(sims[at], digits)
        x, y = np.divmod(at, len(ids_b))
        a, b = ids_a[x], ids_b[y]
        keep = (sims >= threshold) & (a < b) if i == j else sims >= threshold
        a, b = a[keep], b[keep]
        return [pa.repeat(pa.scalar(kind, pa.string()), len(a)), pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64()), pa.array(sims[keep], pa.float64())]

    return _tiled(blocks, blocks, near_blocks(blocks, pivots, threshold, digits), meet, "type string, a long, b long, sim double")


def pruned_pairs(vectors: DataFrame, threshold: float, digits: int = 6, rows: int = BLOCK_ROWS) -> DataFrame:
    """type, n_blocks, n_pairs, n_near: how many pairs of blocks a similarity join has, and how many it has to compare."""
    pivots = _pivots(vectors, rows)
    blocks = reused(_blocks(vectors, rows, pivots))
    n = blocks.groupBy("type").agg(F.count(F.lit(1)).alias("n_blocks"))
    near = near_blocks(blocks, pivots, threshold, digits).groupBy("type").agg(F.count(F.lit(1)).alias("n_near"))
    return n.join(near, "type", "left").select("type", "n_blocks", (F.col("n_blocks") * (F.col("n_blocks") + 1) / 2).cast("long").alias("n_pairs"), F.coalesce("n_near", F.lit(0)).alias("n_near"))


def ranks(pairs: DataFrame, vectors: DataFrame, backend: str = "block", digits: int = 6, rows: int = BLOCK_ROWS) -> DataFrame:
    """source, target, type, rank, n_candidates, similarity.

    The rank is one more than the candidates of the type, source left out, that are more similar to the source. Pairs of
    one id, and pairs without both vectors, are left out.
    """
    known = pair_similarity(pairs.filter("source <> target").select("source", "target").distinct(), vectors, digits)
    sizes = vectors.groupBy("type").agg((F.count(F.lit(1)) - 1).cast("int").alias("n_candidates"))
    above = (_counted_in_sql if backend == "sql" else _counted)(known, vectors, digits, rows)
    return above.join(sizes, "type").select("source", "target", "type", (F.col("above") + 1).cast("int").alias("rank"), "n_candidates", "similarity")


def _query_blocks(known: DataFrame, vectors: DataFrame, rows: int) -> DataFrame:
    """type, block, ids, vecs, t: blocks of sources with vector and targets."""
    targets = known.groupBy("type", "source").agg(F.collect_list(F.struct("target", "similarity")).alias("t"))
    asked = targets.join(vectors.select("type", F.col("pid").alias("source"), "vec"), ["type", "source"])
    return _packed(asked, rows, "t").withColumn("t", F.col("x.t"))


def _packed(asked: DataFrame, rows: int, *more: str) -> DataFrame:
    """type, block, x, ids, vecs of rows (type, source, vec, more)."""
    n = max(1, -(-asked.count() // rows))
    blocks = asked.groupBy("type", F.pmod(F.xxhash64("source"), F.lit(n)).cast("int").alias("block")).agg(F.collect_list(F.struct("source", "vec", *more)).alias("x"))
    return blocks.select("type", "block", "x", F.col("x.source").alias("ids"), F.col("x.vec").alias("vecs"))


def _counted_in_sql(known: DataFrame, vectors: DataFrame, digits: int, rows: int) -> DataFrame:
    queries, blocks = reused(_query_blocks(known, vectors, rows)), reused(_blocks(vectors, rows))
    pairs = _block_pairs(queries, blocks).repartition(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), "type", "i", "j")
    grid = pairs.join(queries.select("type", F.col("block").alias("i"), "x"), ["type", "i"]).join(blocks.select("type", F.col("block").alias("j"), "ids", "vecs"), ["type", "j"])
    grid = grid.select("type", F.explode("x").alias("s"), F.arrays_zip("ids", "vecs").alias("c"))
    sims = F.transform(F.filter("c", lambda y: y["ids"] != F.col("s.source")), lambda y: F.round(dot(F.col("s.vec"), y["vecs"]), digits))
    each = grid.select("type", "s.source", "s.t", sims.alias("sims")).select("type", "source", F.explode("t").alias("t"), "sims")
    counted = each.select("source", "t.target", "type", "t.similarity", F.size(F.filter("sims", lambda y: y > F.col("t.similarity"))).alias("n"))
    return counted.groupBy("source", "target", "type", "similarity").agg(F.sum("n").alias("above"))


def _counted(known: DataFrame, vectors: DataFrame, digits: int, rows: int, ties: bool = False) -> DataFrame:
    """above: the candidates more similar than the target and, with ties, those as similar of a smaller id."""
    queries = reused(_query_blocks(known, vectors, rows).select("type", "block", "ids", "vecs", F.to_json("t").alias("extra")))
    blocks = reused(_blocks(vectors, rows))

    def meet(kind, left, right):
        _, sources, mq, targets = left
        _, ids, mv, _ = right
        sims = np.round(mq @ mv.T, digits)
        sims[sources[:, None] == ids[None, :]] = -np.inf
        out = [[], [], [], []]
        for k, found in enumerate(json.loads(targets)):
            for t in found:
                above = int((sims[k] > t["similarity"]).sum())
                if ties:
                    above += int(((sims[k] == t["similarity"]) & (ids < t["target"])).sum())
                for column, value in zip(out, (int(sources[k]), t["target"], t["similarity"], above)):
                    column.append(value)
        return [pa.array([kind] * len(out[0]), pa.string()), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64()), pa.array(out[3], pa.int64())]

    counted = _tiled(queries, blocks, _block_pairs(queries, blocks), meet, "type string, source long, target long, similarity double, n long")
    return counted.groupBy("source", "target", "type", "similarity").agg(F.sum("n").alias("above"))


def positional_ranks(pairs: DataFrame, vectors: DataFrame, digits: int = 6, rows: int = BLOCK_ROWS) -> DataFrame:
    """The place of the target in the list of all candidates, ties by id; -1 and 0.0 where it is missing."""
    q = pairs.select("source", "target").distinct()
    known = pair_similarity(q.filter("source <> target"), vectors, digits)
    placed = _counted(known, vectors, digits, rows, ties=True).select("source", "target", (F.col("above") + 1).cast("int").alias("rank"), "similarity")
    return q.join(placed, ["source", "target"], "left").select("source", "target", F.coalesce("rank", F.lit(-1)).alias("rank"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def top_neighbours(queries: DataFrame, vectors: DataFrame, k: int = 10, digits: int = 6, rows: int = BLOCK_ROWS) -> DataFrame:
    """source, rank, target, similarity; the query itself is left out, ties go to the smaller id. Each pair of blocks gives k rows a query at most."""
    asked = queries.select("type", F.col("pid").alias("source")).join(vectors.select("type", F.col("pid").alias("source"), "vec"), ["type", "source"])
    queries, blocks = reused(_packed(asked, rows).drop("x")), reused(_blocks(vectors, rows))

    def meet(kind, left, right):
        _, sources, mq, _ = left
        _, ids, mv, _ = right
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        sims = np.round(mq @ mv[order].T, digits)
        sims[sources[:, None] == ids[None, :]] = -np.inf
        first = np.argsort(-sims, axis=1, kind="stable")[:, :k]  # ties stay in the order of ids
        found = np.take_along_axis(sims, first, axis=1)
        i, j = np.nonzero(np.isfinite(found))
        return [pa.array(sources[i], pa.int64()), pa.array(ids[first[i, j]], pa.int64()), pa.array(found[i, j], pa.float64())]

    w = Window.partitionBy("source").orderBy(F.desc("similarity"), "target")
    found = _tiled(queries, blocks, _block_pairs(queries, blocks), meet, "source long, target long, similarity double")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("source", "rank", "target", "similarity")


def pair_jaccard(pairs: DataFrame, items: DataFrame, a: str = "source", b: str = "target", key: str = "pid", classes: str = "classes", digits: int = 6) -> DataFrame:
    """pairs with jaccard of the classes of both ends: look-ups of these pairs alone. Items without a class share nothing."""
    sets = items.select(F.col(key).alias("__k"), F.array_distinct(classes).alias("__s"))
    both = pairs.join(sets.select(F.col("__k").alias(a), F.col("__s").alias("__x")), a).join(sets.select(F.col("__k").alias(b), F.col("__s").alias("__y")), b)
    shared, union = F.size(F.array_intersect("__x", "__y")), F.size(F.array_union("__x", "__y"))
    return both.withColumn("jaccard", F.when(union > 0, F.round(shared / union, digits)).otherwise(0.0)).select(*pairs.columns, "jaccard")


def class_jaccard(items: DataFrame, key: str = "pid", classes: str = "classes", digits: int = 6) -> DataFrame:
    """a < b, shared, jaccard of items that share a class; all other pairs are zero, and so is every item with itself.

    Items with the same set of classes are joined as one and expanded after: the self-join is over distinct sets.
    """
    sets = items.filter(F.size(classes) > 0).withColumn("set", F.array_join(F.array_sort(F.array_distinct(classes)), ","))
    distinct = sets.select("set").distinct().withColumn("c", F.explode(F.split("set", ",")))
    sizes = distinct.groupBy("set").agg(F.count(F.lit(1)).alias("n"))
    inter = distinct.alias("x").join(distinct.alias("y"), "c").groupBy(F.col("x.set").alias("sa"), F.col("y.set").alias("sb")).agg(F.count(F.lit(1)).alias("shared"))
    scored = inter.join(sizes.select(F.col("set").alias("sa"), F.col("n").alias("na")), "sa").join(sizes.select(F.col("set").alias("sb"), F.col("n").alias("nb")), "sb")
    scored = scored.select("sa", "sb", "shared", F.round(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), digits).alias("jaccard"))
    left = sets.select(F.col(key).alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col(key).alias("b"), F.col("set").alias("sb"))
    return left.join(scored, "sa").join(right, "sb").filter("a < b").select("a", "b", "shared", "jaccard")
