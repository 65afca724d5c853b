"""Exact top-k inner products of quantised vectors.

Components become the integers floor(1024 * x), and scores are exact whatever their size: while the largest squared length
is under 2^53, products of doubles are; beyond, doubles only choose the candidates, with a margin for their error, and
scores are sums of longs modulo 2^64, which are right as long as the score itself is a long. A score that is none is an
error, as is a component that is none. Vectors are dealt by descending length into shards
of bounded size. A rotation from the SVD of the vectors' Gram matrix (DIM x DIM, summed over all of them) moves most of
the length into the first coordinates; a shard compares blocks of queries with a few rotated coordinates first and
bounds what is missing by Cauchy-Schwarz, with the lengths of the rests. Only pairs whose bound reaches the query's
threshold get their exact integer product.

The thresholds come from a first pass over the longest vectors, at most SEED_ROWS and SEED_BYTES of them, which are
broadcast: blocks of queries are spread over all tasks, and the k-th score that a query finds there is a lower bound of
its final one. A threshold over the query's length is the least length of a vector that can still matter, so queries
are put into blocks by that, and a block is sent only to the shards that hold such lengths. Every shard then starts
from the thresholds, skips what the product of lengths rules out, and raises them as it goes.

Queries travel to the shards in blocks of QUERY_BLOCK as rows of an ordinary shuffle, and a task holds one shard and
one block at a time, so neither the queries nor the vectors need fit in memory. Each shard returns at most k rows of a
query, and only those that reach its threshold.

Defined results: vectors that are null, or hold null or non-finite components, take no part, nor do rows without an id.
An empty vector is all zeros: its scores are 0. Vectors of different lengths are compared as if the shorter ended in
zeros. Every row is a candidate of its own, and every query row a query of its own, also where ids repeat; a query's
own row is never its candidate, other rows with its id are. Ties go to the smaller id. Fewer candidates than k give
fewer rows; an empty table gives none. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import checkpointed, small_batches

K = 10
QUANTUM = 1024
QUERY_EVERY = 100
#: Most rows, and bytes, of a shard.
SHARD_ROWS, SHARD_BYTES = 16_384, 32 << 20
#: Groups of like length, at most; beyond, more shards hold the same lengths.
GROUPS = 1024
QUERY_BLOCK = 512
#: Vectors of the first pass: the longest ones. They are broadcast.
SEED_ROWS, SEED_BYTES = 4_096, 16 << 20
#: Numbers in one gathered array.
GATHERED = 1 << 22
#: Share of the rotated coordinates that is compared first.
HEAD = 0.5
#: The threshold of a query that has found too little.
NOTHING = float(-(2**62))


def quantised(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """row (a number of its own), vec_id, v array<double> of integers, norm2; sound vectors only."""
    raw = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = raw.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(~bad)
    # doubles from 2^53 on are integers
    large = lambda x: F.when(F.abs(x * QUANTUM) < 2.0**63, x * QUANTUM).otherwise(F.raise_error(F.lit("a component is no long")).cast("double"))
    number = lambda x: F.when(F.abs(x * QUANTUM) < 2.0**53, F.floor(x * QUANTUM).cast("double")).otherwise(large(x))
    whole = sound.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.transform("v", number).alias("v"))
    return whole.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))


def gram(vectors: DataFrame, dim: int) -> np.ndarray:
    """Sum of v v^T: one dim x dim matrix from each task."""

    def add(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            m = _matrix(batch.column(0), dim)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "row"])

    rows = vectors.select("v").mapInArrow(add, "i int, row array<double>")
    summed = rows.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).toArrow()
    out = np.zeros((dim, dim))
    out[summed.column("i").to_numpy(), summed.column("j").to_numpy()] = summed.column("x").to_numpy()
    return out


def _matrix(lists, dim: int) -> np.ndarray:
    """Rows of doubles, the short ones filled with zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _least(scores: np.ndarray) -> np.ndarray:
    """Doubles that are not above these longs, and near them."""
    return np.nextafter(scores.astype(np.float64), -np.inf)


class Shard:
    """Vectors by descending length, and their rotated heads and the lengths of the rests."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, m: np.ndarray, rotation: np.ndarray, k: int):
        norm = np.sqrt((m * m).sum(axis=1))
        order = np.lexsort((ids, -norm))
        self.rows, self.ids, self.m, self.norm, self.k = rows[order], ids[order], m[order], norm[order], k
        self.rotation = rotation
        self.head = max(1, int(HEAD * m.shape[1]))
        rotated = self.m @ rotation
        self.front = rotated[:, : self.head]
        self.rest = np.sqrt((rotated[:, self.head :] ** 2).sum(axis=1))

    def search(self, q_rows: np.ndarray, q: np.ndarray, floor: np.ndarray, step: int = 2048):
        """(place of the query, id, score as a long) of all that may be among a query's k best; floor: scores that k candidates reach at least."""
        norm = np.sqrt((q * q).sum(axis=1))
        rotated = q @ self.rotation
        front, rest = rotated[:, : self.head], np.sqrt((rotated[:, self.head :] ** 2).sum(axis=1))
        floor = floor.copy()
        exact = not len(norm) or not len(self.norm) or float(norm.max()) * float(self.norm[0]) < 2.0**52
        found: list[list[np.ndarray]] = [[], [], []]
        slack = 1e-6 * (1 + norm * (self.norm[0] if len(self.norm) else 0))  # of the rotation in floating point
        for at in range(0, len(self.ids), step):
            part = slice(at, at + step)
            live = np.flatnonzero(norm * self.norm[at] + slack >= floor)
            if not len(live):
                break
            bound = front[live] @ self.front[part].T + np.outer(rest[live], self.rest[part]) + slack[live][:, None]
            i, j = np.nonzero(bound >= floor[live][:, None])
            i, j = live[i], j + at
            keep = q_rows[i] != self.rows[j]
            i, j = i[keep], j[keep]
            few = len(i) < len(live) * step // 4 and len(i) * q.shape[1] <= GATHERED
            s = np.einsum("nd,nd->n", q[i], self.m[j]) if few else (q[live] @ self.m[part].T)[np.searchsorted(live, i), j - at]
            good = s + (0 if exact else slack[i]) >= floor[i]
            i, j, s = i[good], j[good], s[good]
            s = np.rint(s).astype(np.int64) if exact else self._long_scores(q, i, j, s)
            for kept, new in zip(found, (i, self.ids[j], s)):
                kept.append(new)
            i, ids, s = (np.concatenate(x) for x in found)
            order = np.lexsort((ids, ~s, i))
            i, ids, s = i[order], ids[order], s[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            top = place < self.k
            found = [[i[top]], [ids[top]], [s[top]]]
            last = place == self.k - 1
            floor[i[last]] = np.maximum(floor[i[last]], _least(s[last]))
        if not found[0]:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return tuple(np.concatenate(x) for x in found)

    def _long_scores(self, q: np.ndarray, i: np.ndarray, j: np.ndarray, near: np.ndarray) -> np.ndarray:
        """The scores of these pairs modulo 2^64; near: what doubles make of them."""
        if (np.abs(near) >= 2.0**63 * (1 - 1e-6)).any():
            raise OverflowError("a score is no long")
        out = np.zeros(len(i), dtype=np.int64)
        some = max(1, GATHERED // q.shape[1])
        for at in range(0, len(i), some):
            part = slice(at, at + some)
            out[part] = (q[i[part]].astype(np.int64) * self.m[j[part]].astype(np.int64)).sum(axis=1)
        return out


def _numbers(column) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False)


def _floors(longest: list, blocks: DataFrame, dim: int, rotation: np.ndarray, k: int) -> DataFrame:
    """query, floor: the k-th score that each query finds among the longest vectors (row, vec_id, v), if there are k."""
    m = np.zeros((len(longest), dim))
    for i, r in enumerate(longest):
        m[i, : len(r.v)] = r.v
    seeds = blocks.sparkSession.sparkContext.broadcast((np.array([r.row for r in longest], dtype=np.int64), np.array([r.vec_id for r in longest], dtype=np.int64), m, rotation))

    def run(batches):
        built = None
        for batch in batches:
            built = built or Shard(*seeds.value, k)
            for rows, vs in zip(batch.column(0), batch.column(1)):
                queries = _numbers(rows)
                i, _, score = built.search(queries, _matrix(vs.values, dim), np.full(len(queries), NOTHING))
                n = np.bincount(i, minlength=len(queries))
                floor = np.full(len(queries), np.iinfo(np.int64).max)
                np.minimum.at(floor, i, score)
                yield pa.RecordBatch.from_arrays([pa.array(queries[n == k]), pa.array(_least(floor[n == k]))], ["query", "floor"])

    return blocks.select("rows", "vs").mapInArrow(run, "query long, floor double")


def _search(candidates: DataFrame, blocks: DataFrame, n_shards: int, dim: int, rotation: np.ndarray, k: int) -> DataFrame:
    """candidates: shard, row, vec_id, v. blocks: block, shards (how many of the first it must meet), rows, ids, vs, floors."""
    turned = candidates.sparkSession.sparkContext.broadcast(rotation)  # dim x dim
    rows = candidates.select("shard", F.lit(-1).alias("block"), F.array("row").alias("rows"), F.array("vec_id").alias("ids"), F.array("v").alias("vs"), F.array().cast("array<double>").alias("floors"))
    asked = blocks.select(F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "block", "rows", "ids", "vs", "floors")

    def run(batches):
        held: dict = {"shard": None}
        built = None
        for batch in batches:
            shards, blocks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            # a run of candidates of one shard is taken at once, a block of queries alone
            edge = (blocks[1:] >= 0) | (blocks[:-1] >= 0) | (shards[1:] != shards[:-1])
            bounds = [0, *(np.flatnonzero(edge) + 1), batch.num_rows] if batch.num_rows else [0]
            for begin, end in zip(bounds, bounds[1:]):
                rows, ids, floors = (batch.column(c).slice(begin, end - begin).flatten().to_numpy(zero_copy_only=False) for c in (2, 3, 5))
                if shards[begin] != held["shard"]:
                    held, built = {"shard": shards[begin], "rows": [], "ids": [], "m": []}, None
                m = _matrix(batch.column(4).slice(begin, end - begin).flatten(), dim)
                if blocks[begin] < 0:
                    held["rows"].append(rows)
                    held["ids"].append(ids)
                    held["m"].append(m)
                    continue
                if not held["ids"]:
                    continue
                built = built or Shard(*(np.concatenate(held[x]) for x in ("rows", "ids", "m")), turned.value, k)
                i, found, score = built.search(rows, m, floors)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (rows[i], ids[i], found, score)], ["query", "query_id", "vec_id", "score"])

    dealt = rows.unionAll(asked).repartition(n_shards, "shard").sortWithinPartitions("shard", "block")
    return dealt.mapInArrow(run, "query long, query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _groups(frame: DataFrame, column: str, n: int) -> tuple[Column, list[float]]:
    """The place of a row among n groups of like size by descending values of the column, and the borders of the groups."""
    borders = sorted(set(frame.approxQuantile(column, [i / n for i in range(1, n)], 0.2 / n)), reverse=True) if n > 1 else []
    place = F.lit(0) if not borders else F.size(F.filter(F.array(*map(F.lit, borders)), lambda b: F.col(column) < b))
    return place, borders


def top_k(vectors: DataFrame, queries: Column | None = None, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = SHARD_ROWS, seed_rows: int = SEED_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best. queries: a condition on the column vec_id."""
    spark = vectors.sparkSession
    small_batches(spark)
    sound = checkpointed(quantised(vectors, id_col, vec_col))
    n, dim = sound.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    asked = checkpointed(sound.filter(F.col("vec_id") % QUERY_EVERY == 0 if queries is None else queries))
    n_asked = asked.count()
    if not n_asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = max(1, dim)
    rotation = np.linalg.svd(gram(sound, dim))[0]

    longest = sound.orderBy(F.desc("norm2"), "vec_id").limit(max(k + 1, min(seed_rows, SEED_BYTES // (8 * dim)))).select("row", "vec_id", "v").collect()
    any_block = F.pmod(F.xxhash64("row"), F.lit(-(-n_asked // query_block)))
    seeded = asked.groupBy(any_block.alias("block")).agg(F.collect_list(F.struct("row", "v")).alias("x")).select(F.col("x.row").alias("rows"), F.col("x.v").alias("vs"))
    floors = _floors(longest, seeded, dim, rotation, k)
    # the least squared length of a vector that can reach the threshold
    least = F.when((F.col("floor") > 0) & (F.col("norm2") > 0), F.col("floor") * F.col("floor") / F.col("norm2") * (1 - 1e-9)).otherwise(-1.0)
    known = asked.join(floors, asked.row == floors.query, "left").withColumn("floor", F.coalesce("floor", F.lit(NOTHING)))
    known = checkpointed(known.select("row", "vec_id", "v", "floor", least.alias("least")))

    # shards of about shard_rows by descending length; lengths that many vectors share are dealt on by the row
    n_shards = max(1, -(-n // min(shard_rows, max(1, SHARD_BYTES // (8 * dim)))))
    by_length, borders = _groups(sound, "norm2", min(n_shards, GROUPS))
    groups = len(borders) + 1
    split = max(1, -(-n_shards // groups))
    sharded = sound.withColumn("shard", (by_length * split + F.pmod(F.xxhash64("row"), F.lit(split))).cast("int"))
    # all lengths below the n-th border are in later groups
    reached = 1 + F.size(F.filter(F.array(*map(F.lit, borders)).cast("array<double>"), lambda b: b > F.col("least")))
    by_least, ends = _groups(known, "least", min(-(-n_asked // query_block), GROUPS))
    parts = max(1, -(-n_asked // query_block // (len(ends) + 1)))
    block = (by_least * parts + F.pmod(F.xxhash64("row"), F.lit(parts))).cast("int")
    blocks = known.groupBy(block.alias("block")).agg(F.min("least").alias("least"), F.collect_list(F.struct("row", "vec_id", "v", "floor")).alias("x"))
    blocks = blocks.select("block", (reached * split).cast("int").alias("shards"), F.col("x.row").alias("rows"), F.col("x.vec_id").alias("ids"), F.col("x.v").alias("vs"), F.col("x.floor").alias("floors"))
    return _best(_search(sharded, checkpointed(blocks), groups * split, dim, rotation, k), k)
