"""Samples that are the same on every run and cluster: rows in the order of a hash of their key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import EXACT_WORDS, word_pattern
from loomgraph.operators import graph as g


def hashed(*keys: str, seed: int = 42) -> Column:
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


def sample(df: DataFrame, n: int, keys: list[str], seed: int = 42) -> DataFrame:
    return df.orderBy(hashed(*keys, seed=seed), *keys).limit(n)


def stratified(df: DataFrame, strata: list[tuple[str, Column | None, int, Column | None]], keys: tuple[str, str] = ("source", "target"), seed: int = 42) -> DataFrame:
    """Strata in turn, without replacement: (name, condition, size, order). A condition of None takes the largest component of what is left."""
    left, out = df, None
    for name, condition, n, order in strata:
        pool = left.filter(condition) if condition is not None else _family(left, keys)
        some = pool.orderBy(*([order] if order is not None else []), hashed(*keys, seed=seed), *keys).limit(n).withColumn("stratum", F.lit(name))
        some = g.checkpointed(some)
        out = some if out is None else out.unionByName(some)
        left = left.join(some.select(*keys), list(keys), "left_anti")
    return out


def _family(df: DataFrame, keys: tuple[str, str]) -> DataFrame:
    a, b = keys
    nodes = g.largest_component(df.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))
    return df.join(nodes.select(F.col("node").alias(a)), a, "left_semi")


def pilot_strata(high: float = 0.99, low: float = 0.965, upto: float = 0.975, sizes: tuple[int, ...] = (4, 4, 4, 4, 4, 3)) -> list:
    yes, no = F.lower(F.trim("judgment")) == "yes", F.lower(F.trim("judgment")) == "no"
    says_exact = F.coalesce("reason", F.lit("")).rlike(word_pattern(EXACT_WORDS))
    return [
        ("L1", (F.col("confidence") == 5) & no & says_exact, sizes[0], None),
        ("L2", (F.col("similarity") >= high) & no, sizes[1], None),
        ("L3", (F.col("similarity") >= high) & yes, sizes[2], None),
        ("L4", yes, sizes[3], F.col("similarity")),
        ("L5", F.col("similarity").between(low, upto), sizes[4], None),
        ("L6", None, sizes[5], None),
    ]


def audit(sampled: DataFrame, targets: list[tuple[str, int]]) -> DataFrame:
    """stratum, n_target, n_actual; strata without rows count 0."""
    t = sampled.sparkSession.createDataFrame(targets, "stratum string, n_target int")
    return t.join(sampled.groupBy("stratum").agg(F.count(F.lit(1)).alias("n_actual")), "stratum", "left").na.fill({"n_actual": 0})
