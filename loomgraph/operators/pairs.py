"""From citation records to pairs: dedup, self-join, enrichment, nested events, buckets, resume.

Small look-up tables are left to the planner, which broadcasts a side only below its size threshold; nothing here
hints a broadcast. Where the first or last row counts, an order column is required.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VIEWS = ("front", "overview", "perspective")


def first_record(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, by an aggregate with map-side partials instead of a sort."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("__first")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col(f"__first.{c}").alias(c) for c in rest])


def last_record(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("__last")
    return df.groupBy(*keys).agg(last).select(*keys, *[F.col(f"__last.{c}").alias(c) for c in rest])


def cocitation(records: DataFrame, valid: DataFrame | None = None, app: str = "app", pid: str = "pid", order: str = "ord") -> DataFrame:
    """source < target for every two patents of an application, with the attributes of the source's first record."""
    if valid is not None:
        records = records.join(valid.select(pid), pid, "left_semi")
    records = records.filter(F.trim(F.coalesce(app, F.lit(""))) != "")
    first = first_record(records, [app, pid], [order])
    rest = [c for c in first.columns if c not in (app, pid, order)]
    a, b = first.alias("a"), first.select(app, pid).alias("b")
    joined = a.join(b, (F.col(f"a.{app}") == F.col(f"b.{app}")) & (F.col(f"a.{pid}") < F.col(f"b.{pid}")))
    return joined.select(F.col(f"a.{pid}").alias("source"), F.col(f"b.{pid}").alias("target"), F.col(f"a.{app}").alias("app"), *[F.coalesce(F.col(f"a.{c}"), F.lit("")).alias(c) if dict(first.dtypes)[c] == "string" else F.col(f"a.{c}").alias(c) for c in rest])


def singletons(records: DataFrame, app: str = "app", pid: str = "pid") -> DataFrame:
    """Applications that name one patent only."""
    return records.select(app, pid).distinct().groupBy(app).count().filter("count < 2")


def look_up_both(edges: DataFrame, dim: DataFrame, key: str, columns: list[str], default: str | None = "", a: str = "source", b: str = "target") -> DataFrame:
    """columns of dim for both ends, as source_* and target_*."""
    for end in (a, b):
        side = dim.select(F.col(key).alias(end), *[F.col(c).alias(f"{end}_{c}") for c in columns])
        edges = edges.join(side, end, "left")
        if default is not None:
            edges = edges.na.fill(default, [f"{end}_{c}" for c in columns])
    return edges


def share_a_view(a: Column, b: Column) -> Column:
    return F.arrays_overlap(F.map_keys(a), F.map_keys(b))


def common_view(a: Column, b: Column, prefer: str | None = None) -> Column:
    """The first view that both maps hold; `prefer` is tried before the rest."""
    tried = [*([prefer] if prefer else []), *[v for v in VIEWS if v != prefer]]
    return F.coalesce(*[F.when(F.map_contains_key(a, v) & F.map_contains_key(b, v), F.lit(v)) for v in tried])


def with_events(edges: DataFrame, attributes: list[str], keys: tuple[str, ...] = ("source", "target"), order: str = "ord") -> DataFrame:
    """One row per pair, with its distinct events in order."""
    event = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in attributes])
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), event.alias("e"))))
    return edges.groupBy(*keys).agg(F.array_distinct(F.transform(ordered, lambda x: x["e"])).alias("events"))


def not_done(todo: DataFrame, done: DataFrame, keys: tuple[str, ...] = ("source", "target")) -> DataFrame:
    """Resume: what is not in `done`, each pair once."""
    return todo.dropDuplicates(list(keys)).join(done.select(*keys).distinct(), list(keys), "left_anti")


def with_judgment(ranks: DataFrame, judgments: DataFrame, order: str) -> DataFrame:
    """Ranks with the last judgment of their pair; without one Unknown, 0 and an empty reason."""
    last = last_record(judgments.select("source", "target", "judgment", "confidence", "reason", order), ["source", "target"], [order]).drop(order)
    joined = ranks.join(last, ["source", "target"], "left")
    return joined.na.fill({"judgment": "Unknown", "confidence": 0, "reason": ""})


def unordered(df: DataFrame, a: str = "source", b: str = "target") -> DataFrame:
    """a <= b, with the other columns; loops are dropped."""
    rest = [c for c in df.columns if c not in (a, b)]
    return df.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), *rest)


def edges_by_max(df: DataFrame) -> DataFrame:
    return unordered(df).groupBy("a", "b").agg(F.max("sim").alias("sim"))


def edges_by_last(df: DataFrame, order: str) -> DataFrame:
    return unordered(df).groupBy("a", "b").agg(F.max_by("sim", order).alias("sim"))


def edges_by_view(df: DataFrame, order: str, preferred: str = "perspective") -> DataFrame:
    """The last record of the preferred view, or else the first record."""
    d = unordered(df)
    rest = [c for c in d.columns if c not in ("a", "b")]
    is_view = F.col("type") == preferred
    value = F.struct(*rest)
    return d.groupBy("a", "b").agg(F.coalesce(F.max_by(F.when(is_view, value), F.when(is_view, F.col(order))), F.min_by(value, order)).alias("x")).select("a", "b", *[F.col(f"x.{c}").alias(c) for c in rest])


def node_images(df: DataFrame, order: str) -> DataFrame:
    """The last image that is not empty, of each node on either side."""
    both = df.select(F.col("source").alias("node"), F.col("source_image").alias("path"), order).unionAll(df.select(F.col("target").alias("node"), F.col("target_image").alias("path"), order))
    return both.filter("path <> ''").groupBy("node").agg(F.max_by("path", F.struct(order, "path")).alias("path"))


def first_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """dropDuplicates with a defined survivor."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
