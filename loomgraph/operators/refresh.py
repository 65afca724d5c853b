"""A graph whose degrees, triangles and clustering follow its changes, without starting anew.

The state is a folder of logs: edges, triangles and node counts, each row with a sign or a difference, in one subfolder
for each version. A change writes its own rows alone. Triangles that come or go have a changed edge, so they are found
from the changed edges: the neighbours of the end that has fewer are looked up at the other end. What stands after all
versions is a sum over the logs; `compact` writes these sums as one version.

A version counts once its number is in the folder `commits`, which is written last; a run that is lost leaves parts that
nobody reads and the next run replaces. One writer at a time.

Defined results: edges are undirected, loops and repeats count for nothing, nor do edges that are added though they are
there or removed though they are not. An edge that is both removed and added stays. Nulls are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import graph as g
from loomgraph.sources.shared import checkpointed

SCHEMAS = {
    "edges": "a long, b long, sign int",
    "triangles": "x long, y long, z long, sign int",
    "nodes": "node long, deg long, tri long",
    "commits": "version int, base int",
}


class GraphState:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _commits(self) -> list[tuple[int, int]]:
        """(version, the version that it starts from); a row for each change."""
        if not self._exists("commits"):
            return []
        return sorted((r.version, r.base) for r in self.spark.read.schema(SCHEMAS["commits"]).json(f"{self.folder}/commits").collect())

    @property
    def version(self) -> int:
        return max((v for v, _ in self._commits()), default=-1)

    def _log(self, name: str) -> DataFrame:
        commits = self._commits()
        base = commits[-1][1] if commits else 0
        paths = [f"{self.folder}/{name}/version={v}" for v, _ in commits if v >= base]
        return self.spark.read.schema(SCHEMAS[name]).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMAS[name])

    def edges(self) -> DataFrame:
        """a < b."""
        return self._log("edges").groupBy("a", "b").agg(F.sum("sign").alias("n")).filter("n > 0").select("a", "b")

    def triangles(self) -> DataFrame:
        """x < y < z."""
        return self._log("triangles").groupBy("x", "y", "z").agg(F.sum("sign").alias("n")).filter("n > 0").select("x", "y", "z")

    def clustering(self) -> DataFrame:
        """node, deg, tri, cc, as graph.clustering gives them."""
        n = self._log("nodes").groupBy("node").agg(F.sum("deg").alias("deg"), F.sum("tri").alias("tri")).filter("deg > 0")
        return n.withColumn("cc", F.when(F.col("deg") < 2, 0.0).otherwise(2 * F.col("tri") / (F.col("deg") * (F.col("deg") - 1))))

    def change(self, added: DataFrame | None = None, removed: DataFrame | None = None) -> int:
        """Add and remove edges (a, b); the new version's number."""
        none = self.spark.createDataFrame([], "a long, b long")
        simple = lambda e: g.simple_graph(e.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")), "a", "b")
        plus, minus = simple(none if added is None else added), simple(none if removed is None else removed)
        old = checkpointed(self.edges())
        come = checkpointed(plus.join(old, ["a", "b"], "left_anti"))
        go = checkpointed(minus.join(old, ["a", "b"], "left_semi").join(plus, ["a", "b"], "left_anti"))
        new = old.join(go, ["a", "b"], "left_anti").unionAll(come)
        signed = come.withColumn("sign", F.lit(1)).unionAll(go.withColumn("sign", F.lit(-1)))
        closed = checkpointed(_triangles_of(come, new).withColumn("sign", F.lit(1)).unionAll(_triangles_of(go, old).withColumn("sign", F.lit(-1))))
        ends = signed.select(F.explode(F.array("a", "b")).alias("node"), F.col("sign").cast("long").alias("deg"), F.lit(0).cast("long").alias("tri"))
        corners = closed.select(F.explode(F.array("x", "y", "z")).alias("node"), F.lit(0).cast("long").alias("deg"), F.col("sign").cast("long").alias("tri"))
        nodes = ends.unionAll(corners).groupBy("node").agg(F.sum("deg").alias("deg"), F.sum("tri").alias("tri")).filter("deg <> 0 OR tri <> 0")
        return self._write(signed, closed, nodes, None)

    def compact(self) -> int:
        """One version that stands for all before it; they stay readable until their folders are deleted."""
        edges, triangles = self.edges().withColumn("sign", F.lit(1)), self.triangles().withColumn("sign", F.lit(1))
        return self._write(edges, triangles, self.clustering().select("node", "deg", "tri"), self.version + 1)

    def _write(self, edges: DataFrame, triangles: DataFrame, nodes: DataFrame, base: int | None) -> int:
        commits = self._commits()
        version = self.version + 1
        for name, rows in (("edges", edges), ("triangles", triangles), ("nodes", nodes)):
            kinds = [c.split() for c in SCHEMAS[name].split(", ")]
            rows.select(*[F.col(c).cast(kind).alias(c) for c, kind in kinds]).write.mode("overwrite").parquet(f"{self.folder}/{name}/version={version}")
        start = base if base is not None else commits[-1][1] if commits else 0
        self.spark.createDataFrame([(version, start)], SCHEMAS["commits"]).coalesce(1).write.mode("append").json(f"{self.folder}/commits")
        return version


def _triangles_of(changed: DataFrame, edges: DataFrame) -> DataFrame:
    """x < y < z: the triangles of edges with at least one changed edge, each once."""
    near = changed.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    beside = checkpointed(g.both_ways(edges).join(near, "node", "left_semi"))
    deg = beside.groupBy("node").agg(F.count(F.lit(1)).alias("deg"))
    c = changed.join(deg.select(F.col("node").alias("a"), F.col("deg").alias("da")), "a").join(deg.select(F.col("node").alias("b"), F.col("deg").alias("db")), "b")
    few = F.col("da") <= F.col("db")
    asked = c.select(F.when(few, F.col("a")).otherwise(F.col("b")).alias("node"), F.when(few, F.col("b")).otherwise(F.col("a")).alias("other"))
    thirds = asked.join(beside, "node").join(beside.select(F.col("node").alias("other"), "nbr"), ["other", "nbr"], "left_semi")
    s = F.array_sort(F.array("node", "other", "nbr"))
    return thirds.select(s[0].alias("x"), s[1].alias("y"), s[2].alias("z")).distinct()
