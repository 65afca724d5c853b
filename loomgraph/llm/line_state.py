"""The incremental form of line deduplication: memberships, exact reference counts and cuckoo filters in a folder.

Everything is kept in runs. A change writes one run of each kind, of as many rows as it concerns: memberships (digest,
document, n), the new counts of the digests it touches, and the filters of the shards in which a digest reached the limit
or fell below it. Where a run is not much smaller than the one before, the two become one, so there are few runs and a
row is written again a logarithmic number of times. Memberships add up over the runs; of counts and filters the latest
row holds. What a change writes follows the change; what it reads of the counts are the rows of its digests.

A digest that reaches MIN_DOCS is inserted into its shard's filter, one that falls below is deleted from it, and its
lines come back; only a full filter is built again from the counts. Shards hold few keys, so that a change rewrites
little, and grow in number with the blocked keys: when these outgrow them, all filters are built anew for twice as many.

A manifest, written last, names the runs, so a failed change leaves the former state, and other sessions find the state
as it is. Runs that no manifest names any more are deleted by `clean`, as no session reads an older state then.

Defined results: as of line_dedup. Deleting an id deletes all its rows, null included; unknown ids change nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import checkpointed
from loomgraph.llm.line_dedup import BROADCAST_BYTES, MIN_CHARS, MIN_DOCS, CuckooFilter, drop_blocked, memberships, shard_filters, shard_of

#: Blocked keys in one shard of a state, at most on average.
SHARD_KEYS = 256
#: Two neighbouring runs become one unless the later is so many times smaller.
RATIO = 4
#: Parts of the memberships, by document.
BUCKETS = 64

SCHEMAS = {
    "members": "digest binary, doc_id long, n long, bucket int",
    "counts": "digest binary, n_docs long, keep_id long, at int",
    "filters": "shard int, filter binary, at int",
}
MANIFEST = "generation int, min_chars int, min_docs int, shard_keys int, n_shards int, n_blocked long, runs array<struct<kind: string, name: string, rows: bigint>>"


class LineDedupState:
    """Memberships, exact counts and filters under `path`, which all machines share; insert and delete are exact.

    A document is inserted once; inserting an id again adds its lines again. `apply` drops the lines that the present
    state blocks. One session changes a state at a time; any session reads it.
    """

    def __init__(self, spark: SparkSession, path: str, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS):
        self.spark, self.path, self.min_chars, self.min_docs, self.shard_keys = spark, path.rstrip("/"), min_chars, min_docs, shard_keys
        self.n_shards, self.n_blocked, self.generation = 1, 0, 0
        self.runs: dict[str, list[tuple[str, int]]] = {kind: [] for kind in SCHEMAS}
        if self._exists(f"{self.path}/manifest"):
            rows = spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest").orderBy(F.desc("generation")).limit(1).collect()
            for r in rows:
                self.generation, self.min_chars, self.min_docs, self.shard_keys, self.n_shards, self.n_blocked = r.generation, r.min_chars, r.min_docs, r.shard_keys, r.n_shards, r.n_blocked
                for run in r.runs:
                    self.runs[run.kind].append((run.name, run.rows))

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def _rows(self, kind: str, runs: list[tuple[str, int]] | None = None) -> DataFrame:
        names = [name for name, n in (self.runs[kind] if runs is None else runs) if n]
        read = [self.spark.read.schema(SCHEMAS[kind]).parquet(f"{self.path}/{kind}/{name}") for name in names]
        out = self.spark.createDataFrame([], SCHEMAS[kind])
        for df in read:
            out = out.unionByName(df)
        return out

    @staticmethod
    def _latest(rows: DataFrame, key: str, *values: str) -> DataFrame:
        last = F.max_by(F.struct(*values, "at"), "at").alias("x")
        return rows.groupBy(key).agg(last).select(key, *[F.col(f"x.{v}").alias(v) for v in (*values, "at")])

    def counts(self) -> DataFrame:
        """The exact references: digest, n_docs, keep_id."""
        return self._latest(self._rows("counts"), "digest", "n_docs", "keep_id").filter("n_docs > 0").drop("at")

    def filters(self) -> DataFrame:
        """shard, filter."""
        return self._latest(self._rows("filters"), "shard", "filter").drop("at")

    def blocked(self) -> DataFrame:
        return self.counts().filter(F.col("n_docs") >= self.min_docs)

    def insert(self, docs: DataFrame) -> None:
        self._change(memberships(docs, min_chars=self.min_chars).withColumn("n", F.lit(1).cast("long")))

    def delete(self, doc_ids: DataFrame) -> None:
        gone = checkpointed(doc_ids.select(F.col("doc_id").cast("long").alias("__gone"), self._bucket("doc_id").alias("__bucket")).distinct())
        buckets = [r[0] for r in gone.select("__bucket").distinct().collect()]  # BUCKETS of them at most
        here = self._rows("members").filter(F.col("bucket").isin(buckets))
        members = here.join(gone, F.col("doc_id").eqNullSafe(F.col("__gone")) & (F.col("bucket") == F.col("__bucket")), "left_semi")
        self._change(members.groupBy("digest", "doc_id").agg((-F.sum("n")).alias("n")).filter("n < 0"))

    @staticmethod
    def _bucket(column: str):
        return F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(BUCKETS)).cast("int")

    def _write(self, kind: str, rows: DataFrame, name: str) -> tuple[str, int]:
        columns = [c.split()[0] for c in SCHEMAS[kind].split(", ")]
        writer = rows.select(*columns).write.mode("overwrite")
        (writer.partitionBy("bucket") if kind == "members" else writer).parquet(f"{self.path}/{kind}/{name}")
        return name, self._rows(kind, [(name, 1)]).count()

    def _levelled(self, kind: str, runs: list[tuple[str, int]], new: int) -> list[tuple[str, int]]:
        """The runs, the last ones as one where they are of like size."""
        runs = [r for r in runs if r[1]]
        start, size = len(runs) - 1, runs[-1][1] if runs else 0
        while start > 0 and size * RATIO >= runs[start - 1][1]:
            start -= 1
            size += runs[start][1]
        if start >= len(runs) - 1:
            return runs
        rows = self._rows(kind, runs[start:])
        if kind == "members":
            merged = rows.groupBy("digest", "doc_id", "bucket").agg(F.sum("n").alias("n")).filter("n <> 0")
        elif kind == "counts":
            merged = self._latest(rows, "digest", "n_docs", "keep_id")
            merged = merged if start else merged.filter("n_docs > 0")  # nothing older is left to be overruled
        else:
            merged = self._latest(rows, "shard", "filter")
        return [*runs[:start], self._write(kind, merged.repartition("digest" if kind != "filters" else "shard"), f"{new:09d}-levelled")]

    def _change(self, changed: DataFrame) -> None:
        """changed: digest, doc_id, n rows to add."""
        new = self.generation + 1
        name = f"{new:09d}"
        runs = {kind: list(some) for kind, some in self.runs.items()}
        added = checkpointed(changed.groupBy("digest", "doc_id").agg(F.sum("n").alias("n")).withColumn("bucket", self._bucket("doc_id")))
        runs["members"].append(self._write("members", added, name))
        delta = checkpointed(added.groupBy("digest").agg(F.sum("n").alias("n"), F.max(F.when(F.col("n") > 0, F.col("doc_id"))).alias("most"), F.max(F.when(F.col("n") < 0, F.col("doc_id"))).alias("most_gone")))
        old = self._latest(self._rows("counts").join(delta.select("digest"), "digest", "left_semi"), "digest", "n_docs", "keep_id").select("digest", F.col("n_docs").alias("before"), F.when(F.col("n_docs") > 0, F.col("keep_id")).alias("keep_id"))
        before = F.coalesce("before", F.lit(0))
        both = delta.join(old, "digest", "left").select("digest", before.alias("before"), (before + F.col("n")).alias("n_docs"), F.greatest("keep_id", "most").alias("keep_id"), (F.col("most_gone") >= F.col("keep_id")).alias("lost"))
        both = checkpointed(both)
        # where the largest document went, the next one is looked up: one pass over the memberships of those digests
        lost = both.filter("lost and n_docs > 0").select("digest")
        largest = self._rows("members", runs["members"]).join(lost, "digest", "left_semi").groupBy("digest", "doc_id").agg(F.sum("n").alias("n")).filter("n > 0").groupBy("digest").agg(F.max("doc_id").alias("next"))
        exact = both.join(largest, "digest", "left").select("digest", "n_docs", F.when(F.col("lost"), F.col("next")).otherwise(F.col("keep_id")).alias("keep_id"), F.lit(new).alias("at"))
        runs["counts"].append(self._write("counts", exact, name))

        held = lambda c: (F.col(c) >= self.min_docs).cast("int")
        crossed = checkpointed(both.select("digest", (held("n_docs") - held("before")).alias("turn")).filter("turn <> 0"))
        n_blocked = self.n_blocked + (crossed.agg(F.sum("turn")).first()[0] or 0)
        n_shards = self.n_shards
        blocked = self._latest(self._rows("counts", runs["counts"]), "digest", "n_docs", "keep_id").filter(F.col("n_docs") >= self.min_docs).select("digest")
        if n_blocked > n_shards * self.shard_keys:
            n_shards = 2 * -(-n_blocked // self.shard_keys)
            runs["filters"] = [self._write("filters", shard_filters(blocked, n_shards).withColumn("at", F.lit(new)), name)]
        else:
            turned = self._turned(crossed.withColumn("shard", shard_of(n_shards)), blocked, n_shards)
            runs["filters"].append(self._write("filters", turned.withColumn("at", F.lit(new)), name))
        runs = {kind: self._levelled(kind, some, new) for kind, some in runs.items()}
        row = (new, self.min_chars, self.min_docs, self.shard_keys, n_shards, n_blocked, [(kind, *run) for kind, some in runs.items() for run in some])
        self.spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={new}")
        self.runs, self.generation, self.n_shards, self.n_blocked = runs, new, n_shards, n_blocked

    def _turned(self, crossed: DataFrame, blocked: DataFrame, n_shards: int) -> DataFrame:
        """shard, filter of the shards with a key that crossed the limit: these are inserted and deleted; a full filter is built again."""

        def turn(key, changes: pa.Table, old: pa.Table) -> pa.Table:
            made = set_of_marks(old["filter"][0].as_py()) if old.num_rows else CuckooFilter(0)
            rows = list(zip(changes["digest"].to_pylist(), changes["turn"].to_pylist()))
            whole = all([made.delete(k) for k, by in rows if by < 0]) and all(made.insert(k) for k, by in rows if by > 0)
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([made.table.tobytes() if whole else None], pa.binary())})

        old = self.filters().join(crossed.select("shard").distinct(), "shard", "left_semi")
        turned = checkpointed(crossed.groupBy("shard").cogroup(old.groupBy("shard")).applyInArrow(turn, "shard int, filter binary"))
        full = turned.filter("filter is null").select("shard")
        if full.isEmpty():
            return turned
        again = shard_filters(blocked.withColumn("shard", shard_of(n_shards)).join(full, "shard", "left_semi").select("digest"), n_shards)
        return turned.filter("filter is not null").unionAll(again)

    def clean(self) -> int:
        """Delete the runs that the present manifest does not name; their number."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        gone = 0
        for kind, runs in self.runs.items():
            folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
            system = folder.getFileSystem(conf)
            for status in system.listStatus(folder) if system.exists(folder) else []:
                if status.getPath().getName() not in {name for name, _ in runs}:
                    gone += bool(system.delete(status.getPath(), True))
        return gone

    def apply(self, docs: DataFrame, carry: tuple[str, ...] = (), broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
        return drop_blocked(docs, checkpointed(self.blocked()), carry=carry, min_chars=self.min_chars, broadcast_bytes=broadcast_bytes, filters=self.filters(), n_shards=self.n_shards)


def set_of_marks(table: bytes) -> CuckooFilter:
    return CuckooFilter(0, np.frombuffer(table, dtype=np.uint16).reshape(-1, CuckooFilter.SLOTS).copy())
