"""Exact deduplication with a heavy-hitter split.

Every text becomes a SHA-256 digest, once; all later steps move (id, digest) rows only. Misra-Gries counters
(Spark's freqItems, an aggregate with map-side partials) name the digests that may hold more than SUPPORT of all
rows. Exact counts verify them; the at most 1/SUPPORT winners are broadcast and resolved on the map side, so the
rows of a huge group are never shuffled. All other digests are resolved by an ordinary shuffle, an aggregate with
map-side partials; the groups of more than one row, of at most SUPPORT of all rows each, are joined to their rows, a
join that Spark splits where a group is larger than a task should be.

Defined results: a null text is empty; empty texts form a group like any other. Rows that repeat one id are counted
one by one, and all rows carrying the winning id are kept. A null id loses against any id; a group of null ids alone
has a null winner and keeps its rows. An empty table gives an empty result. Columns besides id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import checkpointed, lower_ascii, no_null

#: A digest with more than this share of the rows is a heavy hitter; 1 / SUPPORT bounds the counters and the broadcast.
SUPPORT = 0.001


def text_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.sha2(lower_ascii(no_null(F.col(text_col))), 256).alias("text_sha256"))


def heavy_digests(digests: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Verified heavy hitters: text_sha256, keep_id, group_size; at most 1 / support rows."""
    total = digests.count()
    candidates = digests.stat.freqItems(["text_sha256"], support).select(F.explode("text_sha256_freqItems").alias("text_sha256"))
    counted = digests.join(F.broadcast(candidates), "text_sha256", "left_semi").groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return checkpointed(counted.filter(F.col("group_size") > max(1.0, support * total)))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = checkpointed(text_digests(docs, id_col, text_col))
    heavy = heavy_digests(digests, support)
    mapped = digests.join(F.broadcast(heavy), "text_sha256")
    rest = digests.join(F.broadcast(heavy.select("text_sha256")), "text_sha256", "left_anti")
    groups = rest.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    shuffled = rest.join(groups, "text_sha256", "left").withColumns({"keep_id": F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")), "group_size": F.coalesce("group_size", F.lit(1).cast("long"))})
    columns = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"]
    return mapped.select(*columns).unionAll(shuffled.select(*columns))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    kept = exact_dedup(docs, id_col, text_col, support).filter("kept").select(F.col("doc_id").alias("__kept_id")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(F.col("__kept_id")), "left_semi")
