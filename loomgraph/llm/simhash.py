"""SimHash near-duplicates within 3 differing bits, by meet-in-the-middle ball hashing.

Fingerprints are made distinct first, so copies cost nothing. Two of them within 3 bits need not have a common
neighbour at half that distance, as 3 is odd; so one of three blocks of bits is masked at a time. For any pair within
3 bits there is a mask under which the open bits differ in at most 2 places, and then both fingerprints emit a common
variant: every fingerprint emits, for each mask, its open bits and all their variants with one bit flipped (131 keys).
The keys are shuffled and sorted, fingerprints that meet under a key are verified by their full distance, and each
verified pair is reported under one key only.

One key holds at most 1/131 of the rows, because the fingerprints are distinct and emit each key once, so no key is
hot. Short runs of a key are compared in a sliding window. For longer ones the masked bits, of 22 at most, are looked
up in the run itself (those that differ in 1 bit link any two that meet; those with equal open bits may differ in 3),
which is linear in the run: no group is expanded into all pairs. The links of a batch are reduced to a forest before
they leave the task.

Defined results: null and empty text have fingerprint zero and link like any other. Rows that repeat a document id
keep their own fingerprints and both components are named by the smallest id in them. Null ids are never a component's
name unless it has no other. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from loomgraph.llm.common import checkpointed, small_batches
from loomgraph.llm.components import components

BITS, RADIUS = 64, 3
WORDS = 3
SEED = 42
#: The masked blocks: first bit, width.
BLOCKS = ((0, 21), (21, 21), (42, 22))
#: Runs of one key up to this length are compared in a window.
WINDOW = 16
ROWS_AT_ONCE = 50_000
#: Fingerprints whose variants one task emits, at most.
ROWS_A_TASK = 200_000


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """bytes.lower() and bytes.split() change and split at ASCII alone, as asked for."""
    import xxhash

    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    shingles = [b" ".join(parts)] if len(parts) < words else map(b" ".join, zip(*[parts[i:] for i in range(words)]))
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), dtype="<u8")
    set_bits = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        set_bits += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed long."""
    small_batches(docs.sparkSession)

    def mark(batches):
        for batch in batches:
            made = np.array([fingerprint(t, words, seed) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(mark, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _open(block: int) -> int:
    at, width = BLOCKS[block]
    return (1 << 64) - 1 ^ ((1 << width) - 1 << at)


def variants(fps: DataFrame) -> DataFrame:
    """fp, mask, key: the open bits of each mask, and all their variants with one flipped bit."""
    made = []
    for block in range(len(BLOCKS)):
        open_bits = F.col("fp").bitwiseAND(F.lit(_signed(_open(block))))
        flips = [0] + [1 << i for i in range(BITS) if _open(block) >> i & 1]
        made.append(F.transform(F.array(*[F.lit(_signed(x)) for x in flips]), _flipped(open_bits, block)))
    return fps.select("fp", F.explode(F.concat(*made)).alias("v")).select("fp", F.col("v.mask").alias("mask"), F.col("v.key").alias("key"))


def _flipped(open_bits, block: int):
    return lambda x: F.struct(F.lit(block).cast("int").alias("mask"), open_bits.bitwiseXOR(x).alias("key"))


def _pairs_of_run(fps: np.ndarray, key: int, block: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what this key connects, for a long run, in time linear in the run."""
    at, width = BLOCKS[block]
    open_mask = np.uint64(_open(block))
    masked = ((fps & ~open_mask) >> np.uint64(at)).astype(np.uint64)
    order = np.argsort(masked, kind="stable")
    masked, fps = masked[order], fps[order]
    values, first = np.unique(masked, return_index=True)
    lead = fps[first]
    # equal masked bits: the open bits differ in 2 places at most
    out = [(fps, lead[np.searchsorted(values, masked)])]

    def met(values, lead, flips):
        for flip in flips:
            other = values ^ np.uint64(flip)
            place = np.minimum(np.searchsorted(values, other), len(values) - 1)
            hit = (values[place] == other) & (values < other)
            if hit.any():
                out.append((lead[hit], lead[place[hit]]))

    met(values, lead, [1 << i for i in range(width)])
    same = (fps & open_mask) == np.uint64(key)  # open bits equal to the key: the masked ones may differ in 2 or 3
    if same.sum() > 1:
        flips = [1 << i | 1 << j for i in range(width) for j in range(i)] + [1 << i | 1 << j | 1 << k for i in range(width) for j in range(i) for k in range(j)]
        v, f = masked[same], fps[same]
        if len(v) <= len(flips):
            for i in range(len(v) - 1):
                hit = np.bitwise_count(v[i + 1 :] ^ v[i]) <= RADIUS
                out.append((np.repeat(f[i], hit.sum()), f[i + 1 :][hit]))
        else:
            met(v, f, flips)
    return out


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the same as the links a - b, fewer than there are ends."""
    ends, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    up = np.arange(len(ends))
    x, y = at[: len(a)], at[len(a) :]
    while True:  # hook the larger root to the smaller, then shorten the paths
        rx, ry = up[x], up[y]
        if (rx == ry).all():
            break
        np.minimum.at(up, np.maximum(rx, ry), np.minimum(rx, ry))
        while (up[up] != up).any():
            up = up[up]
    child = up != np.arange(len(ends))
    return ends[child], ends[up[child]]


def _links(fps: np.ndarray, masks: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified links between fingerprints that meet; fps, masks and keys are sorted by mask and key."""
    a, b = [], []
    cut = np.flatnonzero((masks[1:] != masks[:-1]) | (keys[1:] != keys[:-1])) + 1
    first = np.concatenate([[0], cut])
    sizes = np.diff(np.concatenate([first, [len(keys)]]))
    run = np.repeat(np.arange(len(first)), sizes)
    short = np.repeat(sizes <= WINDOW, sizes)
    for k in range(1, min(WINDOW, int(sizes.max(initial=1)))):
        at = np.flatnonzero((run[k:] == run[:-k]) & short[k:])
        x, y = fps[at], fps[at + k]
        near = np.bitwise_count(x ^ y) <= RADIUS
        a.append(x[near])
        b.append(y[near])
    for r in np.flatnonzero(sizes > WINDOW):
        members = slice(first[r], first[r] + sizes[r])
        for x, y in _pairs_of_run(fps[members], int(keys[first[r]]), int(masks[first[r]])):
            different = x != y
            a.append(x[different])
            b.append(y[different])
    if not a:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
    return _forest(np.concatenate(a), np.concatenate(b))


def links(fps: DataFrame) -> DataFrame:
    """(a, b): verified links that connect the distinct fingerprints in fps(fp) as all pairs within the radius would."""

    def meet(batches):
        held: list[np.ndarray] = []
        rows, enough = 0, ROWS_AT_ONCE

        def emit(columns):
            a, b = _links(columns[0].view(np.uint64), columns[1], columns[2].view(np.uint64))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            rows += batch.num_rows
            if rows < enough:
                continue
            columns = [np.concatenate([h[i] for h in held]) for i in range(3)]
            begin = np.flatnonzero((columns[1] != columns[1][-1]) | (columns[2] != columns[2][-1]))
            whole = int(begin[-1]) + 1 if len(begin) else 0  # the last key may go on
            if whole:
                yield emit([c[:whole] for c in columns])
            held = [[c[whole:] for c in columns]]
            rows -= whole
            enough = max(ROWS_AT_ONCE, 2 * rows)  # a run longer than that is not copied at every batch
        if held and len(held[0][0]):
            yield emit([np.concatenate([h[i] for h in held]) for i in range(3)])

    # each fingerprint becomes 131 rows, so the few bytes of the fingerprints are dealt over all tasks before that
    dealt = fps.select("fp").repartition(_tasks(fps), "fp")
    met = variants(dealt).repartition("mask", "key").sortWithinPartitions("mask", "key")
    return met.mapInArrow(meet, "a long, b long")


def _tasks(fps: DataFrame) -> int:
    """Tasks that emit variants: as many as shuffles have, and more where a task would hold over ROWS_A_TASK fingerprints."""
    return max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-fps.count() // ROWS_A_TASK))


def _named(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """doc_id, fp of every row; and fp, root, component_id of every distinct fingerprint."""
    marked = checkpointed(fingerprints(docs, id_col, text_col, words, seed))
    nodes = checkpointed(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = components(links(nodes.select("fp")))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least_id", "root")
    linked = rooted.filter("root is not null")
    named = linked.join(linked.groupBy("root").agg(F.min("least_id").alias("component_id")), "root").select("fp", "root", "component_id")
    return marked, checkpointed(named.unionAll(rooted.filter("root is null").select("fp", F.col("fp").alias("root"), F.col("least_id").alias("component_id"))))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id; one row per row of docs."""
    marked, names = _named(docs, id_col, text_col, words, seed)
    return marked.join(names.select("fp", "component_id"), "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of every component the row that names it, with all its columns.

    Ids are looked up alone, so texts are not moved for that. Only rows whose id is null or repeated, and names a
    component, are marked again: of those in the component one stays, the first by the hashes of its text and of the row.
    """
    marked, names = _named(docs, id_col, text_col)
    winners = names.select(F.col("component_id").alias("kept")).distinct()
    found = marked.groupBy(F.col("doc_id").alias("kept")).agg(F.count(F.lit(1)).alias("n"))
    repeated = checkpointed(found.filter("n > 1 and kept is not null").select("kept").join(winners, "kept", "left_semi"))
    none = not names.filter("component_id is null").isEmpty()
    rows = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names of our own cannot clash
    doc, text = (rows[f"c{docs.columns.index(c)}"] for c in (id_col, text_col))
    some = not repeated.isEmpty()
    single = winners.join(repeated, "kept", "left_anti") if some else winners
    kept = rows.join(single, doc == F.col("kept"), "left_semi")
    if some or none:
        again = rows.filter(doc.isNull()) if none else rows.limit(0)
        if some:
            again = again.unionAll(rows.join(repeated, doc == F.col("kept"), "left_semi"))
        kept = kept.unionAll(_first_of_each(again, names, *(f"c{docs.columns.index(c)}" for c in (id_col, text_col))))
    return kept.toDF(*docs.columns)


def _first_of_each(rows: DataFrame, names: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of every component one of the rows whose id is its name."""
    small_batches(rows.sparkSession)
    at = rows.columns.index(text_col)

    def mark(batches):
        for batch in batches:
            made = np.array([fingerprint(t) for t in batch.column(at).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.int64())], [*batch.schema.names, "fp"])

    marked = rows.mapInArrow(mark, StructType([*rows.schema.fields, StructField("fp", LongType())]))
    own = marked.join(names, "fp").filter(F.col(id_col).eqNullSafe(F.col("component_id")))
    order = F.struct(F.sha2(F.coalesce(text_col, F.lit("")), 256), F.sha2(F.to_json(F.struct(*rows.columns)), 256))
    return own.groupBy("root").agg(F.min_by(F.struct(*rows.columns), order).alias("row")).select("row.*")
