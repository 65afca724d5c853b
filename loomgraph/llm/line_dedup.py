"""Reversible line deduplication over sharded cuckoo filters and exact reference counts.

The key of a line is the line without `[\\x20\\x09-\\x0D]` at both ends and with A-Z in lower case. Keys of MIN_CHARS code
points or more are counted, by a 128-bit digest, once for each document that holds them. The exact table of
references (digest, n_docs, keep_id) comes from one aggregation with map-side partials, so a line that a third of all
documents share costs one row for each task. Digests with MIN_DOCS documents or more are blocked: their lines go,
except in the largest document id that holds them.

The blocked digests are dealt over shards by their first bytes, each small enough for one task, and each shard has a
cuckoo filter of them. The filters take about 5 bytes a key; they are broadcast and turn away nearly all other lines of
a batch at once, in a few array operations. What passes is decided by the exact table: by search in its sorted rows (24
bytes a key), broadcast too while both stay under BROADCAST_BYTES; beyond that by a salted join, to which only the lines
that passed the filters go, and only documents that lose lines are matched to their list. Where even the filters would
not fit, all long lines are joined.

line_state.LineDedupState is the incremental form, in a folder.

Defined results: null or empty text is one empty line. Rows that repeat a document id count one by one, and each of
them keeps its lines if the id is the largest. A null id counts as a document and is never the largest; where only
null ids hold a line, all of them lose it. Other columns are
passed through only where `carry` names them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import checkpointed, small_batches

MIN_CHARS = 40
MIN_DOCS = 5
#: Blocked keys in one shard, on average.
SHARD_KEYS = 65_536
#: Filters and exact rows are broadcast up to this size, of this many bytes a blocked key; else filters alone.
BROADCAST_BYTES = 64 << 20
KEY_BYTES, FILTER_BYTES = 32, 6
SALTS = 16
#: The keep_id of lines that only null ids hold.
NO_ID = -(2**63)
#: White space at the ends of a line; bytes.strip() would be the same set, str.strip() would not.
BLANK = " \t\n\x0b\x0c\r"
_LOWER = {i: i + 32 for i in range(65, 91)}


def line_key(line: str) -> str:
    return line.strip(BLANK).translate(_LOWER) if not line.isascii() else line.strip(BLANK).lower()


def digest(key: str) -> bytes:
    return hashlib.blake2b(key.encode(), digest_size=16).digest()


class CuckooFilter:
    """Four 16-bit fingerprints a bucket, two buckets a key; supports insertion and deletion of single keys."""

    SLOTS, KICKS, MIX = 4, 500, 0x5BD1E995

    def __init__(self, n_keys: int, table: np.ndarray | None = None):
        self.n_buckets = 1 << max(1, int(np.ceil(np.log2(max(1, n_keys) / self.SLOTS / 0.8)))) if table is None else len(table)
        self.table = np.zeros((self.n_buckets, self.SLOTS), dtype=np.uint16) if table is None else table
        self._seed = 1

    @staticmethod
    def _mix(mark: int) -> int:
        return mark * CuckooFilter.MIX

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[4:6], "little") or 1
        first = int.from_bytes(key[8:16], "little") & (self.n_buckets - 1)
        return mark, first, (first ^ self._mix(mark)) & (self.n_buckets - 1)

    def insert(self, key: bytes) -> bool:
        """False: the filter is full; build a larger one from the exact rows."""
        mark, first, second = self._places(key)
        for at in (first, second):
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return True
        at = second
        for _ in range(self.KICKS):
            self._seed = (self._seed * 1103515245 + 12345) & 0x7FFFFFFF
            slot = (self._seed >> 16) % self.SLOTS
            mark, self.table[at, slot] = int(self.table[at, slot]), mark
            at = (at ^ self._mix(mark)) & (self.n_buckets - 1)
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return True
        return False

    def delete(self, key: bytes) -> bool:
        mark, first, second = self._places(key)
        for at in (first, second):
            here = np.flatnonzero(self.table[at] == mark)
            if len(here):
                self.table[at, here[0]] = 0
                return True
        return False

    def __contains__(self, key: bytes) -> bool:
        mark, first, second = self._places(key)
        return bool((self.table[first] == mark).any() or (self.table[second] == mark).any())

    @classmethod
    def of(cls, keys: list[bytes]) -> CuckooFilter:
        room = len(keys)
        while True:
            built = cls(room)
            if all(built.insert(k) for k in keys):
                return built
            room = 2 * max(1, room)


def memberships(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, row: Column | None = None) -> DataFrame:
    """(digest, doc_id): each long key once for each row of docs; with `row`, that string of the row beside them."""
    small_batches(docs.sparkSession)
    names = ["digest", "doc_id", *(["row"] if row is not None else [])]

    def keys(batches):
        for batch in batches:
            marks, ids, rows = [], [], []
            for n, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                found = {k for k in map(line_key, (text or "").split("\n")) if len(k) >= min_chars}
                marks += map(digest, found)
                ids += [doc] * len(found)
                rows += [n] * len(found)
            more = [batch.column(2).take(pa.array(rows, pa.int64()))] if len(names) > 2 else []
            yield pa.RecordBatch.from_arrays([pa.array(marks, pa.binary()), pa.array(ids, pa.int64()), *more], names)

    picked = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *([row.alias("row")] if row is not None else [])]
    return docs.select(*picked).mapInArrow(keys, "digest binary, doc_id long" + ", row string" * (row is not None))


def references(members: DataFrame) -> DataFrame:
    """The exact table: digest, n_docs, keep_id."""
    return members.groupBy("digest").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keep_id"))


def shard_filters(blocked: DataFrame, n_shards: int) -> DataFrame:
    """shard, filter: a cuckoo filter of each shard's digests, into which they are inserted one by one."""

    def build(rows: pa.Table) -> pa.Table:
        made = CuckooFilter.of(sorted(rows["digest"].to_pylist()))
        return pa.table({"shard": rows["shard"].slice(0, 1), "filter": pa.array([made.table.tobytes()], pa.binary())})

    return blocked.select(shard_of(n_shards).alias("shard"), "digest").groupBy("shard").applyInArrow(build, "shard int, filter binary")


def shard_of(n_shards: int) -> Column:
    return (F.conv(F.hex(F.substring("digest", 1, 3)), 16, 10).cast("int") % n_shards).cast("int")


class Filters:
    """The filters of all shards, for many keys at once."""

    def __init__(self, rows: list[tuple[int, bytes]], n_shards: int):
        tables = {shard: np.frombuffer(table, dtype=np.uint16).reshape(-1, CuckooFilter.SLOTS) for shard, table in rows}
        none = np.zeros((1, CuckooFilter.SLOTS), dtype=np.uint16)
        tables = [tables.get(k, none) for k in range(n_shards)]
        self.mask = np.array([len(t) - 1 for t in tables], dtype=np.uint64)
        self.begin = np.cumsum([0] + [len(t) for t in tables[:-1]], dtype=np.uint64)
        self.table = np.concatenate(tables)

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        """keys: rows of 16 bytes."""
        if not len(keys):
            return np.zeros(0, dtype=bool)
        whole = keys.astype(np.uint64)
        shard = ((whole[:, 0] << np.uint64(16)) + (whole[:, 1] << np.uint64(8)) + whole[:, 2]) % np.uint64(len(self.mask))
        mark = whole[:, 4] + (whole[:, 5] << np.uint64(8))
        mark[mark == 0] = 1
        first = np.ascontiguousarray(keys[:, 8:16]).view("<u8")[:, 0]
        mask, begin = self.mask[shard], self.begin[shard]
        one, two = first & mask, (first ^ mark * np.uint64(CuckooFilter.MIX)) & mask
        marks = mark.astype(np.uint16)[:, None]
        return (self.table[one + begin] == marks).any(axis=1) | (self.table[two + begin] == marks).any(axis=1)


def _keys(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype=np.uint8).reshape(-1, 16)


class Blocked:
    """The exact rows of all blocked digests, sorted, behind the filters."""

    def __init__(self, filters: Filters, digests: bytes, keep_ids: bytes):
        self.filters = filters
        order = np.argsort(np.frombuffer(digests, dtype="S16"), kind="stable")
        self.digests, self.keep_ids = np.frombuffer(digests, dtype="S16")[order], np.frombuffer(keep_ids, dtype=np.int64)[order]

    def goes(self, digests: list[bytes], docs: list[int | None]) -> np.ndarray:
        """For each line, by its digest and the document that holds it."""
        keys = _keys(digests)
        out = self.filters.may_hold(keys)
        passed = np.flatnonzero(out)
        if len(passed):
            asked = np.ascontiguousarray(keys[passed]).view("S16")[:, 0]
            at = np.minimum(np.searchsorted(self.digests, asked), len(self.digests) - 1)
            null = np.array([docs[i] is None for i in passed])
            own = np.array([docs[i] or 0 for i in passed], dtype=np.int64)
            out[passed] = (self.digests[at] == asked) & (null | (self.keep_ids[at] != own))
        return out


def _long_lines(texts: list[str | None], min_chars: int) -> tuple[list[list[str]], list[tuple[int, int]], list[bytes]]:
    """The lines of each text; of those with a long key, their places (text, line) and digests."""
    lines = [(t or "").split("\n") for t in texts]
    places, digests = [], []
    for n, some in enumerate(lines):
        for i, x in enumerate(some):
            if len(x) >= min_chars and len(k := line_key(x)) >= min_chars:
                places.append((n, i))
                digests.append(digest(k))
    return lines, places, digests


def _without(lines: list[list[str]], gone: list[tuple[int, int]]) -> tuple[list[str], list[int], list[int]]:
    """Texts without the lines at these places, numbers of lines, and of those that went."""
    counts, lost = list(map(len, lines)), [0] * len(lines)
    for n, i in gone:
        lines[n][i] = None
        lost[n] += 1
    return ["\n".join(some if not k else [x for x in some if x is not None]) for some, k in zip(lines, lost)], counts, lost


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs as doc_id, text without blocked lines, n_lines, n_dropped, then the columns of carry."""
    refs = references(memberships(docs, id_col, text_col, min_chars))
    return drop_blocked(docs, checkpointed(refs.filter(F.col("n_docs") >= min_docs)), id_col, text_col, carry, min_chars, broadcast_bytes)


def drop_blocked(docs: DataFrame, blocked: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), min_chars: int = MIN_CHARS, broadcast_bytes: int = BROADCAST_BYTES, filters: DataFrame | None = None, n_shards: int = 0) -> DataFrame:
    """blocked: digest, keep_id. filters (shard, filter) over n_shards may be given where they exist."""
    spark = docs.sparkSession
    small_batches(spark)
    n_keys = blocked.count()
    if filters is None:
        n_shards = max(1, -(-n_keys // SHARD_KEYS))
        filters = shard_filters(blocked, n_shards)
    rest = docs.select(*carry).schema.fields
    source = docs.select(F.col(id_col).cast("long").alias("__0"), F.col(text_col).cast("string").alias("__1"), *[F.col(c).alias(f"__{i + 2}") for i, c in enumerate(carry)])
    kinds = ", ".join(f"__{i + 2} {f.dataType.simpleString()}" for i, f in enumerate(rest))
    schema = "__0 long, __1 string, n_lines long, n_dropped long" + f", {kinds}" * bool(kinds)

    def emit(batch, texts, counts, lost):
        kept = [batch.column(f"__{i + 2}") for i in range(len(carry))]
        made = [batch.column("__0"), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(lost, pa.int64()), *kept]
        return pa.RecordBatch.from_arrays(made, ["__0", "__1", "n_lines", "n_dropped", *[f"__{i + 2}" for i in range(len(carry))]])

    known = None
    if n_keys * FILTER_BYTES <= broadcast_bytes:
        known = spark.sparkContext.broadcast([(r.shard, bytes(r.filter)) for r in filters.collect()])
    if n_keys * KEY_BYTES <= broadcast_bytes:
        rows = blocked.select("digest", F.coalesce("keep_id", F.lit(NO_ID)).alias("keep_id")).toArrow()
        exact = spark.sparkContext.broadcast((b"".join(rows["digest"].to_pylist()), rows["keep_id"].to_numpy().tobytes()))

        def mapped(batches):
            look = Blocked(Filters(known.value, n_shards), *exact.value)
            for batch in batches:
                docs, (lines, places, digests) = batch.column("__0").to_pylist(), _long_lines(batch.column("__1").to_pylist(), min_chars)
                gone = look.goes(digests, [docs[n] for n, _ in places])
                yield emit(batch, *_without(lines, [places[i] for i in np.flatnonzero(gone)]))

        out = source.mapInArrow(mapped, schema)
    else:
        # rows of the same id and text lose the same lines, so these two are the key of a row; salts spread its copies
        row = F.md5(F.coalesce("__1", F.lit("")))
        salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
        salts = F.explode(F.array(*map(F.lit, range(SALTS))))
        lines = memberships(source, "__0", "__1", min_chars, row)
        if known is not None:
            lines = lines.mapInArrow(_passing(known, n_shards), lines.schema)
        lines = lines.withColumn("salt", salt)
        salted = blocked.select("digest", F.coalesce("keep_id", F.lit(NO_ID)).alias("keep_id"), salts.alias("salt"))
        lost = lines.join(salted, ["digest", "salt"]).filter(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy(F.col("doc_id").alias("__doc"), F.col("row").alias("__row")).agg(F.collect_set("digest").alias("__gone"))
        lost = lost.select("*", salts.alias("__salt"))

        def joined(batches):
            for batch in batches:
                gone = [set(g or ()) for g in batch.column("__gone").to_pylist()]
                lines, places, digests = _long_lines(batch.column("__1").to_pylist(), min_chars)
                yield emit(batch, *_without(lines, [(n, i) for (n, i), k in zip(places, digests) if k in gone[n]]))

        keyed = source.withColumns({"__r": row, "__s": salt})
        here = F.col("__0").eqNullSafe(F.col("__doc")) & (F.col("__r") == F.col("__row")) & (F.col("__s") == F.col("__salt"))
        out = keyed.join(lost, here, "left").drop("__doc", "__row", "__salt", "__r", "__s").mapInArrow(joined, schema)
    return out.select(F.col("__0").alias(id_col), F.col("__1").alias(text_col), "n_lines", "n_dropped", *[F.col(f"__{i + 2}").alias(c) for i, c in enumerate(carry)])


def _passing(known, n_shards: int):
    def passing(batches):
        filters = Filters(known.value, n_shards)
        for batch in batches:
            yield batch.filter(pa.array(filters.may_hold(_keys(batch.column("digest").to_pylist()))))

    return passing
