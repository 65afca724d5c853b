"""Hierarchical multi-length packing of token streams.

Documents become token ids with an end mark. Whole windows of the longest context leave at once; a rest is routed to
the smallest context size (tier) that holds it. The gap of a tier's window is filled from shorter tiers, longest
pieces first, cutting the last one; what no shorter tier can fill is packed end to end into longest windows. The
last tokens of a task, fewer than one longest window, are cut into windows of powers of two. So every sequence is
exactly as long as its context and nothing is padded.

Sequences of one context size are dealt, within a task, into step groups of STEP_TOKENS tokens, so full steps cost the
same. The last group of each size in a task may be smaller, and those of its last windows are.

Packing runs inside the tasks that read the documents: nothing is shuffled, and a task holds at most PENDING_TOKENS
tokens of open pieces beside one batch. A sequence id is the task's number and a counter, unique in the result; a task
that runs again makes the same sequences from the same rows.

Defined results: null and empty text is the end mark alone. Rows that repeat an id are packed as documents of their
own; null ids stay null. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.bpe import encoder_of, read_file
from loomgraph.llm.common import small_batches

TIERS = (1024, 512, 256, 128)
END_MARK = 0
STEP_TOKENS = 8 * 1024
PENDING_TOKENS = 1 << 20
#: Characters given to the compiled encoder at once.
PIECE_CHARS = 1 << 16


class Packer:
    """Pieces (doc, start, ids) in, sequences out: lists of pieces with their context size."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = tuple(sorted(tiers, reverse=True))
        self.pools: dict[int, list] = {t: [] for t in self.tiers}
        self.pending = 0
        self.out: list[tuple[int, list]] = []

    def _tier(self, n: int) -> int:
        return next(t for t in reversed(self.tiers) if t >= n)

    def _route(self, piece: tuple) -> None:
        if len(piece[2]):
            self.pools[self._tier(len(piece[2]))].append(piece)
            self.pending += len(piece[2])

    def add(self, doc, ids: np.ndarray) -> None:
        longest = self.tiers[0]
        whole = len(ids) // longest * longest
        for at in range(0, whole, longest):
            self.out.append((longest, [(doc, at, ids[at : at + longest])]))
        self._route((doc, whole, ids[whole:].copy()))  # a view would keep the whole document's ids

    def settle(self) -> None:
        """Close every window whose gap the shorter tiers can fill."""
        for k, tier in enumerate(self.tiers):
            shorter = self.tiers[k + 1 :]
            supply = sum(len(p[2]) for t in shorter for p in self.pools[t])
            waiting = []
            for piece in self.pools[tier]:
                gap = tier - len(piece[2])
                if gap > supply:
                    waiting.append(piece)
                    continue
                window = [piece]
                self.pending -= len(piece[2])
                supply -= gap
                while gap:
                    pool = self.pools[next(t for t in shorter if self.pools[t])]
                    doc, start, ids = pool.pop()
                    self.pending -= len(ids)
                    window.append((doc, start, ids[:gap]))
                    self._route((doc, start + gap, ids[gap:]))
                    gap -= len(window[-1][2])
                self.out.append((tier, window))
            self.pools[tier] = waiting

    def _end_to_end(self, sizes) -> None:
        """Cut all that is open, in order, into windows of these sizes."""
        pieces = [p for t in self.tiers for p in self.pools[t]]
        self.pools = {t: [] for t in self.tiers}
        self.pending = 0
        left = pieces[::-1]
        for size in sizes:
            window, room = [], size
            while room:
                doc, start, ids = left.pop()
                window.append((doc, start, ids[:room]))
                if len(ids) > room:
                    left.append((doc, start + room, ids[room:]))
                room -= len(window[-1][2])
            self.out.append((size, window))
        for piece in reversed(left):
            self._route(piece)

    def batch_over(self) -> list[tuple[int, list]]:
        self.settle()
        if self.pending > PENDING_TOKENS:
            self._end_to_end([self.tiers[0]] * (self.pending // self.tiers[0]))
        return self._take()

    def finish(self) -> list[tuple[int, list]]:
        self.settle()
        whole, rest = divmod(self.pending, self.tiers[0])
        self._end_to_end([self.tiers[0]] * whole + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1])
        return self._take()

    def _take(self) -> list[tuple[int, list]]:
        out, self.out = self.out, []
        return out


def tokenizer_of(content: bytes):
    """text -> ids. Where ids are ordered as the merges are, a compiled encoder does the same faster.

    The compiled encoder's word pattern takes stack space for every character of a run of blanks, so it gets at most
    PIECE_CHARS at once, cut before a blank that follows another character, where a word always ends. What has no such
    place for longer than that goes to the streaming encoder.
    """
    encoder = encoder_of(content)
    v = encoder.v
    streamed = lambda text: np.frombuffer(encoder.encode(text), dtype="<u4")
    ordered = sorted(v.ids.values()) == list(range(len(v.ids))) and all(v.ids[v.table[a] + v.table[b]] == 256 + k for (a, b), k in v.rank.items())
    if not ordered or any(encoder.blank.search(s) for s in v.special):
        return streamed
    import tiktoken

    from loomgraph.llm.bpe import WORDS

    compiled = tiktoken.Encoding("loomgraph", pat_str=WORDS, mergeable_ranks=v.ids, special_tokens=v.special)
    special = tuple(v.special)

    def at_once(text: str):
        return compiled.encode(text, allowed_special="all") if any(s in text for s in special) else compiled.encode_ordinary(text)

    def encode(text: str):
        if len(text) <= PIECE_CHARS:
            return at_once(text)
        out, at = [], 0
        while at < len(text):
            end = min(at + PIECE_CHARS, len(text))
            cut = end if end == len(text) else encoder.last_border(text, at, end)
            if cut:
                out.append(np.array(at_once(text[at:cut]), dtype="<u4"))
            else:
                after = encoder.border.search(text, end)
                cut = after.start() if after else len(text)
                out.append(streamed(text[at:cut]))
            at = cut
        return np.concatenate(out)

    return encode


_TOKENIZERS: dict[int, object] = {}


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS, end_mark: int = END_MARK, step_tokens: int = STEP_TOKENS, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, context, step_group and, on request, ids."""
    spark = docs.sparkSession
    small_batches(spark)
    content = spark.sparkContext.broadcast(read_file(path))
    kinds = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64(), "context": pa.int32(), "step_group": pa.int64()}
    if with_ids:
        kinds["ids"] = pa.list_(pa.int64())

    def run(batches):
        from pyspark import TaskContext

        key = zlib.crc32(content.value)
        if key not in _TOKENIZERS:
            _TOKENIZERS[key] = tokenizer_of(content.value)
        encode = _TOKENIZERS[key]
        task = TaskContext.get().partitionId() << 40
        packer, n_sequences, n_groups = Packer(tiers), 0, 0
        open_group: dict[int, tuple[int, int]] = {}  # of each context: its group, sequences that still fit

        def rows(sequences):
            nonlocal n_sequences, n_groups
            columns = {k: [] for k in kinds}
            for context, pieces in sequences:
                group, room = open_group.get(context, (0, 0))
                if not room:
                    group, room = n_groups, max(1, step_tokens // context)
                    n_groups += 1
                open_group[context] = group, room - 1
                offset = 0
                for (doc, total), start, ids in pieces:
                    row = (doc, start, len(ids), zlib.crc32(ids.tobytes()), total, task + n_sequences, offset, context, task + group)
                    for k, value in zip(columns, row):
                        columns[k].append(value)
                    if with_ids:
                        columns["ids"].append(ids.tolist())
                    offset += len(ids)
                n_sequences += 1
            return pa.RecordBatch.from_arrays([pa.array(columns[k], t) for k, t in kinds.items()], list(kinds))

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(np.asarray(encode(text or ""), dtype="<u4"), np.array([end_mark], dtype="<u4"))
                packer.add((doc, len(ids)), ids)
            yield rows(packer.batch_over())
        yield rows(packer.finish())

    schema = ", ".join(f"{k} {'array<long>' if k == 'ids' else 'int' if k == 'context' else 'long'}" for k in kinds)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
