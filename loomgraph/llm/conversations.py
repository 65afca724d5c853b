"""Conversation structure repair by shortest paths with a bucket queue.

Rows of a conversation stand by turn, nulls first; rows of one turn by role, then by a hash of role and text. The first
fault of a row counts: `blank` (white space alone), `duplicate` (role and text as in an earlier row), `truncated` (the
last character that is not white space ends no sentence). The cheapest edits make the initials of the roles read
(s?(ua)+)?: Keep costs 0, Rerole (to user or assistant) 2, Delete 3, Insert (an empty user or assistant row) 2, and a
truncated row that stays 1 more. Blank and duplicate rows must go. Of the cheapest edits, those whose initials come first
in ASCII are taken.

The graph of a conversation has a node for each row yet to be read and each of the four states of the pattern. Costs are
integers of 3 at most, so Dial's queue of four buckets finds the distance of every node to the end, going backwards in
time linear in the rows. A walk from the start along tight arcs, always by the least letter, gives the audit; a letter
leads from a state to one other, so nothing needs to be tried. Rows that must go only add D wherever the walk meets them:
inserting after them is never dearer, and D is the least letter.

No conversation needs to fit into a task. Rows are sorted by ranges of (conversation, turn, role, hash), so a conversation
may span several ranges. Only the first and the last conversation of a range can: for these each range tells its table of
distances from entry to exit state (4 x 4), the tables are chained backwards from the end, each range then tells where
its walk leaves from each entry, and these are chained forwards. Chains are bounded by the number of ranges. A duplicate
is found by the first turn of its role and text, an aggregate with map-side partials.

Defined results: a null role or text is one space. A null conversation id is a conversation of its own. Roles count by
their first character, as it is written. Other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from array import array

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomgraph.llm.common import checkpointed, small_batches

BLANK = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT = "KRDI"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED_COST = 1
#: States: nothing yet, after s, after u, after a. The pattern may end in the first and the last.
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ENDS = (0, None, None, 0)
NAMES = {USER: "user", ASSISTANT: "assistant"}
LETTERS = "sua"
FAULTS = (None, "blank", "duplicate", "truncated")
#: The repeated rows that are broadcast, at most; more are joined.
BROADCAST_ROWS = 200_000

#: A row's code is twice the place of its initial in LETTERS (3 for others), plus 1 if it is truncated; this one must go.
GONE = 8
#: For each code, (letter, from, to, cost) of what may be done with the row.
_ARCS = [
    [(DELETE, p, p, COST[DELETE]) for p in STATES]
    + [(KEEP, p, q, code % 2 * TRUNCATED_COST) for (p, x), q in STEP.items() if LETTERS[code // 2 : code // 2 + 1] == x]
    + [(REROLE, p, q, COST[REROLE] + code % 2 * TRUNCATED_COST) for (p, x), q in STEP.items() if x in "ua"]
    for code in range(8)
]
_INSERTS = [(INSERT, p, q, COST[INSERT]) for (p, x), q in STEP.items() if x in "ua"]
_BACK = [[[(p, cost) for _, p, q, cost in arcs if q == to] for to in STATES] for arcs in _ARCS]
_BEFORE = [[p for _, p, q, _ in _INSERTS if q == to] for to in STATES]
#: For each code and state, (letter, cost, rows read, next state), the least letter first.
_ONWARD = [[sorted((letter, cost, int(letter != INSERT), q) for letter, p, q, cost in arcs + _INSERTS if p == at) for at in STATES] for arcs in _ARCS]
_BUCKETS = 1 + max(cost for arcs in _ARCS for *_, cost in arcs)


def distances(codes: bytes, ends: tuple) -> array:
    """For each row and state (4 x row + state) and for the end, the least cost from there; ends: the costs after the last row, None if it cannot be. -1 where there is no way."""
    known = array("q", [-1]) * (4 * len(codes) + 4)
    starts = sorted((d, 4 * len(codes) + q) for q, d in enumerate(ends) if d is not None)
    buckets: list[list[int]] = [[] for _ in range(_BUCKETS)]
    d = starts[0][0] if starts else 0
    while starts or any(buckets):
        bucket = buckets[d % _BUCKETS]
        while starts and starts[0][0] == d:
            bucket.append(starts.pop(0)[1])
        for node in bucket:  # arcs without cost lengthen it
            if known[node] >= 0:
                continue
            known[node] = d
            row, state = divmod(node, 4)
            for p in _BEFORE[state]:
                if known[4 * row + p] < 0:
                    buckets[(d + COST[INSERT]) % _BUCKETS].append(4 * row + p)
            if row:
                for p, cost in _BACK[codes[row - 1]][state]:
                    if known[4 * row - 4 + p] < 0:
                        buckets[(d + cost) % _BUCKETS].append(4 * row - 4 + p)
        buckets[d % _BUCKETS] = []
        d += 1
    return known


def walk(codes: bytes, ends: tuple, state: int):
    """(place of the row, letter, state) of each edit, the rows that must go among them; an insertion has the place of the next row."""
    live = bytes(c for c in codes if c != GONE)
    known = distances(live, ends)
    at = 0
    for place, code in enumerate(codes):
        if code == GONE:
            yield place, DELETE, state
            continue
        read = 0
        while not read:
            here = known[4 * at + state]
            letter, _, read, state = next(x for x in _ONWARD[code][state] if known[4 * (at + x[2]) + x[3]] >= 0 and here == x[1] + known[4 * (at + x[2]) + x[3]])
            yield place, letter, state
        at += 1
    while known[4 * at + state] != ends[state]:
        state = next(q for _, p, q, cost in _INSERTS if p == state and known[4 * at + p] == cost + known[4 * at + q])
        yield len(codes), INSERT, state


def table_of(codes: bytes) -> list[int | None]:
    """The least cost from each entry state (rows) to each exit state (columns)."""
    live = bytes(c for c in codes if c != GONE)
    lost = COST[DELETE] * (len(codes) - len(live))
    columns = [distances(live, tuple(0 if q == out else None for q in STATES)) for out in STATES]
    return [lost + columns[out][p] if columns[out][p] >= 0 else None for p in STATES for out in STATES]


def _space(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", kinds: int = 20) -> DataFrame:
    """conv_id, turn, role, text with faults by the crc32 of `conv_id:turn`: of `kinds` equal parts, the first five drop a row, empty its text, take its stops, repeat it, or make it the user's."""
    part = F.pmod(F.crc32(F.concat(_space(F.col(conv_col)), F.lit(":"), _space(F.col(turn_col))).cast("binary")), F.lit(kinds))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), _space(F.col(role_col)).alias("role"), _space(F.col(text_col)).alias("text"), part.alias("__part"))
    text = F.when(F.col("__part") == 1, "").when(F.col("__part") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("__part") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("__part") == 0, 0).when(F.col("__part") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), copies))).drop("col")


def _placed(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, row (a hash), mark (place in FAULTS), letter, piece: sorted, and cut into ranges."""
    spark = turns.sparkSession
    named = F.concat(F.when(F.col("conv_id").isNull(), "null").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string"))), F.lit(":"), F.length("role"), F.lit(":"), F.col("role"), F.col("text"))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), _space(F.col("role")).alias("role"), _space(F.col("text")).alias("text")).withColumn("row", F.md5(named))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = rows.groupBy("row").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last").select(F.col("row").alias("__row"), "first")
    firsts = checkpointed(firsts)
    firsts = F.broadcast(firsts) if firsts.count() <= BROADCAST_ROWS else firsts
    rows = rows.join(firsts, F.col("row") == F.col("__row"), "left")
    end = F.right(F.rtrim("text", F.lit(BLANK)), F.lit(1))
    mark = F.when(end == "", 1).when(F.col("first") != place, 2).when(~end.isin(".", "!", "?"), 3).otherwise(0)
    initial = F.substring("role", 1, 1)
    letter = F.when(initial == LETTERS[0], 0).when(initial == LETTERS[1], 1).when(initial == LETTERS[2], 2).otherwise(3)
    marked = rows.select("conv_id", "turn", "role", "text", "row", mark.alias("mark"), letter.alias("letter"))
    order = ["conv_id", "turn", "role", "row"]
    ranges = marked.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    return checkpointed(ranges.withColumn("piece", F.spark_partition_id()))


class _Piece:
    """The rows of one conversation in one range."""

    def __init__(self, number: int, conv_id):
        self.number, self.conv_id, self.codes, self.marks, self.slices = number, conv_id, bytearray(), bytearray(), []


def _pieces(batches, keep_rows: bool):
    """Pieces in order, from batches of conv_id, piece, turn, row, mark, letter and perhaps more columns. Equal rows of one turn are neighbours: all but the first are duplicates."""
    piece, last = None, None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in range(6)]
        begin = 0
        for at, (conv_id, number, turn, row, mark, letter) in enumerate(zip(*columns)):
            if piece is None or conv_id != piece.conv_id:
                if piece is not None:
                    if keep_rows and at > begin:
                        piece.slices.append(batch.slice(begin, at - begin))
                    yield piece
                piece, last, begin = _Piece(number, conv_id), None, at
            if mark != 1 and last == (turn, row):
                mark = 2
            last = (turn, row)
            piece.marks.append(mark)
            piece.codes.append(GONE if mark in (1, 2) else 2 * letter + (mark == 3))
        if keep_rows and piece is not None and batch.num_rows > begin:
            piece.slices.append(batch.slice(begin))
    if piece is not None:
        yield piece


_COMPACT = ["conv_id", "piece", "turn", "row", "mark", "letter"]


def _chains(placed: DataFrame) -> dict:
    """(range, conversation): (entry state, costs after the last row), of conversations in several ranges; at most two for each range."""
    kind = placed.schema["conv_id"].dataType

    def rows_of(found: list) -> pa.RecordBatch:
        numbers, ids, tables = ([x[k] for x in found] for k in range(3))
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(ids, to_arrow_type(kind)), pa.array(tables, pa.list_(pa.int64()))], ["piece", "conv_id", "table"])

    def outer(batches):  # the first and the last conversation of the range
        first = last = None
        for piece in _pieces(batches, False):
            if first is None:
                yield rows_of([(piece.number, piece.conv_id, table_of(piece.codes))])
                first = piece
            else:
                last = piece
        if last is not None:
            yield rows_of([(last.number, last.conv_id, table_of(last.codes))])

    schema = f"piece int, conv_id {kind.simpleString()}, table array<long>"
    tables = placed.select(*_COMPACT).mapInArrow(outer, schema).collect()
    by_range: dict = {}
    for r in tables:
        by_range.setdefault(r["piece"], []).append((r.conv_id, r.table))
    chains: list = []
    last = None
    for number in sorted(by_range):
        for k, (conv_id, table) in enumerate(by_range[number]):
            if k == 0 and last is not None and last[-1][1] == conv_id:
                last.append((number, conv_id, table))
            else:
                last = [(number, conv_id, table)]
                chains.append(last)
    chains = [c for c in chains if len(c) > 1]
    if not chains:
        return {}
    after: dict = {}
    for chain in chains:
        ends = ENDS
        for number, conv_id, table in chain[::-1]:
            after[number, conv_id] = ends
            ends = tuple(min((table[4 * p + q] + ends[q] for q in STATES if table[4 * p + q] is not None and ends[q] is not None), default=None) for p in STATES)
    known = placed.sparkSession.sparkContext.broadcast(after)

    def leave(batches):  # for each entry state, the state after the walk
        for piece in _pieces(batches, False):
            ends = known.value.get((piece.number, piece.conv_id))
            if ends is not None:
                live = distances(bytes(c for c in piece.codes if c != GONE), ends)
                yield rows_of([(piece.number, piece.conv_id, [_last(walk(piece.codes, ends, state), state) if live[state] >= 0 else None for state in STATES])])

    exits = {(r["piece"], r.conv_id): r.table for r in placed.select(*_COMPACT).mapInArrow(leave, schema).collect()}
    entries = {}
    for chain in chains:
        state = START
        for number, conv_id, _ in chain:
            entries[number, conv_id] = (state, after[number, conv_id])
            state = exits[number, conv_id][state]
    return entries


def _last(steps, state: int) -> int:
    for _, _, state in steps:
        pass
    return state


AUDIT = "piece int, pos long, turn long, role string, text string, fault string, edit string, new_role string"


def _edited(placed: DataFrame, chains, several: bool) -> DataFrame:
    """The audit of the conversations in several ranges, or of the others."""
    kind = placed.schema["conv_id"].dataType.simpleString()

    def run(batches):
        for piece in _pieces(batches, True):
            chained = chains.value.get((piece.number, piece.conv_id))
            if (chained is not None) == several:
                yield from _written(piece, *(chained or (START, ENDS)))

    return placed.select(*_COMPACT, "role", "text").mapInArrow(run, f"conv_id {kind}, {AUDIT}")


def _written(piece: _Piece, state: int, ends: tuple):
    """The edits of a piece as batches, one for each batch of its rows."""
    steps = walk(piece.codes, ends, state)
    begin, pos, step = 0, 0, next(steps, None)
    for k, rows in enumerate(piece.slices):
        end, last = begin + rows.num_rows, k == len(piece.slices) - 1
        took, letters, new_roles, faults = [], [], [], []
        while step is not None and (step[0] < end or last):
            place, letter, after = step
            took.append(None if letter == INSERT else place - begin)
            letters.append(letter)
            new_roles.append(None if letter in (KEEP, DELETE) else NAMES[after])
            faults.append(None if letter == INSERT else FAULTS[piece.marks[place]])
            step = next(steps, None)
        index = pa.array(took, pa.int64())
        old = {c: rows.column(c).take(index) for c in ("turn", "role", "text")}
        kept = pa.array([x == KEEP for x in letters], pa.bool_())
        new_role = pc.if_else(kept, old["role"], pa.array(new_roles, pa.string()))
        columns = [rows.column("conv_id").take(pa.array([0] * len(took), pa.int64())), pa.array([piece.number] * len(took), pa.int32()), pa.array(range(pos, pos + len(took)), pa.int64())]
        columns += [old["turn"], old["role"], old["text"], pa.array(faults, pa.string()), pa.array(letters, pa.string()), new_role]
        yield pa.RecordBatch.from_arrays(columns, ["conv_id", *(c.split()[0] for c in AUDIT.split(", "))])
        begin, pos = end, pos + len(took)


def _audits(turns: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    small_batches(turns.sparkSession)
    placed = _placed(turns)
    chains = _chains(placed)
    known = turns.sparkSession.sparkContext.broadcast(chains)
    return _edited(placed, known, False), _edited(placed, known, True) if chains else None


def audit(turns: DataFrame) -> DataFrame:
    """Each edit of conversations (conv_id, turn, role, text), in the order of piece and pos: the row's turn, role, text and fault, the edit's initial, and the new role, null if the row goes. Insertions have neither turn, role nor text."""
    whole, several = _audits(turns)
    return whole if several is None else whole.unionAll(several)


def repaired(edits: DataFrame) -> DataFrame:
    """conv_id, piece, pos, role, text of the rows that an audit leaves, in the order of piece and pos."""
    return edits.filter(F.col("edit") != DELETE).select("conv_id", "piece", "pos", F.col("new_role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))


SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Summary:
    """Counts and digests of one conversation, from its edits in order; texts pass through."""

    def __init__(self):
        self.turns, self.low, self.high, self.last_turn, self.last = 0, None, None, None, None
        self.faults, self.illegal, self.cost, self.letters, self.digest, self.rows = dict.fromkeys(FAULTS, 0), 0, 0, bytearray(), hashlib.sha256(), 0

    def add(self, turn, role, text, fault, letter, new_role) -> None:
        self.letters += letter.encode()
        self.cost += COST[letter] + (TRUNCATED_COST if fault == "truncated" and letter != DELETE else 0)
        if letter != INSERT:
            self.faults[fault] += 1
            initial = role[:1]
            self.illegal += self.last is not None and self.last + initial not in ("su", "ua", "au")
            self.last = initial
            if turn is not None and turn != self.last_turn:
                self.turns, self.low, self.high = self.turns + 1, turn if self.low is None else self.low, turn
            self.last_turn = turn
        if letter != DELETE:
            self.digest.update(f"{chr(10) if self.rows else ''}{new_role}:{text or ''}".encode())
            self.rows += 1

    def row(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return gaps, self.faults["blank"], self.faults["duplicate"], self.faults["truncated"], self.illegal, self.cost, self.letters.decode(), self.digest.hexdigest()


def _summed(edits: DataFrame) -> DataFrame:
    """One row for each conversation of edits that are in order, and whole, in each partition."""
    kind = edits.schema["conv_id"].dataType

    def run(batches):
        types = [to_arrow_type(kind), *[pa.int64()] * 6, pa.string(), pa.string()]
        names = ["conv_id", *(c.split()[0] for c in SUMMARY.split(", "))]
        conv_id, now = None, None
        for batch in batches:
            done = []
            for at, *edit in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or at != conv_id:
                    if now is not None:
                        done.append((conv_id, *now.row()))
                    conv_id, now = at, _Summary()
                now.add(*edit)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((conv_id, *now.row()), types)], names)

    return edits.select("conv_id", "turn", "role", "text", "fault", "edit", "new_role").mapInArrow(run, f"conv_id {kind.simpleString()}, {SUMMARY}")


def summaries(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256; one row for each conversation.

    The digest of a conversation that spans several ranges is made by one task, as SHA-256 goes through all bytes in
    order; its texts pass through that task and are not kept."""
    whole, several = _audits(turns)
    out = _summed(whole)
    if several is not None:
        n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        out = out.unionAll(_summed(several.repartition(n, "conv_id").sortWithinPartitions("conv_id", "piece", "pos")))
    return out


def repair_report(conversations: DataFrame, turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """The summaries of turns for every conversation id of the first frame, zeros where no row is left."""
    ids = conversations.select(F.col(conv_col).alias("__id")).distinct()
    found = ids.join(summaries(turns), F.col("__id").eqNullSafe(F.col("conv_id")), "left")
    empty = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    names = [c.split()[0] for c in SUMMARY.split(", ")]
    return found.select(F.col("__id").alias("conv_id"), *[F.coalesce(c, F.lit(empty.get(c, 0))).alias(c) for c in names])
