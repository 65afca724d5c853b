"""Conversation repair against a plain search for the cheapest edits, over many ranges too."""

import hashlib
import random
import re
import zlib

import pytest

from loomgraph.llm import conversations as cv

WHITE = " \t\n\x0b\x0c\r"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
FULL = {"u": "user", "a": "assistant"}


def by_hand(rows):
    """rows: (turn, role, text) after damage, in order. The best edits of every suffix are kept as whole strings."""
    seen, faults = set(), []
    for _, role, text in rows:
        end = text.rstrip(WHITE)[-1:]
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else None)
        seen.add((role, text))
    later = None
    for k in range(len(rows), -1, -1):
        here = {}
        for q in ("", "s", "u", "a"):
            found = [(0, "", ())] if k == len(rows) and q in ("", "a") else []
            if k < len(rows):
                _, role, text = rows[k]
                extra = int(faults[k] == "truncated")
                cost, letters, kept = later[q]
                found.append((cost + 3, "D" + letters, kept))
                if faults[k] not in ("blank", "duplicate"):
                    if to := NEXT.get((q, role[:1])):
                        cost, letters, kept = later[to]
                        found.append((cost + extra, "K" + letters, ((role, text), *kept)))
                    for x, name in FULL.items():
                        if to := NEXT.get((q, x)):
                            cost, letters, kept = later[to]
                            found.append((cost + extra + 2, "R" + letters, ((name, text), *kept)))
            here[q] = min(found, default=None)
        for _ in range(3):
            for q in here:
                for x, name in FULL.items():
                    if (to := NEXT.get((q, x))) and here[to]:
                        cost, letters, kept = here[to]
                        here[q] = min(filter(None, (here[q], (cost + 2, "I" + letters, ((name, ""), *kept)))))
        later = here
    cost, letters, kept = later[""]
    assert re.fullmatch(r"(s?(ua)+)?", "".join(r[:1] for r, _ in kept))
    turns = {t for t, *_ in rows if t is not None}
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, letters, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()


def in_order(conv_id, rows):
    tag = "null" if conv_id is None else f"={conv_id}"
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{tag}:{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))


def some(rng, conv_id, n):
    texts = ["Fine.", "Fine.", "Why?", "cut off", "", " \t", "é𝄞!", "dots . \n", "No! \x0b", "x"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", "ux"]
    return [(conv_id, rng.choice([None, k, k, k, k, k // 2, k + 3]), rng.choice(roles), rng.choice(texts) + rng.choice(["", "", str(rng.randrange(9)) + "."])) for k in range(n)]


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_against_a_plain_search(spark, parts):
    rng = random.Random(parts)
    rows = [r for c in range(60) for r in some(rng, c, rng.randint(1, 9))] + some(rng, None, 6) + some(rng, 500, 250) + some(rng, 501, 120) + [(502, 1, "user", "Same.")] * 30 + [(503, None, "user", "?")] * 2
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        frame = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, row string").repartition(4)
        got = sorted(map(tuple, cv.summaries(frame).collect()), key=str)
        held = cv.repaired(cv.audit(frame)).collect()
        assert cv.summaries(frame.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    groups = {}
    for c, *r in rows:
        groups.setdefault(c, []).append(tuple(r))
    assert got == sorted(((c, *by_hand(in_order(c, some))) for c, some in groups.items()), key=str)
    digests = {r[0]: r[-1] for r in got}
    for c in groups:
        mine = sorted((r["piece"], r.pos, r.role, r.text) for r in held if r.conv_id == c)
        assert hashlib.sha256("\n".join(f"{x[2]}:{x[3]}" for x in mine).encode()).hexdigest() == digests[c]


def test_damage_and_report(spark):
    rng = random.Random(2)
    rows = [r for c in [*range(150), None] for r in some(rng, c, rng.randint(1, 8))] + [(900, k, None, None) for k in range(5)]
    lone = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:7".encode()) % 20 == 0)
    rows.append((lone, 7, "user", "It goes."))
    groups = {c: [] for c, *_ in rows}
    for c, turn, role, text in rows:
        part = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if part == 1:
            text = ""
        if part == 2:
            text = re.sub("[.!?]", "", text)
        if part == 4:
            role = "user"
        groups[c] += [(turn, role, text)] * {0: 0, 3: 2}.get(part, 1)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = cv.repair_report(frame, cv.damaged(frame))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((c, *by_hand(in_order(c, some))) for c, some in groups.items()), key=str)
    assert got.filter(f"conv_id = {lone}").first().repaired_sha256 == hashlib.sha256(b"").hexdigest()
    assert cv.repair_report(frame.limit(0), cv.damaged(frame.limit(0))).count() == 0


def test_bucket_queue(spark):
    """Distances of random rows against repeated relaxation."""
    rng = random.Random(6)
    for _ in range(60):
        codes = bytes(rng.randrange(8) for _ in range(rng.randint(0, 12)))
        ends = tuple(rng.choice([None, 0, 3, 11]) for _ in cv.STATES)
        want = [float("inf")] * (4 * len(codes) + 4)
        for q, d in enumerate(ends):
            want[4 * len(codes) + q] = float("inf") if d is None else d
        for _ in range(len(want)):
            for k in range(len(codes) + 1):
                for letter, p, q, cost in cv._INSERTS:
                    want[4 * k + p] = min(want[4 * k + p], cost + want[4 * k + q])
                if k < len(codes):
                    for letter, p, q, cost in cv._ARCS[codes[k]]:
                        want[4 * k + p] = min(want[4 * k + p], cost + want[4 * k + 4 + q])
        assert list(cv.distances(codes, ends)) == [-1 if x == float("inf") else x for x in want]
