"""Exact and line dedup, license scan and top-k against plain Python."""

import hashlib
import random

import numpy as np
import pytest

from loomgraph.llm import exact_dedup, license_scan, line_dedup, line_state, topk

LOWER = {i: i + 32 for i in range(65, 91)}


def test_exact(spark):
    docs = [(i, "hot Text") for i in range(60)] + [(100, None), (101, ""), (102, "É a"), (103, "é a"), (104, "A"), (105, "a"), (None, "lone"), (None, "a"), (105, "a")]
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, group_size int, text_sha256 string")
    rows = exact_dedup.exact_dedup(frame, support=0.2).collect()
    groups = {}
    for i, t in docs:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    want = []
    for i, t in docs:
        g = groups[(t or "").translate(LOWER)]
        keep = max((x for x in g if x is not None), default=None)
        want.append((i, keep, len(g), i == keep, hashlib.sha256((t or "").translate(LOWER).encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    assert exact_dedup.heavy_digests(exact_dedup.text_digests(frame), 0.2).count() == 1
    assert exact_dedup.exact_dedup(frame.limit(0)).count() == 0
    assert exact_dedup.deduplicated(frame).filter("doc_id = 59").count() == 1


def lines_by_hand(docs, min_chars, min_docs):
    key = lambda x: x.strip(line_dedup.BLANK).translate(LOWER)
    held = {}
    for n, (i, t) in enumerate(docs):
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                held.setdefault(k, []).append(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= min_chars and len(held[key(x)]) >= min_docs and max((h for h in held[key(x)] if h is not None), default=-(2**63)) != i)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def some_docs():
    rng = random.Random(3)
    lines = [f"This is the shared LINE number {k} of many documents" for k in range(8)] + ["short", "", "  ", "ß" * 45, "a" * 40, "A" * 39 + "\x0b"]
    docs = [(i, "\n".join(rng.choices(lines, k=rng.randint(0, 6)))) for i in range(40)]
    return docs + [(70, None), (71, ""), (None, lines[0]), (5, lines[1])]


@pytest.mark.parametrize("limit", [line_dedup.BROADCAST_BYTES, 100, 0])
def test_lines(spark, limit):
    docs = some_docs()
    frame = spark.createDataFrame([(i, t, "x", 9) for i, t in docs], "doc_id long, text string, digest string, n_lines int")
    got = line_dedup.line_dedup(frame, broadcast_bytes=limit)
    assert sorted(map(tuple, got.collect()), key=str) == lines_by_hand(docs, 40, 5)
    carried = line_dedup.line_dedup(frame, carry=("digest",), broadcast_bytes=limit)
    assert carried.columns[-1] == "digest" and {r.digest for r in carried.collect()} == {"x"}
    assert line_dedup.line_dedup(frame.limit(0), broadcast_bytes=limit).count() == 0


@pytest.mark.parametrize("limit", [line_dedup.BROADCAST_BYTES, 100, 0])
def test_lines_of_null_ids(spark, limit):
    null_only, shared = "Only rows without any id hold this long line 1", "Rows with ids and rows without hold this line 2"
    docs = [(None, f"{null_only}\nrow {k % 3}\n{shared}") for k in range(7)] + [(4, shared), (9, f"{shared}\n{shared}"), (9, shared), (9, f"x\n{shared}")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(map(tuple, line_dedup.line_dedup(frame, broadcast_bytes=limit).collect()), key=str)
    assert got == lines_by_hand(docs, 40, 5) and not any(null_only in r[1] for r in got)


def test_lines_of_repeated_ids_as_in_sql(spark, tmp_path):
    """A document is a row: rows that repeat an id count one by one, here and in the SQL counterpart."""
    import duckdb

    from loomgraph.llm.queries import ORACLE_SQL, QUERIES

    shared, other = "One line that all five of these rows hold alike", "A second line that only four rows hold, so it stays"
    docs = [(1, shared), (1, f"{shared}\n{other}"), (1, f"{other}\n{shared}"), (2, f"x\n{shared}\n{other}"), (3, f"{shared}\n{other}"), (None, f"{shared} "), (None, None), (3, shared.upper())]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, QUERIES["op4_line_dedup"](spark, str(tmp_path)).collect()), key=str)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(duck.execute(ORACLE_SQL["op4_line_dedup"]).fetchall(), key=str)
    assert sum(r[2] for r in got) == 5


def test_lines_come_back(spark, tmp_path):
    docs = [d for d in some_docs() if d[0] is not None][:41]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    state = line_state.LineDedupState(spark, str(tmp_path))
    assert state.blocked().count() == 0
    state.insert(frame.filter("doc_id < 20"))
    state.insert(frame.filter("doc_id >= 20"))
    assert sorted(map(tuple, state.apply(frame).collect()), key=str) == lines_by_hand(docs, 40, 5)
    state.delete(frame.filter("doc_id >= 12").select("doc_id"))
    left = [d for d in docs if d[0] < 12]
    assert sorted(map(tuple, state.apply(frame.filter("doc_id < 12")).collect()), key=str) == lines_by_hand(left, 40, 5)
    state.delete(frame.select("doc_id"))
    assert state.blocked().count() == 0


def test_state_over_sessions(spark, tmp_path):
    """Random insertions and deletions, nulls and repeats among them, each by a state that is opened anew; filters hold exactly what is blocked."""
    rng = random.Random(9)
    docs = {}
    lines = [f"A line that is shared by many, of number {k}, in the text" for k in range(12)]
    for turn in range(6):
        state = line_state.LineDedupState(spark, str(tmp_path), shard_keys=3)
        if turn % 3 < 2:
            new = [(rng.choice([None, *range(30)]), "\n".join(rng.choices(lines, k=4))) for _ in range(15)]
            state.insert(spark.createDataFrame(new, "doc_id long, text string"))
            for i, t in new:
                docs.setdefault(i, []).append(t)
        else:
            gone = rng.sample(sorted(i for i in docs if i is not None), 9) + [None, 999]
            state.delete(spark.createDataFrame([(i,) for i in gone], "doc_id long"))
            docs = {i: t for i, t in docs.items() if i not in gone}
        rows = [(i, t) for i, some in docs.items() for t in some]
        state = line_state.LineDedupState(spark, str(tmp_path))
        assert state.shard_keys == 3 and state.generation == turn + 1 and state.n_blocked <= 3 * state.n_shards
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        for limit in (line_dedup.BROADCAST_BYTES, 200, 0):
            assert sorted(map(tuple, state.apply(frame, broadcast_bytes=limit).collect()), key=str) == lines_by_hand(rows, 40, 5)
        filters = line_dedup.Filters([(r.shard, bytes(r.filter)) for r in state.filters().collect()], state.n_shards)
        blocked = [bytes(r.digest) for r in state.blocked().collect()]
        held = sum(int((np.frombuffer(r.filter, dtype=np.uint16) != 0).sum()) for r in state.filters().collect())
        assert held == len(blocked) and filters.may_hold(line_dedup._keys(blocked)).all()


def test_shards_grow_and_changes_write_little(spark, tmp_path):
    def lines(part, n, k):
        return [(part * 1000 + i, "\n".join(f"Line {part}.{i}.{j} with some words to make it long enough" for j in range(k))) for i in range(n)]

    def size(folder):
        return sum(f.stat().st_size for f in folder.rglob("*.parquet"))

    state = line_state.LineDedupState(spark, str(tmp_path), min_docs=1, shard_keys=16)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    for part, n in enumerate((2, 3, 150)):
        state.insert(frame(lines(part, n, 100)))
        filters = line_dedup.Filters([(r.shard, bytes(r.filter)) for r in state.filters().collect()], state.n_shards)
        assert filters.may_hold(line_dedup._keys([bytes(r.digest) for r in state.blocked().collect()])).all()
    assert state.n_blocked == state.blocked().count() == 15_500 and 15_500 / 16 <= state.n_shards <= 4 * 15_500 / 16
    other = [hashlib.blake2b(str(i).encode(), digest_size=16).digest() for i in range(5000)]
    assert filters.may_hold(line_dedup._keys(other)).mean() < 0.01
    state.clean()
    before, held = size(tmp_path), state.filters().count()
    state.insert(frame(lines(9, 1, 4)))
    assert size(tmp_path) - before < 0.05 * before and state.filters().count() == held
    for kind, runs in state.runs.items():
        assert len(runs) <= 3 and runs[-1][1] <= 8
    assert state.n_blocked == state.counts().count() == 15_504
    state.delete(spark.createDataFrame([(9000,)], "doc_id long"))
    assert state.n_blocked == state.blocked().count() == 15_500
    assert state.clean() >= 0 and line_state.LineDedupState(spark, str(tmp_path)).blocked().count() == 15_500


def test_full_filters_are_built_again(spark, tmp_path):
    """All keys in one shard, whose filter grows."""
    state = line_state.LineDedupState(spark, str(tmp_path), min_docs=1, shard_keys=10_000)
    for part in range(3):
        rows = [(part * 100 + i, "\n".join(f"Line {part}.{i}.{k} with some words to make it long enough" for k in range(20))) for i in range(20)]
        state.insert(spark.createDataFrame(rows, "doc_id long, text string"))
    filters = line_dedup.Filters([(r.shard, bytes(r.filter)) for r in state.filters().collect()], state.n_shards)
    blocked = [bytes(r.digest) for r in state.blocked().collect()]
    assert state.n_shards == 1 and len(blocked) == 1200 and filters.may_hold(line_dedup._keys(blocked)).all()


def test_cuckoo_filter():
    keys = [hashlib.blake2b(str(i).encode(), digest_size=16).digest() for i in range(6000)]
    f = line_dedup.CuckooFilter.of(keys[:5000])
    assert all(k in f for k in keys[:5000])
    assert sum(k in f for k in keys[5000:]) < 10
    assert f.delete(keys[0]) and all(k in f for k in keys[1:5000])
    assert line_dedup.CuckooFilter.of([]) is not None
    many = line_dedup.Filters([(0, f.table.tobytes())], 1).may_hold(line_dedup._keys(keys))
    assert many.tolist() == [k in f for k in keys]


def test_licenses(spark):
    texts = [None, "", "all rights reserved", "All  RIGHTS-reserved; cc by 4.0 and CC-BY", "cc bye", "x general public license", "Éall rights reserved", "Licensed under the Apache License, Version 2.0.", "permission is hereby granted, free of charge, to any person obtaining a copy", "apache license version 2 0", "cc " * 3000 + "by"]
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate([*texts, "cc by"])], "doc_id long, text string, words string, labels string")
    got = {r.doc_id: r for r in license_scan.scan_licenses(frame).collect()}
    assert (got[0].n_words, got[0].n_base, got[0].first_word, got[0].base_labels, got[0].labels, got[0].score) == (0, 0, None, "", "", 0.0)
    assert (got[2].first_word, got[2].last_word, got[2].base_labels, got[2].score) == (0, 0, "reserved", 1.0)
    assert (got[3].n_base, got[3].first_word, got[3].last_word, got[3].base_labels) == (3, 0, 8, "cc-by,reserved")
    assert got[4].n_base == got[6].n_base == 0 and got[5].base_labels == "gpl"
    assert got[7].labels == "apache-2.0" and got[7].base_labels == "" and 0 < got[7].score <= 1
    assert got[8].labels == "mit" and got[9].labels == "apache-2.0"
    assert (got[10].n_words, got[10].first_word) == (3001, 2999)
    assert license_scan.scan_licenses(frame.limit(0)).count() == 0


@pytest.mark.parametrize("shard_rows, seed_rows", [(16_384, 4096), (40, 30), (7, 11), (7, 400)])
def test_top_k(spark, shard_rows, seed_rows, monkeypatch):
    monkeypatch.setattr(topk, "GROUPS", 5)
    rng = np.random.default_rng(2)
    m = rng.normal(size=(300, 7)) * rng.uniform(0.2, 2, size=(300, 1))
    rows = [(int(i), v.tolist()) for i, v in enumerate(m)] + [(400, m[3].tolist()), (500, m[3].tolist()), (600, None), (700, [1.0, float("nan")]), (800, [None, 1.0]), (900, []), (None, m[1].tolist()), (1000, [2.0, 1.0]), (200, m[200].tolist())]
    frame = spark.createDataFrame([(*r, 1.0) for r in rows], "vec_id long, embedding array<double>, score double").repartition(4)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(frame, shard_rows=shard_rows, seed_rows=seed_rows, query_block=2).collect())
    sound = [(i, np.floor(1024 * np.array(v + [0.0] * (7 - len(v))))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for row, (q, x) in enumerate(sound):
        if q % 100 == 0:
            best = sorted((-int(x @ v), i) for other, (i, v) in enumerate(sound) if other != row)[:10]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == sorted(want) and {q for q, *_ in got} == {0, 100, 200, 400, 500, 900, 1000}
    assert topk.top_k(frame.limit(0)).count() == 0
    assert topk.top_k(frame.filter("vec_id in (100, 101)")).count() == 1
    assert [tuple(r) for r in topk.top_k(frame.filter("vec_id = 900").unionAll(frame.filter("vec_id = 900"))).collect()] == [(900, 1, 900, 0)] * 2


@pytest.mark.parametrize("size", [1e3, 1e5, 3e5])
def test_top_k_of_large_components(spark, size):
    """Scores past 2^53 equal those of Python's integers; near ties are decided by them."""
    rng = np.random.default_rng(5)
    m = rng.normal(size=(250, 64)) * size
    m[100:150] = m[100] + rng.normal(size=(50, 64)) * 1e-4  # scores that differ in their last bits
    frame = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>").repartition(3)
    whole = [[int(np.floor(1024 * x)) for x in v] for v in m]
    want = []
    for q in (0, 100, 200):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in enumerate(whole) if i != q)[:10]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    for shard_rows, seed_rows in ((16_384, 4096), (40, 30)):
        assert sorted(map(tuple, topk.top_k(frame, shard_rows=shard_rows, seed_rows=seed_rows).collect())) == want


def test_top_k_of_components_beyond_scores(spark):
    few = spark.createDataFrame([(0, [1e12, 0.0, 5.0]), (1, [0.0, 3e12, 7.0]), (2, [0.0, 0.0, -1e3])], "vec_id long, embedding array<double>")
    assert [tuple(r)[1:] for r in topk.top_k(few).collect()] == [(1, 1, 35 * 1024 * 1024), (2, 2, -5 * 1024 * 1024 * 1000)]
    with pytest.raises(Exception, match="no long"):
        topk.top_k(few.unionAll(spark.createDataFrame([(3, [1e12, 0.0, 0.0])], few.schema))).collect()
    with pytest.raises(Exception, match="no long"):
        topk.top_k(few.unionAll(spark.createDataFrame([(3, [1e17, 0.0, 0.0])], few.schema))).collect()


def test_very_long_texts(spark):
    """Half a million words with licence phrases at both ends, and equal texts of some megabytes."""
    middle = "word and " * 250_000
    texts = [(1, "All rights reserved " + middle + "cc by"), (2, "cc " * 20_000 + "by"), (3, middle), (4, middle.upper()), (5, "x" * 3_000_000)]
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    got = {r.doc_id: r for r in license_scan.scan_licenses(frame).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (500_005, 2, 0, 500_003, "cc-by,reserved")
    assert (got[2].n_words, got[2].n_base, got[2].first_word) == (20_001, 1, 19_999) and got[5].n_words == 1 and got[3].score == 0
    kept = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(frame).collect()}
    assert kept[3] == (4, 2, False, hashlib.sha256(middle.encode()).hexdigest()) and kept[4][:3] == (4, 2, True) and kept[5][:3] == (5, 1, True)
    lines = {r.doc_id: r.n_lines for r in line_dedup.line_dedup(frame).collect()}
    assert lines == dict.fromkeys(range(1, 6), 1)
