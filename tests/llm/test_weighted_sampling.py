"""Consistent weighted sampling against its textbook form, and edited texts against plain Python."""

import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from loomgraph.llm import weighted_sampling as ws


def by_hand(spark, sets, samples):
    """For each set {term: weight} and position, the (term, t) of the least a, with r, c and b written out."""
    terms = sorted({t for s in sets for t in s})
    rows = spark.createDataFrame([(t, k) for t in terms for k in range(samples)], "term long, k int")
    hashes = rows.select("term", "k", F.xxhash64("term", "k"), F.xxhash64("term", "k", F.lit(1)), F.xxhash64("term", "k", F.lit(2))).collect()
    uniform = lambda h: ((h >> 12) + (1 << 51) + 0.5) / (1 << 52)
    drawn = {(r[0], r[1]): -np.log([uniform(h) for h in r[2:]]) for r in hashes}
    out = []
    for s in sets:
        signs = []
        for k in range(samples):
            best = (np.inf, None, None)
            for term, w in s.items():
                e1, e2, e3 = drawn[term, k]
                c, r = e1 + e2, e3 - np.log(e1 / (e1 + e2))
                b = e3 / r
                t = np.floor(np.log(w) / r + b)
                y = np.exp(r * (t - b))
                assert y <= w * (1 + 1e-9)
                best = min(best, (c / (y * np.exp(r)), term, t))
            signs.append(best[1:])
        out.append(signs)
    return out


def test_samples_are_those_of_the_method(spark):
    rng = random.Random(8)
    weights = [1.0, 1.0, 1.0, 2.0, 3.0, 7.0, 0.3, 250.0]
    sets = [{rng.randrange(40): rng.choice(weights) for _ in range(rng.randint(1, 25))} for _ in range(14)]
    sets += [dict(sets[0]), {t: 1.0 for t in sets[1]}, {t: w + 1 for t, w in sets[2].items()}]
    frame = spark.createDataFrame([(i, t, w) for i, s in enumerate(sets) for t, w in s.items()], "key int, term long, weight double").repartition(3)
    got = {r.key: r.fingerprint for r in ws.fingerprints(frame, ["key"], 24).collect()}
    want = by_hand(spark, sets, 24)
    for i in range(len(sets)):
        for j in range(i):
            assert [a == b for a, b in zip(got[i], got[j])] == [a == b for a, b in zip(want[i], want[j])]


def test_collisions_are_generalised_jaccard(spark):
    rng = random.Random(1)
    sets = [{t: float(rng.choice([1, 1, 2, 5])) for t in range(60)}]
    sets += [{t: w for t, w in sets[0].items() if t % 3}, {t: w * 2 for t, w in sets[0].items()}, {t + 30: w for t, w in sets[0].items()}]
    frame = spark.createDataFrame([(i, t, w) for i, s in enumerate(sets) for t, w in s.items()], "key int, term long, weight double")
    n = 300
    parts = []  # many positions, some at a time: other positions are other terms of the hash
    for block in range(n // 60):
        moved = frame.withColumn("term", F.xxhash64("term", F.lit(block)))
        parts.append({r.key: r.fingerprint for r in ws.fingerprints(moved, ["key"], 60).collect()})
    for i in range(len(sets)):
        for j in range(i):
            shared = sum(a == b for p in parts for a, b in zip(p[i], p[j])) / n
            all_terms = set(sets[i]) | set(sets[j])
            low, high = (sum(f(sets[i].get(t, 0), sets[j].get(t, 0)) for t in all_terms) for f in (min, max))
            assert abs(shared - low / high) < 4.5 * np.sqrt(0.25 / n)


def test_terms_are_counted_shingles(spark):
    texts = [None, "", " \t ", "One", "a b c d", "a b c d e", "A b c d e\x0ba B c d e f", "x " * 40, "É é É é É é", "  b"]
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "id int, text string, term int")
    got = {}
    for r in ws.weighted_terms(frame, ["id"]).collect():
        got.setdefault(r.id, []).append((r.term, r.weight))
    for i, t in enumerate(texts):
        words = "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()
        shingles = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else Counter([tuple(words)] if words else [])
        assert sorted(w or 0 for _, w in got[i]) == (sorted(shingles.values()) or [0])
        assert len({t for t, _ in got[i]}) == max(1, len(shingles))
    assert ws.weighted_terms(frame.limit(0), ["id"]).count() == 0


def edited_by_hand(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5((("null" if r[0] is None else f"={r[0]}") + ":" + (r[1] or "")).encode()).hexdigest()))
    out = []
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        cut = len(t) // 4
        out.append((i, len(t), hashlib.sha256((t[: len(t) - cut] + nxt[:cut]).encode()).hexdigest(), t, nxt))
    return out


def test_edited(spark):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in "béxyz" for b in "uvw𝄞"]
    docs = [(i * 3, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(50)]
    docs += [(7, None), (8, ""), (9, "w" * 400_000), (None, "without an id, but with some words"), (None, "another one"), (6, docs[2][1]), (6, docs[2][1]), (6, docs[2][1]), (6, "other")]
    frame = spark.createDataFrame([(i, t, "x", 2) for i, t in docs], "doc_id long, text string, key string, n int").repartition(5)
    out = ws.edited_fingerprints(frame)
    got = sorted(map(tuple, out.select("doc_id", "n_chars", "edited_sha256").collect()), key=str)
    want = edited_by_hand(docs)
    assert got == sorted((w[:3] for w in want), key=str)
    # likeness as fingerprints of the texts themselves give it
    texts = sorted({x for w in want for x in w[3:]})
    prints = {r.text: r.fingerprint for r in ws.fingerprint_texts(spark.createDataFrame([(t,) for t in texts], "text string"), ["text"]).select("text", ws.as_hex(F.col("fingerprint")).alias("fingerprint")).collect()}
    cut = lambda h: [h[k : k + 8] for k in range(0, len(h), 8)]
    like = lambda a, b: sum(x == y for x, y in zip(cut(a), cut(b))) / ws.SAMPLES
    full = sorted(((r.doc_id, r.edited_sha256, r.fingerprint, round(r.near_next, 9)) for r in out.collect()), key=str)
    assert full == sorted(((i, s, prints[t], round(like(prints[t], prints[nxt]), 9)) for i, _, s, t, nxt in want), key=str)
    assert all(r.near_edited == like(r.fingerprint, r.edited_fingerprint) and len(r.fingerprint) == 8 * ws.SAMPLES for r in out.collect())
    assert ws.edited_fingerprints(frame.limit(0)).count() == 0
    alone = ws.edited_fingerprints(spark.createDataFrame([(1, "only one document here")], "doc_id long, text string")).first()
    assert alone.near_next == 1.0 and alone.edited_sha256 == hashlib.sha256(b"only one document" + b"only ").hexdigest()
