"""SimHash near-duplicates against brute force."""

import random

import numpy as np
import pytest
import xxhash

from loomgraph.llm import simhash


def brute(fps):
    """The least member of each fingerprint's component."""
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for x in fps:
        for y in fps:
            if bin(x ^ y).count("1") <= 3 and find(x) != find(y):
                root[max(find(x), find(y))] = min(find(x), find(y))
    return {f: find(f) for f in fps}


def by_hand(text):
    words = [w for w in (text or "").translate({i: i + 32 for i in range(65, 91)}).encode().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    for text in [None, "", " \n", "One", "a b", "a b c", "A b\tC\x0bd e a b c", " a b c d É é", "x " * 50]:
        assert simhash.fingerprint(text) == by_hand(text)


def clouds(rng, n_centres, each, spread):
    fps = set()
    for _ in range(n_centres):
        centre = rng.getrandbits(64)
        for _ in range(each):
            f = centre
            for b in rng.sample(range(64), rng.randint(0, spread)):
                f ^= 1 << b
            fps.add(f)
    return sorted(fps)


@pytest.mark.parametrize("window", [2, 16])
def test_links_connect_as_all_pairs_do(spark, monkeypatch, window):
    monkeypatch.setattr(simhash, "WINDOW", window)
    rng = random.Random(7)
    fps = clouds(rng, 12, 30, 6) + clouds(rng, 1, 150, 3)
    # chains of exactly 3 bits, in one block and over all blocks
    for bits in ([0, 1, 2], [5, 30, 60], [0, 1, 40], [43, 44, 63]):
        f = rng.getrandbits(64)
        fps += [f, f ^ sum(1 << b for b in bits)]
    fps = sorted(set(fps))
    frame = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long").repartition(3)
    got, want = {f: f for f in fps}, brute(fps)
    rows = simhash.links(frame).collect()
    for r in rows:
        a, b = int(np.int64(r.a).view(np.uint64)), int(np.int64(r.b).view(np.uint64))
        assert a != b and want[a] == want[b]  # a forest of the verified links: its ends are linked, if by several steps
    from loomgraph.llm.components import components

    links = spark.createDataFrame([(r.a, r.b) for r in rows], "a long, b long")
    for r in components(links).collect():
        got[int(np.int64(r.node).view(np.uint64))] = int(np.int64(r.root).view(np.uint64))
    groups = {}
    for f in fps:
        groups.setdefault(got[f], set()).add(f)
    expected = {}
    for f in fps:
        expected.setdefault(want[f], set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_query_on_documents(spark):
    base = " ".join(f"w{i}" for i in range(400))
    docs = [(5, base), (9, base + " extra"), (2, base.upper()), (7, None), (8, ""), (None, "lonely words stand here"), (11, "lonely words stand here"), (11, "lonely words stand here")]
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id long, text string, fp string, component_id string")
    got = sorted((tuple(r) for r in simhash.simhash_components(frame).collect()), key=str)
    marks = [by_hand(t) for _, t in docs]
    roots = brute(set(marks))
    least = {}
    for (i, _), m in zip(docs, marks):
        if i is not None:
            least[roots[m]] = min(i, least.get(roots[m], i))
    want = sorted(((i, f"{m:016x}", least.get(roots[m])) for (i, _), m in zip(docs, marks)), key=str)
    assert got == want
    assert simhash.simhash_components(frame.limit(0)).count() == 0
    assert sorted(r.doc_id for r in simhash.one_of_each(frame).collect()) == sorted({x[2] for x in want})
