"""Toxicity and language: held-out accuracy and defined results; the pipeline against its stages by hand."""

import math
import random
import zlib
from itertools import product

import numpy as np
import public_tokenizers
import pytest

from loomgraph.llm import language, simhash, toxicity
from loomgraph.llm.bpe import Vocabulary, read_file

DATA = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_toxicity_learns_subwords():
    rng = random.Random(1)
    plain = ["".join(rng.choices("abcdeilmnorstu", k=rng.randint(2, 9))) for _ in range(400)]
    bad = ["zorkish", "zorkful", "grumpf", "grumpfing"]
    texts, labels = [], []
    for i in range(300):
        words = rng.choices(plain, k=rng.randint(20, 120))
        if i % 4 == 0:
            for _ in range(max(1, len(words) // 15)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        texts.append(" ".join(words))
        labels.append(int(i % 4 == 0))
    model = toxicity.train(texts[:200], labels[:200])
    score = model.scorer()
    hits = [(score(t) >= 0.5) == bool(y) for t, y in zip(texts[200:], labels[200:])]
    assert sum(hits) >= 95
    unseen = " ".join(rng.choices(plain, k=30))
    assert score(unseen + " zorkishly zorkist grumpfed") > score(unseen) + 0.2
    again = toxicity.train(texts[:200], labels[:200])
    assert np.array_equal(again.weights, model.weights)


def grams_by_hand(word, size):
    """The rows of a word: all runs of 3 to 6 characters of <word>, repeats too, and one for the whole."""
    marked = "<" + word + ">"
    runs = [marked[i:j] for i in range(len(marked)) for j in range(i + 3, i + 7) if j <= len(marked)]
    return [zlib.crc32(g.encode()) % size for g in [*runs, "=" + marked]]


def test_toxicity_scores_by_definition():
    """Each text's score from the table of weights, word by word, with forms that training never saw."""
    rng = random.Random(6)
    weights = np.random.default_rng(2).normal(size=64).astype(np.float32)
    model = toxicity.Model(weights, -0.7)
    score = model.scorer()
    letters = ["a", "b", "é", "ß", "日", "x", "1", "Z"]
    for n in [0, 1, 2, 5, 40, 300]:
        words = ["".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(n)]
        text = rng.choice([" ", ", ", "--", "_"]).join(words)
        low = [w.lower() for w in words]
        values = [np.mean([weights[g] for g in grams_by_hand(w, 64)]) for w in low]
        z = -0.7 + (toxicity.SCALE * len(set(low)) / (len(set(low)) + toxicity.PRIOR_WORDS) * np.mean(values) if words else 0)
        assert score(text) == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6)


def test_toxicity_training_follows_the_gradient():
    """A few rounds against Adam on numerical gradients of the loss, written from its definition."""
    texts = ["bad zork day", "zork zork", "fine day here", "day here fine fine", "bad here zork", "fine bad day", "zork fine here", "here day bad"]
    y = np.array([1, 1, 0, 0, 1, 0, 1, 0])
    size, dim, rounds = 32, 2, 4
    grams = {w: grams_by_hand(w, size) for t in texts for w in t.split()}
    used = sorted({g for v in grams.values() for g in v})
    place = {g: i for i, g in enumerate(used)}
    rng = np.random.default_rng(7)
    table = (rng.standard_normal((len(used), dim)) * 0.01).astype(np.float32).astype(float)
    softmax = np.stack([-np.ones(dim), np.ones(dim)]) * rng.choice([-0.5, 0.5], dim)
    parameters = np.concatenate([table.ravel(), softmax.ravel(), np.zeros(2)])
    cut = table.size, table.size + 2 * dim

    def loss(p):
        t, s, b = p[: cut[0]].reshape(-1, dim), p[cut[0] : cut[1]].reshape(2, dim), p[cut[1] :]
        out = toxicity.DECAY / 2 * ((t**2).sum() + (s**2).sum())
        for text, label in zip(texts, y):
            words = text.split()
            trust = len(set(words)) / (len(set(words)) + toxicity.PRIOR_WORDS)
            mean = toxicity.SCALE * trust * np.mean([np.mean([t[place[g]] for g in grams[w]], axis=0) for w in words], axis=0)
            z = s @ mean + b
            out += (np.log(np.exp(z).sum()) - z[label]) * 0.5 / (y == label).sum()
        return out

    m = v = np.zeros_like(parameters)
    for k in range(1, rounds + 1):
        gradient = np.array([(loss(parameters + d) - loss(parameters - d)) / 2e-6 for d in np.eye(len(parameters)) * 1e-6])
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        parameters = parameters - toxicity.RATE * (1 - k / (rounds + 1)) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
    t, s, b = parameters[: cut[0]].reshape(-1, dim), parameters[cut[0] : cut[1]].reshape(2, dim), parameters[cut[1] :]
    model = toxicity.train(texts, y, buckets_size=size, dim=dim, epochs=rounds)
    want = np.zeros(size)
    want[used] = t @ (s[1] - s[0])
    assert model.weights == pytest.approx(want, abs=2e-2) and np.corrcoef(model.weights, want)[0, 1] > 0.999
    assert model.bias + toxicity.CAUTION == pytest.approx(b[1] - b[0], abs=1e-2)


def test_columns_of_clashing_names(spark):
    """Whatever else the tables hold under the names that operators use or give."""
    from loomgraph.llm import bpe, license_scan

    names = "held_out string, score string, predicted string, n_tokens string, ids_sha256 string, lang_pred string, words string, n_words string, labels string, value string, toxic int"
    docs = spark.createDataFrame([(i, t, *"abcdefghij", 1) for i, t in enumerate(["some words", None, "all rights reserved"])], f"doc_id long, text string, {names}")
    plain = docs.select("doc_id", "text")
    labels = spark.createDataFrame([(0, 1, "x"), (2, 0, "y")], "doc_id long, toxic int, text string")
    model = toxicity.fit(docs, labels)
    for run in (lambda d: toxicity.score(d, model), lambda d: bpe.encode_decode(d, PATH), license_scan.scan_licenses):
        assert sorted(map(tuple, run(docs).collect()), key=str) == sorted(map(tuple, run(plain).collect()), key=str)
    assert toxicity.keep_clean(docs, model).columns == docs.columns


def test_licences_of_null_and_repeated_ids(spark):
    from loomgraph.llm import license_scan

    docs = spark.createDataFrame([(None, "all rights reserved"), (None, None), (3, "cc by"), (3, "cc by"), (3, "other")], "doc_id long, text string")
    rows = sorted(((r.doc_id, r.n_base, r.base_labels) for r in license_scan.scan_licenses(docs).collect()), key=str)
    assert rows == sorted([(None, 1, "reserved"), (None, 0, ""), (3, 1, "cc-by"), (3, 1, "cc-by"), (3, 0, "")], key=str)


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "some words", "x"), (None, "!!!", "x")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.score(docs, toxicity.fit(docs, none)).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert {r.doc_id: r.held_out for r in rows}[None] is False
    assert toxicity.score(docs.limit(0), toxicity.fit(docs, none)).count() == 0
    assert toxicity.keep_clean(docs, toxicity.Model(np.zeros(8, dtype=np.float32), -3.0)).count() == 4


def test_toxicity_sample_takes_labelled_documents_alone(spark):
    """Labels without a document take no place, and a repeated id is learned from once, with its least text."""
    ids = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 5]
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids[::100]] + [(ids[100], "again")] * 50 + [(None, "none")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in ids for _ in range(2)] + [(ids[0], None), (None, 1), (ids[100], 0)], "doc_id long, toxic int")
    got = toxicity.training_rows(docs, labels, rows=20)
    assert [x[2] for x in got].count(0) == 1 and [x[2] for x in got].count(1) == 20 and len(set(got)) == 21
    assert {x[1] for x in got if x[0] == ids[100]} == {"again"}
    more = toxicity.training_rows(docs, labels, rows=1000)
    assert sorted(x[0] for x in more if x[2]) == ids[::100]


def test_toxicity_on_documents(spark):
    """On a bounded sample of the small table: rankings of held-out rows are far from chance."""
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    found = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels.select("doc_id", "toxic"), "doc_id").collect()
    for r in found[:50]:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    seen = [r for r in found if not r.held_out]
    assert sum(r.predicted == r.toxic for r in seen) / len(seen) > 0.97
    held = [r for r in found if r.held_out]
    assert sum(r.predicted == r.toxic for r in held) / len(held) > 0.85


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(read_file(PATH))


def test_forward_sums_all_segmentations(vocabulary):
    listed = [b" ", b"a", b"b", b"ab", b" a", b" ab", b"ba", b"abababababab"]
    pieces = {b: i for i, b in enumerate(listed)}
    rng = np.random.default_rng(1)
    p = rng.dirichlet(np.ones(len(pieces)), 2).T
    for word in ["a", "ab", "abab", "ba" * 12]:
        marked = b" " + word.encode()
        total = np.zeros(2)
        if len(word) < 6:
            for cuts in product([0, 1], repeat=len(marked) - 1):
                parts, at = [], 0
                for i, c in enumerate([*cuts, 1]):
                    if c:
                        parts.append(marked[at : i + 1])
                        at = i + 1
                if all(x in pieces for x in parts):
                    total += np.prod([p[pieces[x]] for x in parts], axis=0)
        else:  # the same by recursion
            best = {0: np.ones(2)}
            for e in range(1, len(marked) + 1):
                best[e] = sum((best[s] * p[pieces[marked[s:e]]] for s in range(max(0, e - 12), e) if marked[s:e] in pieces), np.zeros(2))
            total = best[len(marked)]
        model = language.Model(["x", "y"], listed, np.log(p))
        assert np.allclose(model.log_words([word])[0], np.log(total))
    long = model.log_words(["ab" * 3000])
    assert np.isfinite(long).all() and (long < -1000).all()
    together = model.log_words(["ab" * n for n in (3000, 1, 7, 200, 3000)])
    assert np.allclose(together[0], long) and np.allclose(together[[1, 2]], [model.log_words(["ab" * n])[0] for n in (1, 7)])


def counted(spark, counts):
    return spark.createDataFrame([(l, w, n) for l, c in counts.items() for w, n in c.items()], "lang string, word string, n long").repartition(3)


def test_long_words_in_parts(spark, vocabulary, monkeypatch):
    model = language.learn(counted(spark, {"en": {"the": 5, "thethe": 2}, "ja": {"日本語": 5}}), vocabulary)
    some, n = [b" " + w.encode() for w in ("日本語" * 90, "the" * 200, "x", "hello")], np.array([2.0, 1.0, 5.0, 3.0])
    uses = model.expected(some, n, model.log_p[:, 0])
    assert (uses @ np.array([len(x) for x in model.pieces])) == pytest.approx(n @ [len(w) for w in some])
    words = ["日本語" * 400, "the" * 900, "x", "日本" * 150]
    whole = model.log_words(words)
    monkeypatch.setattr(language, "BYTES_AT_ONCE", 150)
    assert np.allclose(model.log_words(words), whole)
    assert np.allclose(model.expected(some, n, model.log_p[:, 0]), uses)


def test_many_values_of_the_language_column(spark, vocabulary):
    """The most frequent ones are learned, ties by name; quotes and empty strings are values like others."""
    rows = [(i, "the and of", "en") for i in range(40)] + [(100 + i, "der die das", "d'e\"") for i in range(30)] + [(200 + i, "le la les", "") for i in range(20)] + [(1000 + i, "x y", f"l{i:03d}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    words = language.training_words(docs, languages=5)
    known = {r.lang for r in words.select("lang").distinct().collect()}
    first = sorted(f"l{i:03d}" for i in range(300) if zlib.crc32(str(1000 + i).encode()) % 4 != 2)[:2]
    assert known == {"en", "d'e\"", "", *first}
    got = {r.doc_id: r.lang_pred for r in language.predict(docs, language.fit(docs, PATH, languages=5)).collect()}
    assert got[0] == "en" and got[100] == "d'e\"" and got[200] == ""


def test_scripts_without_spaces_are_learned(spark, vocabulary):
    """Runs of letters far beyond any word's length; all pieces of the vocabulary take part."""
    rng = random.Random(3)
    letters = {"ja": "あいうえおかきくけこ", "th": "กขคงจฉชซญดต", "zh": "天地人日月山水火木金"}
    rows = [(i, "".join(rng.choices(letters[lang], k=rng.randint(80, 300))) + "。", lang) for i, lang in enumerate(sorted(letters) * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, PATH)
    assert len(model.pieces) == len(vocabulary.ids) and max(map(len, model.pieces)) == vocabulary.longest
    counts = {}
    for r in language.training_words(docs).collect():
        counts.setdefault(r.lang, {})[r.word] = r.n
    used = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    assert min(len(w) for c in counts.values() for w in c) >= 80  # whole
    assert {k: sum(n * len(w) for w, n in c.items()) for k, c in counts.items()} == {k: sum(len(t) - 1 for _, t, lang in used if lang == k) for k in letters}
    got = {r.doc_id: r.lang_pred for r in language.predict(docs, model).collect()}
    assert all(got[i] == lang for i, _, lang in rows)


def test_expectation_maximisation_raises_the_likelihood(spark, vocabulary):
    counts = {"en": {"the": 50, "and": 30, "theand": 4}, "de": {"der": 40, "die": 30, "und": 20}}
    scores = []
    for rounds in (1, 3, 6):
        m = language.learn(counted(spark, counts), vocabulary, rounds)
        assert np.allclose(np.exp(m.log_p).sum(axis=0), 1)
        scores.append(sum(n * m.log_words([w])[0, m.languages.index(l)] for l, c in counts.items() for w, n in c.items()))
    assert scores[0] <= scores[1] <= scores[2] + 1e-9


def test_language_edges(spark, vocabulary):
    model = language.learn(counted(spark, {"en": {"the": 5}, "de": {"der": 5}}), vocabulary)
    texts = [None, "", "123 !!", "²", "der der", "the", "d" * 5000, "中文"]
    docs = spark.createDataFrame([(i, t, "xx", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, score int")
    got = {r.doc_id: r for r in language.predict(docs, model).collect()}
    assert [got[i].lang_pred for i in range(6)] == ["und", "und", "und", "und", "de", "en"]
    assert all(0 <= r.score <= 1 and math.isfinite(r.score) for r in got.values()) and got[6].lang_pred != "und" != got[7].lang_pred
    assert language.predict(docs.limit(0), model).count() == 0
    empty = language.Model([], [], np.zeros((0, 0)))
    assert {r.lang_pred for r in language.predict(docs, empty).collect()} == {"und"}
    assert language.fit(docs.filter("doc_id < 0"), PATH).languages == []
    assert sorted(r.doc_id for r in language.keep_languages(docs, model).collect()) == [4, 5, 6, 7]


def test_language_on_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = language.predict(docs, language.fit(docs, PATH)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    for r in rows[:50]:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [r for r in rows if r.held_out and r.lang_pred != "und"]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.98


def test_pipeline(spark):
    import corpus_pipeline
    from loomgraph.llm.line_dedup import line_key

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {name: None for name, _ in corpus_pipeline.STAGES}
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in at.collect()}
        out = stage(spark, at, sf)
        if name != "packing":
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            at = spark.createDataFrame(out.collect(), docs.schema)
        after = {r.doc_id: r for r in out.collect()}
        kept[name] = len(after)
        if name == "toxicity":
            model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet")).scorer()
            assert set(after) == {i for i, r in before.items() if model(r.text) < 0.5}
        elif name == "language":
            assert set(after) == {i for i, r in before.items() if language.has_letter(r.text)}
        elif name == "line_dedup":
            count = {}
            for i, r in before.items():
                for k in {line_key(x) for x in (r.text or "").split("\n")}:
                    count.setdefault(k, []).append(i)
            for i, r in before.items():
                left = [x for x in (r.text or "").split("\n") if len(line_key(x)) < 40 or len(count[line_key(x)]) < 5 or max(count[line_key(x)]) == i]
                assert after[i].text == "\n".join(left) and after[i].n_chars == len(after[i].text)
        elif name == "near_dedup":
            marks = {i: simhash.fingerprint(r.text) for i, r in before.items()}
            root = {i: i for i in marks}

            def find(i):
                while root[i] != i:
                    i = root[i]
                return i

            for i in marks:
                for j in marks:
                    if i < j and bin(marks[i] ^ marks[j]).count("1") <= 3 and find(i) != find(j):
                        root[max(find(i), find(j))] = min(find(i), find(j))
            assert set(after) == {find(i) for i in marks}
        else:
            assert set(after) == set(before)
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == set(after)
