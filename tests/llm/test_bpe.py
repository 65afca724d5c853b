"""BPE against the library, by whole texts and by pieces; packing by its round trip."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomgraph.llm import bpe, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", "the", "ing", " ", "  ", "\n", "'s", "'re", "'", "é", "ß", "中", "日本", "🙂", "١", "²", "1", "12", "_", "-", "--", "\t", "\xa0", " ", "\x1c", "\x85", "<|endoftext|>", "<|endo", "A", "Ing", "!", "...", "́", "ﬁ", "xxxxx", "       "]


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Vocabulary(bpe.read_file(PATH)))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def merged(v, content):
    """Plain BPE: the merge of the lowest rank, leftmost first, until none is left."""
    ids = [v.ids[bytes([b])] for b in content]
    while ranked := [(v.rank[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in v.rank]:
        _, i = min(ranked)
        ids[i : i + 2] = [v.ids[v.table[ids[i]] + v.table[ids[i + 1]]]]
    return ids


def ids_of(packed):
    return np.frombuffer(packed, dtype="<u4").tolist()


def test_like_the_library(encoder, library):
    rng = random.Random(5)
    encode = packing.tokenizer_of(bpe.read_file(PATH))
    for _ in range(1500):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40)))
        want = library.encode(text, add_special_tokens=False).ids
        assert ids_of(encoder.encode(text)) == want
        assert list(encode(text)) == want
        out, at = [], 0
        while at < len(text):
            n = rng.randint(1, 9)
            out.append(encoder.feed(text[at : at + n]))
            at += n
        assert ids_of(b"".join(out) + encoder.finish()) == want


@pytest.mark.parametrize("text", ["a" * 9000, "ab" * 40000 + "c", " " * 40000 + "x", "\xa0" * 40001, "!" * 45000 + "'s", "日本" * 20000, "\n " * 30000 + "q", "1" * 40000, "x'" * 20000])
def test_pretokens_without_end(encoder, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert ids_of(encoder.encode(text)) == want
    assert list(packing.tokenizer_of(bpe.read_file(PATH))(text)) == want


@pytest.mark.parametrize("text", [" " * 1_000_000 + "x", "\n" * 300_000 + " y", "words and more\n" * 40_000, "a b" * 60_000 + "\t" * 100_000 + "<|endoftext|>" + " c" * 50_000 + " <|endo", "z" * 140_000 + " z" * 66_000 + " ", "日" * 70_000 + "  日" * 70_000])
def test_very_long_texts_in_packing(library, text):
    """Long enough for the stack of the compiled encoder's word pattern."""
    assert list(packing.tokenizer_of(bpe.read_file(PATH))(text)) == library.encode(text, add_special_tokens=False).ids


def test_memory_of_the_transducer_is_bounded(encoder, library):
    t = bpe.Transducer(encoder.v)
    rng, most, out = random.Random(1), 0, []
    content = bytes(rng.choice(b"abcdehinrst") for _ in range(20000))
    for at in range(0, len(content), 50):
        out += t.feed(content[at : at + 50])
        most = max(most, t.size, len(t.last) - 1)
    out += t.finish()
    assert b"".join(encoder.v.table[i] for i in out) == content
    assert most <= 2 * (encoder.v.lookahead + encoder.v.longest) + 50
    assert out == library.encode(content.decode(), add_special_tokens=False).ids


def test_every_word_like_plain_merging(encoder):
    rng = random.Random(7)
    for _ in range(4000):
        content = bytes(rng.choice(rng.choice([b"ab", b"etaoin ", b"-=_", bytes(range(256))])) for _ in range(rng.randint(1, 30)))
        assert encoder.transducer.whole(content) == merged(encoder.v, content)


def test_decoder(encoder, library):
    rng = random.Random(2)
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 30))]
        decoder = bpe.Decoder(encoder.v)
        assert "".join(decoder.decode(ids, step=3)) == library.decode(ids, skip_special_tokens=False)


def test_query(spark, library):
    texts = [(1, "Hello world"), (2, None), (3, ""), (3, ""), (None, "x <|endoftext|> y"), (5, "long " * 30000)]
    frame = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, n_tokens long")
    rows = {(r.doc_id, r.n_tokens): r for r in bpe.encode_decode(frame, PATH, with_ids=True).collect()}
    assert len(bpe.encode_decode(frame, PATH).collect()) == 6
    for i, t in texts:
        want = library.encode(t or "", add_special_tokens=False).ids
        assert rows[i, len(want)].ids == want and rows[i, len(want)].decoded == (t or "")
    assert bpe.encode_decode(frame.limit(0), PATH).count() == 0


def test_packing_round_trip(spark, library):
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "é", "\n"]
    texts = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 50, 300, 1500, 6000])))) for i in range(120)] + [(500, None), (501, ""), (502, "x"), (None, "no id")]
    frame = spark.createDataFrame([(i, t, 7) for i, t in texts], "doc_id long, text string, length int").repartition(3)
    rows = packing.pack(frame, PATH, with_ids=True).collect()
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
        assert r.length == len(r.ids) > 0 and r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
    for i, t in texts:
        pieces = sorted(docs[i], key=lambda r: r.start)
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        assert sum((p.ids for p in pieces), []) == ids
        assert [p.start for p in pieces] == list(np.cumsum([0] + [p.length for p in pieces])[:-1]) and {p.doc_tokens for p in pieces} == {len(ids)}
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == list(np.cumsum([0] + [p.length for p in pieces])[:-1])
        total = sum(p.length for p in pieces)
        assert total == pieces[0].context <= 1024 and total & (total - 1) == 0
    groups = {}
    for pieces in sequences.values():
        groups.setdefault(pieces[0].step_group, []).append(pieces[0].context)
    assert all(len(set(g)) == 1 and sum(g) <= packing.STEP_TOKENS for g in groups.values())
    assert packing.pack(frame.limit(0), PATH).count() == 0


def test_open_pieces_do_not_keep_their_documents():
    packer = packing.Packer()
    for i in range(50):
        packer.add((i, 100_001), np.arange(100_001, dtype="<u4"))
        packer.batch_over()
    assert all(p[2].base is None or p[2].base.size <= 1024 for pool in packer.pools.values() for p in pool)


def test_packing_across_batches(spark, library):
    """More rows than one Arrow batch, very long texts among them."""
    texts = [(i, "word " * (i % 40)) for i in range(2600)] + [(9000, " " * 1_000_000 + "x"), (9001, "ab " * 200_000)]
    rows = packing.pack(spark.createDataFrame(texts, "doc_id long, text string").repartition(2), PATH).collect()
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    for i, t in texts:
        found = sorted(pieces[i], key=lambda r: r.start)
        ids = np.array(library.encode(t, add_special_tokens=False).ids + [0], dtype="<u4")
        assert [p.start for p in found] == list(np.cumsum([0] + [p.length for p in found])[:-1]) and sum(p.length for p in found) == len(ids)
        assert all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in found)
    sizes = {}
    for r in rows:
        sizes[r.sequence_id] = sizes.get(r.sequence_id, 0) + r.length
    assert all(n <= 1024 and n & (n - 1) == 0 for n in sizes.values()) and sum(n < 1024 for n in sizes.values()) < 0.2 * len(sizes)


def test_pending_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "PENDING_TOKENS", 3000)
    packer, seen = packing.Packer(), 0
    for i in range(200):
        packer.add((i, 900), np.arange(900, dtype="<u4"))
        seen += sum(len(p[2]) for _, w in packer.batch_over() for p in w)
        assert packer.pending <= 3000
    seen += sum(len(p[2]) for _, w in packer.finish() for p in w)
    assert seen == 200 * 900
