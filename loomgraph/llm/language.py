"""Language identification by segmentation-marginalised unigrams.

Every language has a distribution over the pieces of a fixed public vocabulary, all of them. The probability of a word
is the sum over all its segmentations into pieces, by a forward pass over its bytes in logarithms; that of a text is
the product over its words. A string automaton finds the pieces that end at each byte. The piece probabilities are
those that expectation-maximisation over all segmentations gives for the training words. Vocabularies hold every
single byte, so every word has a probability.

The training sample is bounded: of the LANGUAGES most frequent values of the language column (ties by name), each, the
documents whose hashed id falls below a threshold that makes SAMPLE_DOCS of them in expectation. Their words are counted
whole and stay on the executors; a round of expectation-maximisation is an aggregate over them, and what reaches the
driver is the model, a number for each piece and language. Neither training nor scoring cuts a word: words beyond
BYTES_AT_ONCE go through both passes in parts, of which training keeps one number a byte. Scoring is one pass over all
whole texts; a word's log-probabilities are computed once and remembered for each worker, in bounded memory, and new
words of a batch are scored together.

Defined results: a null text and a text without a letter are `und` with score 0. Documents with a null language or a
null id are not learned from. Repeated rows are learned from and scored like others. Without any training document all
texts are `und`. An empty table gives an empty result. Ties go to the first language by name. Other columns are not
read.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import cached_property
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.bpe import Vocabulary, read_file
from loomgraph.llm.common import checkpointed, small_batches

SAMPLE_DOCS = 400
#: Values of the language column that are learned, at most; a column without order may hold any number of them.
LANGUAGES = 200
FOLDS, HELD_OUT = 4, 2
ROUNDS = 3
#: Added to every piece's expected count.
SMOOTH = 0.02
UNKNOWN = "und"
#: Words, and characters of words, that a worker remembers.
WORD_CACHE, CHAR_CACHE = 150_000, 4_000_000
#: Bytes that are run through the forward pass together.
BYTES_AT_ONCE = 1 << 16
_LENGTH_BITS = 12
_LENGTH = (1 << _LENGTH_BITS) - 1
_WORD = re.compile(r"[^\W\d_]+")


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


class Lattice:
    """Where pieces stand in some words: for each end, shortest first, the words, starts and pieces. Positions are bytes."""

    def __init__(self, words: list[bytes], found, offsets: np.ndarray, first: int = 0):
        """found: pairs (place of the last byte, piece and its length); offsets: place of each word; first: bytes of a word before these."""
        flat = np.fromiter(chain.from_iterable(found), dtype=np.int64).reshape(-1, 2)
        word = np.searchsorted(offsets, flat[:, 0], side="right") - 1
        end = flat[:, 0] - offsets[word] + 1 + first
        order = np.lexsort((word, end))
        self.word, self.piece = word[order], flat[order, 1] >> _LENGTH_BITS
        self.start = (end - (flat[:, 1] & _LENGTH))[order]
        self.ends, self.at = np.unique(end[order], return_index=True)
        self.at = np.append(self.at, len(order))

    def steps(self):
        return zip(self.ends.tolist(), map(slice, self.at[:-1].tolist(), self.at[1:].tolist()))


def forward(lattice: Lattice, log_p: np.ndarray, a: np.ndarray, first: int = 0) -> None:
    """Fills a[word, end - first]: the log of the sum over all segmentations of the word up to there, by language."""
    for end, some in lattice.steps():
        word = lattice.word[some]
        x = a[word, lattice.start[some] - first] + log_p[lattice.piece[some]]
        begin = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        if len(begin) < len(word):
            most = np.maximum.reduceat(x, begin, axis=0)
            x = most + np.log(np.add.reduceat(np.exp(x - np.repeat(most, np.diff(np.append(begin, len(word))), axis=0)), begin, axis=0))
        a[word[begin], end - first] = x


def _expected(lattices, sizes: np.ndarray, n: np.ndarray, log_q: np.ndarray) -> np.ndarray:
    """Expected uses of each piece, over all segmentations of words that occur n times; lattices: functions that give the words' parts, in order."""
    shape = len(sizes), int(sizes.max()) + 1
    a, b = np.zeros((*shape, 1)), np.full(shape, -np.inf)
    for part in lattices:
        forward(part(), log_q[:, None], a)
    every = np.arange(len(sizes))
    total, b[every, sizes] = a[every, sizes, 0], 0.0
    out = np.zeros(len(log_q))
    for part in reversed(lattices):
        for end, some in reversed(list((lattice := part()).steps())):
            word, start, piece = lattice.word[some], lattice.start[some], lattice.piece[some]
            x = b[word, end] + log_q[piece]
            b[word, start] = np.logaddexp(b[word, start], x)
            out += np.bincount(piece, weights=n[word] * np.exp(a[word, start, 0] + x - total[word]), minlength=len(out))
    return out


class Model:
    def __init__(self, languages: list[str], pieces: list[bytes], log_p: np.ndarray):
        self.languages, self.pieces, self.log_p = languages, pieces, log_p  # log_p: [piece, language]

    def __getstate__(self):
        return self.languages, self.pieces, self.log_p

    def __setstate__(self, state):
        self.__init__(*state)

    @cached_property
    def automaton(self):
        """Finds all pieces in a text of bytes, shown as the characters of the same numbers."""
        found = ahocorasick.Automaton()
        for i, t in enumerate(self.pieces):
            found.add_word(t.decode("latin-1"), i << _LENGTH_BITS | len(t))
        found.make_automaton()
        return found

    def groups(self, words: list[bytes]):
        """Indices of words of similar length, of BYTES_AT_ONCE together or one longer word."""
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        begin = 0
        while begin < len(order):
            end = begin + 1
            while end < len(order) and (end + 1 - begin) * (len(words[order[end]]) + 1) <= BYTES_AT_ONCE:
                end += 1
            yield order[begin:end]
            begin = end

    def lattice(self, words: list[bytes]) -> Lattice:
        sizes = np.array([len(w) + 1 for w in words])
        text = "\u0100".join(w.decode("latin-1") for w in words)  # a mark that is no byte keeps words apart
        return Lattice(words, self.automaton.iter(text), np.cumsum(sizes) - sizes)

    def parts(self, words: list[bytes]) -> list:
        """Functions that give the lattices of these words, several only for one long word."""
        if len(words) > 1 or len(words[0]) <= BYTES_AT_ONCE:
            whole = self.lattice(words)
            return [lambda: whole]
        longest = max(map(len, self.pieces))

        def ending(at: int):  # the pieces that end in this part
            first = max(0, at - longest + 1)
            text = words[0][first : at + BYTES_AT_ONCE].decode("latin-1")
            return lambda: Lattice(words, ((place, x) for place, x in self.automaton.iter(text) if place + first >= at), np.zeros(1, dtype=np.int64), first)

        return [ending(at) for at in range(0, len(words[0]), BYTES_AT_ONCE)]

    def expected(self, words: list[bytes], n: np.ndarray, log_q: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in these words, of which each occurs n times."""
        out = np.zeros(len(self.pieces))
        for group in self.groups(words):
            some = [words[i] for i in group]
            out += _expected(self.parts(some), np.array([len(w) for w in some]), n[group], log_q)
        return out

    def log_words(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.languages)))
        marked = [b" " + w.encode() for w in words]
        for group in self.groups(marked):
            some = [marked[i] for i in group]
            if len(some[0]) > BYTES_AT_ONCE:
                out[group[0]] = self._long(some[0])
                continue
            a = np.zeros((len(some), len(some[-1]) + 1, len(self.languages)))
            forward(self.lattice(some), self.log_p, a)
            out[group] = a[np.arange(len(some)), [len(w) for w in some]]
        return out

    def _long(self, word: bytes) -> np.ndarray:
        """One word in parts, of which only the sums that a piece can still start from are kept."""
        longest = max(map(len, self.pieces))
        found, a, kept = None, np.zeros((1, 1, len(self.languages))), 0  # a[0, i]: the sum up to byte kept + i
        for at in range(0, len(word), BYTES_AT_ONCE):
            part = word[at : at + BYTES_AT_ONCE].decode("latin-1")
            if found is None:
                found = self.automaton.iter(part)
            else:
                found.set(part)  # goes on where it stands, places too
            a = np.concatenate([a, np.zeros((1, len(part), len(self.languages)))], axis=1)
            forward(Lattice([word], found, np.zeros(1, dtype=np.int64)), self.log_p, a, kept)
            kept, a = kept + max(0, a.shape[1] - longest), a[:, -longest:]
        return a[0, -1]

    def predictor(self):
        known: dict[str, int] = {}
        rows, characters = np.zeros((0, len(self.languages))), 0

        def predict(texts: list[str | None]) -> list[tuple[str, float]]:
            nonlocal rows, characters
            if not self.languages:
                return [(UNKNOWN, 0.0)] * len(texts)
            counts = [Counter(words_of(t)) if t else Counter() for t in texts]
            new = list({w: None for c in counts for w in c if w not in known})
            characters += sum(map(len, new))
            if known and (len(known) + len(new) > WORD_CACHE or characters > CHAR_CACHE):
                known.clear()
                rows = rows[:0]
                new = list({w: None for c in counts for w in c})
                characters = sum(map(len, new))
            if new:
                known.update(zip(new, range(len(rows), len(rows) + len(new))))
                rows = np.concatenate([rows, self.log_words(new)])
            out = []
            for text, c in zip(texts, counts):
                if not c or not has_letter(text):
                    out.append((UNKNOWN, 0.0))
                    continue
                n = np.fromiter(c.values(), dtype=np.float64, count=len(c))
                z = n @ rows[np.fromiter(map(known.__getitem__, c), dtype=np.int64, count=len(c))]
                best = int(z.argmax())
                out.append((self.languages[best], float(1 / np.exp(z - z[best]).sum())))
            return out

        return predict


def learn(words: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> Model:
    """words: lang, word, n. Expectation-maximisation over all segmentations; a round is an aggregate over the words."""
    spark = words.sparkSession
    small_batches(spark)
    words = checkpointed(words.select("lang", F.col("word"), F.col("n").cast("double").alias("n")))
    languages = sorted(r.lang for r in words.select("lang").distinct().collect())
    pieces = sorted(vocabulary.ids)
    place = {x: i for i, x in enumerate(languages)}
    finder = spark.sparkContext.broadcast(Model(languages, pieces, np.zeros((0, 0))))  # its automaton is built once for each worker
    log_q = np.full((len(pieces), len(languages)), -np.log(len(pieces)))
    for _ in range(rounds if languages else 0):
        now = spark.sparkContext.broadcast(log_q)

        def count(batches):
            found: dict[int, np.ndarray] = {}
            for batch in batches:
                lang, word = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                n = batch.column(2).to_numpy(zero_copy_only=False)
                for language in sorted(set(lang)):
                    at = place[language]
                    mine = np.flatnonzero([x == language for x in lang])
                    uses = finder.value.expected([b" " + word[i].encode() for i in mine], n[mine], now.value[:, at])
                    found[at] = found[at] + uses if at in found else uses
            for at, uses in found.items():
                used = np.flatnonzero(uses)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), at), pa.int32()), pa.array(used, pa.int32()), pa.array(uses[used], pa.float64())], ["at", "piece", "uses"])

        summed = words.mapInArrow(count, "at int, piece int, uses double").groupBy("at", "piece").agg(F.sum("uses").alias("uses")).toArrow()
        expected = np.full(log_q.shape, SMOOTH)
        expected[summed.column("piece").to_numpy(), summed.column("at").to_numpy()] += summed.column("uses").to_numpy()
        log_q = np.log(expected / expected.sum(axis=0))
        now.destroy()
    return Model(languages, pieces, log_q)


def training_words(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, languages: int = LANGUAGES) -> DataFrame:
    """lang, word, n of the training sample, whole words, dealt over tasks."""
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    usable = source.filter("doc_id is not null and lang is not null").filter(~held_out())
    sizes = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("__n")).orderBy(F.desc("__n"), "lang").limit(languages)
    known = sizes.select("lang", F.least(F.lit(1.0), sample_docs / F.col("__n")).alias("__share"))
    drawn = usable.join(F.broadcast(known), "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < F.col("__share") * float(1 << 40))  # LANGUAGES rows

    def count(batches):
        for batch in batches:
            found: Counter = Counter()
            for text, language in zip(batch.column(0), batch.column(1)):
                found.update((language.as_py(), w) for w in words_of(text.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "word", "n"])

    counted = drawn.select("text", "lang").mapInArrow(count, "lang string, word string, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, path: str, sample_docs: int = SAMPLE_DOCS, languages: int = LANGUAGES) -> Model:
    return learn(training_words(docs, sample_docs, languages), Vocabulary(read_file(path)))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score; one row per row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        guess = shared.value.predictor()
        for batch in batches:
            found = guess(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_languages(docs: DataFrame, model: Model, languages: tuple[str, ...] | None = None, text_col: str = "text") -> DataFrame:
    """docs, with all their columns, without rows of no language or, where given, of other languages; one pass."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        guess = shared.value.predictor()
        for batch in batches:
            found = guess(batch.column(at).to_pylist())
            yield batch.filter(pa.array([x != UNKNOWN and (languages is None or x in languages) for x, _ in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
