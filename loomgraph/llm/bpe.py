"""Byte-level BPE as a streaming transducer with bounded lookahead, and its inverse.

A token sequence is the BPE encoding of a text if and only if no merge crosses any border of two neighbours, which
the merge trees of the two decide alone. So the last token of the encoding of every prefix is unique, and one pass
over the bytes keeps it for the last few positions only. A token leaves once all positions that a later token can
start from agree on it. How far behind the input that is at most follows from the merge list: a border can depend on
what follows only through a chain of merges of ever higher priority, each sharing a token with the one before
(`Vocabulary.lookahead` is the longest such chain in bytes). Every pre-token goes through the transducer; the ids of
short ones are remembered for the next time, in bounded memory. Memory is constant for a pre-token of any length; text
is cut into pre-tokens as it comes, also within runs of letters or blanks that never end.

Decoding is a state machine from token bytes to text: bytes of an unfinished character wait, broken ones become U+FFFD.

The tokenizer file is a parameter; its bytes are read where the driver runs and broadcast (their size is that of the
file, checked against MAX_FILE).

Defined results: null and empty text give no tokens and an empty text. Strings of special tokens in a text become the
special token, as in the library. Repeated rows and null ids are encoded like others; an empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import sys
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import small_batches

MAX_FILE = 64 << 20
#: Characters taken from a text at once.
CHUNK = 1 << 15
#: The low bits of a token's number in the transducer hold its length.
_LENGTH_BITS = 12
_LENGTH = (1 << _LENGTH_BITS) - 1
_LITTLE = sys.byteorder == "little" and array("I").itemsize == 4
#: Words whose ids are remembered, in each of two generations.
CACHE = 150_000

_SPACE = r"\t-\r \x85\xa0  -     　"
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: The same for text of these characters only, where the faster built-in module has the same classes.
_PLAIN_WORDS = r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+"
_NOT_PLAIN = r"[^\t\n\r\x20-\x7e\xa1\xab\xbb\xbf\xc0-\xd6\xd8-\xf6\xf8-ɏ–—‘’“”…]"


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    def __init__(self, content: bytes):
        parsed = json.loads(content)
        letters = _byte_letters()
        to_bytes = lambda t: bytes(letters[c] for c in t)
        model = parsed["model"]
        self.ids = {to_bytes(t): i for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in parsed.get("added_tokens", ())}
        self.table: list[bytes] = [b""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for t, i in self.ids.items():
            self.table[i] = t
        for t, i in self.special.items():
            self.table[i] = t.encode()
        self.longest = max(map(len, self.ids))
        if self.longest > _LENGTH or len(self.ids) > 1 << 32 - _LENGTH_BITS:
            raise ValueError(f"{len(self.ids)} tokens of up to {self.longest} bytes")
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for k, m in enumerate(model["merges"]):
            left, right = m.split(" ") if isinstance(m, str) else m
            left, right = to_bytes(left), to_bytes(right)
            pair = self.ids[left], self.ids[right]
            self.rank.setdefault(pair, k)
            self.parts.setdefault(self.ids[left + right], (k, *pair))
        # finds the tokens that end at each byte, the longest first, in one pass; bytes are shown as the characters of the same numbers
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.automaton.add_word(t.decode("latin-1"), i << _LENGTH_BITS | len(t))
        self.automaton.make_automaton()
        self.lookahead = self._lookahead()
        never = len(self.rank)
        # the tokens that stand at a token's right and left edge while it is built, with the rank of the merge that ends each
        self._right = [self._edge(i, 2, never) for i in range(len(self.table))]
        self._left = [self._edge(i, 1, never) for i in range(len(self.table))]
        self.valid: dict[int, bool] = {}

    def _edge(self, token: int, side: int, until: int) -> list[tuple[int, int]]:
        out = [(token, until)]
        while token in self.parts:
            until, token = self.parts[token][0], self.parts[token][side]
            out.append((token, until))
        return out

    def _lookahead(self) -> int:
        """Bytes after a border that can still decide about it: chains of merges of rising priority, each starting with the token that the one before would take."""
        after: dict[int, int] = {}
        most = 0
        for (left, right), _ in sorted(self.rank.items(), key=lambda x: x[1]):
            reach = len(self.table[right]) + after.get(right, 0)
            after[left] = max(after.get(left, 0), reach)
            most = max(most, reach)
        return most

    def borders(self, left: int, right: int) -> bool:
        """Whether two tokens, with their lengths, can stand side by side: no merge takes the edges of both while they are there."""
        if len(self.valid) > 1_000_000:
            self.valid.clear()
        found = self.valid[left << 32 | right] = self._borders(left >> _LENGTH_BITS, right >> _LENGTH_BITS)
        return found

    def _borders(self, left: int, right: int) -> bool:
        rank = self.rank
        lefts = self._left[right]
        for r, r_until in self._right[left]:
            for l, l_until in lefts:
                k = rank.get((r, l))
                if k is not None and k < r_until and k <= l_until:
                    return False
        return True


class Transducer:
    """Bytes of one pre-token in, tokens out. Tokens are kept with their lengths, as the automaton gives them."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.step = vocabulary.lookahead + vocabulary.longest
        self.reset()

    def reset(self) -> None:
        self.size = 0  # bytes from position self.base on
        self.base = 0
        self.last: list[int] = [-1]  # last token of the encoding of each prefix, from self.base on
        self.found = None

    def feed(self, more: bytes) -> list[int]:
        out: list[int] = []
        for at in range(0, len(more), self.step):
            self._extend(more[at : at + self.step])
            if self.size > self.step:
                out += self._stable()
        return out

    def finish(self) -> list[int]:
        out = self._chain(self.size)
        self.reset()
        return [t >> _LENGTH_BITS for t in out]

    def whole(self, content: bytes) -> list[int]:
        """The tokens of a pre-token that is at hand; the one that spans all of it is the first that would be tried."""
        token = self.v.ids.get(content)
        return [token] if token is not None else self.feed(content) + self.finish()

    def _extend(self, more: bytes) -> None:
        self.size += len(more)
        shown = more.decode("latin-1")
        if self.found is None:
            self.found = self.v.automaton.iter(shown)
        else:
            self.found.set(shown)  # goes on where it stands
        last, ahead, valid, borders = self.last, self.base - 1, self.v.valid.get, self.v.borders
        n = len(last)
        for at, token in self.found:
            end = at - ahead
            if end < n:
                continue  # its token is known
            start = end - (token & _LENGTH)
            if start < 0:
                continue
            while end > n:
                last.append(-2)  # only before self.base: not a place where a token can end
                n += 1
            before = last[start]
            if before >= 0:
                fits = valid(before << 32 | token)
                if fits is None:
                    fits = borders(before, token)
                if not fits:
                    continue
            elif before == -2:
                continue
            last.append(token)
            n += 1
        last += [-2] * (self.size + 1 - n)

    def _chain(self, end: int) -> list[int]:
        out, last = [], self.last
        while end > 0:
            out.append(last[end])
            end -= last[end] & _LENGTH
        return out[::-1]

    def _stable(self) -> list[int]:
        """Tokens that all places where a later token can start agree on."""
        n = self.size
        chains = [self._chain(end) for end in range(max(1, n + 1 - self.v.longest), n + 1) if self.last[end] != -2]
        agreed = []
        for tokens in zip(*chains):
            if len(set(tokens)) > 1:
                break
            agreed.append(tokens[0])
        if len(agreed) < 2:
            return []
        out = agreed[:-1]  # the last one is kept, as a neighbour to what follows
        cut = sum(t & _LENGTH for t in out)
        self.last = [out[-1]] + self.last[cut + 1 :]
        # positions inside the tokens that left can start nothing
        self.size -= cut
        self.base += cut
        return [t >> _LENGTH_BITS for t in out]


class _Remembered(dict):
    """Ids, as bytes, of whole words; two generations bound the memory."""

    def __init__(self, encoder: Encoder):
        self.encoder, self.old = encoder, {}

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = self.encoder.word(word)
        if len(word) <= 64:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[word] = found
        return found


class Encoder:
    """Text in pieces in, ids out as little-endian 32-bit integers."""

    def __init__(self, vocabulary: Vocabulary):
        import re

        import regex

        self.v = vocabulary
        self.transducer = Transducer(vocabulary)
        self.known = _Remembered(self)
        self._words, self._plain = regex.compile(WORDS), re.compile(_PLAIN_WORDS)
        self._odd = re.compile(_NOT_PLAIN)
        self.border = regex.compile(rf"(?<=[^{_SPACE}])(?=[{_SPACE}])")
        self.blank = regex.compile(rf"[{_SPACE}]+")
        self._runs = [regex.compile(x) for x in (r"\p{L}+", r"\p{N}+", rf"[{_SPACE}]+", rf"[^{_SPACE}\p{{L}}\p{{N}}]+")]
        self._special = regex.compile("|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True)))) if vocabulary.special else None
        self.buffer = ""
        self.run = None  # the class of a pre-token that is under way

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return np.array(ids, dtype="<u4").tobytes()

    def word(self, word: str) -> bytes:
        ids = self.transducer.whole(word.encode())
        return array("I", ids).tobytes() if _LITTLE else self._pack(ids)

    def _closed(self, text: str) -> bytes:
        """Text with a border of pre-tokens at its end."""
        find = self._words if self._odd.search(text) else self._plain
        return b"".join(map(self.known.__getitem__, find.findall(text)))

    def last_border(self, text: str, begin: int, end: int) -> int:
        """The last place in (begin, end] where a blank follows another character, so that a pre-token ends; 0 if there is none."""
        for at in range(min(end, len(text) - 1), begin, -1):
            if text[at].isspace() and self.blank.match(text[at]) and not self.blank.match(text[at - 1]):
                return at
        return 0

    def feed(self, text: str) -> bytes:
        self.buffer += text
        out = []
        while True:
            if self._special is not None and (m := self._special.search(self.buffer)):
                rest = self.buffer[m.end() :]
                self.buffer = self.buffer[: m.start()]
                out += [self._pieces(True), self._pack([self.v.special[m[0]]])]
                self.buffer = rest
                continue
            break
        out.append(self._pieces(False))
        return b"".join(out)

    def finish(self) -> bytes:
        return self._pieces(True)

    def _held(self) -> int:
        """Characters at the end that may belong to a special token or change what stands before them."""
        most = 3
        for s in self.v.special:
            for n in range(len(s) - 1, 0, -1):
                if self.buffer.endswith(s[:n]):
                    most = max(most, n)
                    break
        return most

    def _pieces(self, final: bool) -> bytes:
        out = []
        if self.run is not None:
            out.append(self._go_on(final))
        if self.run is not None:
            return b"".join(out)
        if final:
            out.append(self._closed(self.buffer))
            self.buffer = ""
            return b"".join(out)
        limit = len(self.buffer) - self._held()
        if cut := self.last_border(self.buffer, 0, max(0, limit)):
            out.append(self._closed(self.buffer[:cut]))
            self.buffer = self.buffer[cut:]
        elif limit > CHUNK // 8:  # no blank in sight
            while (m := self._words.match(self.buffer)) and m.end() < len(self.buffer) - self._held():
                out.append(self.known[m[0]])
                self.buffer = self.buffer[m.end() :]
            if len(self.buffer) > CHUNK // 8 and m:
                self.run = next(r for r in self._runs if r.match(m[0][-1]))
                lead = 1 if m[0][0] == " " and not self.run.match(" ") else 0
                out.append(self._pack(self.transducer.feed(self.buffer[:lead].encode())))
                self.buffer = self.buffer[lead:]
                out.append(self._go_on(False))
        return b"".join(out)

    def _go_on(self, final: bool) -> bytes:
        """Feed the pre-token under way; ends it where another class begins."""
        m = self.run.match(self.buffer)
        end = m.end() if m else 0
        over = end < len(self.buffer) and not (not final and end >= len(self.buffer) - self._held())
        blank = self.run is self._runs[2]
        if over:
            end -= blank  # a blank before other text belongs to that
        elif not final:
            end = max(0, min(end, len(self.buffer) - self._held()))
        ids = self.transducer.feed(self.buffer[:end].encode())
        self.buffer = self.buffer[end:]
        if over or final:
            ids += self.transducer.finish()
            self.run = None
        return self._pack(ids)

    def pieces(self, text: str) -> Iterator[bytes]:
        """The ids of a text as they leave."""
        if len(text) <= CHUNK and (self._special is None or not self._special.search(text)):
            yield self._closed(text)
            return
        for at in range(0, len(text), CHUNK):
            yield self.feed(text[at : at + CHUNK])
        yield self.finish()

    def encode(self, text: str) -> bytes:
        return b"".join(self.pieces(text))


class Decoder:
    """Ids in pieces in, text out."""

    def __init__(self, vocabulary: Vocabulary):
        self.table = vocabulary.table
        self._machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        return self._machine.decode(b"".join(map(self.table.__getitem__, ids)))

    def finish(self) -> str:
        out = self._machine.decode(b"", True)
        self._machine.reset()
        return out

    def decode(self, ids: list[int], step: int = 8192) -> Iterator[str]:
        for at in range(0, len(ids), step):
            yield self.feed(ids[at : at + step])
        yield self.finish()


def read_file(path: str) -> bytes:
    with open(path, "rb") as f:
        content = f.read(MAX_FILE + 1)
    if len(content) > MAX_FILE:
        raise ValueError(f"{path} holds more than {MAX_FILE} bytes")
    return content


_LOADED: dict[str, Encoder] = {}


def encoder_of(content: bytes) -> Encoder:
    """The encoder of a tokenizer file, once for each Python worker."""
    key = hashlib.sha256(content).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Encoder(Vocabulary(content))
    return _LOADED[key]


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, on request, ids and the decoded text."""
    spark = docs.sparkSession
    small_batches(spark)
    content = spark.sparkContext.broadcast(read_file(path))

    def run(batches):
        encoder = encoder_of(content.value)
        decoder = Decoder(encoder.v)
        for batch in batches:
            counts, ids_sha, text_sha, all_ids, all_texts = [], [], [], [], []
            for cell in batch.column(1):  # one text at a time, and of its ids one piece
                n, of_ids, of_text, kept_ids, kept = 0, hashlib.sha256(), hashlib.sha256(), [], []
                for packed in encoder.pieces(cell.as_py() or ""):
                    of_ids.update(packed)
                    ids = np.frombuffer(packed, dtype="<u4").tolist()
                    n += len(ids)
                    decoded = decoder.feed(ids)
                    of_text.update(decoded.encode())
                    if with_ids:
                        kept_ids += ids
                        kept.append(decoded)
                decoded = decoder.finish()
                of_text.update(decoded.encode())
                counts.append(n)
                ids_sha.append(of_ids.hexdigest())
                text_sha.append(of_text.hexdigest())
                if with_ids:
                    all_ids.append(kept_ids)
                    all_texts.append("".join([*kept, decoded]))
            made = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                made += [pa.array(all_ids, pa.list_(pa.int64())), pa.array(all_texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(made, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
