"""Model calls as Arrow-batched UDFs behind small protocols, and deterministic stand-ins for tests.

A model is built once per worker by a factory that travels with the plan. A call that fails makes a row with its error
and no value; retries and their waits come from `backoff`. Raters, embedders and language models plug in as plain
callables, so nothing here needs a network. A judge answers one pair a call; one that also has `many` (Arrow columns of
left and right inputs and the prompt; it gives Arrow columns of answers and errors) is asked once a batch.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.values import backoff

VERDICT = "similarity string, confidence int, reason string"
#: An answer that reads the same by any reader of JSON.
PLAIN = re.compile(r'\{ *"similarity": *"([^"\\{}\x00-\x1f]*)", *"confidence": *(0|[1-9][0-9]{0,8}), *"reason": *"([^"\\{}\x00-\x1f]*)" *\}')
CLAIMS = "array<struct<claim: string, verdict: string>>"


class MockJudge:
    """Verdicts from a hash of both inputs; `broken` pairs raise, as a remote model may."""

    def __init__(self, broken: int = 0):
        self.broken = broken

    def __call__(self, left: str, right: str, prompt: str) -> str:
        h = int(hashlib.md5(f"{left}|{right}|{prompt}".encode()).hexdigest()[:8], 16)
        if self.broken and h % self.broken == 0:
            raise RuntimeError("no answer")
        return self.answer(h)

    @staticmethod
    def answer(h: int) -> str:
        return json.dumps({"similarity": "Yes" if h % 3 == 0 else "No", "confidence": h % 5 + 1, "reason": f"case {h % 7}"})

    def many(self, left: pa.Array, right: pa.Array, prompt: str) -> tuple[pa.Array, pa.Array]:
        md5, both = hashlib.md5, zip(left.to_numpy(zero_copy_only=False), right.to_numpy(zero_copy_only=False))
        digests = b"".join([md5(f"{x}|{y}|{prompt}".encode(), usedforsecurity=False).digest() for x, y in both])
        h = np.frombuffer(digests, ">u4")[::4].astype(np.int64)
        failed = h % self.broken == 0 if self.broken else np.zeros(len(h), dtype=bool)
        answers = pa.array([self.answer(k) for k in range(3 * 5 * 7)])  # all there are
        return answers.take(pa.array(h % len(answers), mask=failed)), pa.array(["RuntimeError: no answer"]).take(pa.array(np.zeros(len(h), dtype=np.int64), mask=~failed))


class MockEmbedder:
    """Unit vectors from a hash; batches with an input `bad` fail as a whole, as a batch on a device may."""

    def __init__(self, dim: int = 8):
        self.dim = dim

    def __call__(self, inputs: list[str]) -> list[list[float]]:
        if "bad" in inputs:
            raise RuntimeError("batch failed")
        out = []
        for x in inputs:
            v = [b / 255 - 0.5 for b in hashlib.sha256(x.encode()).digest()[: self.dim]]
            n = sum(a * a for a in v) ** 0.5 or 1.0
            out.append([a / n for a in v])
        return out


def with_retries(call: Callable[[], str], kind: str = "parse", tries: int = 4, sleep: Callable[[float], None] = time.sleep):
    """(answer, None) or (None, error) after `tries`, waiting in between."""
    error = None
    for n in range(tries):
        try:
            return call(), None
        except Exception as e:  # noqa: BLE001  whatever a model raises becomes the row's error
            error = f"{type(e).__name__}: {e}"
            if n + 1 < tries:
                sleep(backoff(n, kind))
    return None, error


def _asked(model, left: pa.Array, right: pa.Array, prompt: str, tries: int) -> tuple[pa.Array, pa.Array]:
    """Answers and errors of a batch; pairs that a model of batches fails for are asked again one by one, if tries are left."""
    again = lambda which, n: [with_retries(lambda x=left[k].as_py(), y=right[k].as_py(): model(x, y, prompt), tries=n, sleep=lambda _: None) for k in which]
    try:
        raw, error = model.many(left, right, prompt)
    except Exception:  # noqa: BLE001  without `many`, or the whole batch failed
        done = again(range(len(left)), tries)
        return pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.string())
    if tries > 1 and error.null_count < len(error):
        raw, error = raw.to_pylist(), error.to_pylist()
        which = [k for k, e in enumerate(error) if e is not None]
        for k, (answer, e) in zip(which, again(which, tries - 1)):
            raw[k], error[k] = answer, e
        raw, error = pa.array(raw, pa.string()), pa.array(error, pa.string())
    return raw, error


def _sent(pairs: DataFrame, names: list[str], left: str, right: str) -> DataFrame:
    return pairs.select(*dict.fromkeys([*names, left, right]))


def _schema(pairs: DataFrame, names: list[str]) -> str:
    return "".join(f"`{n}` {pairs.schema[n].dataType.simpleString()}, " for n in names)


def judge(pairs: DataFrame, factory: Callable[[], Callable[[str, str, str], str]], prompt: str = "", left: str = "left", right: str = "right", tries: int = 1, keep: list[str] | None = None) -> DataFrame:
    """pairs (all columns, or those to keep) with raw (the answer), error."""
    names = pairs.columns if keep is None else keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *_asked(model, batch.column(left), batch.column(right), prompt, tries)], [*names, "raw", "error"])

    return _sent(pairs, names, left, right).mapInArrow(run, f"{_schema(pairs, names)}raw string, error string")


def verdicts(judged: DataFrame) -> DataFrame:
    """raw as similarity, confidence, reason; what cannot be read, or has an error, is PARSE_ERROR with 0 and an empty reason."""
    from loomgraph.functions.values import tolerant_json

    v = tolerant_json(F.coalesce("raw", F.lit("")), VERDICT, "similarity")
    return judged.withColumn("__v", v).select(*judged.columns, F.coalesce("__v.similarity", F.lit("PARSE_ERROR")).alias("similarity"), F.coalesce("__v.confidence", F.lit(0)).alias("confidence"), F.coalesce("__v.reason", F.lit("")).alias("reason"))


def _plain(raw: pa.Array) -> list[pa.Array]:
    """raw, null where it is read here; similarity, confidence, reason, null where it is not. An answer is read once a batch."""
    coded = raw.dictionary_encode()
    found = [PLAIN.fullmatch(x) for x in coded.dictionary.to_pylist()]
    read = [(None, m[1], int(m[2]), m[3]) if m else (x, None, None, None) for x, m in zip(coded.dictionary.to_pylist(), found)]
    read.append((None, "PARSE_ERROR", 0, ""))  # without an answer
    place = coded.indices.fill_null(len(read) - 1)
    return [pa.array(c, kind).take(place) for c, kind in zip(zip(*read), (pa.string(), pa.string(), pa.int32(), pa.string()))]


def judge_verdicts(pairs: DataFrame, factory: Callable[[], Callable[[str, str, str], str]], prompt: str = "", left: str = "left", right: str = "right", tries: int = 1, keep: list[str] | None = None) -> DataFrame:
    """The same as `verdicts` of `judge` without raw and error: plain answers are read beside the model, and only the others go through the tolerant reader."""
    from loomgraph.functions.values import tolerant_json

    names = pairs.columns if keep is None else keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for batch in batches:
            raw, _ = _asked(model, batch.column(left), batch.column(right), prompt, tries)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *_plain(raw)], [*names, "__raw", "__s", "__c", "__r"])

    read = _sent(pairs, names, left, right).mapInArrow(run, f"{_schema(pairs, names)}__raw string, __s string, __c int, __r string")
    read = read.withColumn("__v", F.when(F.col("__raw").isNotNull(), tolerant_json(F.col("__raw"), VERDICT, "similarity")))
    both = lambda c, name, none: F.coalesce(c, f"__v.{name}", F.lit(none)).alias(name)
    return read.select(*names, both("__s", "similarity", "PARSE_ERROR"), both("__c", "confidence", 0), both("__r", "reason", ""))


def judge_batch(pairs: list[tuple[str, str]], factory, prompt: str = "") -> list[str | None]:
    """A few pairs on the driver, in order."""
    model = factory()
    return [with_retries(lambda x=x, y=y: model(x, y, prompt), tries=1)[0] for x, y in pairs]


def embed(items: DataFrame, factory: Callable[[], Callable[[list[str]], list[list[float]]]], column: str = "path", batch_size: int = 8) -> DataFrame:
    """items with vec; a batch that fails is tried one by one, and what fails alone stays NULL."""

    def run(batches):
        model = factory()
        for batch in batches:
            values, out = batch.column(column).to_pylist(), []
            for at in range(0, len(values), batch_size):
                some = values[at : at + batch_size]
                try:
                    out += model(some)
                except Exception:  # noqa: BLE001
                    for x in some:
                        try:
                            out += model([x])
                        except Exception:  # noqa: BLE001
                            out.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float64()))], [*batch.schema.names, "vec"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    return items.mapInArrow(run, f"{fields}, vec array<double>")


def claims(answers: DataFrame, raw: str = "raw") -> DataFrame:
    """answers with one row per claim of their JSON list."""
    parsed = F.from_json(raw, f"claims {CLAIMS}")["claims"]
    return answers.withColumn("__c", F.explode_outer(parsed)).select(*answers.columns, F.col("__c.claim").alias("claim"), F.col("__c.verdict").alias("verdict"))


class ClaimReader:
    """A table function over the pieces of one document's answer, in order: claims leave as soon as they are complete, and what is held is the unfinished one.

    A document without any claim gives one row of nulls. What is no JSON ends the document's claims.
    """

    def __init__(self):
        self.key, self.buffer, self.state, self.n = None, "", "before", 0

    def eval(self, row):
        self.key = row["key"]
        if self.state != "done":
            self.buffer += row["raw"] or ""
            yield from self._complete()

    def terminate(self):
        if not self.n:
            yield self.key, None, None

    def _complete(self):
        if self.state == "before":
            begin = re.search(r'"claims"\s*:\s*\[', self.buffer)
            if begin is None:
                return
            self.buffer, self.state = self.buffer[begin.end() :], "claims"
        while self.state == "claims":
            self.buffer = self.buffer.lstrip(" \t\r\n,")
            if self.buffer[:1] not in ("", "{"):
                self.state = "done"  # the end of the list, or no list of claims
                return
            try:
                claim, end = json.JSONDecoder().raw_decode(self.buffer)
            except ValueError:
                return  # not all there yet
            self.buffer, self.n = self.buffer[end:], self.n + 1
            yield (self.key, *(None if claim.get(c) is None else str(claim[c]) for c in ("claim", "verdict")))


def streamed_claims(pieces: DataFrame, key: str, order: str, raw: str = "raw") -> DataFrame:
    """key, claim, verdict of answers that come in pieces; a partition of the table function is one document."""
    kind = pieces.schema[key].dataType.simpleString()
    read = F.udtf(ClaimReader, returnType=f"key {kind}, claim string, verdict string")
    rows = pieces.select(F.col(key).alias("key"), F.col(order).alias("order"), F.col(raw).cast("string").alias("raw"))
    return read(rows.asTable().partitionBy("key").orderBy("order")).withColumnRenamed("key", key)


def faithfulness(answers: DataFrame, key: str, raw: str = "raw") -> DataFrame:
    """key, n_claims, upr, m5_score; without claims the score is 1."""
    return faithfulness_of(claims(answers, raw), key)


def faithfulness_of(claims: DataFrame, key: str) -> DataFrame:
    """The same of claims (key, claim, verdict)."""
    c = claims.groupBy(key).agg(F.count("claim").alias("n_claims"), F.count_if(F.col("verdict").isin("contradicted", "unverifiable")).alias("bad"))
    upr = F.col("bad") / F.greatest(F.col("n_claims"), F.lit(1))
    return c.select(key, "n_claims", F.round(upr, 6).alias("upr"), F.round(F.when(F.col("n_claims") == 0, 1.0).otherwise(1 - upr), 6).alias("m5_score"))


def attach(rows: DataFrame, results: DataFrame, key: str, score: str) -> DataFrame:
    """rows with their results, best scores first, rows without one last."""
    return rows.join(results, key, "left").orderBy(F.desc_nulls_last(score))
