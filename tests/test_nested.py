"""Values without a schema, and claims that come in pieces."""

import json
import os

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import values as v
from loomgraph.operators import models
from loomgraph.sources import readers


def test_keyed_variants(spark, tmp_path):
    whole = {"a": {"b": [1, {"c": None}], "d": "é"}, "e": [1.5, "x"], "f": None, "g": 12345678901234567890, "": True}
    files = {"one.json": json.dumps(whole), "two.json": "{not json", "three.json": "[1, 2]", "four.json": "{}", "five.json": ""}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    rows = readers.keyed_variants(spark, str(tmp_path)).select("file", "key", F.to_json("value").alias("j"), v.kind_of(F.col("value")).alias("kind")).collect()
    found = {r.key: (json.loads(r.j) if r.j is not None else None, r.kind) for r in rows if r.key is not None}
    assert found == {k: (x, {dict: "object", list: "array", type(None): "null", int: "number", bool: "boolean"}[type(x)]) for k, x in whole.items()}
    assert {os.path.basename(r.file) for r in rows if r.key is not None} == {"one.json"}


def test_rules_at_paths(spark):
    texts = ['{"a": {"n": 5}, "k": "yes"}', '{"a": {"n": "5"}, "k": "no"}', '{"a": 3, "k": null}', "null", None, "[]", '{"a": {"n": 50}}']
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rules = {"$.a.n": ("number", lambda x: x < 10), "$.k": ("string", lambda x: x == "yes")}
    got = {r.i: r.e for r in frame.select("i", v.path_errors(F.try_parse_json("t"), rules).alias("e")).collect()}
    assert got == {0: [], **{i: ["$.a.n", "$.k"] for i in range(1, 7)}}


@pytest.mark.parametrize("step", [1, 7, 1000])
def test_claims_in_pieces(spark, step):
    answers = {
        1: json.dumps({"note": "x", "claims": [{"claim": "a ]} \" b", "verdict": "supported"}, {"claim": "b", "verdict": "contradicted", "more": [{"claims": [1]}]}]}),
        2: '{"claims": []}', 3: "no json", 4: "", 5: '{"claims": [{"claim": 7}, {"verdict": "unverifiable"}], "claims": [{"claim": "late"}]}', 6: '{"claims": [{"claim": "whole"}, {"claim": "cut o', 7: None,
    }
    pieces = [(k, n, t[n : n + step]) for k, t in answers.items() if t for n in range(0, len(t), step)] + [(4, 0, ""), (7, 0, None)]
    frame = spark.createDataFrame(pieces, "k long, n int, raw string").repartition(3)
    got = sorted(((r.k, r.claim, r.verdict) for r in models.streamed_claims(frame, "k", "n").collect()), key=str)
    none = [(k, None, None) for k in (2, 3, 4, 7)]
    first = json.loads(answers[1])["claims"][0]["claim"]
    assert got == sorted([(1, first, "supported"), (1, "b", "contradicted"), (5, "7", None), (5, None, "unverifiable"), (6, "whole", None), *none], key=str)
    scores = {r.k: (r.n_claims, r.m5_score) for r in models.faithfulness_of(models.streamed_claims(frame, "k", "n"), "k").collect()}
    assert scores[2] == scores[4] == (0, 1.0) and scores[1] == (2, 0.5)
    assert models.streamed_claims(frame.limit(0), "k", "n").count() == 0
