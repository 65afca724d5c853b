"""Parsers and scores against hand-checked values."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.functions import text as t
from loomgraph.functions import values as v


def one(spark, expr, **columns):
    row = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} {'string' if isinstance(x, str) or x is None else 'array<string>' if isinstance(x, list) else 'double'}" for k, x in columns.items()))
    return row.select(expr.alias("x")).first()["x"]


def test_class_parsers(spark):
    matrix = {
        "D18 50": ("D18", "D18", "D18", "D18"),
        "D14138": ("D14", "D??", "D14", "D14138"),
        "D 6480": ("D6", "D??", "D6", "D6480"),
        "D 9": ("D9", "D09", "D9", "D09"),
        "X": (None, "D??", "Unknown", "D??"),
        "": (None, "D??", "Unknown", "D??"),
        None: (None, "D??", "Unknown", "D??"),
        "D99": ("D99", "D99", "D99", "D99"),
        "D0": (None, "D??", "Unknown", "D00"),
    }
    rows = spark.createDataFrame([(k,) for k in matrix], "raw string")
    c = F.col("raw")
    got = rows.select("raw", t.main_class(c), t.strict_class(c), t.lenient_class(c), t.padded_class(c)).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == matrix
    assert one(spark, t.all_classes(F.col("x")), x="D14422,D6100") == ["D14", "D6"]


def test_views(spark):
    for texts, view in [(["FIG. 1 is a perspective view"], "perspective"), (["FIG. 1 is a front view"], "front"), (["FIG. 1 is a top plan view"], "overview"), (["a front view", "a perspective view"], "perspective"), ([], "overview")]:
        assert one(spark, t.view_type(F.col("x")), x=texts) == view


def test_ids(spark):
    for raw, key in [("D0543613", 10_000_543_613), ("D543613", 10_000_543_613), ("invalid", None), (None, None)]:
        assert one(spark, t.id_key(F.col("x")), x=raw) == key
    assert one(spark, t.id_gap(F.col("x"), F.col("y")), x="D0534345", y="D0534347") == 2
    assert one(spark, t.id_gap(F.col("x"), F.col("y")), x="Dxx", y="D1") is None
    assert one(spark, t.unpadded_id(F.col("x")), x="D0543613") == "D543613"


def test_reasons(spark):
    for text, bucket in [("substantially identical", "high_similar"), ("are identical", "exact_match"), ("similar shape", "similar"), ("same silhouette, identical", "high_similar"), (None, "similar")]:
        assert one(spark, t.reason_bucket(F.col("x")), x=text) == bucket
    assert t.word_pattern(["a.b"]) == r"(?i)\b(a\.b)\b"
    assert t.threshold_tag(0.8) == "080"


def test_json(spark):
    schema = "similarity string, confidence int, reason string"
    for raw, want in [('```json\n{"similarity":"Yes","confidence":4,"reason":"x",}\n```', "Yes"), ("no braces", None), ('text {"similarity": "No"} more', "No"), ("{", None), (None, None)]:
        got = one(spark, v.tolerant_json(F.col("x"), schema, "similarity"), x=raw)
        assert (got and got["similarity"]) == want


def triad(spark, ab, bc, ac):
    sides = [F.lit(float(x)) for x in (ab, bc, ac)]
    return spark.range(1).select(v.weakest_link(*sides), v.tightness(*sides), v.compliance(*sides)).first()


def test_triads(spark):
    for sides, want in [((0.99, 0.95, 0.97), (0.95, 0.797835, 0.834860)), ((0.9, 0.8, 0.6), (0.6, 0.409666, 0.270584)), ((1, 1, 1), (1, 1, 1)), ((1, 1, 0.5), (0.5, 0.333333, 0))]:
        assert tuple(triad(spark, *sides)) == pytest.approx(want, abs=1e-6)
    # .30 * .95 + .20 * .797835 + .25 * .834860 + .15 * .5
    assert spark.range(1).select(v.confidence(*[F.lit(x) for x in (0.95, 0.797835, 0.834860, 0.5)])).first()[0] == pytest.approx(0.728282, abs=1e-6)


def test_match_score(spark):
    for flag, want in [("consistent", (0.8372, 0.92, [])), ("internally_contradictory", (0.50232, 0.52, ["M1_internally_contradictory"]))]:
        s = v.match_score(F.lit(0.91), F.lit(0.04), F.lit(flag))
        got = spark.range(1).select(*s).first()
        assert (round(got[0], 5), round(got[1], 5), got[2]) == want


def test_recency(spark):
    for year, count, want in [(2005, 32, 2.0), (2022, 3, 3.0)]:
        assert spark.range(1).select(v.citation_rate(F.lit(count), F.lit(year))).first()[0] == want


@settings(max_examples=20, deadline=None)
@given(st.lists(st.floats(-1, 1), min_size=3, max_size=3))
def test_scores_stay_in_range(spark, sides):
    s1, s2, _ = triad(spark, *sides)
    assert -1 <= s1 <= 1 and 0 <= s2 <= 1
