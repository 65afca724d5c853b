"""Fill-in-middle against a plain reading of its rules, and whole texts out of every output."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import fill_middle


def by_hand(doc_id, text, pattern, rate, spm):
    text = text or ""
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall(pattern, text)
    assert "".join(units) == text
    n = len(units)
    if text == "" or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("pattern, rate, spm", [(fill_middle.LINES, 100, 50), (r"\S*\s+|\S+", 60, 10), (r"(?s).", 100, 100)])
def test_against_the_rules(spark, pattern, rate, spm):
    rng = random.Random(4)
    pieces = ["one line\n", "\n", "é𝄞\n", "no end", "<", "<S", "P>", "<P", ">", "M", "\r\n", " x", " ", "\0"]
    texts = [None, "", "\n", "a", "x<P>y\nz", "only <M>\n", "<S>", "line\n" * 20_000, "w" * 300_000] + ["".join(rng.choices(pieces, k=rng.randint(1, 30))) for _ in range(150)]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "a\nb\nc\n", "x", 1), (5, "again\nand again\n", "y", 2), (5, "again\nand again\n", "y", 2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, output string, n int").repartition(3)
    made = fill_middle.fill_in_middle(frame, unit=pattern, rate=rate, spm=spm)
    got = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", fill_middle.restored(F.col("output"), F.col("form")).alias("text")).collect()
    want = [(*by_hand(i, t, pattern, rate, spm), t or "") for i, t, *_ in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert {r.form for r in got} >= ({"plain", "spm"} if spm == 100 else {"plain", "psm", "spm"})
    assert fill_middle.fill_in_middle(frame.limit(0)).count() == 0


def test_ids_of_other_types(spark):
    frame = spark.createDataFrame([("k", "a\nb"), (None, "a\nb")], "name string, body string")
    got = fill_middle.fill_in_middle(frame, "name", "body").collect()
    assert sorted((str(r.doc_id), r.n, r.form, r.output) for r in got) == sorted((str(i), w[1], w[2], w[5]) for i in ("k", None) for w in [by_hand(i, "a\nb", fill_middle.LINES, 100, 50)])
