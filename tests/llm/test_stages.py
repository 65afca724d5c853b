"""Every pipeline stage on odd rows: nulls, empty and long texts, repeats, empty tables, columns with clashing names."""

import pytest
from pyspark.sql import Row

import corpus_pipeline

CLASHING = "n_lines long, n_dropped int, score string, held_out string, fp string, component_id long, digest binary, __kept long, __0 string, label string"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(1, 1, 0), (None, 0, 1), (2, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def odd(spark):
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"
    shared = "A passage that many of these documents hold in common, as it happens."
    texts = [(1, "the first text of all"), (2, "the second text, another one"), (3, None), (4, ""), (5, "word " * 60_000), (6, "123 ..."), (7, "twice the same row"), (7, "twice the same row"), (None, "no id here, only text"), (None, None)]
    texts += [(10 + i, f"{shared}\nBut number {i} says {'abcdefg'[i] * 9} too, {'hijklmn'[i] * 7} and more {'opqrstu'[i] * 5}") for i in range(7)]
    rows = [(i, t, None if k % 5 == 0 else "en", None if k % 3 == 0 else "s", None, k, k, "x", "y", "z", k, b"1", k, "q", None) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, schema)


def key(r: Row) -> tuple:
    return tuple(str(x) for x in r)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows(spark, sf, name, stage):
    docs = odd(spark)
    before = docs.collect()
    out = stage(spark, docs, sf)
    after = out.collect()
    nothing = stage(spark, docs.limit(0), sf)
    assert nothing.count() == 0 and nothing.columns == out.columns
    if name == "packing":
        assert {r.doc_id for r in after} == {r.doc_id for r in before}
        return
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    if name == "line_dedup":
        others = [c for c in docs.columns if c not in ("text", "n_chars")]
        pick = lambda rows: sorted(tuple(str(r[c]) for c in others) for r in rows)
        assert pick(after) == pick(before)
        held = {r.doc_id: r.text for r in after if r.doc_id is not None}
        assert held[16].startswith("A passage") and all(held[10 + i].startswith("But number") for i in range(6)) and held[3] == held[4] == ""
        return
    assert not set(map(key, after)) - set(map(key, before))
    if name == "language":  # without a letter there is no language
        assert sorted(str(r.doc_id) for r in after) == sorted(str(r.doc_id) for r in before if r.text and any(map(str.isalpha, r.text)))
    elif name == "near_dedup":  # repeats of the row that stays are one document
        ids = [r.doc_id for r in after]
        assert len(ids) == len(set(ids)) and {1, 2, 3, 5, 7, None} <= set(ids) and 4 not in ids
