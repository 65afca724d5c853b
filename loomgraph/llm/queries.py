"""The queries and SQL of the corpus operators, by name."""

from __future__ import annotations

from loomgraph.llm.common import LOWER, UPPER, table

QUERIES = {}
ORACLE_SQL = {}


def _query(name):
    def add(f):
        QUERIES[name] = f
        return f

    return add


@_query("op7_exact_dedup")
def op7(spark, sf_dir):
    from loomgraph.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE_SQL["op7_exact_dedup"] = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM t
"""


@_query("op4_line_dedup")
def op4(spark, sf_dir):
    from pyspark.sql import functions as F

    from loomgraph.llm.line_dedup import line_dedup

    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL["op4_line_dedup"] = f"""
WITH l AS (
  SELECT r, doc_id, g.i AS i, g.line AS line,
         translate(trim(g.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS k
  FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d,
       LATERAL (SELECT unnest(range(len(d.ls))) AS i, unnest(d.ls) AS line) g),
b AS (SELECT k, max(doc_id) AS keep_id FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT r) >= 5),
m AS (SELECT l.r, l.doc_id, l.i, l.line, b.k IS NOT NULL AND (l.doc_id IS NULL OR l.doc_id <> b.keep_id) AS gone FROM l LEFT JOIN b USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""


@_query("op1_license_scan")
def op1(spark, sf_dir):
    from loomgraph.llm.license_scan import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def _license_sql() -> str:
    from loomgraph.llm.license_scan import duckdb_sql

    return duckdb_sql()


ORACLE_SQL["op1_license_scan"] = _license_sql()


@_query("op3_simhash")
def op3(spark, sf_dir):
    from loomgraph.llm.simhash import simhash_components

    return simhash_components(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@_query("op10_bpe")
def op10(spark, sf_dir):
    from loomgraph.llm.bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), tokenizer_path())


@_query("op8_packing")
def op8(spark, sf_dir):
    from loomgraph.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


@_query("op5_top_k")
def op5(spark, sf_dir):
    from loomgraph.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE_SQL["op5_top_k"] = """
WITH e AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::hugeint) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.n AS q, q.vec_id AS query_id, c.vec_id AS vec_id, coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0)::bigint AS score
      FROM e q JOIN e c ON q.n <> c.n WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, k::int AS rank, vec_id, score FROM r WHERE k <= 10
"""


@_query("op9_language")
def op9(spark, sf_dir):
    from loomgraph.llm import language

    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.fit(docs, tokenizer_path()))


@_query("op6_html_extract")
def op6(spark, sf_dir):
    from loomgraph.llm.html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


@_query("op2_toxicity")
def op2(spark, sf_dir):
    from loomgraph.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@_query("op11_fill_middle")
def op11(spark, sf_dir):
    from pyspark.sql import functions as F

    from loomgraph.llm.fill_middle import fill_in_middle, restored

    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE_SQL["op11_fill_middle"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::varchar, '')) AS h FROM documents),
u AS (SELECT doc_id, t, string_split(t, chr(10)) AS ls, ('0x' || substr(h, 1, 8))::bigint AS h1, ('0x' || substr(h, 9, 8))::bigint AS h2,
             ('0x' || substr(h, 17, 8))::bigint AS h3, ('0x' || substr(h, 25, 8))::bigint AS h4,
             CASE WHEN t = '' THEN 0 ELSE length(t) - length(replace(t, chr(10), '')) + (right(t, 1) <> chr(10))::int END AS n FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
c AS (SELECT *, CASE WHEN lo = 0 THEN '' WHEN lo = n THEN t ELSE array_to_string(list_slice(ls, 1, lo), chr(10)) || chr(10) END AS p,
             CASE WHEN hi = 0 THEN '' WHEN hi = n THEN t ELSE array_to_string(list_slice(ls, 1, hi), chr(10)) || chr(10) END AS q FROM f),
m AS (SELECT doc_id, t, n, form, p, substr(t, length(p) + 1, length(q) - length(p)) AS mid, substr(t, length(q) + 1) AS s FROM c)
SELECT doc_id, n::bigint AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || mid ELSE '<S>' || s || '<P>' || p || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM m
"""


@_query("op12_fingerprints")
def op12(spark, sf_dir):
    from loomgraph.llm.weighted_sampling import edited_fingerprints

    return edited_fingerprints(table(spark, sf_dir, "documents"))


@_query("op13_conversations")
def op13(spark, sf_dir):
    from loomgraph.llm.conversations import damaged, repair_report

    turns = table(spark, sf_dir, "conversations")
    return repair_report(turns, damaged(turns))
