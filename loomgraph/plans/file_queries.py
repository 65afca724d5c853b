"""Queries of sources and sinks, each by writing to the shared folder and reading back; model, image and step queries."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import functions as F

from loomgraph.functions import text as t
from loomgraph.functions import values as val
from loomgraph.operators import ergm, models, stats
from loomgraph.operators import graph as g
from loomgraph.operators.refresh import GraphState
from loomgraph.plans.base import query
from loomgraph.plans.graph_queries import classes
from loomgraph.plans.pairs import N, dense
from loomgraph.plans.steps import Steps
from loomgraph.sources import adapters as a
from loomgraph.sources import npy
from loomgraph.sources import readers as r
from loomgraph.sources import writers as w
from loomgraph.sources.shared import shared_folder
from loomgraph.streaming import limits


def scratch(spark, name: str) -> str:
    return f"{shared_folder(spark)}/queries/{name}-{uuid.uuid4().hex}"


PARTS = "id string, title string, class string"


def parts(spark, d):
    return a.patents(spark, d).select(F.col("pid").alias("id"), "title", F.col("class_text").alias("class"))


def tricky(df):
    """Texts with quotes, separators and line feeds."""
    return df.withColumn("title", F.concat("title", F.lit(', "quoted"\nnext	tab')))


WHOLE = "SELECT pid AS id, title || ', \"quoted\"' || chr(10) || 'next' || chr(9) || 'tab' AS title, class_text AS class FROM pat"


@query("SRC-01", WHOLE, "pat")
def csv_scan(spark, d):
    path = scratch(spark, "csv")
    w.csv(tricky(parts(spark, d)), path)
    return r.csv_rows(spark, path, PARTS)


@query("SNK-01", "SELECT pid AS id, title, class_text AS class FROM pat", "pat")
def csv_overwrite(spark, d):
    path = scratch(spark, "csv")
    for _ in range(2):  # overwriting leaves one copy
        w.csv(parts(spark, d), path)
    return r.csv_rows(spark, path, PARTS)


@query("SNK-02", "SELECT pid AS id, class_text AS class FROM pat", "pat")
def csv_projected(spark, d):
    path = scratch(spark, "csv")
    w.csv(parts(spark, d), path, ["id", "class"])
    return r.csv_rows(spark, path, "id string, class string")


@query("SNK-03", "SELECT a, b, printf('%.6f', sim) AS sim FROM g", "g")
def csv_decimals(spark, d):
    path = scratch(spark, "csv")
    w.csv(w.six_decimals(a.graph(spark, d), ["sim"]), path)
    return r.csv_rows(spark, path, "a long, b long, sim string")


@query("SRC-03", "SELECT pid AS id, title FROM pat", "pat")
def csv_tolerant(spark, d):
    path = scratch(spark, "csv")
    good = parts(spark, d).select(F.concat_ws(",", "id", "title").alias("value"))
    good.unionAll(good.limit(5).select(F.concat_ws(",", "value", F.lit("x"), F.lit("y")).alias("value"))).write.text(path)
    # the files have no header
    return spark.read.schema("id string, title string").csv(path, mode="DROPMALFORMED")


@query("SRC-12", WHOLE, "pat")
def tsv_scan(spark, d):
    path = scratch(spark, "tsv")
    w.csv(tricky(parts(spark, d)), path, sep="\t")
    return r.tsv_rows(spark, path, PARTS)


@query("SNK-10", "SELECT pid, size FROM pat", "pat")
def attribute_tsv(spark, d):
    path = scratch(spark, "tsv")
    w.csv(a.patents(spark, d).select("pid", "size"), path, sep="\t")
    return r.tsv_rows(spark, path, "pid string, size int")


@query("SRC-04", "SELECT DISTINCT pid, app FROM cit", "cit")
def keyed_json(spark, d):
    path = scratch(spark, "json")
    rec = F.struct(*[F.lit("").alias(c.split()[0]) if c.split()[0] != "patentApplicationNumber" else F.col("app").alias("patentApplicationNumber") for c in r.EVENT.split(", ")])
    one = a.citations(spark, d).select("pid", "app").distinct().groupBy("pid").agg(F.struct(F.col("pid").alias("original_id"), F.count(F.lit(1)).cast("int").alias("citations_found"), F.collect_list(rec).alias("records")).alias("v"))
    # one object per file, its keys unknown to any schema: files of a hash of the key
    one.groupBy((F.crc32("pid") % 4).alias("k")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("pid", "v")))).alias("value")).write.partitionBy("k").text(path)
    return r.keyed_json(spark, path).select(F.col("key").alias("pid"), F.explode("value.records").alias("x")).select("pid", F.col("x.patentApplicationNumber").alias("app"))


@query(
    "SRC-04-variant",
    "SELECT pid, CASE n % 6 WHEN 0 THEN 'object' WHEN 1 THEN 'array' WHEN 2 THEN 'number' WHEN 3 THEN 'string' WHEN 4 THEN 'boolean' ELSE 'null' END AS kind, CASE n % 6 WHEN 0 THEN n WHEN 1 THEN n + 1 WHEN 2 THEN n WHEN 3 THEN NULL END::bigint AS number FROM pat",
    "pat",
)
def keyed_variants(spark, d):
    """Values of six kinds under keys that no schema knows."""
    path = scratch(spark, "variant")
    n = F.col("n").cast("string")
    text = [F.concat(F.lit('{"a": {"n": '), n, F.lit('}, "b": ["x"]}')), F.concat(F.lit('["x", '), (F.col("n") + 1).cast("string"), F.lit("]")), n, F.concat(F.lit('"text '), n, F.lit('"')), F.lit("true"), F.lit("null")]
    p = a.patents(spark, d).select("pid", F.concat(F.lit('"'), "pid", F.lit('": '), F.get(F.array(*text), (F.col("n") % 6).cast("int"))).alias("entry"))
    p.groupBy((F.crc32("pid") % 4).alias("k")).agg(F.concat(F.lit("{"), F.array_join(F.collect_list("entry"), ", "), F.lit("}")).alias("value")).write.partitionBy("k").text(path)
    v = r.keyed_variants(spark, path)
    number = F.coalesce(F.try_variant_get("value", "$.a.n", "bigint"), F.try_variant_get("value", "$[1]", "bigint"), F.when(val.kind_of(F.col("value")) == "number", F.try_variant_get("value", "$", "bigint")))
    return v.select(F.col("key").alias("pid"), val.kind_of(F.col("value")).alias("kind"), number.alias("number"))


EDGES = "source long, target long, similarity double, judgment string"


def edge_lines(spark, d):
    return a.judged_edges(spark, d).select("source", "target", "similarity", "judgment")


@query("SRC-05", "SELECT source, target, similarity, judgment FROM je", "je")
def json_strict(spark, d):
    path = scratch(spark, "jsonl")
    edge_lines(spark, d).write.json(path, compression="gzip")
    return r.json_strict(spark, path, EDGES)


@query("SRC-06", "SELECT source, target, similarity, judgment FROM je", "je")
def json_tolerant(spark, d):
    path = scratch(spark, "jsonl")
    lines = edge_lines(spark, d).select(w.json_text("source", "target", "similarity", "judgment").alias("value"))
    lines.unionAll(spark.createDataFrame([("",), ("{broken",)], "value string")).write.text(path, compression="gzip")
    return r.json_tolerant(spark, path, EDGES)


@query("SRC-07", "SELECT source, target FROM je", "je")
def json_without_loops(spark, d):
    path = scratch(spark, "jsonl")
    e = edge_lines(spark, d).select("source", "target")
    both = F.explode(F.array("target", "source"))  # each edge, and a loop beside it
    e.select("source", both.alias("target")).write.json(path, compression="gzip")
    return r.edges_without_loops(spark, path, "source long, target long")


@query("SRC-08", "SELECT source, target, similarity, judgment FROM je", "je")
def recursive(spark, d):
    path = scratch(spark, "tree")
    e = edge_lines(spark, d)
    for k, part in enumerate((e.filter("source % 2 = 0"), e.filter("source % 2 = 1"))):
        part.write.json(f"{path}/root{k}/deep/er", compression="gzip")
    return r.recursive_json(spark, [f"{path}/root0", f"{path}/root1"], EDGES, "*.json.gz")


@query("SRC-10", "SELECT source, target, similarity, judgment FROM je WHERE source % 2 = 0", "je")
def digit_named(spark, d):
    path = scratch(spark, "years")
    e = edge_lines(spark, d).withColumn("k", F.when(F.col("source") % 2 == 0, "1").otherwise("x"))
    e.filter("k = '1'").drop("k").write.json(f"{path}/2007.jsonl", compression="gzip")
    e.filter("k = 'x'").drop("k").write.json(f"{path}/notes.jsonl", compression="gzip")
    return spark.read.schema(EDGES).json(f"{path}/[0-9]*.jsonl")


def numbered_arcs(spark, d):
    e = a.graph(spark, d)
    ids = dense(g.degrees(e).select("node"), "node")
    return e.join(ids.select(F.col("node").alias("a"), F.col("id").alias("u")), "a").join(ids.select(F.col("node").alias("b"), F.col("id").alias("v")), "b").select("u", "v")


ARCS = "WITH n AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS id FROM deg) SELECT x.id::int AS u, y.id::int AS v FROM g JOIN n x ON x.node = a JOIN n y ON y.node = b"


@query("SRC-11", f"{ARCS} UNION ALL SELECT y.id::int, x.id::int FROM g JOIN n x ON x.node = a JOIN n y ON y.node = b", "g deg")
def arc_list(spark, d):
    path = scratch(spark, "arcs")
    w.arc_list(numbered_arcs(spark, d), path)
    spark.createDataFrame([("*vertices 5",), ("x y",)], "value string").write.mode("append").text(path)
    return r.arc_list(spark, path)


@query("SNK-09", f"SELECT u || ' ' || v AS value FROM ({ARCS}) UNION ALL SELECT v || ' ' || u FROM ({ARCS})", "g deg")
def arc_lines(spark, d):
    return w.arc_lines(numbered_arcs(spark, d))


@query("SRC-13", "SELECT vec_id AS pid, round(embedding[1]::double, 5) AS x FROM embeddings")
def vectors_with_sidecar(spark, d):
    """Files of vectors, ids and paths in numpy's format."""
    path = npy_files(spark, d)
    return spark.read.format("npy").load(path).select(F.col("id").alias("pid"), F.round(F.col("vec")[0].cast("double"), 5).alias("x"))


def npy_files(spark, d, dtype: str = "float32") -> str:
    path = scratch(spark, "npy")
    spark.dataSource.register(npy.NpySource)
    e = a.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("/images/"), F.col("vec_id").cast("string"), F.lit(".tif")).alias("path"), F.col("embedding").alias("vec"))
    e.write.format("npy").option("dtype", dtype).mode("append").save(path)
    return path


@query("SRC-13-paths", "SELECT vec_id AS pid, '/images/' || vec_id || '.tif' AS path FROM embeddings")
def paths_beside_vectors(spark, d):
    return spark.read.format("npy").load(npy_files(spark, d)).select(F.col("id").alias("pid"), "path")


@query("SRC-14-npy", "SELECT g.a AS a, g.b AS b, round(vec[g.b % 64 + 1], 6) AS value FROM g JOIN vec ON pid = g.a", "g vec")
def matrix_points(spark, d):
    """One number of the matrix for each edge: the row of one end, a column by the other; only these rows are read."""
    path = npy_files(spark, d, "float64")
    rows = spark.read.format("npy").load(path).select("row", F.col("id").alias("a"))
    places = a.graph(spark, d).select("a", "b").join(rows, "a").select("a", "b", "row", (F.col("b") % 64).cast("int").alias("column"))
    return npy.points(places.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "row"), path).select("a", "b", F.round("value", 6).alias("value"))


@query("SRC-15", "SELECT pid, class_text FROM pat", "pat")
def cached_dimension(spark, d):
    path = scratch(spark, "dim")
    a.patents(spark, d).select("pid", "class_text").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@query("SRC-17", "SELECT max(name) AS name FROM (SELECT n_name || CASE n_nationkey % 3 WHEN 0 THEN '_theta_' WHEN 1 THEN '_coef_' ELSE '_other_' END || n_nationkey || '.csv' AS name FROM nation) WHERE regexp_matches(name, '(theta|coef).*\\.csv$')")
def latest_coefficients(spark, d):
    """One folder for each nation's file, as Spark names the files inside; the last by name of those that match."""
    path, key = scratch(spark, "coef"), F.col("n_nationkey")
    kind = F.when(key % 3 == 0, "_theta_").when(key % 3 == 1, "_coef_").otherwise("_other_")
    names = a.table(spark, d, "nation").select(F.concat("n_name", kind, key.cast("string"), F.lit(".csv")).alias("file"), F.lit("x").alias("value"))
    names.coalesce(1).write.partitionBy("file").text(path)
    found = r.files(spark, path, parent=True).select(F.regexp_replace("name", "^file=", "").alias("path"))
    return r.latest(found).select(F.col("path").alias("name"))


@query("SRC-18", "SELECT true AS missing, count(*) AS n FROM pat", "pat")
def optional_input(spark, d):
    path = scratch(spark, "csv")
    w.csv(parts(spark, d), path)
    missing = r.optional_csv(spark, path + "-none", PARTS) is None and r.optional_csv(spark, None, PARTS) is None
    return r.optional_csv(spark, path, PARTS).agg(F.lit(missing).alias("missing"), N().alias("n"))


BY_YEAR = "SELECT pid, date, year FROM pub"


def by_year(spark, d):
    return a.publications(spark, d).select("pid", "date", "year")


@query("SNK-04", BY_YEAR, "pub")
def json_per_year(spark, d):
    path = scratch(spark, "by-year")
    for _ in range(2):
        w.json_by_year(by_year(spark, d), path)
    return spark.read.schema("pid string, date string, year int").json(path)


@query("SNK-05", f"{BY_YEAR} UNION ALL {BY_YEAR}", "pub")
def append_per_year(spark, d):
    path = scratch(spark, "by-year")
    for _ in range(2):  # appending twice writes twice, as its contract says
        w.json_by_year(by_year(spark, d), path, append=True)
    return spark.read.schema("pid string, date string, year int").json(path)


@query("STM-06", BY_YEAR, "pub")
def idempotent_rerun(spark, d):
    path = scratch(spark, "by-year")
    w.json_by_year(by_year(spark, d), path)
    w.json_by_year(by_year(spark, d).filter("year = 1996"), path)  # a second run of one year replaces that year
    return spark.read.schema("pid string, date string, year int").json(path)


@query("SNK-06", "SELECT bucket, year, count(*) AS n FROM (SELECT CASE WHEN right(pid, 1)::int < 3 THEN 'exact' WHEN right(pid, 1)::int < 6 THEN 'high' ELSE 'similar' END AS bucket, year FROM pub) GROUP BY ALL", "pub")
def three_folders(spark, d):
    path = scratch(spark, "buckets")
    k = F.substring("pid", -1, 1).cast("int")
    w.by_bucket(by_year(spark, d).withColumn("bucket", F.when(k < 3, "exact").when(k < 6, "high").otherwise("similar")), path)
    return spark.read.schema("pid string, date string, bucket string, year int").json(path).groupBy("bucket", "year").agg(N().alias("n"))


@query("SNK-07", "SELECT source, target, similarity, judgment FROM je", "je")
def micro_batches(spark, d):
    path = scratch(spark, "stream")
    edge_lines(spark, d).write.json(f"{path}/in", compression="gzip")
    third = -(-len(spark.read.schema(EDGES).json(f"{path}/in").inputFiles()) // 3)  # a batch has as many tasks as files
    stream = spark.readStream.schema(EDGES).option("maxFilesPerTrigger", max(1, third)).json(f"{path}/in")
    w.in_batches(stream, f"{path}/out", f"{path}/checkpoint")
    return spark.read.schema(EDGES).json(f"{path}/out").drop("batch")


@query("SNK-13", "SELECT source, target FROM je", "je")
def resumable(spark, d):
    path = scratch(spark, "resume")
    e = edge_lines(spark, d).select("source", "target")
    e.filter("source % 2 = 0").write.json(f"{path}/in/1", compression="gzip")
    for k in (1, 2):  # the second run takes up what is new, once
        limits.incremental(spark, f"{path}/in/*", "source long, target long", f"{path}/out", f"{path}/checkpoint", ["source", "target"])
        if k == 1:
            e.write.json(f"{path}/in/2", compression="gzip")
    return spark.read.parquet(f"{path}/out")


@query("STM-04", "SELECT count(*) AS n, count(DISTINCT (source, target)) AS n_distinct FROM je", "je")
def completed_files(spark, d):
    return resumable(spark, d).agg(N().alias("n"), F.count_distinct("source", "target").alias("n_distinct"))


@query("SNK-11", "SELECT count(DISTINCT grp)::int AS n_classes, (count(DISTINCT grp) // 2)::int AS first_half, min(grp)::varchar AS first FROM vec", "vec")
def config(spark, d):
    names = [x[0] for x in classes(spark, d).select("cls").distinct().orderBy(F.col("cls").cast("int")).collect()]
    text = w.model_config(names, "arcs.txt", "attributes.txt")
    half = text.split("# second")[0]
    return spark.createDataFrame([(text.count("Matching("), half.count("Matching("), half.split("IsClass_")[1].split(")")[0])], "n_classes int, first_half int, first string")


@query("SNK-12", "SELECT pid AS row, round(vec[1], 6) AS x FROM vec", "vec")
def matrix_blocks(spark, d):
    """Chunks of 64 KB, read again as they are."""
    path = scratch(spark, "blocks")
    spark.dataSource.register(npy.NpySource)
    a.vectors(spark, d).select(F.col("pid").alias("id"), "vec").write.format("npy").option("dtype", "float64").option("file_bytes", 1 << 16).mode("append").save(path)
    return spark.read.format("npy").load(path).select(F.col("id").alias("row"), F.round(F.col("vec")[0], 6).alias("x"))


@query("SNK-14", "SELECT p_name || ' é \"' AS caption, p_type AS description FROM part")
def caption(spark, d):
    path = scratch(spark, "meta")
    p = a.table(spark, d, "part").select(F.concat("p_name", F.lit(' é "')).alias("caption"), F.col("p_type").alias("description"))
    w.sidecars(p, "caption", "description").write.text(path)
    return spark.read.schema("caption string, description string").json(path)


@query("SNK-15", "SELECT concat_ws(chr(10), '\\begin{tabular}{lr}', '\\hline', 'Statistic & Value \\\\', '\\hline', string_agg('n\\_' || lower(r_name) || ' & ' || n || ' \\\\', chr(10) ORDER BY r_name), '\\hline', '\\end{tabular}') AS text FROM (SELECT r_name, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name)")
def latex(spark, d):
    n = a.table(spark, d, "nation").join(a.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(N().alias("n"))
    text = w.latex_table([(f"n_{x.r_name.lower()}", x.n) for x in n.orderBy("r_name").collect()])
    return spark.createDataFrame([(text,)], "text string")


@query("SNK-16", "SELECT '| judgment | n |' AS head, count(DISTINCT judgment) + 2 AS lines FROM je", "je")
def markdown(spark, d):
    n = a.judged_edges(spark, d).groupBy("judgment").agg(N().alias("n")).orderBy("judgment")
    text = w.markdown_table(n.columns, [tuple(x) for x in n.collect()])
    return spark.createDataFrame([(text.split("\n")[0], text.count("\n") + 1)], "head string, lines long")


@query("SNK-17", "SELECT path AS src, 'out/' || pid || '.tif' || CASE WHEN path LIKE '%2' THEN '2' ELSE '' END AS dst FROM img", "img")
def manifest(spark, d):
    return w.copy_manifest(a.patent_images(spark, d).select(F.explode(F.map_values("images")).alias("path")), "out")


@query("SNK-18", "SELECT printf('P%03d', row_number() OVER (ORDER BY source, target)) AS pair_id, source, target, '' AS human_verdict FROM je", "je")
def annotation_sheet(spark, d):
    numbered = dense(a.judged_edges(spark, d).select(F.struct("source", "target").alias("pair")), "pair")
    return numbered.select(F.format_string("P%03d", F.col("id") + 1).alias("pair_id"), "pair.source", "pair.target", F.lit("").alias("human_verdict"))


@query("SNK-19", "SELECT k, n FROM (SELECT deg AS k, count(*) AS n FROM deg GROUP BY deg)", "deg")
def figure_data(spark, d):
    return g.distribution(g.degrees(a.graph(spark, d))).select("k", "n")


@query("AGG-32", "SELECT year, count(*) AS n FROM pub GROUP BY year", "pub")
def lines_per_file(spark, d):
    path = scratch(spark, "by-year")
    w.json_by_year(by_year(spark, d), path)
    lines = spark.read.text(path + "/*").select(F.regexp_extract(F.input_file_name(), r"year=(\d+)", 1).cast("int").alias("year"))
    return lines.groupBy("year").agg(N().alias("n"))


@query("STM-05", "SELECT o_orderkey::varchar AS name, CASE WHEN o_orderkey % 4 = 3 THEN 'missing' WHEN o_orderkey % 3 = 0 THEN 'stale' ELSE 'fresh' END AS state FROM orders")
def staleness(spark, d):
    o, key = a.table(spark, d, "orders"), F.col("o_orderkey")
    at = lambda days: F.date_add(F.col("o_orderdate").cast("date"), days).cast("timestamp").alias("modified")
    made = o.select(key.cast("string").alias("name"), at(F.lit(0)))
    return r.stale(made, o.filter(key % 4 != 3).select(key.cast("string").alias("name"), at((key % 3 - 1).cast("int"))))


@query("DAT-07", "SELECT year, year % 2 = 0 AS stale FROM pub GROUP BY year", "pub")
def modification_times(spark, d):
    """Outputs of even years are written before their inputs, so they are stale."""
    inputs, outputs = scratch(spark, "mtime-in"), scratch(spark, "mtime-out")
    rows = g.reused(by_year(spark, d).repartition("year"))
    for path, even in ((outputs, 0), (inputs, None), (outputs, 1)):
        time.sleep(1.1)  # file systems may keep whole seconds
        (rows if even is None else rows.filter(F.col("year") % 2 == even)).write.mode("append").partitionBy("year").json(path)
    modified = lambda path, name: r.files(spark, path, parent=True).groupBy(F.regexp_extract("name", r"year=(\d+)", 1).cast("int").alias("year")).agg(F.max("modified").alias(name))
    return modified(inputs, "read").join(modified(outputs, "made"), "year").select("year", (F.col("read") > F.col("made")).alias("stale"))


# --- models, images, steps


def left_right(spark, d):
    return a.judged_edges(spark, d).select("source", "target", F.concat(F.lit("i"), F.col("source").cast("string")).alias("left"), F.concat(F.lit("i"), F.col("target").cast("string")).alias("right"))


H = "('0x' || left(md5('i' || source || '|i' || target || '|p'), 8))::bigint"


@query("UDF-01", f"SELECT source, target, CASE WHEN {H} % 3 = 0 THEN 'Yes' ELSE 'No' END AS similarity, ({H} % 5 + 1)::int AS confidence, 'case ' || {H} % 7 AS reason FROM je", "je")
def judged_by_model(spark, d):
    return models.judge_verdicts(left_right(spark, d), models.MockJudge, "p", keep=["source", "target"])


@query("UDF-05", f"SELECT source, target, CASE WHEN {H} % 4 = 0 THEN 'PARSE_ERROR' WHEN {H} % 3 = 0 THEN 'Yes' ELSE 'No' END AS similarity FROM je", "je")
def failing_model(spark, d):
    return models.judge_verdicts(left_right(spark, d), lambda: models.MockJudge(4), "p", keep=["source", "target"]).select("source", "target", "similarity")


@query("UDF-07", f"SELECT {H} % 4 = 0 AS failed, count(*) AS n FROM je GROUP BY failed", "je")
def failure_rows(spark, d):
    return models.judge(left_right(spark, d), lambda: models.MockJudge(4), "p", keep=[]).groupBy(F.col("error").isNotNull().alias("failed")).agg(N().alias("n"))


PAIR_HASH = "('0x' || left(md5(n_name || '|' || r_name || '|p'), 8))::bigint"


@query("UDF-02", f"SELECT n_name AS left_name, r_name AS right_name, CASE WHEN {PAIR_HASH} % 3 = 0 THEN 'Yes' ELSE 'No' END AS similarity FROM nation JOIN region ON r_regionkey = n_regionkey")
def judged_on_driver(spark, d):
    """A list of pairs on the driver, as many as there are nations."""
    import json

    rows = a.table(spark, d, "nation").join(a.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name").collect()
    answers = models.judge_batch([tuple(x) for x in rows], models.MockJudge, "p")
    return spark.createDataFrame([(*x, json.loads(answer)["similarity"]) for x, answer in zip(rows, answers)], "left_name string, right_name string, similarity string")


@query("UDF-03", "SELECT pid, CASE WHEN pid % 50 = 0 THEN NULL ELSE 1.0 END AS length FROM vec", "vec")
def embedded(spark, d):
    items = a.vectors(spark, d).select("pid", F.when(F.col("pid") % 50 == 0, "bad").otherwise(F.col("pid").cast("string")).alias("path"))
    from loomgraph.functions.values import dot

    return models.embed(items, models.MockEmbedder).select("pid", F.round(dot(F.col("vec"), F.col("vec")), 6).alias("length"))


@query("UDF-06", "SELECT vec_id, round(median(x), 6) AS med FROM (SELECT vec_id, unnest(embedding[1:3])::double AS x FROM embeddings) GROUP BY vec_id")
def ensemble_of_judges(spark, d):
    e = a.table(spark, d, "embeddings").select("vec_id", F.posexplode(F.slice("embedding", 1, 3)).alias("judge", "p"))
    return e.groupBy("vec_id").agg(F.round(F.median(F.col("p").cast("double")), 6).alias("med"))


@query("UDF-08", "SELECT conv_id, count(*) AS n_claims, round(count(*) FILTER (role = 'assistant') / count(*)::double, 6) AS upr, round(1 - count(*) FILTER (role = 'assistant') / count(*)::double, 6) AS m5_score FROM conversations GROUP BY conv_id")
def claims(spark, d):
    verdict = F.when(F.col("role") == "assistant", "contradicted").otherwise("supported")
    c = a.table(spark, d, "conversations").groupBy("conv_id").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("turn").cast("string").alias("claim"), verdict.alias("verdict"))).alias("claims"))).alias("raw"))
    return models.faithfulness(c, "conv_id")


@query("UDF-08-stream", "SELECT conv_id, count(*) AS n_claims, round(count(*) FILTER (role = 'assistant') / count(*)::double, 6) AS upr, round(1 - count(*) FILTER (role = 'assistant') / count(*)::double, 6) AS m5_score FROM conversations GROUP BY conv_id")
def claims_in_pieces(spark, d):
    """Each turn is a piece of its conversation's answer, cut within a claim."""
    verdict = F.when(F.col("role") == "assistant", "contradicted").otherwise("supported")
    claim = F.to_json(F.struct(F.concat(F.col("turn").cast("string"), F.lit(" ]},{")).alias("claim"), verdict.alias("verdict")))
    t = a.table(spark, d, "conversations").select("conv_id", "turn", claim.alias("c"))
    head = F.when(F.col("turn") == 0, '{"claims": [').otherwise(", ")
    cut = F.array(F.struct((F.col("turn") * 2).alias("place"), F.concat(head, F.substring("c", 1, 9)).alias("raw")), F.struct((F.col("turn") * 2 + 1).alias("place"), F.substring(F.col("c"), F.lit(10), F.length("c")).alias("raw")))
    pieces = t.select("conv_id", F.explode(cut).alias("x")).select("conv_id", "x.place", "x.raw")
    return models.faithfulness_of(models.streamed_claims(pieces, "conv_id", "place"), "conv_id")


@query("UDF-09", f"SELECT {H.replace('|p', '|image only')} % 3 = 0 AS yes, count(*) AS n FROM je GROUP BY yes", "je")
def baseline(spark, d):
    v = models.judge_verdicts(left_right(spark, d), models.MockJudge, "image only", keep=[])
    return v.groupBy((F.col("similarity") == "Yes").alias("yes")).agg(N().alias("n"))


@query("UDF-10", "SELECT count(*) FILTER (regexp_matches(reason, '(?i)\\b(identical|copy)\\b')) AS n FROM je", "je")
def discovered_words(spark, d):
    words = ["identical", "copy"]  # what a model proposed becomes a parameter
    return a.judged_edges(spark, d).agg(F.count_if(F.col("reason").rlike(t.word_pattern(words))).alias("n"))


@query("UDF-12", "SELECT d.doc_id AS doc_id, quality AS score FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def attached(spark, d):
    return models.attach(a.table(spark, d, "documents").select("doc_id"), a.table(spark, d, "labels").select("doc_id", F.col("quality").alias("score")), "doc_id", "score")


@query("GRF-23")
def network_model(spark, d):
    return ergm.fit_chains(a.graph(spark, d), classes(spark, d), [1, 2])


def one_step_each(names) -> Steps:
    """Steps of these names, each on the one before."""
    s = Steps()
    for before, name in zip([None, *names], names):
        s.add(name, (before,) if before else ())(lambda *x, **y: None)
    return s


def step_rows(spark, names):
    return spark.createDataFrame([(x,) for x in names], "step string")


def names_of(spark, d, table: str, key: str, name: str) -> list[str]:
    """The names of a dimension of a few rows, by its key."""
    return [r[0] for r in a.table(spark, d, table).orderBy(key).select(name).collect()]


@query("ORC-01", "SELECT n_name AS step FROM nation WHERE n_nationkey BETWEEN 5 AND 20 AND n_nationkey <> 8")
def step_slice(spark, d):
    names = names_of(spark, d, "nation", "n_nationkey", "n_name")
    return step_rows(spark, one_step_each(names).chosen(start=names[5], end=names[20], skip=(names[8],)))


def upstream():
    s = Steps()
    s.add("edges")(lambda spark, d: a.edges(spark, d))
    s.add("pairs", ("edges",))(lambda spark, d, edges: edges.select("source", "target").distinct())
    s.add("plot", ("edges",))(lambda spark, d, edges: edges.groupBy("source").count())
    s.add("judge", ("pairs",))(lambda spark, d, pairs: pairs.withColumn("similarity", F.lit("Yes")))
    return s


@query("ORC-02", "SELECT count(*) AS n FROM (SELECT DISTINCT source, target FROM edge)", "edge")
def step_run(spark, d):
    s = upstream()
    return s.run(s.chosen(["edges", "pairs"]), spark, d)["pairs"].agg(N().alias("n"))


@query("ORC-04", "SELECT r_name AS step FROM region WHERE r_name NOT LIKE 'A%'")
def step_flags(spark, d):
    names = names_of(spark, d, "region", "r_regionkey", "r_name")
    return step_rows(spark, one_step_each(names).chosen(flags={"WITH_A": False}, optional={n: "WITH_A" for n in names if n.startswith("A")}))


@query("ORC-06", "SELECT n_name AS step, CASE WHEN n_nationkey % 4 = 3 THEN 'run' WHEN n_nationkey % 5 > n_nationkey % 3 THEN 'run again' ELSE 'nothing' END AS command FROM nation")
def pipeline_state(spark, d):
    n = a.table(spark, d, "nation")
    at = lambda days: F.date_add(F.lit("2024-01-01").cast("date"), days.cast("int")).cast("timestamp").alias("modified")
    key = F.col("n_nationkey")
    return r.commands(r.stale(n.select(F.col("n_name").alias("name"), at(key % 5)), n.filter(key % 4 != 3).select(F.col("n_name").alias("name"), at(key % 3)))).select(F.col("name").alias("step"), "command")


@query("ORC-07", f"SELECT n AS n_nodes, {'{'}'bytes': n * n * 4{'}'}.bytes AS dense_bytes, n * 500 * 4 AS chunk_bytes, n * n * 4 <= 1000000 AS dense_fits FROM (SELECT count(*) AS n FROM deg)", "deg")
def memory_guard(spark, d):
    """What a dense similarity matrix and one chunk of its rows would take, and whether the dense one stays under the limit; Spark spills instead."""
    n = F.col("n_nodes")
    sizes = g.degrees(a.graph(spark, d)).agg(N().alias("n_nodes"))
    return sizes.select("n_nodes", (n * n * 4).alias("dense_bytes"), (n * 500 * 4).alias("chunk_bytes"), (n * n * 4 <= 1_000_000).alias("dense_fits"))


@query("UDF-11", "SELECT seq::int AS seq, 'triad ' || printf('%03d', seq) || ': ' || A || ', ' || B || ', ' || C AS title, ['rank ' || seq, 'confidence ' || printf('%.3f', confidence)] AS meta, [CASE WHEN s_AB >= 0.35 THEN 'green' ELSE 'red' END, CASE WHEN s_BC >= 0.35 THEN 'green' ELSE 'red' END, CASE WHEN s_AC >= 0.35 THEN 'green' ELSE 'red' END] AS borders, ['AB ' || printf('%.3f', s_AB), 'BC ' || printf('%.3f', s_BC), 'AC ' || printf('%.3f', s_AC)] AS captions FROM (SELECT *, row_number() OVER (ORDER BY confidence DESC, A, B, C) AS seq FROM scored)", "scored")
def plot_rows(spark, d):
    """What a plot of each triad shows, by functions of its row: title, lines of the panel, border colours, captions."""
    from loomgraph.operators import triads as tr

    sides = ("AB", "BC", "AC")
    return tr.plot_rows(
        tr.scored(a.graph(spark, d)).select("A", "B", "C", *[f"s_{x}" for x in sides], "confidence"),
        title=lambda seq: F.concat(F.format_string("triad %03d: ", seq), F.concat_ws(", ", "A", "B", "C")),
        meta=lambda seq: F.array(F.concat(F.lit("rank "), seq.cast("string")), F.format_string("confidence %.3f", "confidence")),
        borders=lambda seq: F.array(*[F.when(F.col(f"s_{x}") >= 0.35, "green").otherwise("red") for x in sides]),
        captions=lambda seq: F.array(*[F.format_string(f"{x} %.3f", f"s_{x}") for x in sides]),
    )


@query("IMG-07", "SELECT p_partkey, 'data:image/png;base64,' || to_base64(p_name::blob) AS url FROM part")
def data_urls(spark, d):
    return a.table(spark, d, "part").select("p_partkey", F.concat(F.lit("data:image/png;base64,"), F.regexp_replace(F.base64(F.col("p_name").cast("binary")), r"\s", "")).alias("url"))


@query("MTH-16", "SELECT count(*) AS n, true AS close, true AS repeatable, true AS spread FROM (SELECT DISTINCT deg FROM deg)", "deg")
def jittered(spark, d):
    """Jitter by a seed: near the value, the same for the same seed, different by seed and by value."""
    k = g.reused(g.distribution(g.degrees(a.graph(spark, d))))
    one, two, other = (stats.log_jitter(k, "k", seed).select("k", F.col("jittered").alias(n)) for seed, n in ((42, "one"), (42, "two"), (43, "other")))
    j = one.join(two, "k").join(other, "k").withColumn("off", F.col("one") - F.log10(F.col("k").cast("double")))
    far = F.max(F.abs("off")) <= 0.05 + 1e-9
    return j.agg(N().alias("n"), far.alias("close"), F.min(F.col("one") == F.col("two")).alias("repeatable"), ((F.stddev_samp("off") > 0.004) & (F.stddev_samp("off") < 0.02) & (F.count_if(F.col("one") == F.col("other")) == 0)).alias("spread"))


@query("MTH-17", "SELECT pow(10, floor(log10(least(min(k), min(n)))))::double AS low, pow(10, ceil(log10(greatest(max(k), max(n)))))::double AS high FROM (SELECT deg AS k, count(*) AS n FROM deg GROUP BY deg)", "deg")
def axis_limits(spark, d):
    """Both axes get the limits that hold the data of either, in whole powers of ten."""
    both = g.distribution(g.degrees(a.graph(spark, d)))
    low, high = F.least(F.min("k"), F.min("n")), F.greatest(F.max("k"), F.max("n"))
    return both.agg(F.pow(F.lit(10.0), F.floor(F.log10(low))).alias("low"), F.pow(F.lit(10.0), F.ceil(F.log10(high))).alias("high"))


@query("ORC-03", "SELECT r_name AS step FROM region WHERE r_regionkey >= 3")
def numbered_steps(spark, d):
    names = names_of(spark, d, "region", "r_regionkey", "r_name")
    s = one_step_each(names)
    try:
        s.chosen([names[3]], start=names[4])
    except ValueError:  # the two ways of choosing exclude each other
        return step_rows(spark, s.chosen(start=names[3]))


@query("ORC-05", "SELECT count(*) AS n FROM scored", "scored")
def refreshed_grids(spark, d):
    from loomgraph.operators import triads as tr

    s = Steps()
    s.add("edges")(lambda: a.graph(spark, d))
    s.add("triads", ("edges",))(lambda edges: tr.scored(edges))
    s.add("grid", ("triads",))(lambda triads: tr.grid(triads, "s1", "s3", [-1.0], [-100.0]))
    return s.run(["edges", "triads", "grid"])["grid"].filter("t2 is not null").select("n")


@query(
    "ORC-05-delta",
    """WITH h AS MATERIALIZED (SELECT a, b FROM g WHERE (a + b) % 7 = 0 OR (a + b) % 5 <> 0), t AS MATERIALIZED (SELECT p.a AS x, p.b AS y, q.b AS z FROM h p JOIN h q ON p.b = q.a JOIN h r ON r.a = p.a AND r.b = q.b),
    d AS (SELECT node, count(*) AS deg FROM (SELECT a AS node FROM h UNION ALL SELECT b FROM h) GROUP BY node), c AS (SELECT node, count(*) AS tri FROM (SELECT x AS node FROM t UNION ALL SELECT y FROM t UNION ALL SELECT z FROM t) GROUP BY node)
    SELECT d.node AS node, deg::bigint AS deg, coalesce(tri, 0)::bigint AS tri, CASE WHEN deg < 2 THEN 0.0 ELSE round(2.0 * coalesce(tri, 0) / (deg * (deg - 1)), 6) END AS cc FROM d LEFT JOIN c ON c.node = d.node""",
    "g",
)
def refreshed_by_changes(spark, d):
    """Edges whose ends add up to a seventh come later, those of a fifth go; the clustering follows."""
    state = GraphState(spark, scratch(spark, "state"))
    e = g.reused(a.graph(spark, d).select("a", "b", (F.col("a") + F.col("b")).alias("s")))
    state.change(e.filter("s % 7 <> 0"))
    state.change(e.filter("s % 7 = 0"), e.filter("s % 5 = 0"))
    return state.clustering().select("node", "deg", "tri", F.round("cc", 6).alias("cc"))
