"""Queries of scans, filters, joins and aggregates over citation pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import text as t
from loomgraph.functions import values as val
from loomgraph.operators import pairs as p
from loomgraph.operators.graph import dense
from loomgraph.plans.base import query
from loomgraph.sources import adapters as a


def N():  # noqa: N802
    return F.count(F.lit(1))


@query("JN-01", "SELECT source, target, app, oa_date, category FROM edge", "edge")
def cocitation_edges(spark, d):
    return a.edges(spark, d)


@query("AGG-01", "SELECT app, pid, arg_min(oa_date, ord) AS oa_date, arg_min(category, ord) AS category FROM cit GROUP BY app, pid", "cit")
def first_records(spark, d):
    return p.first_record(a.citations(spark, d), ["app", "pid"], ["ord"]).drop("ord")


@query("AGG-02", "SELECT app, count(DISTINCT pid) AS count FROM cit GROUP BY app HAVING count(DISTINCT pid) < 2", "cit")
def singleton_applications(spark, d):
    return p.singletons(a.citations(spark, d))


@query("AGG-03", "SELECT source, target, count(DISTINCT (app, category)) AS n_events, string_agg(DISTINCT app || ':' || category, ',' ORDER BY app || ':' || category) AS events FROM edge GROUP BY source, target", "edge")
def pair_events(spark, d):
    e = p.with_events(a.edges(spark, d), ["app", "category"], order="app")
    return e.select("source", "target", F.size("events").cast("long").alias("n_events"), F.array_join(F.array_sort(F.transform("events", lambda x: F.concat_ws(":", x["app"], x["category"]))), ",").alias("events"))


@query("ARR-04", "SELECT app, string_agg(DISTINCT category, ',' ORDER BY category) AS cats FROM cit GROUP BY app", "cit")
def append_if_absent(spark, d):
    return a.citations(spark, d).groupBy("app").agg(F.array_join(F.array_sort(F.array_distinct(F.collect_list("category"))), ",").alias("cats"))


@query("ARR-07", "SELECT source, target FROM edge GROUP BY source, target HAVING count(DISTINCT app) >= 2", "edge")
def strong_pairs(spark, d):
    return p.with_events(a.edges(spark, d), ["app"], order="app").filter(F.size("events") >= 2).select("source", "target")


@query("FLT-01", "SELECT app, pid, ord FROM cit WHERE pid IN (SELECT pid FROM pat WHERE size <= 34)", "cit pat")
def whitelist(spark, d):
    return a.citations(spark, d).join(a.patents(spark, d).filter("size <= 34").select("pid"), "pid", "left_semi").select("app", "pid", "ord")


@query("FLT-02", "SELECT count(*) AS n FROM cit WHERE trim(app) <> ''", "cit")
def keyed_records(spark, d):
    return a.citations(spark, d).filter(F.trim("app") != "").agg(N().alias("n"))


IMAGED = "SELECT source, target, list(DISTINCT i.view) AS vs, list(DISTINCT j.view) AS vt FROM (SELECT DISTINCT source, target FROM edge) e JOIN img i ON i.pid = source JOIN img j ON j.pid = target GROUP BY source, target"


def imaged(spark, d):
    return p.look_up_both(a.edges(spark, d).select("source", "target").distinct(), a.patent_images(spark, d), "pid", ["images"], default=None)


@query("JN-02", f"SELECT source, target FROM ({IMAGED}) WHERE len(list_intersect(vs, vt)) > 0", "edge img")
def pairs_with_common_view(spark, d):
    return imaged(spark, d).filter(p.share_a_view(F.col("source_images"), F.col("target_images"))).select("source", "target")


@query("FLT-03", f"SELECT count(*) AS n FROM ({IMAGED}) WHERE len(list_intersect(vs, vt)) > 0", "edge img")
def view_overlap(spark, d):
    return imaged(spark, d).filter(p.share_a_view(F.col("source_images"), F.col("target_images"))).agg(N().alias("n"))


@query("ARR-01", f"SELECT list_contains(vs, 'front') AS sf, list_contains(vt, 'front') AS tf, count(*) AS n FROM ({IMAGED}) GROUP BY ALL", "edge img")
def view_membership(spark, d):
    return imaged(spark, d).groupBy(F.map_contains_key("source_images", "front").alias("sf"), F.map_contains_key("target_images", "front").alias("tf")).agg(N().alias("n"))


@query("FLT-04", f"SELECT source, target, CASE WHEN list_contains(vs, 'perspective') AND list_contains(vt, 'perspective') THEN 'perspective' WHEN list_contains(vs, 'front') AND list_contains(vt, 'front') THEN 'front' WHEN list_contains(vs, 'overview') AND list_contains(vt, 'overview') THEN 'overview' END AS view FROM ({IMAGED})", "edge img")
def preferred_view(spark, d):
    return imaged(spark, d).select("source", "target", p.common_view(F.col("source_images"), F.col("target_images"), "perspective").alias("view"))


@query("ARR-02", f"SELECT source, target, i.path AS source_path, j.path AS target_path FROM (SELECT DISTINCT source, target FROM edge) e LEFT JOIN img i ON i.pid = source AND i.view = 'front' LEFT JOIN img j ON j.pid = target AND j.view = 'front'", "edge img")
def map_look_up(spark, d):
    return imaged(spark, d).select("source", "target", F.try_element_at("source_images", F.lit("front")).alias("source_path"), F.try_element_at("target_images", F.lit("front")).alias("target_path"))


@query("ARR-03", "SELECT DISTINCT i.view AS view, i.pid AS pid, i.path AS path FROM (SELECT source AS pid FROM edge UNION SELECT target FROM edge) e JOIN img i ON i.pid = e.pid", "edge img")
def exploded_views(spark, d):
    e = a.edges(spark, d)
    nodes = e.select(F.col("source").alias("pid")).unionAll(e.select(F.col("target").alias("pid"))).distinct()
    rows = nodes.join(a.patent_images(spark, d), "pid").select(F.explode("images").alias("view", "path"), "pid")
    return rows.groupBy("view", "pid").agg(F.min("path").alias("path"))


@query("AGG-37", "SELECT view, count(*) AS n FROM img GROUP BY view", "img")
def view_distribution(spark, d):
    return a.patent_images(spark, d).select(F.explode(F.map_keys("images")).alias("view")).groupBy("view").agg(N().alias("n"))


def classed(spark, d):
    pat = a.patents(spark, d).select("pid", t.strict_class(F.col("class_text")).alias("class"))
    e = p.cocitation(a.citations(spark, d))
    return p.look_up_both(e.select("source", "target", "app"), pat, "pid", ["class"]).withColumnsRenamed({"source_class": "sc", "target_class": "tc"})


ALL_EDGES = "all_edge AS (SELECT x.pid AS source, y.pid AS target, x.app AS app FROM (SELECT DISTINCT app, pid FROM cit WHERE trim(app) <> '') x JOIN (SELECT DISTINCT app, pid FROM cit) y ON x.app = y.app AND x.pid < y.pid), ce AS (SELECT source, target, app, s.strict_class AS sc, t.strict_class AS tc FROM all_edge JOIN cls s ON s.pid = source JOIN cls t ON t.pid = target)"


def on_classes(body: str) -> str:
    return f"WITH {ALL_EDGES} {body}"


@query("JN-03", on_classes("SELECT source, target, app, sc, tc FROM ce"), "cit cls")
def edges_with_class(spark, d):
    return classed(spark, d)


@query("FLT-06", on_classes("SELECT count(*) AS n FROM ce WHERE sc <> 'D??' AND tc <> 'D??'"), "cit cls")
def parsable_pairs(spark, d):
    return classed(spark, d).filter("sc <> 'D??' and tc <> 'D??'").agg(N().alias("n"))


@query("FLT-05", on_classes("SELECT source, target, app FROM ce WHERE sc = 'D18' AND tc = 'D18'"), "cit cls")
def both_in_class(spark, d):
    return classed(spark, d).filter("sc = 'D18' and tc = 'D18'").select("source", "target", "app")


@query("AGG-04", on_classes("SELECT sc, tc, count(*) AS n FROM ce GROUP BY sc, tc"), "cit cls")
def class_pairs(spark, d):
    return classed(spark, d).groupBy("sc", "tc").agg(N().alias("n"))


def known_class(spark, d):
    return classed(spark, d).filter("sc <> 'D??' and tc <> 'D??'")


@query("AGG-05", on_classes("SELECT cls, count(*) AS n FROM (SELECT sc AS cls, tc AS o FROM ce UNION ALL SELECT tc, sc FROM ce) WHERE cls <> 'D??' AND o <> 'D??' GROUP BY cls"), "cit cls")
def class_ends(spark, d):
    return known_class(spark, d).select(F.explode(F.array("sc", "tc")).alias("cls")).groupBy("cls").agg(N().alias("n"))


def diagonal(spark, d):
    return known_class(spark, d).groupBy(F.col("sc").alias("cls")).agg(F.count_if(F.col("sc") == F.col("tc")).alias("within"), F.count_if(F.col("sc") != F.col("tc")).alias("across"))


@query("AGG-06", on_classes("SELECT sc AS cls, count(*) FILTER (sc = tc) AS within, count(*) FILTER (sc <> tc) AS across FROM ce WHERE sc <> 'D??' AND tc <> 'D??' GROUP BY sc"), "cit cls")
def diagonal_and_cross(spark, d):
    return diagonal(spark, d)


@query("JN-12", on_classes(", w AS (SELECT sc AS cls, count(*) AS within FROM ce WHERE sc = tc AND sc <> 'D??' GROUP BY sc), x AS (SELECT tc AS cls, count(*) AS into FROM ce WHERE sc <> tc AND sc <> 'D??' AND tc <> 'D??' GROUP BY tc) SELECT coalesce(w.cls, x.cls) AS cls, coalesce(within, 0) AS within, coalesce(\"into\", 0) AS incoming FROM w FULL JOIN x ON w.cls = x.cls").replace("AS into", 'AS "into"'), "cit cls")
def full_outer(spark, d):
    k = known_class(spark, d)
    w = k.filter("sc = tc").groupBy(F.col("sc").alias("cls")).agg(N().alias("within"))
    x = k.filter("sc <> tc").groupBy(F.col("tc").alias("cls")).agg(N().alias("incoming"))
    return w.join(x, "cls", "full").na.fill(0).select("cls", "within", "incoming")


TOP = "top AS (SELECT cls FROM (SELECT sc AS cls, tc AS o FROM ce UNION ALL SELECT tc, sc FROM ce) WHERE cls <> 'D??' AND o <> 'D??' GROUP BY cls ORDER BY count(*) DESC, cls LIMIT 14)"


def top_classes(k, n=14):
    return k.select(F.explode(F.array("sc", "tc")).alias("cls")).groupBy("cls").agg(N().alias("n")).orderBy(F.desc("n"), "cls").limit(n)


@query("TOP-02", on_classes("SELECT cls, count(*) AS n FROM (SELECT sc AS cls, tc AS o FROM ce UNION ALL SELECT tc, sc FROM ce) WHERE cls <> 'D??' AND o <> 'D??' GROUP BY cls ORDER BY n DESC, cls LIMIT 14"), "cit cls")
def top_n_classes(spark, d):
    return top_classes(known_class(spark, d))


def top_matrix(spark, d):
    k = known_class(spark, d)
    top = top_classes(k).select("cls")
    return k.join(top.select(F.col("cls").alias("sc")), "sc", "left_semi").join(top.select(F.col("cls").alias("tc")), "tc", "left_semi")


@query("AGG-07", on_classes(f", {TOP} SELECT sc, tc, count(*) AS n, round(ln(1 + count(*)), 6) AS log_n FROM ce WHERE sc IN (SELECT cls FROM top) AND tc IN (SELECT cls FROM top) GROUP BY sc, tc"), "cit cls")
def top_class_matrix(spark, d):
    return top_matrix(spark, d).groupBy("sc", "tc").agg(N().alias("n"), F.round(F.log1p(N()), 6).alias("log_n"))


@query("MTH-12", on_classes("SELECT sc, tc, round(ln(1 + count(*)), 6) AS log_n FROM ce GROUP BY sc, tc"), "cit cls")
def log_matrix(spark, d):
    return classed(spark, d).groupBy("sc", "tc").agg(F.round(F.log1p(N()), 6).alias("log_n"))


NAMES_SQL = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in t.CLASS_NAMES.items()) + ") nm(code, name)"


@query("JN-04", f"SELECT pid, main_class AS cls, coalesce(name, '') AS name FROM cls LEFT JOIN {NAMES_SQL} ON code = main_class", "cls")
def class_names(spark, d):
    names = spark.createDataFrame(list(t.CLASS_NAMES.items()), "cls string, name string")
    return a.patents(spark, d).select("pid", t.main_class(F.regexp_replace("class_text", " .*", "")).alias("cls")).join(names, "cls", "left").na.fill({"name": ""}).select("pid", "cls", "name")


@query("JN-05", "SELECT source, target, s.title AS source_title, t.title AS target_title, s.class_text AS source_class_text, t.class_text AS target_class_text FROM (SELECT DISTINCT source, target FROM edge) JOIN pat s ON s.pid = source JOIN pat t ON t.pid = target", "edge pat")
def pair_metadata(spark, d):
    return p.look_up_both(a.edges(spark, d).select("source", "target").distinct(), a.patents(spark, d), "pid", ["title", "class_text"])


@query("JN-06", "SELECT DISTINCT source, target FROM edge WHERE right(source, 1)::int % 2 = 1", "edge")
def resume(spark, d):
    e = a.edges(spark, d).select("source", "target")
    return p.not_done(e, e.filter(F.substring("source", 8, 1).cast("int") % 2 == 0))


@query("STM-03", "SELECT DISTINCT source, target FROM edge WHERE category <> 'A' AND (source, target) NOT IN (SELECT source, target FROM edge WHERE category = 'A')", "edge")
def resume_by_status(spark, d):
    e = a.edges(spark, d)
    return p.not_done(e.filter("category <> 'A'").select("source", "target"), e.filter("category = 'A'"))


@query("JN-07", "SELECT d.doc_id AS doc_id, lang, coalesce(CASE toxic WHEN 1 THEN 'Yes' WHEN 0 THEN 'No' END, 'Unknown') AS judgment, coalesce(quality, 0) AS confidence, '' AS reason FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def left_join_with_defaults(spark, d):
    docs = a.table(spark, d, "documents").select(F.col("doc_id").alias("source"), F.col("doc_id").alias("target"), "lang")
    verdicts = a.table(spark, d, "labels").select(F.col("doc_id").alias("source"), F.col("doc_id").alias("target"), F.when(F.col("toxic") == 1, "Yes").otherwise("No").alias("judgment"), F.col("quality").cast("int").alias("confidence"), F.lit("").alias("reason"), F.lit(0).alias("ord"))
    return p.with_judgment(docs, verdicts, "ord").select(F.col("source").alias("doc_id"), "lang", "judgment", "confidence", "reason")


DEG = "dg AS (SELECT node, count(*) AS deg FROM (SELECT source AS node FROM edge UNION ALL SELECT target FROM edge) GROUP BY node)"


def ends(e):
    return e.select(F.col("source").alias("node"), F.col("target").alias("nbr")).unionAll(e.select(F.col("target").alias("node"), F.col("source").alias("nbr")))


@query("AGG-08", "SELECT node, count(*) FILTER (o) AS out_deg, count(*) FILTER (NOT o) AS in_deg, count(*) AS deg FROM (SELECT source AS node, true AS o FROM edge UNION ALL SELECT target, false FROM edge) GROUP BY node", "edge")
def degree_kinds(spark, d):
    e = a.edges(spark, d)
    both = e.select(F.col("source").alias("node"), F.lit(True).alias("o")).unionAll(e.select(F.col("target").alias("node"), F.lit(False).alias("o")))
    return both.groupBy("node").agg(F.count_if("o").alias("out_deg"), F.count_if(~F.col("o")).alias("in_deg"), N().alias("deg"))


@query("AGG-09", "SELECT year, node, count(*) AS deg FROM (SELECT left(oa_date, 4)::int AS year, source AS node FROM edge UNION ALL SELECT left(oa_date, 4)::int, target FROM edge) GROUP BY ALL", "edge")
def degree_per_year(spark, d):
    e = a.edges(spark, d).withColumn("year", val.year_of(F.col("oa_date")))
    return e.select("year", F.explode(F.array("source", "target")).alias("node")).groupBy("year", "node").agg(N().alias("deg"))


@query("AGG-10", on_classes("SELECT node, count(DISTINCT nbr) AS deg FROM (SELECT source AS node, target AS nbr, sc, tc FROM ce UNION ALL SELECT target, source, sc, tc FROM ce) WHERE sc <> 'D??' AND tc <> 'D??' GROUP BY node"), "cit cls")
def distinct_neighbours(spark, d):
    return ends(known_class(spark, d)).groupBy("node").agg(F.count_distinct("nbr").alias("deg"))


@query("JN-10", f"WITH {DEG} SELECT node, deg, year FROM dg JOIN pub ON pid = node", "edge pub")
def degree_with_year(spark, d):
    deg = ends(a.edges(spark, d)).groupBy("node").agg(N().alias("deg"))
    return deg.join(a.publications(spark, d).withColumnRenamed("pid", "node"), "node").select("node", "deg", "year")


@query("FLT-14", f"WITH {DEG} SELECT year, count(*) AS n FROM dg JOIN pub ON pid = node GROUP BY year HAVING count(*) >= 10", "edge pub")
def groups_of_size(spark, d):
    return degree_with_year(spark, d).groupBy("year").agg(N().alias("n")).filter("n >= 10")


@query("DAT-03", f"WITH {DEG} SELECT node, round(deg / greatest(1, 2022 - greatest(year, 2007) + 1)::double, 6) AS rate FROM dg JOIN pub ON pid = node", "edge pub")
def citation_rates(spark, d):
    return degree_with_year(spark, d).select("node", F.round(val.citation_rate(F.col("deg"), F.col("year")), 6).alias("rate"))


@query("AGG-18", f"WITH {DEG} SELECT max(deg) AS most, arg_min(node, (-deg, node)) AS most_node, min(deg) AS least, arg_min(node, (deg, node)) AS least_node FROM dg", "edge")
def extreme_nodes(spark, d):
    deg = ends(a.edges(spark, d)).groupBy("node").agg(N().alias("deg"))
    return deg.agg(F.max("deg").alias("most"), F.min_by("node", F.struct(-F.col("deg"), "node")).alias("most_node"), F.min("deg").alias("least"), F.min_by("node", F.struct("deg", "node")).alias("least_node"))


@query("AGG-34", on_classes(", e AS (SELECT DISTINCT source AS a, target AS b FROM ce WHERE sc = 'D18' AND tc = 'D18'), dd AS (SELECT node, count(*) AS k FROM (SELECT a AS node FROM e UNION ALL SELECT b FROM e) GROUP BY node) SELECT count(*) AS n_nodes, (SELECT count(*) FROM e) AS n_edges, round(avg(k), 6) AS mean, max(k) AS most, min(k) AS least FROM dd"), "cit cls")
def class_network(spark, d):
    from loomgraph.operators import graph as g

    e = g.simple_graph(both_in_class(spark, d), "source", "target")
    s = g.degrees(e).agg(N().alias("n_nodes"), F.round(F.avg("deg"), 6).alias("mean"), F.max("deg").alias("most"), F.min("deg").alias("least"))
    return s.join(e.agg(N().alias("n_edges"))).select("n_nodes", "n_edges", "mean", "most", "least")


@query("AGG-31", "SELECT year, count(*) AS n FROM (SELECT left(oa_date, 4)::int AS year FROM edge) GROUP BY GROUPING SETS ((year), ())", "edge")
def totals_by_year(spark, d):
    return a.edges(spark, d).select(val.year_of(F.col("oa_date")).alias("year")).rollup("year").agg(N().alias("n"))


@query("AGG-23", "SELECT 'records' AS stage, count(*) AS n FROM cit UNION ALL SELECT 'edges', count(*) FROM edge UNION ALL SELECT 'pairs', count(*) FROM (SELECT DISTINCT source, target FROM edge)", "cit edge")
def stage_counts(spark, d):
    e = a.edges(spark, d)
    stages = [("records", a.citations(spark, d)), ("edges", e), ("pairs", e.select("source", "target").distinct())]
    out = None
    for name, df in stages:
        row = df.agg(N().alias("n")).select(F.lit(name).alias("stage"), "n")
        out = row if out is None else out.unionAll(row)
    return out


@query("PRJ-07", "SELECT 'fixed' AS stage, 'patents' AS item, 435101::bigint AS n UNION ALL SELECT 'measured', 'patents', count(*) FROM pat", "pat")
def constant_rows(spark, d):
    fixed = spark.createDataFrame([("fixed", "patents", 435_101)], "stage string, item string, n long")
    return fixed.unionAll(a.patents(spark, d).agg(N().alias("n")).select(F.lit("measured").alias("stage"), F.lit("patents").alias("item"), "n"))


@query("PRJ-01", "SELECT source, target, coalesce(t.title, '') AS title, coalesce(t.class_text, '') AS class_text, '' AS reason, NULL::int AS id_diff FROM (SELECT DISTINCT source, target FROM edge) LEFT JOIN pat t ON t.pid = target AND t.size < 20", "edge pat")
def projection_with_defaults(spark, d):
    known = a.patents(spark, d).filter("size < 20").select(F.col("pid").alias("target"), "title", "class_text")
    e = a.edges(spark, d).select("source", "target").distinct().join(known, "target", "left")
    return e.select("source", "target", t.text_of(F.col("title")).alias("title"), t.text_of(F.col("class_text")).alias("class_text"), F.lit("").alias("reason"), F.lit(None).cast("int").alias("id_diff"))


@query("PRJ-02", "SELECT source, target, to_json({app: app, date: oa_date, category: category})::varchar AS event FROM edge", "edge")
def event_struct(spark, d):
    return a.edges(spark, d).select("source", "target", F.to_json(F.struct("app", F.col("oa_date").alias("date"), "category")).alias("event"))


@query("PRJ-03", "SELECT vec_id AS id_a, label AS param FROM embeddings")
def aliased_columns(spark, d):
    alias = {"vec_id": "id_a", "label": "param", "theta": "estimate"}
    e = a.table(spark, d, "embeddings")
    return e.withColumnsRenamed(alias).select("id_a", "param")


@query("PRJ-04", "SELECT doc_id, quality AS m5_quality, toxic AS m5_toxic FROM labels")
def prefixed_columns(spark, d):
    x = a.table(spark, d, "labels")
    return x.withColumnsRenamed({c: f"m5_{c}" for c in x.columns if c != "doc_id"})


@query("PRJ-05", "SELECT l.doc_id AS doc_id, l.quality AS quality FROM labels l JOIN documents d ON d.doc_id = l.doc_id")
def drop_suffixes(spark, d):
    joined = a.table(spark, d, "labels").select("doc_id", "quality").join(a.table(spark, d, "documents").select("doc_id", F.col("lang").alias("quality_m5dup")), "doc_id")
    return joined.drop(*[c for c in joined.columns if c.endswith(("_pms", "_m5dup", "_bdup"))])


@query("PRJ-06", "SELECT pid, " + ", ".join(f"list_contains(cs, '{c}')::int AS is_{c}" for c in t.CLASS_NAMES) + " FROM (SELECT pid, list_distinct([CASE WHEN size BETWEEN 10 AND 34 THEN 'D' || size ELSE 'D' || left(size::varchar, 1) END, CASE WHEN n % 34 + 1 BETWEEN 10 AND 34 THEN 'D' || (n % 34 + 1) ELSE 'D' || (n % 34 + 1) END]) AS cs FROM pat)", "pat")
def one_hot(spark, d):
    cs = t.all_classes(F.col("classes_text"))
    return a.patents(spark, d).withColumn("cs", cs).select("pid", *[F.array_contains("cs", c).cast("int").alias(f"is_{c}") for c in t.CLASS_NAMES])


@query("SET-01", "SELECT year, count(*) AS n FROM (SELECT left(oa_date, 4)::int AS year FROM cit WHERE oa_date < '19970101' UNION ALL SELECT left(oa_date, 4)::int FROM cit WHERE oa_date >= '19970101') GROUP BY year", "cit")
def union_of_parts(spark, d):
    c = a.citations(spark, d)
    both = c.filter("oa_date < '19970101'").unionByName(c.filter("oa_date >= '19970101'"))
    return both.groupBy(val.year_of(F.col("oa_date")).alias("year")).agg(N().alias("n"))


@query("SET-02", "SELECT doc_id, quality, NULL::varchar AS lang FROM labels UNION ALL SELECT doc_id, NULL, lang FROM documents")
def union_of_schemas(spark, d):
    return a.table(spark, d, "labels").select("doc_id", "quality").unionByName(a.table(spark, d, "documents").select("doc_id", "lang"), allowMissingColumns=True)


@query("SET-03", "SELECT source, target, len(list_intersect(vs, vt)) AS n FROM (" + IMAGED + ")", "edge img")
def set_intersection(spark, d):
    return imaged(spark, d).select("source", "target", F.size(F.array_intersect(F.map_keys("source_images"), F.map_keys("target_images"))).cast("long").alias("n"))


@query("SET-04", "SELECT source, target, array_to_string(list_sort(list_filter(vs, lambda x: NOT list_contains(vt, x))), ',') AS only_source FROM (" + IMAGED + ")", "edge img")
def set_difference(spark, d):
    return imaged(spark, d).select("source", "target", F.array_join(F.array_sort(F.array_except(F.map_keys("source_images"), F.map_keys("target_images"))), ",").alias("only_source"))


@query("ARR-06", "SELECT source, target, array_to_string(list_sort(list_distinct(list_concat(vs, vt))), ',') AS vs FROM (" + IMAGED + ")", "edge img")
def sorted_set(spark, d):
    return imaged(spark, d).select("source", "target", F.array_join(F.array_sort(F.array_union(F.map_keys("source_images"), F.map_keys("target_images"))), ",").alias("vs"))


@query("SET-07", "SELECT DISTINCT node FROM (SELECT source AS node FROM edge UNION ALL SELECT target FROM edge)", "edge")
def node_set(spark, d):
    return ends(a.edges(spark, d)).select("node").distinct()


@query("SET-08", "SELECT unnest([1990, 1995, 1996, 2030])::int AS year EXCEPT SELECT left(oa_date, 4)::int FROM cit", "cit")
def missing_years(spark, d):
    from loomgraph.sources.readers import missing_years as missing

    return missing(a.citations(spark, d).select(val.year_of(F.col("oa_date")).alias("year")), [1990, 1995, 1996, 2030])


@query("FLT-13", "SELECT count(*) AS n FROM pub WHERE year BETWEEN 1970 AND 2030", "pub")
def year_range(spark, d):
    return a.publications(spark, d).filter(F.col("year").between(1970, 2030)).agg(N().alias("n"))


@query("SRC-09", "SELECT pid, date FROM pub WHERE year IN (1995, 1998)", "pub")
def year_selection(spark, d):
    from loomgraph.sources.readers import years

    return years(a.publications(spark, d), [1995, 1998]).select("pid", "date")


@query("SRC-02", "SELECT p_partkey, p_size FROM part")
def projected_scan(spark, d):
    return a.table(spark, d, "part").select("p_partkey", "p_size")


@query("FLT-15", "SELECT DISTINCT p_name FROM part WHERE NOT regexp_matches(p_name, '(?i)ring')")
def name_exclusion(spark, d):
    return a.table(spark, d, "part").select("p_name").distinct().filter(~F.col("p_name").rlike("(?i)ring"))


@query("FLT-18", "SELECT doc_id FROM labels WHERE lower(toxic::varchar) IN ('yes', 'true', '1', 'similar')")
def truthy(spark, d):
    return a.table(spark, d, "labels").filter(F.lower(F.col("toxic").cast("string")).isin("yes", "true", "1", "similar")).select("doc_id")


@query("FLT-19", "SELECT d.doc_id AS doc_id, l.quality AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality IS NOT NULL AND d.doc_id IS NOT NULL")
def null_keys(spark, d):
    return a.table(spark, d, "documents").select("doc_id").join(a.table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").na.drop(subset=["doc_id", "quality"])


@query("JN-11", "SELECT pid, title, n_lines FROM pat JOIN (SELECT l_partkey, count(*) AS n_lines FROM lineitem GROUP BY 1) ON regexp_replace(pid, '^D0+', 'D') = 'D' || l_partkey", "pat")
def normalised_key_join(spark, d):
    lines = a.table(spark, d, "lineitem").groupBy(F.concat(F.lit("D"), F.col("l_partkey").cast("string")).alias("key")).agg(N().alias("n_lines"))
    return a.patents(spark, d).withColumn("key", t.unpadded_id(F.col("pid"))).join(lines, "key").select("pid", "title", "n_lines")


@query("JN-13", "SELECT d.doc_id AS doc_id, l.quality AS m5_quality, l2.toxic AS b_toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN (SELECT * FROM labels WHERE toxic = 1) l2 ON l2.doc_id = d.doc_id")
def chained_left_joins(spark, d):
    labels = a.table(spark, d, "labels")
    out = a.table(spark, d, "documents").select("doc_id")
    for side in (labels.select("doc_id", F.col("quality").alias("m5_quality")), labels.filter("toxic = 1").select("doc_id", F.col("toxic").alias("b_toxic"))):
        out = out.join(side, "doc_id", "left")
    return out


@query("JN-16", "SELECT pid, title, path FROM pat LEFT JOIN (SELECT pid AS ip, path FROM img WHERE view = 'front') ON ip = pid", "pat img")
def title_and_image(spark, d):
    return a.patents(spark, d).select("pid", "title").join(a.patent_images(spark, d), "pid", "left").select("pid", "title", F.try_element_at("images", F.lit("front")).alias("path"))


@query("AGG-33", "SELECT s.stratum AS stratum, s.n_target AS n_target, count(d.doc_id) AS n_actual FROM (VALUES ('en', 5), ('fr', 7), ('xx', 1)) s(stratum, n_target) LEFT JOIN documents d ON d.lang = s.stratum GROUP BY ALL")
def stratum_audit(spark, d):
    from loomgraph.operators.sampling import audit

    return audit(a.table(spark, d, "documents").select(F.col("lang").alias("stratum")), [("en", 5), ("fr", 7), ("xx", 1)])


@query("AGG-13", "SELECT k AS quality, count(l.doc_id) AS n FROM (SELECT unnest([0, 1, 2, 3])::int AS k) LEFT JOIN labels l ON l.quality = k GROUP BY k")
def fixed_domain(spark, d):
    domain = spark.createDataFrame([(k,) for k in range(4)], "quality int")
    n = a.table(spark, d, "labels").groupBy(F.col("quality").cast("int").alias("quality")).agg(N().alias("n"))
    return domain.join(n, "quality", "left").na.fill({"n": 0})


@query("WIN-08", "SELECT printf('P%03d', row_number() OVER (ORDER BY doc_id)) AS pair_id, doc_id FROM labels WHERE toxic = 1")
def sequence_ids(spark, d):
    toxic = dense(a.table(spark, d, "labels").filter("toxic = 1").select("doc_id"), "doc_id")
    return toxic.select(F.format_string("P%03d", F.col("id") + 1).alias("pair_id"), "doc_id")


@query("WIN-09", "SELECT pid, row_number() OVER (ORDER BY pid) - 1 AS id FROM (SELECT DISTINCT source AS pid FROM edge UNION SELECT DISTINCT target FROM edge)", "edge")
def dense_ids(spark, d):
    return dense(ends(a.edges(spark, d)).select(F.col("node").alias("pid")).distinct(), "pid")
