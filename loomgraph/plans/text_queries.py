"""Queries of parsers, JSON, dates, filters and vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgraph.functions import text as t
from loomgraph.functions import values as val
from loomgraph.operators import vectors as v
from loomgraph.plans.base import query
from loomgraph.plans.pairs import N
from loomgraph.sources import adapters as a

# every spelling of class codes that occurs: of parts, in five shapes
CODES = "code AS (SELECT p_partkey AS k, unnest(['D' || p_size || ' ' || p_partkey, 'D ' || p_partkey, 'D' || p_partkey, 'd0' || (p_partkey % 40), '', 'X' || p_size, 'D' || p_size || ',D ' || (p_partkey % 10) || ',D99']) AS raw FROM part)"


def codes(spark, d):
    p = a.table(spark, d, "part")
    k, s = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    D = F.lit("D")
    shapes = [F.concat(D, s, F.lit(" "), k), F.concat(F.lit("D "), k), F.concat(D, k), F.concat(F.lit("d0"), (F.col("p_partkey") % 40).cast("string")), F.lit(""), F.concat(F.lit("X"), s), F.concat(D, s, F.lit(",D "), (F.col("p_partkey") % 10).cast("string"), F.lit(",D99"))]
    return p.select(F.col("p_partkey").alias("k"), F.explode(F.array(*shapes)).alias("raw"))


def code_query(name, sql, f):
    @query(name, f"WITH {CODES} SELECT k, raw, {sql} AS cls FROM code")
    def run(spark, d):
        return codes(spark, d).select("k", "raw", f(F.col("raw")).alias("cls"))

    return run


def _p1(x):
    return f"""CASE WHEN regexp_matches({x}, '^D \\d') THEN 'D' || regexp_extract({x}, '^D (\\d)', 1)
      WHEN regexp_matches({x}, '^D\\d\\d') AND left(regexp_extract({x}, '^D(\\d+)', 1), 2) IN ('10','11','12','13','14','15','16','17','18','19','20','21','22','23','24','25','26','27','28','29','30','31','32','33','34','99') THEN 'D' || left(regexp_extract({x}, '^D(\\d+)', 1), 2)
      WHEN regexp_matches({x}, '^D[1-9]') THEN 'D' || left(regexp_extract({x}, '^D(\\d+)', 1), 1) END"""


NUMBER = "try_cast(nullif(regexp_extract(raw, '(?i)^D\\s*0*(\\d+)', 1), '') AS int)"
code_query("STR-01", _p1("trim(split_part(raw, ',', 1))"), t.main_class)
code_query("STR-02", "array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(raw, ','), lambda x: " + _p1("trim(x)") + "), lambda x: x IS NOT NULL))), ',')", lambda c: F.array_join(t.all_classes(c), ","))
code_query("STR-03", f"CASE WHEN {NUMBER} BETWEEN 1 AND 34 OR {NUMBER} = 99 THEN 'D' || lpad({NUMBER}::varchar, 2, '0') ELSE 'D??' END", t.strict_class)
_DIGITS = "nullif(regexp_extract(raw, '^D\\s*(\\d+)', 1), '')"
code_query("STR-04", f"CASE WHEN length({_DIGITS}) >= 2 AND (left({_DIGITS}, 2)::int BETWEEN 1 AND 34 OR left({_DIGITS}, 2) = '99') THEN 'D' || left({_DIGITS}, 2)::int WHEN left({_DIGITS}, 1)::int BETWEEN 1 AND 9 THEN 'D' || left({_DIGITS}, 1) ELSE 'Unknown' END", t.lenient_class)
code_query("STR-05", f"CASE WHEN {NUMBER} IS NOT NULL THEN CASE WHEN {NUMBER} < 10 THEN 'D0' || {NUMBER} ELSE 'D' || {NUMBER} END ELSE 'D??' END", t.padded_class)
code_query("STR-06", "array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(raw, ','), lambda x: CASE WHEN regexp_matches(regexp_replace(upper(x), '\\s+', '', 'g'), '^D\\d+$') THEN 'D' || lpad(regexp_replace(upper(x), '[D\\s]+', '', 'g'), 7, '0') END), lambda x: x IS NOT NULL))), ',')", lambda c: F.array_join(t.padded_ids(c), ","))
code_query("STR-07", "try_cast(nullif(regexp_extract(raw, 'D0*(\\d+)', 1), '') AS bigint) + 10000000000", t.id_key)


@query("STR-08", "SELECT pid, ltrim(pid, 'D')::bigint AS n FROM pat", "pat")
def id_numbers(spark, d):
    return a.patents(spark, d).select("pid", t.id_number(F.col("pid")).alias("n"))


@query("STR-09", "SELECT vec_id, printf('D%07d', vec_id) AS pid FROM embeddings")
def id_texts(spark, d):
    return a.table(spark, d, "embeddings").select("vec_id", t.id_text(F.col("vec_id")).alias("pid"))


@query("STR-10", "SELECT source, target, abs(ltrim(source, 'D')::int - ltrim(target, 'D')::int) AS gap FROM (SELECT DISTINCT source, target FROM edge)", "edge")
def id_gaps(spark, d):
    return a.edges(spark, d).select("source", "target").distinct().select("source", "target", t.id_gap(F.col("source"), F.col("target")).alias("gap"))


@query("STR-11", "SELECT pid, regexp_replace(pid, '^D0+', 'D') AS short FROM pat", "pat")
def unpadded(spark, d):
    return a.patents(spark, d).select("pid", t.unpadded_id(F.col("pid")).alias("short"))


@query("STR-12", "SELECT pid, CASE WHEN n % 3 = 0 THEN 'perspective' WHEN n % 3 = 1 THEN 'front' ELSE 'overview' END AS view FROM pat", "pat")
def view_types(spark, d):
    text = F.when(F.col("n") % 3 == 0, F.array(F.lit("FIG. 1 is a front view"), F.lit("FIG. 2 is a Perspective view"))).when(F.col("n") % 3 == 1, F.array(F.lit("a front  elevation"), F.lit("x"))).otherwise(F.array(F.lit("top plan view")))
    return a.patents(spark, d).withColumn("t", text).select("pid", t.view_type(F.col("t")).alias("view"))


@query("STR-13", "SELECT pid, 'images/' || (2007 + n % 16) || '/' || pid || '-' || (2007 + n % 16) || '0101-D00001.TIF' AS path FROM pat", "pat")
def image_paths(spark, d):
    name = F.concat("pid", F.lit("-"), (2007 + F.col("n") % 16).cast("string"), F.lit("0101-D00001.TIF"))
    return a.patents(spark, d).select("pid", t.image_path("images", name).alias("path"))


@query("STR-14", "SELECT pid, CASE WHEN n % 2 = 0 THEN (2007 + n % 16)::varchar ELSE 'unknown' END AS year FROM pat", "pat")
def path_years(spark, d):
    m = F.when(F.col("n") % 2 == 0, F.create_map(F.lit("front"), F.concat(F.lit("/images/"), (2007 + F.col("n") % 16).cast("string"), F.lit("/x.tif")))).otherwise(F.create_map(F.lit("front"), F.lit("/other/x.tif")))
    return a.patents(spark, d).select("pid", t.year_of_path(m).alias("year"))


@query("STR-15", "SELECT pid, CASE WHEN n % 3 < 2 THEN pid || ',' || replace(title, '''', '') || ' ,x' END AS items FROM pat", "pat")
def literal_lists(spark, d):
    raw = F.when(F.col("n") % 3 < 2, F.concat(F.lit("['"), "pid", F.lit("', \""), F.regexp_replace("title", "'", ""), F.lit(" ,x\"]"))).otherwise(F.concat(F.lit("[broken "), "pid"))
    return a.patents(spark, d).select("pid", F.array_join(t.literal_list(raw), ",").alias("items"))


def reasons(spark, d):
    texts = F.get(F.array(*map(F.lit, a.REASONS)), (F.col("n") % len(a.REASONS)).cast("int"))
    return a.patents(spark, d).select("pid", "n", texts.alias("reason"))


R = f"r AS (SELECT pid, n, {a._REASONS_SQL}[n % {len(a.REASONS)} + 1] AS reason FROM pat)"


def _matched_sql(patterns):
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(reason, '(?i){p}') THEN '{p}' END" for p in patterns) + "], lambda x: x IS NOT NULL), '|')"


@query("STR-16", f"WITH {R} SELECT pid, {_matched_sql(t.HIGH_SIMILAR)} AS high, {_matched_sql(t.EXACT)} AS exact FROM r", "pat")
def matched_patterns(spark, d):
    return reasons(spark, d).select("pid", F.array_join(t.matched(F.col("reason"), t.HIGH_SIMILAR), "|").alias("high"), F.array_join(t.matched(F.col("reason"), t.EXACT), "|").alias("exact"))


BUCKET = "CASE WHEN " + " OR ".join(f"regexp_matches(reason, '(?i){p}')" for p in t.HIGH_SIMILAR) + " THEN 'high_similar' WHEN " + " OR ".join(f"regexp_matches(reason, '(?i){p}')" for p in t.EXACT) + " THEN 'exact_match' ELSE 'similar' END"


@query("SET-05", f"WITH {R} SELECT pid, {BUCKET} AS bucket FROM r", "pat")
def three_way(spark, d):
    return reasons(spark, d).select("pid", t.reason_bucket(F.col("reason")).alias("bucket"))


SAME = " OR ".join(f"regexp_matches(reason, '(?i){p}')" for p in t.SAME_DESIGN)


@query("SET-06", f"WITH {R} SELECT pid, CASE WHEN n % 10 = 0 THEN 'same_id' WHEN {SAME} OR n % 9 <= 1 THEN 'exact' ELSE 'distinct' END AS part FROM r", "pat")
def two_stages(spark, d):
    hit = (F.size(t.matched(F.col("reason"), t.SAME_DESIGN)) > 0) | (F.col("n") % 9 <= 1)
    return reasons(spark, d).select("pid", F.when(F.col("n") % 10 == 0, "same_id").when(hit, "exact").otherwise("distinct").alias("part"))


@query("STR-17", f"WITH {R} SELECT pid, {_matched_sql(t.SAME_DESIGN)} AS patterns FROM r", "pat")
def same_design_patterns(spark, d):
    return reasons(spark, d).select("pid", F.array_join(t.matched(F.col("reason"), t.SAME_DESIGN), "|").alias("patterns"))


WORDS = "(?i)\\b(identical|exact|same)\\b"


@query("STR-18", f"WITH {R} SELECT pid, regexp_matches(reason, '{WORDS}') AS hit FROM r", "pat")
def any_word(spark, d):
    return reasons(spark, d).select("pid", F.col("reason").rlike(t.word_pattern(t.EXACT_WORDS)).alias("hit"))


@query("STR-19", f"SELECT source, target, CASE WHEN judgment = 'Yes' THEN CASE WHEN regexp_matches(reason, '{WORDS}') THEN 'Yes_exact' ELSE 'Yes_nonexact' END ELSE judgment END AS label FROM je", "je")
def exact_labels(spark, d):
    return a.judged_edges(spark, d).select("source", "target", t.exactness(F.col("judgment"), F.col("reason")).alias("label"))


@query("STR-20", f"WITH {R} SELECT pid, " + " OR ".join(f"contains(lower(reason), ' {w} ') OR starts_with(lower(reason), '{w} ') OR ends_with(lower(reason), ' {w}')" for w in t.EXACT_WORDS) + " AS hit FROM r", "pat")
def spaced_words(spark, d):
    return reasons(spark, d).select("pid", t.has_spaced_word(F.col("reason")).alias("hit"))


@query("STR-21", f"WITH {R} SELECT pid, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(reason, '(?i)\\b{w}\\b') THEN '{w}' END" for w in t.EXACT_WORDS) + "], lambda x: x IS NOT NULL), ',') AS words FROM r", "pat")
def each_word(spark, d):
    return reasons(spark, d).select("pid", F.array_join(t.words_present(F.col("reason"), t.EXACT_WORDS), ",").alias("words"))


@query("STR-22", "SELECT source, target, CASE judgment WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS bin FROM je", "je")
def yes_no(spark, d):
    return a.judged_edges(spark, d).select("source", "target", t.yes_no(F.concat(F.lit(" "), F.upper("judgment"))).alias("bin"))


@query("STR-23", f"WITH {R} SELECT pid, regexp_matches(reason, '(?i)\\b(identical|same design|indistinguishable)\\b') AS same, regexp_matches(reason, '(?i)\\b(different|differs?|distinct)\\b') AS differs FROM r", "pat")
def identity_phrases(spark, d):
    x = F.col("reason")
    return reasons(spark, d).select("pid", x.rlike(r"(?i)\b(identical|same design|indistinguishable)\b").alias("same"), x.rlike(r"(?i)\b(different|differs?|distinct)\b").alias("differs"))


@query("STR-24", f"WITH {R} SELECT pid, CASE WHEN length(reason) > 20 THEN left(reason, 17) || '...' ELSE reason END AS short FROM r", "pat")
def shortened(spark, d):
    return reasons(spark, d).select("pid", t.shortened(F.col("reason"), 20).alias("short"))


@query("STR-25", "SELECT DISTINCT replace(printf('%.2f', l_discount), '.', '') AS two, replace(printf('%.3f', l_discount), '.', '') AS three FROM lineitem")
def tags(spark, d):
    x = F.col("l_discount").cast("double")
    return a.table(spark, d, "lineitem").select(t.threshold_tags(x).alias("two"), t.threshold_tags(x, 3).alias("three")).distinct()


# --- JSON


@query("JSN-01", "SELECT event_id, CASE WHEN event_id % 5 = 4 THEN 'PARSE_ERROR' ELSE event_type END AS similarity, CASE WHEN event_id % 5 = 4 THEN 0 ELSE (props->>'k')::int END AS confidence FROM events")
def tolerant_json(spark, d):
    k = F.get_json_object("props", "$.k")
    body = F.concat(F.lit('{"similarity": "'), "event_type", F.lit('", "confidence": '), k, F.lit("}"))
    n = F.col("event_id") % 5
    raw = F.when(n == 4, "no braces at all").when(n == 3, F.concat(F.lit("```json\n12\n"), F.regexp_replace(body, r"\}$", ",}"), F.lit("\n```"))).otherwise(F.concat(F.lit("Sure: "), body, F.lit(" done")))
    j = val.tolerant_json(raw, "similarity string, confidence int", "similarity")
    return a.events(spark, d).withColumn("j", j).select("event_id", F.coalesce("j.similarity", F.lit("PARSE_ERROR")).alias("similarity"), F.coalesce("j.confidence", F.lit(0)).alias("confidence"))


@query("JSN-02", "SELECT event_id, (props->>'k')::int AS k FROM events")
def fenced_json(spark, d):
    raw = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    return a.events(spark, d).select("event_id", F.from_json(val.unfenced(raw), "k int")["k"].alias("k"))


@query("JSN-03", "SELECT event_id, (props->>'k')::int BETWEEN 10 AND 60 AND event_type IN ('click', 'error') AS valid FROM events")
def validated_json(spark, d):
    k = F.from_json("props", "k int")["k"]
    return a.events(spark, d).select("event_id", F.coalesce(k.between(10, 60) & F.col("event_type").isin("click", "error"), F.lit(False)).alias("valid"))


@query(
    "JSN-03-paths",
    "SELECT event_id, concat_ws(',', CASE WHEN k < 10 OR k > 60 OR event_id % 4 = 0 THEN '$.a.k' END, CASE WHEN event_type NOT IN ('click', 'error') THEN '$.kind' END, CASE WHEN event_id % 3 > 0 THEN '$.list' END) AS errors FROM (SELECT event_id, event_type, (props->>'k')::int AS k FROM events)",
)
def validated_paths(spark, d):
    """Kinds and conditions at paths of nested values: a number that is text in every fourth record, a list that is none in two of three."""
    k, i = F.get_json_object("props", "$.k"), F.col("event_id")
    number = F.when(i % 4 == 0, F.concat(F.lit('"'), k, F.lit('"'))).otherwise(k)
    some = F.when(i % 3 == 0, "[1, 2]").when(i % 3 == 1, "{}").otherwise("null")
    v = F.try_parse_json(F.concat(F.lit('{"a": {"k": '), number, F.lit('}, "kind": "'), "event_type", F.lit('", "list": '), some, F.lit("}")))
    rules = {"$.a.k": ("number", lambda x: x.between(10, 60)), "$.kind": ("string", lambda x: x.isin("click", "error")), "$.list": ("array", None)}
    return a.events(spark, d).select("event_id", F.array_join(val.path_errors(v, rules), ",").alias("errors"))


@query("JSN-04", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type || ',x' ELSE 'identical,exact,same' END AS words FROM events")
def word_lists(spark, d):
    raw = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"words": ["'), F.upper("event_type"), F.lit('", "X"]}'))).otherwise("oops")
    words = F.transform(F.from_json(raw, "words array<string>")["words"], F.lower)
    return a.events(spark, d).select("event_id", F.array_join(F.coalesce(words, F.array(*map(F.lit, t.EXACT_WORDS))), ",").alias("words"))


@query("JSN-05", "SELECT doc_id, to_json({lang: lang, source: source})::varchar AS j FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def records_as_json(spark, d):
    from loomgraph.sources.writers import json_text

    return a.table(spark, d, "documents").filter("lang is not null and source is not null").select("doc_id", json_text("lang", "source").alias("j"))


@query("JSN-06", "SELECT conv_id, to_json({conv: conv_id, turns: list({turn: turn, role: role} ORDER BY turn)})::varchar AS j FROM conversations GROUP BY conv_id")
def nested_json(spark, d):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("turns")
    return a.table(spark, d, "conversations").groupBy("conv_id").agg(turns).select("conv_id", F.to_json(F.struct(F.col("conv_id").alias("conv"), "turns")).alias("j"))


# --- dates


@query("DAT-01", "SELECT app, pid, ord, left(oa_date, 4)::int AS year FROM cit", "cit")
def years(spark, d):
    return a.citations(spark, d).select("app", "pid", "ord", val.year_of(F.col("oa_date")).alias("year"))


@query("DAT-02", "SELECT pid, strptime(date, '%Y%m%d')::date AS day FROM pub", "pub")
def parsed(spark, d):
    return a.publications(spark, d).select("pid", val.parsed_date(F.col("date")).alias("day"))


DATED = "SELECT source, target, strptime(s.date, '%Y%m%d')::date AS ds, strptime(t.date, '%Y%m%d')::date AS dt FROM (SELECT DISTINCT source, target FROM edge) JOIN pub s ON s.pid = source JOIN pub t ON t.pid = target"


def dated(spark, d):
    pub = a.publications(spark, d).withColumn("day", val.parsed_date(F.col("date"))).select("pid", "day")
    e = a.edges(spark, d).select("source", "target").distinct()
    return e.join(pub.select(F.col("pid").alias("source"), F.col("day").alias("ds")), "source").join(pub.select(F.col("pid").alias("target"), F.col("day").alias("dt")), "target")


@query("DAT-04", f"SELECT source, target, (dt > ds)::int AS h FROM ({DATED})", "edge pub")
def heaviside(spark, d):
    return dated(spark, d).select("source", "target", val.newer(F.col("dt"), F.col("ds")).alias("h"))


@query("GRF-22", f"SELECT count(*) AS n_arcs, count(*) FILTER (dt <= ds) AS violations FROM ({DATED})", "edge pub")
def date_guard(spark, d):
    return dated(spark, d).agg(N().alias("n_arcs"), F.count_if(val.newer(F.col("dt"), F.col("ds")) == 0).alias("violations"))


@query("DAT-05", f"SELECT least(9, floor((greatest(-2, least(2, date_diff('day', ds, dt) / 365.25)) + 2) / 0.4))::int AS bin, count(*) AS n FROM ({DATED}) GROUP BY bin", "edge pub")
def year_differences(spark, d):
    return dated(spark, d).groupBy(val.clipped_bin(val.years_between(F.col("dt"), F.col("ds")), -2, 2, 10).alias("bin")).agg(N().alias("n"))


@query("DAT-06", "SELECT event_id, date_trunc('day', ts) + INTERVAL 17 HOUR + CASE WHEN ts >= date_trunc('day', ts) + INTERVAL 17 HOUR THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS reset FROM events")
def next_reset(spark, d):
    today = F.date_trunc("day", "ts") + F.expr("INTERVAL 17 HOURS")
    return a.events(spark, d).select("event_id", F.when(F.col("ts") >= today, today + F.expr("INTERVAL 1 DAY")).otherwise(today).alias("reset"))


# --- filters over verdicts


@query("FLT-07", "SELECT source, target FROM je WHERE judgment = 'Yes'", "je")
def yes_pairs(spark, d):
    return a.judged_edges(spark, d).filter("judgment = 'Yes'").select("source", "target")


@query("FLT-08", "SELECT source, target, rank, similarity FROM jd WHERE judgment = 'Yes' AND similarity >= 0.3", "jd")
def yes_and_similar(spark, d):
    return a.ranked_pairs(spark, d).filter("judgment = 'Yes' and similarity >= 0.3").orderBy("rank", F.desc("similarity")).select("source", "target", "rank", "similarity")


@query("FLT-09", "SELECT source, target, similarity FROM je WHERE similarity >= 0.3 AND judgment NOT IN ('Unknown')", "je")
def threshold_and_exclusion(spark, d):
    return a.judged_edges(spark, d).filter("similarity >= 0.3").filter(~F.col("judgment").isin("Unknown")).orderBy(F.desc("similarity")).select("source", "target", "similarity")


@query("FLT-10", "SELECT source, target FROM jd WHERE type = 'all' AND judgment = 'No' AND similarity >= 0.3", "jd")
def three_conditions(spark, d):
    return a.ranked_pairs(spark, d).filter("type = 'all' and judgment = 'No' and similarity >= 0.3").select("source", "target")


@query("TOP-05", "SELECT source, target, rank, similarity FROM jd", "jd")
def by_rank(spark, d):
    return a.ranked_pairs(spark, d).orderBy("rank", F.desc("similarity"), "source", "target").select("source", "target", "rank", "similarity")


@query("AGG-11", "SELECT type, judgment, count(*) AS n FROM jd GROUP BY type, judgment", "jd")
def verdict_counts(spark, d):
    return a.ranked_pairs(spark, d).groupBy("type", "judgment").agg(N().alias("n"))


@query("AGG-12", "SELECT x.grp = y.grp AS same, round(avg((judgment = 'Yes')::int), 6) AS yes_rate FROM je JOIN vec x ON x.pid = source JOIN vec y ON y.pid = target GROUP BY same", "je")
def yes_rate(spark, d):
    g = a.vectors(spark, d).select("pid", "grp")
    j = a.judged_edges(spark, d).join(g.select(F.col("pid").alias("source"), F.col("grp").alias("ga")), "source").join(g.select(F.col("pid").alias("target"), F.col("grp").alias("gb")), "target")
    return j.groupBy((F.col("ga") == F.col("gb")).alias("same")).agg(F.round(F.avg((F.col("judgment") == "Yes").cast("int")), 6).alias("yes_rate"))


@query("PRJ-08", "SELECT source, target, CASE WHEN rank <= 10 AND similarity >= 0.3 THEN CASE judgment WHEN 'Yes' THEN 'TP' WHEN 'No' THEN 'FP' ELSE '??' END ELSE CASE judgment WHEN 'Yes' THEN 'FN' WHEN 'No' THEN 'TN' ELSE '??' END END AS cell FROM jd", "jd")
def confusion(spark, d):
    from loomgraph.operators.triads import confusion as label

    return a.ranked_pairs(spark, d).select("source", "target", label(F.col("rank"), F.col("similarity"), F.col("judgment"), 10, 0.3).alias("cell"))


@query("FLT-17", "SELECT source, target, CASE WHEN rank <= 10 AND similarity >= 0.3 AND judgment = 'No' THEN 'FP' ELSE 'FN' END AS kind FROM jd WHERE (rank <= 10 AND similarity >= 0.3 AND judgment = 'No') OR (rank >= 15 AND similarity < 0.3 AND judgment = 'Yes')", "jd")
def discord_edges(spark, d):
    from loomgraph.operators.triads import discordant

    return discordant(a.ranked_pairs(spark, d), 10, 0.3, 15, 0.3).select("source", "target", "kind")


@query("STA-14", "SELECT floor(similarity / 0.01)::bigint AS bin, count(*) AS n FROM je GROUP BY bin", "je")
def histogram(spark, d):
    from loomgraph.operators.stats import histogram as h

    return h(a.judged_edges(spark, d), "similarity")


@query("STA-18", "SELECT confidence, count(*) FILTER (judgment = 'No') AS no, count(*) FILTER (judgment = 'Unknown') AS unknown, count(*) FILTER (judgment = 'Yes') AS yes FROM je GROUP BY confidence", "je")
def crosstab(spark, d):
    p = a.judged_edges(spark, d).groupBy("confidence").pivot("judgment", ["No", "Unknown", "Yes"]).agg(N()).na.fill(0)
    return p.withColumnsRenamed({"No": "no", "Unknown": "unknown", "Yes": "yes"})


@query("STA-17", "SELECT count(*) AS n, round(avg(similarity), 6) AS mean, round(stddev_samp(similarity), 6) AS std, min(similarity) AS low, max(similarity) AS high, round(quantile_cont(similarity, 0.25), 6) AS q1, round(quantile_cont(similarity, 0.5), 6) AS med, round(quantile_cont(similarity, 0.75), 6) AS q3 FROM je", "je")
def described(spark, d):
    s = "similarity"
    # values have six digits, so there are few different ones: all is read from how often each occurs
    often = a.judged_edges(spark, d).groupBy(s).agg(N().alias("n"))
    n, total, squares = F.sum("n"), F.sum(F.col(s) * F.col("n")), F.sum(F.col(s) * F.col(s) * F.col("n"))
    std = F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), squares - total * total / n) / (n - 1)))
    q = lambda x, name: F.round(F.percentile(s, F.lit(x), F.col("n")), 6).alias(name)
    return often.agg(F.coalesce(n, F.lit(0)).alias("n"), F.round(total / n, 6).alias("mean"), F.round(std, 6).alias("std"), F.min(s).alias("low"), F.max(s).alias("high"), q(0.25, "q1"), q(0.5, "med"), q(0.75, "q3"))


# --- vectors


@query("MTH-01", "SELECT pid, round(list_sum(list_transform(vec, lambda x: (x / CASE WHEN n = 0 THEN 1 ELSE n END) * (x / CASE WHEN n = 0 THEN 1 ELSE n END))), 6) AS length2, round(vec[1] / CASE WHEN n = 0 THEN 1 ELSE n END, 6) AS first FROM (SELECT *, sqrt(list_inner_product(vec, vec)) AS n FROM vec)", "vec")
def unit_vectors(spark, d):
    u = v.normalised(a.vectors(spark, d))
    return u.select("pid", F.round(val.dot(F.col("vec"), F.col("vec")), 6).alias("length2"), F.round(F.col("vec")[0], 6).alias("first"))


@query("MTH-02", "SELECT x.pid AS source, y.pid AS target, x.type AS type, round(list_inner_product(x.vec, y.vec), 6) AS similarity FROM vec x JOIN vec y ON y.pid = x.pid + 1 AND x.type = y.type", "vec")
def cosines(spark, d):
    vs = a.typed_vectors(spark, d)
    return v.pair_similarity(vs.select(F.col("pid").alias("source"), (F.col("pid") + 1).alias("target")), vs)


@query("JN-08", "SELECT x.pid AS source, y.pid AS target, x.type AS type FROM vec x JOIN vec y ON y.pid = x.pid + 7 AND x.type = y.type", "vec")
def both_vectors(spark, d):
    vs = a.typed_vectors(spark, d)
    return v.pair_similarity(vs.select(F.col("pid").alias("source"), (F.col("pid") + 7).alias("target")), vs).select("source", "target", "type")


@query("JN-09", "SELECT a, b, sim FROM g", "g")
def similarity_edges(spark, d):
    return a.graph(spark, d)


@query("WIN-01", "SELECT source, target, rank, n_candidates, similarity FROM rank1", "rank1")
def target_ranks(spark, d):
    e = a.graph(spark, d)
    return v.ranks(e.select(F.col("a").alias("source"), F.col("b").alias("target")), a.vectors(spark, d), "block").select("source", "target", "rank", "n_candidates", "similarity")


@query("UDF-04", "SELECT source, target, rank, n_candidates, similarity FROM rank1", "rank1")
def ranks_in_sql(spark, d):
    e = a.graph(spark, d)
    return v.ranks(e.select(F.col("a").alias("source"), F.col("b").alias("target")), a.vectors(spark, d), "sql").select("source", "target", "rank", "n_candidates", "similarity")


NEAR = "SELECT x.pid AS source, y.pid AS target, round(list_inner_product(x.vec, y.vec), 6) AS similarity FROM vec x JOIN vec y ON x.pid <> y.pid AND x.type = y.type"


@query("WIN-02", f"WITH o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY similarity DESC, target)::int AS k FROM ({NEAR})) SELECT q.source AS source, q.target AS target, coalesce(k, -1) AS rank, coalesce(similarity, 0.0) AS similarity FROM (SELECT pid AS source, pid + 10 AS target FROM vec) q LEFT JOIN o ON o.source = q.source AND o.target = q.target", "vec")
def positional(spark, d):
    vs = a.typed_vectors(spark, d)
    return v.positional_ranks(vs.select(F.col("pid").alias("source"), (F.col("pid") + 10).alias("target")), vs)


@query("WIN-03", "SELECT type, pid, count(*) OVER (PARTITION BY type) - 1 AS n_candidates FROM vec", "vec")
def candidates(spark, d):
    vs = a.typed_vectors(spark, d)
    sizes = vs.groupBy("type").agg((N() - 1).alias("n_candidates"))
    return vs.join(sizes, "type").select("type", "pid", "n_candidates")


@query("TOP-01", f"SELECT source, k AS rank, target, similarity FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY similarity DESC, target)::int AS k FROM ({NEAR})) WHERE k <= 10", "vec")
def top_neighbours(spark, d):
    vs = a.typed_vectors(spark, d)
    return v.top_neighbours(vs, vs)


@query("AGG-28", "SELECT type, pid, grp FROM vec", "vec")
def first_vectors(spark, d):
    vs = a.typed_vectors(spark, d)
    twice = vs.withColumn("pos", F.lit(1)).unionAll(vs.withColumn("grp", F.lit(-1)).withColumn("pos", F.lit(2)))
    return v.first_vectors(twice, ["pos"]).select("type", "pid", "grp")


@query("JN-17", "SELECT pid, CASE WHEN pid % 3 = 0 THEN 'copied' ELSE 'generated' END AS origin FROM vec", "vec")
def existing_or_new(spark, d):
    vs = a.vectors(spark, d)
    have = vs.filter("pid % 3 = 0").select("type", "pid", F.lit(1).alias("have"))
    return vs.join(have, ["type", "pid"], "left").select("pid", F.when(F.col("have").isNull(), "generated").otherwise("copied").alias("origin"))


@query("JN-22", "SELECT type, count(*) AS n FROM vec WHERE pid % 3 <> 0 GROUP BY type", "vec")
def still_to_generate(spark, d):
    vs = a.typed_vectors(spark, d)
    return vs.join(vs.filter("pid % 3 = 0").select("type", "pid"), ["type", "pid"], "left_anti").groupBy("type").agg(N().alias("n"))


JAC = "m AS (SELECT pid, n, list_distinct([CASE WHEN size BETWEEN 10 AND 34 THEN 'D' || size ELSE 'D' || left(size::varchar, 1) END, 'D' || (n % 34 + 1)]) AS cs FROM pat)"


def classed_patents(spark, d):
    return a.patents(spark, d).select("pid", t.all_classes(F.col("classes_text")).alias("classes"))


@query("ARR-08", f"WITH {JAC} SELECT x.pid AS a, y.pid AS b, len(list_intersect(x.cs, y.cs))::bigint AS shared, round(len(list_intersect(x.cs, y.cs)) / len(list_distinct(list_concat(x.cs, y.cs))), 6) AS jaccard FROM m x JOIN m y ON x.pid < y.pid WHERE len(list_intersect(x.cs, y.cs)) > 0", "pat")
def jaccard(spark, d):
    return v.class_jaccard(classed_patents(spark, d))


@query("JN-19", f"WITH {JAC} SELECT source, target, coalesce(round(len(list_intersect(x.cs, y.cs)) / len(list_distinct(list_concat(x.cs, y.cs))), 6), 0.0) AS jaccard FROM (SELECT DISTINCT source, target FROM edge) JOIN m x ON x.pid = source JOIN m y ON y.pid = target", "edge pat")
def pair_jaccard(spark, d):
    return v.pair_jaccard(a.edges(spark, d).select("source", "target").distinct(), classed_patents(spark, d))


# --- windows


@query("WIN-07", "SELECT year, n, sum(n) OVER (ORDER BY year)::bigint AS total FROM (SELECT left(oa_date, 4)::int AS year, count(*) AS n FROM cit GROUP BY year)", "cit")
def cumulative(spark, d):
    n = a.citations(spark, d).groupBy(val.year_of(F.col("oa_date")).alias("year")).agg(N().alias("n"))
    return n.withColumn("total", F.sum("n").over(Window.orderBy("year").rowsBetween(Window.unboundedPreceding, 0)))
