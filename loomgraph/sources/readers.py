"""Readers: every scan with an explicit schema, and where first or last counts, with the order of its rows.

Spark promises no order of rows, so readers of files whose order matters add `file_ord` (the file's place by name) and
`line_no`. Text that does not fit is kept apart, dropped or refused, as each reader says; nothing is inferred.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT = "patentApplicationNumber string, officeActionDate string, officeActionCategory string, citationCategoryCode string, examinerCitedReferenceIndicator string, applicantCitedExaminerReferenceIndicator string, workGroup string, groupArtUnitNumber string, techCenter string"
ATTRIBUTES = "title string, id string, claim string, date string, class string, class_search string, inv_country string, no_figs string, sheets string, file_names string, fig_desc string, caption string"
CITATIONS = f"map<string, struct<original_id: string, citations_found: int, records: array<struct<citedDocumentIdentifier: string, {', '.join(': '.join(x.split()) for x in EVENT.split(', '))}>>>>"
RANKS = "source string, target string, type string, rank int, n_candidates int, similarity double, source_image string, target_image string"


def csv_rows(spark: SparkSession, path: str, schema: str, sep: str = ",", mode: str = "PERMISSIVE") -> DataFrame:
    """All files with a header; embedded line feeds and doubled quotes are read."""
    return spark.read.schema(schema).csv(path, header=True, sep=sep, multiLine=True, escape='"', mode=mode, enforceSchema=False)


def csv_columns(spark: SparkSession, path: str, schema: str, columns: list[str]) -> DataFrame:
    return csv_rows(spark, path, schema).select(*columns)


def csv_tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines with another number of fields are dropped."""
    return csv_rows(spark, path, schema, mode="DROPMALFORMED")


def tsv_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return csv_rows(spark, path, schema, sep="\t")


def keyed_json(spark: SparkSession, path: str, schema: str = CITATIONS) -> DataFrame:
    """One object per file, with keys that no schema knows: file, pos, key, value."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", schema).alias("m"))
    return whole.select("file", F.posexplode("m").alias("pos", "key", "value"))


def keyed_variants(spark: SparkSession, path: str) -> DataFrame:
    """One object per file, with keys and values that no schema knows: file, pos, key, value (a variant). Files that are no JSON object have no rows."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.try_parse_json("value").alias("v"))
    return whole.filter("v is not null").lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("file", "pos", "key", "value")


def json_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The first line that is no JSON fails the query."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def json_tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Blank and broken lines are dropped; `broken_lines` counts them."""
    kept = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    read = spark.read.schema(T.StructType([*kept.fields, T.StructField("_corrupt", T.StringType())])).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")
    return read.filter("_corrupt is null").drop("_corrupt")


def broken_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no and line of what is no JSON object."""
    lines = text_lines(spark, path).filter(F.trim("line") != "")
    return lines.filter(F.try_parse_json("line").isNull()).select("file", "line_no", "line")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 1), line. A file is read whole: for sidecars and lists, not for large logs."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return whole.select("file", F.posexplode(F.split(F.regexp_replace("value", r"\n\z", ""), "\n")).alias("p", "line")).select("file", (F.col("p") + 1).alias("line_no"), "line")


def edges_without_loops(spark: SparkSession, path: str, schema: str, source: str = "source", target: str = "target") -> DataFrame:
    return json_strict(spark, path, schema).filter(F.col(source) != F.col(target))


def recursive_json(spark: SparkSession, roots: list[str], schema: str, pattern: str = "*.jsonl") -> DataFrame:
    """All matching files below any of the folders."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(roots)


def years(df: DataFrame, wanted: list[int] | None) -> DataFrame:
    """Partitions of these years; all without a list."""
    return df if wanted is None else df.filter(F.col("year").isin([int(y) for y in wanted]))


def missing_years(df: DataFrame, wanted: list[int]) -> DataFrame:
    spark = df.sparkSession
    return spark.createDataFrame([(int(y),) for y in wanted], "year int").exceptAll(df.select(F.col("year").cast("int").alias("year")).distinct())


def digit_files(spark: SparkSession, folder: str, suffix: str, schema: str) -> DataFrame:
    """Files whose name begins with a digit."""
    reader = spark.read.schema(schema).option("pathGlobFilter", f"[0-9]*.{suffix}")
    return reader.json(folder) if suffix == "jsonl" else reader.csv(folder, header=True)


def arc_list(spark: SparkSession, path: str) -> DataFrame:
    """u, v from lines of two integers; other lines are skipped."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter(F.size(parts) == 2).select(F.get(parts, F.lit(0)).try_cast("int").alias("u"), F.get(parts, F.lit(1)).try_cast("int").alias("v")).filter("u is not null and v is not null")


def npy_vectors(spark: SparkSession, path: str) -> DataFrame:
    """file, pos, vec of the rows of binary .npy matrices, read by Spark and decoded in Arrow batches."""
    import io

    import numpy as np
    import pyarrow as pa

    def decode(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                m = np.load(io.BytesIO(content), allow_pickle=False)
                m = m.reshape(len(m), -1).astype(np.float32)
                for at in range(0, len(m), 4096):
                    part = m[at : at + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(range(at, at + len(part)), pa.int64()), pa.array(part.tolist(), pa.list_(pa.float32()))], ["file", "pos", "vec"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(decode, "file string, pos long, vec array<float>")


def with_sidecar(vectors: DataFrame, lines: DataFrame) -> DataFrame:
    """Vectors with the path on the same row of a text sidecar, or an empty path."""
    return vectors.join(lines.select(F.col("file_ord"), (F.col("line_no") - 1).alias("pos"), F.col("line").alias("path")), ["file_ord", "pos"], "left").na.fill({"path": ""})


def images(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = ("tif", "tiff", "png", "jpg", "jpeg")) -> DataFrame:
    pattern = "*.{" + ",".join([*suffixes, *map(str.upper, suffixes)]) + "}"
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)


def latest(files: DataFrame, patterns: tuple[str, ...] = ("*theta*.csv", "*coef*.csv")) -> DataFrame:
    """path: the last by name of the files (path) that match any pattern."""
    name = F.substring_index("path", "/", -1)
    match = F.lit(False)
    for p in patterns:
        match |= name.rlike("^" + p.replace(".", r"\.").replace("*", ".*") + "$")
    return files.filter(match).agg(F.max("path").alias("path"))


def latest_file(spark: SparkSession, folder: str, patterns: tuple[str, ...] = ("*theta*.csv", "*coef*.csv")) -> DataFrame:
    """path: the last by name of the files in the folder that match any pattern."""
    return latest(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path"), patterns)


def optional_csv(spark: SparkSession, path: str | None, schema: str) -> DataFrame | None:
    """None where there is no file."""
    if not path:
        return None
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return csv_rows(spark, path, schema) if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at) else None


def file_order(df: DataFrame, column: str = "file") -> DataFrame:
    """file_ord: the place of a row's file among all, by name. Names are numbered by range partitions, and joined as their size asks for."""
    from loomgraph.operators.graph import dense

    return df.join(dense(df.select(column).distinct(), column).select(column, (F.col("id") + 1).cast("int").alias("file_ord")), column)


def stale(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """name, state: `missing` or `stale` outputs, from (name, modified) of both sides."""
    both = inputs.select("name", F.col("modified").alias("made")).join(outputs.select("name", F.col("modified").alias("done")), "name", "left")
    return both.select("name", F.when(F.col("done").isNull(), "missing").when(F.col("made") > F.col("done"), "stale").otherwise("fresh").alias("state"))


def commands(states: DataFrame) -> DataFrame:
    """states with command: what to do about each."""
    return states.withColumn("command", F.when(F.col("state") == "missing", "run").when(F.col("state") == "stale", "run again").otherwise("nothing"))


def files(spark: SparkSession, folder: str, parent: bool = False) -> DataFrame:
    """name (with parent, that of the folder that holds the file), modified, bytes."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return found.select(F.element_at(F.split("path", "/"), -2 if parent else -1).alias("name"), F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))
