"""Sinks. Each writes what it is given; overwriting is idempotent, appending is not and says so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def csv(df: DataFrame, path: str, columns: list[str] | None = None, sep: str = ",") -> None:
    """Overwrite with these columns in this order; others are left out."""
    (df.select(*columns) if columns else df).write.mode("overwrite").csv(path, header=True, sep=sep, emptyValue="", escape='"')


def six_decimals(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.format_string("%.6f", F.col(c).cast("double")) for c in columns})


def json_by_year(df: DataFrame, path: str, append: bool = False) -> None:
    """One folder per year. Overwriting replaces only the years in df; appending a second time writes rows twice."""
    writer = df.write.partitionBy("year")
    writer = writer.mode("append") if append else writer.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.json(path)


def by_bucket(df: DataFrame, path: str, bucket: str = "bucket") -> None:
    df.write.mode("append").partitionBy(bucket, "year").json(path)


def in_batches(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write each micro-batch under its own number, so that a batch that runs again replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/batch={number}", compression="gzip")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def json_text(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))


def arc_lines(edges: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """Both directions of each edge, as lines."""
    return edges.select(F.concat_ws(" ", a, b).alias("value")).unionAll(edges.select(F.concat_ws(" ", b, a).alias("value")))


def arc_list(edges: DataFrame, path: str) -> None:
    arc_lines(edges).write.mode("overwrite").text(path)


def model_config(classes: list[str], arcs: str, attributes: str) -> str:
    """A network model's settings, the class effects in two halves."""
    half = len(classes) // 2
    groups = [classes[:half], classes[half:]]
    lines = [f"arclistFile = {arcs}", f"binattrFile = {attributes}"]
    for name, group in zip(("first", "second"), groups):
        lines.append(f"# {name} half: {len(group)} classes")
        lines += [f"attrParam = Matching(IsClass_{c})" for c in group]
    return "\n".join(lines) + "\n"


def latex_table(rows: list[tuple[str, float]]) -> str:
    escaped = [(str(k).replace("_", r"\_").replace("%", r"\%"), v) for k, v in rows]
    return "\n".join([r"\begin{tabular}{lr}", r"\hline", r"Statistic & Value \\", r"\hline", *[rf"{k} & {v:.6g} \\" for k, v in escaped], r"\hline", r"\end{tabular}"])


def markdown_table(columns: list[str], rows: list[tuple]) -> str:
    line = lambda xs: "| " + " | ".join("" if x is None else str(x) for x in xs) + " |"
    return "\n".join([line(columns), "|" + "|".join(["---"] * len(columns)) + "|", *map(line, rows)])


def copy_manifest(images: DataFrame, target: str) -> DataFrame:
    """src, dst of files to copy, with those that have no source counted apart by a null dst."""
    return images.select(F.col("path").alias("src"), F.when(F.col("path") != "", F.concat(F.lit(target + "/"), F.substring_index("path", "/", -1))).alias("dst"))


def sidecars(df: DataFrame, caption: str, description: str) -> DataFrame:
    """value: one JSON object with caption and description for each row."""
    return df.select(F.to_json(F.struct(F.col(caption).alias("caption"), F.col(description).alias("description")), {"ignoreNullFields": "false"}).alias("value"))
