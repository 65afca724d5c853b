"""The corpus pipeline: stages over `documents`, each written as Parquet and read again as the next one's input.

toxicity and language drop the documents that their models reject; line_dedup takes repeated lines out of the texts
(n_chars follows); near_dedup keeps the document with the smallest id of every SimHash component; packing cuts what is
left into sequences. Every stage works on all rows that its predecessor kept. The models are fitted on the stage's own
input and on `labels`.

Defined results: a null or empty text is scored by the prior alone, then rejected as of no language; it is one empty
line, has fingerprint zero, and packs to the end mark. Null ids, sources, languages and labels reject nothing. Rows that
repeat an id are judged one by one, and of the equal or near ones a single row stays, null ids included. Columns of any
other name pass through all stages but the last, which does not read them. Empty tables give empty results.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import language, line_dedup, packing, simhash, toxicity
from loomgraph.llm.common import shared_folder, table
from loomgraph.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_unknown_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_languages(docs, language.fit(docs, tokenizer_path()))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # columns of any name are carried along
    names = dict(zip(docs.columns, plain.columns))
    others = tuple(names[c] for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    cleaned = line_dedup.line_dedup(plain, names["doc_id"], names["text"], carry=others)
    cleaned = cleaned.withColumn(names["n_chars"], F.length(names["text"]).cast("long"))
    return cleaned.select(*plain.columns).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("language", drop_unknown_languages), ("line_dedup", drop_repeated_lines), ("near_dedup", drop_near_duplicates), ("packing", pack)]
#: The stages fit models, so SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; the stages before are written to a folder of this run in spark.checkpoint.dir."""
    folder = os.path.join(shared_folder(spark), f"corpus-pipeline-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
