"""Document fingerprints by consistent weighted sampling, in DataFrame functions alone.

A text is the weighted set of its five-word shingles, the weight being how often one occurs. For each of SAMPLES
positions and each term of weight w, improved consistent weighted sampling draws r and c from Gamma(2, 1) and b uniform,
takes t = floor(ln w / r + b) and a = c / exp(r (t - b + 1)), and the term with the least a, together with its t, is the
position's sample. Two texts share a sample with a probability equal to the generalised Jaccard similarity of their
weighted sets: the sum of the lesser weights over the sum of the greater ones.

The draws come from hashes of term and position in a form that makes the common case cheap. A Gamma(2, 1) variable times
an independent uniform one, and times one less it, are two independent exponentials. So with three exponentials e1, e2,
e3 out of three hashes, c = e1 + e2, r = e3 - ln(e1 / c) and b = e3 / r have the wanted laws, and a = e1 exp(-r t). For
weight 1, t is 0 and a is e1, minus the logarithm of the first hash: such terms compare by that hash itself, without any
logarithm. For other weights exp(-a) is put on the scale of the hash. The greatest value wins, and as it tells term and t,
it is the sample; a fingerprint keeps 32 bits of each.

Everything of one text is done within one row and its aggregate: shingles are hashed, sorted and counted by runs, and a
partial aggregate in the same task reduces the terms to SAMPLES numbers, so no term is ever shuffled.

Defined results: null texts are empty; texts without words share a fingerprint of their own. Texts under five words are
one term. Likeness is the share of equal samples, 1 for equal texts. Other columns are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import checkpointed, lower_ascii, no_null

WORDS = 5
SAMPLES = 64
_BLANK = " \t\n\x0b\x0c\r"
#: The largest double below 2^63.
_TOP = 9223372036854774784.0


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """A hash of each shingle of the text, repeats included; one of the whole sequence if it has fewer words."""
    parts = F.split(F.trim(lower_ascii(no_null(text)), F.lit(_BLANK)), r"[\x20\x09-\x0D]+")

    def shingles(h: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(h) - words), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(words)]))
        return F.when(F.size(h) >= words, each).otherwise(F.array(F.xxhash64(h, F.size(h))))

    return _let(parts, lambda p: F.when(F.get(p, F.lit(0)) == "", F.array().cast("array<bigint>")).otherwise(_let(F.transform(p, lambda w: F.xxhash64(w)), shingles)))


def weighted_terms(texts: DataFrame, keys: list[str], text_col: str = "text", words: int = WORDS) -> DataFrame:
    """keys, term, weight: the distinct shingles of each row and how often they occur; a row without words has one null term."""
    ordered = texts.select(*keys, F.sort_array(shingle_hashes(F.col(text_col), words)).alias("__s"))
    last = lambda s: F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: ~F.get(s, i).eqNullSafe(F.get(s, i - 1)))
    runs = ordered.select(*keys, "__s", F.when(F.size("__s") > 0, _let(F.col("__s"), last)).alias("__e"))
    placed = runs.select(*keys, "__s", "__e", F.explode_outer(F.when(F.size("__e") > 0, F.sequence(F.lit(0), F.size("__e") - 1))).alias("__j"))
    end = F.get("__e", F.col("__j"))
    return placed.select(*keys, F.get("__s", end - 1).alias("term"), (end - F.coalesce(F.get("__e", F.col("__j") - 1), F.lit(0))).cast("double").alias("weight"))


def _exponential(*of) -> Column:
    """Minus the logarithm of the hash's place between the least and the greatest long; it falls as the hash rises."""
    return -F.log((F.shiftright(F.xxhash64(*of), 12).cast("double") + (2.0**51 + 0.5)) * 2.0**-52)


def weighted_sample(term: Column, weight: Column, position: Column) -> Column:
    """The term's value at this position, as a long; the greatest of a set is its sample."""
    e1, e2, e3 = (_exponential(term, position, *map(F.lit, tag)) for tag in ((), (1,), (2,)))
    r = e3 + F.log1p(e2 / e1)
    t = F.floor((F.log(weight) + e3) / r)
    scaled = (F.exp(-e1 * F.exp(-r * t)) - 0.5) * 2.0**64
    return F.when(t == 0, F.xxhash64(term, position)).otherwise(F.least(scaled, F.lit(_TOP)).cast("long"))


def fingerprints(weighted: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """keys, fingerprint array<int>, of rows (keys, term long, weight double > 0); null terms do not count."""
    # a term of weight 1 takes part in all positions as one row, another as one row for each position
    places = F.when(F.col("weight") == 1, F.array(F.lit(-1))).when(F.col("weight") > 0, F.sequence(F.lit(0), F.lit(samples - 1)))
    dealt = weighted.select(*keys, "term", "weight", F.explode_outer(places).alias("__k"))
    valued = dealt.select(*keys, "term", "__k", F.when(F.col("__k") >= 0, weighted_sample(F.col("term"), F.col("weight"), F.col("__k"))).alias("__v"))
    best = valued.groupBy(*keys).agg(*[F.max(F.when(F.col("__k") == -1, F.xxhash64("term", F.lit(i))).when(F.col("__k") == i, F.col("__v"))).alias(f"__b{i}") for i in range(samples)])
    short = [F.shiftright(F.xxhash64(F.col(f"__b{i}")), 32).cast("int") for i in range(samples)]
    return best.select(*keys, F.array(*short).alias("fingerprint"))


def fingerprint_texts(texts: DataFrame, keys: list[str], text_col: str = "text", words: int = WORDS, samples: int = SAMPLES) -> DataFrame:
    """keys, fingerprint; one row for each distinct combination of keys, which must name the rows."""
    return fingerprints(weighted_terms(texts, keys, text_col, words), keys, samples)


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples: an estimate of the generalised Jaccard similarity."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.size(a)


def as_hex(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def _in_order(rows: DataFrame) -> DataFrame:
    """The columns of rows (doc_id, key, ...) with next_key and last_key, those of the next and the last row by doc_id and key, in a ring.

    Rows are sorted by ranges; only the first and last row of each range go through a window over the ranges."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = checkpointed(rows.repartitionByRange(n, "doc_id", "key").withColumn("__piece", F.spark_partition_id()))
    ends = pieces.groupBy("__piece").agg(F.min(F.struct("doc_id", "key"))["key"].alias("first"), F.max(F.struct("doc_id", "key"))["key"].alias("last"))
    ring = Window.orderBy("__piece")
    whole = Window.partitionBy(F.lit(1))
    around = ends.select(
        F.col("__piece").alias("__p"),
        F.coalesce(F.lead("first").over(ring), F.min_by("first", "__piece").over(whole)).alias("__after"),
        F.coalesce(F.lag("last").over(ring), F.max_by("last", "__piece").over(whole)).alias("__before"),
    )
    by_id = Window.partitionBy("__piece").orderBy("doc_id", "key")
    placed = pieces.withColumns({"next_key": F.lead("key").over(by_id), "last_key": F.lag("key").over(by_id)})
    placed = placed.join(F.broadcast(around), F.col("__piece") == F.col("__p"))
    return placed.select(*rows.columns, F.coalesce("next_key", "__after").alias("next_key"), F.coalesce("last_key", "__before").alias("last_key"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 4, words: int = WORDS, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; one row per row of docs.

    The edited text has its last n_chars / share characters replaced by as many of the first of the next document, by id.
    Rows that repeat an id follow one another by the hash of their text; null ids come first. Rows equal in id and text
    follow one another, so the next text of all but the last of them is their own.
    """
    text = no_null(F.col(text_col))
    named = F.concat(F.when(F.col(id_col).isNull(), "null").otherwise(F.concat(F.lit("="), F.col(id_col).cast("string"))), F.lit(":"), text)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.md5(named).alias("key"), text.alias("text"))
    counted = rows.select("doc_id", "key", F.length("text").alias("n")).groupBy("doc_id", "key").agg(F.max("n").cast("long").alias("n"), F.count(F.lit(1)).alias("copies"))
    order = checkpointed(_in_order(counted)).withColumn("cut", F.floor(F.col("n") / share).cast("int"))

    # every text travels once, to its key; the beginnings that others need travel from there
    texts = rows.groupBy("key").agg(F.first("text").alias("text"))
    wanted = order.select(F.col("next_key").alias("key"), F.col("key").alias("to"), F.col("cut").alias("take"))
    heads = texts.join(wanted, "key").select(F.col("to").alias("key"), F.substring("text", F.lit(1), F.col("take")).alias("head"))
    body = F.substring("text", F.lit(1), F.col("n").cast("int") - F.col("cut"))
    made = texts.join(order, "key").join(heads, "key").select(
        "doc_id", "key", "last_key", "n", "copies",
        F.explode(F.array_compact(F.array(
            F.struct(F.lit(0).alias("kind"), F.col("text").alias("text")),
            F.struct(F.lit(1).alias("kind"), F.concat(body, "head").alias("text")),
            F.when(F.col("copies") > 1, F.struct(F.lit(2).alias("kind"), F.concat(body, F.substring("text", F.lit(1), F.col("cut"))).alias("text"))),
        ))).alias("x"),
    )
    about = ["key", "kind", "doc_id", "last_key", "n", "copies", "sha256"]
    named_texts = made.select("doc_id", "key", "last_key", "n", "copies", F.col("x.kind").alias("kind"), F.sha2("x.text", 256).alias("sha256"), F.col("x.text").alias("text"))
    marked = fingerprint_texts(named_texts, about, "text", words, samples)

    # a text's fingerprint goes to its own document and to the one before it
    to = F.when(F.col("kind") == 0, F.array(F.struct(F.col("key").alias("to"), F.lit(0).alias("role")), F.struct(F.col("last_key").alias("to"), F.lit(3).alias("role"))))
    sent = marked.withColumn("x", F.explode(F.coalesce(to, F.array(F.struct(F.col("key").alias("to"), F.col("kind").alias("role"))))))
    sent = sent.select("x.to", "x.role", "doc_id", "n", "copies", "sha256", "fingerprint")
    role = lambda k, c: F.max(F.when(F.col("role") == k, F.col(c)))
    found = sent.groupBy("to").agg(*[role(0, c).alias(c) for c in ("doc_id", "n", "copies", "fingerprint")], *[role(k, c).alias(f"{c}{k}") for k in (1, 2) for c in ("sha256", "fingerprint")], role(3, "fingerprint").alias("fingerprint3"))
    last = F.struct(F.col("sha2561").alias("sha256"), F.col("fingerprint1").alias("edited"), F.col("fingerprint3").alias("next"))
    other = F.struct(F.col("sha2562").alias("sha256"), F.col("fingerprint2").alias("edited"), F.col("fingerprint").alias("next"))
    each = F.when(F.col("copies") > 1, F.concat(F.array(last), F.array_repeat(other, F.col("copies").cast("int") - 1))).otherwise(F.array(last))
    out = found.select("doc_id", F.col("n").alias("n_chars"), "fingerprint", F.explode(each).alias("x"))
    return out.select(
        "doc_id", "n_chars", F.col("x.sha256").alias("edited_sha256"), as_hex(F.col("fingerprint")).alias("fingerprint"), as_hex(F.col("x.edited")).alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("x.edited")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("x.next")).alias("near_next"),
    )
