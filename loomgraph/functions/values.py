"""Dates, JSON, vectors, geometric scores and other arithmetic, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

# --- dates


def year_of(col: Column) -> Column:
    """The first four characters, if they are digits."""
    head = F.substring(col.cast("string"), 1, 4)
    return F.when(head.rlike(r"^\d{4}$"), head.try_cast("int"))


def parsed_date(col: Column, pattern: str = "yyyyMMdd") -> Column:
    return F.try_to_date(col, pattern)


def effective_age(year: Column, observed: int = 2022, since: int = 2007) -> Column:
    return F.greatest(F.lit(1), F.lit(observed) - F.greatest(year, F.lit(since)) + 1)


def citation_rate(count: Column, year: Column, observed: int = 2022, since: int = 2007) -> Column:
    return count / effective_age(year, observed, since)


def newer(later: Column, earlier: Column) -> Column:
    """1 if the first date lies after the second, else 0."""
    return F.when(F.datediff(later, earlier) > 0, 1).otherwise(0)


def years_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier) / F.lit(365.25)


def clipped_bin(col: Column, low: float, high: float, bins: int) -> Column:
    """0-based bin of a value clipped to [low, high]."""
    clipped = F.greatest(F.lit(low), F.least(F.lit(high), col))
    return F.least(F.lit(bins - 1), F.floor((clipped - low) / ((high - low) / bins)).cast("int"))


# --- JSON


def outer_json(col: Column) -> Column:
    """From the first opening to the last closing brace; NULL without both."""
    found = F.regexp_extract(col, r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


def cleaned_json(col: Column) -> Column:
    """Without lines of digits alone and without commas before a closing bracket."""
    return F.regexp_replace(F.regexp_replace(col, r"(?m)^\s*\d+\s*$", ""), r",\s*([}\]])", "$1")


def tolerant_json(col: Column, schema: str, key: str) -> Column:
    """Parsed as it stands, or else cleaned; NULL where `key` is missing from both."""
    body = outer_json(col)
    first, second = F.from_json(body, schema), F.from_json(cleaned_json(body), schema)
    return F.when(first[key].isNotNull(), first).when(second[key].isNotNull(), second)


def unfenced(col: Column) -> Column:
    """Without a code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(col), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))


# --- vectors


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """Divided by its length; a zero vector stays."""
    length = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.when(length == 0, 1.0).otherwise(length))


# --- geometry of triads


def _clip(s: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s))


def angle(s: Column) -> Column:
    return F.acos(_clip(s))


def _spread(ab: Column, bc: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), 1 - ab * ab)) * F.sqrt(F.greatest(F.lit(0.0), 1 - bc * bc))


def lower_bound(ab: Column, bc: Column) -> Column:
    return ab * bc - _spread(ab, bc)


def upper_bound(ab: Column, bc: Column) -> Column:
    return ab * bc + _spread(ab, bc)


def weakest_link(ab: Column, bc: Column, ac: Column) -> Column:
    return F.least(ab, bc, ac)


def tightness(ab: Column, bc: Column, ac: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.greatest(angle(ab), angle(bc), angle(ac)) / (math.pi / 2))


def compliance(ab: Column, bc: Column, ac: Column) -> Column:
    """Where ac lies between the bounds that ab and bc set; not symmetric."""
    low, high = lower_bound(ab, bc), upper_bound(ab, bc)
    return F.when(high - low < 1e-9, F.when(ac > 0.99, 1.0).otherwise(0.0)).otherwise((ac - low) / (high - low))


def confidence(s1: Column, s2: Column, s3: Column, s4: Column) -> Column:
    return 0.30 * s1 + 0.20 * s2 + 0.25 * s3 + 0.15 * s4


def tier(s1: Column, s3: Column, conf: Column) -> Column:
    return F.when((s1 >= 0.95) & (s3 >= 0.90) & (conf >= 0.85), "A").when((s1 >= 0.90) & (s3 >= 0.70) & (conf >= 0.75), "B").when((s1 >= 0.85) & (conf >= 0.65), "C").otherwise("D")


# --- match scores


def match_score(mean: Column, std: Column, flag: Column) -> tuple[Column, Column, Column]:
    """score, confidence, flags (sorted as tested); std NULL means that no paraphrase was scored."""
    spread = F.coalesce(std, F.lit(0.0))
    by_spread = F.least(F.lit(1.0), spread * 2)
    by_flag = F.when(flag == "internally_contradictory", 0.4).when(flag == "ambiguous", 0.2).otherwise(0.0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean * (1 - by_spread) * (1 - by_flag)))
    flags = F.array_compact(F.array(F.when(std.isNull(), "M3_unavailable"), F.when(spread > 0.20, "M3_high_variance"), F.when(flag == "internally_contradictory", "M1_internally_contradictory"), F.when(flag == "ambiguous", "M1_ambiguous")))
    return score, F.greatest(F.lit(0.0), 1 - by_spread - by_flag), flags


def swap_consistent(label_a: Column, label_b: Column, p_a: Column, p_b: Column) -> tuple[Column, Column]:
    """Whether both orders agree, and their mean if they do."""
    same = (label_a == label_b) & (F.abs(p_a - p_b) < 0.15)
    return same, F.when(same, (p_a + p_b) / 2)


def ensemble_median(values: Column) -> Column:
    """The median of the known values, if there are two or more."""
    known = F.array_sort(F.array_compact(values))
    n = F.size(known)
    mid = (F.get(known, ((n - 1) / 2).cast("int")) + F.get(known, (n / 2).cast("int"))) / 2
    return F.when(n >= 2, mid)


def kind_of(variant: Column) -> Column:
    """null, boolean, number, string, array or object; NULL where there is no value at all."""
    schema = F.schema_of_variant(variant)
    named = F.when(schema == "VOID", "null").when(schema == "BOOLEAN", "boolean").when(schema == "STRING", "string").when(schema.startswith("ARRAY"), "array").when(schema.startswith("OBJECT"), "object")
    return F.when(variant.isNotNull(), F.coalesce(named, F.lit("number")))


def path_errors(variant: Column, rules: dict) -> Column:
    """The paths at which a variant breaks the rules {path: (kind, condition or None)}, in their order.

    A path must hold a value of this kind, of which the condition must be true; it takes text, or a double for numbers.
    A null variant breaks them all.
    """
    found = []
    for path, (kind, condition) in rules.items():
        good = kind_of(F.try_variant_get(variant, path, "variant")) == kind
        if condition is not None:
            good &= condition(F.try_variant_get(variant, path, "double" if kind == "number" else "string"))
        found.append(F.when(~F.coalesce(good, F.lit(False)), path))
    return F.array_compact(F.array(*found))


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def backoff(attempt: int, kind: str, base: float = 60.0) -> float:
    """Seconds to wait before the next try."""
    return {"rate": base * (attempt + 1) * 10, "busy": 300.0 * (attempt + 1), "parse": 2.0**attempt, "quota": 30.0 * 2**attempt}[kind]


def backoffs(attempt: Column, base: float = 60.0) -> dict[str, Column]:
    """The same for a column of attempts, by kind."""
    return {"rate": F.lit(base) * (attempt + 1) * 10, "busy": F.lit(300.0) * (attempt + 1), "parse": F.pow(F.lit(2.0), attempt), "quota": 30.0 * F.pow(F.lit(2.0), attempt)}
