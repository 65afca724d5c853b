"""Parsers of class codes, ids, view types and free text, all as column expressions.

Dirty input never raises: what a parser cannot read is NULL, `D??` or `Unknown`, as said for each. The five class
parsers differ on purpose; tests hold their behaviour side by side.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The design classes and their names.
CLASS_NAMES = {
    "D1": "Edible Products",
    "D2": "Apparel & Haberdashery",
    "D3": "Travel Goods & Personal Items",
    "D4": "Brushware",
    "D5": "Textile/Fabric Articles",
    "D6": "Furnishings",
    "D7": "Equipment for Preparing Food",
    "D8": "Tools & Hardware",
    "D9": "Tools & Hardware (misc)",
    "D10": "Measuring/Testing Devices",
    "D11": "Jewelry/Symbolic Insignia",
    "D12": "Transportation",
    "D13": "Equipment for Production/Distribution",
    "D14": "Recording/Communication/Info",
    "D15": "Machines",
    "D16": "Photography & Optics",
    "D17": "Musical Instruments",
    "D18": "Printing & Office Machinery",
    "D19": "Office Supplies/Equipment",
    "D20": "Sales/Advertising/Signs",
    "D21": "Amusement Devices",
    "D22": "Arms/Pyrotechnics/etc.",
    "D23": "Environmental Heating/Cooling",
    "D24": "Medical/Lab Equipment",
    "D25": "Building Units & Construction",
    "D26": "Lighting",
    "D27": "Tobacco & Smoking",
    "D28": "Pharmaceuticals & Cosmetics",
    "D29": "Animal Husbandry",
    "D30": "Outdoor/Garden",
    "D31": "Articles of Manufacture",
    "D32": "Washing/Cleaning Equipment",
    "D33": "Food/Beverage Service",
    "D34": "Material/Article Handling",
    "D99": "Miscellaneous",
}

# Phrases of verdict reasons, the highly similar ones tried before the exact ones.
HIGH_SIMILAR = [
    r"\bsubstantially\s+identical\b",
    r"\bmatching\s+proportions?\b",
    r"\bmatching\s+patterns?\b",
    r"\bsame\s+(?:overall\s+)?configuration\b",
    r"\bsame\s+arrangement\b",
    r"\bsame\s+silhouette\b",
    r"\bsame\s+overall\s+shape\b",
]
EXACT = [
    r"\bindistinguishable\b",
    r"\bno\s+discernible\s+differences?\b",
    r"\bidentical\b",
]
# Phrases that say two designs are one.
SAME_DESIGN = [
    r"\bindistinguishable\b",
    r"\bare\s+identical\b",
    r"\bappear(?:s)?\s+identical\b",
    r"\blook(?:s)?\s+identical\b",
    r"\bseem(?:s)?\s+identical\b",
    r"\bidentical\s+design(?:s)?\b",
    r"\bidentical\s+in\s+every\b",
    r"\bidentical\s+in\s+all\b",
    r"\bthe\s+identical\b",
    r"\bvirtually\s+identical\b",
    r"\bnearly\s+identical\b",
    r"\bpractically\s+identical\b",
    r"\bessentially\s+identical\b",
    r"\beffectively\s+identical\b",
    r"\bexact\s+(?:copy|replica|duplicate|match|same)\b",
    r"\bperfect\s+(?:copy|replica|duplicate|match)\b",
    r"\bsame\s+design\b",
    r"\bsame\s+\w+\s+design\b",
    r"\bsame\s+\w+\s+model\b",
    r"\bsame\s+product\b",
    r"\bappear(?:s)?\s+to\s+be\s+the\s+same\b",
    r"\bseem(?:s)?\s+to\s+be\s+the\s+same\b",
    r"\bdifferent\s+(?:views?|angles?|states?|perspectives?|orientations?)\s+of\s+the\s+same\b",
    r"\bvirtually\s+indistinguishable\b",
    r"\bnearly\s+indistinguishable\b",
    r"\bpractically\s+indistinguishable\b",
]
EXACT_WORDS = ["identical", "exact", "same"]


def text_of(col: Column) -> Column:
    """Missing text is empty text."""
    return F.coalesce(col.cast("string"), F.lit(""))


def _number(col: Column) -> Column:
    return F.expr("try_cast(null as int)") if col is None else col.try_cast("int")


def _group(col: Column, pattern: str) -> Column:
    """The first group, or NULL without a match."""
    found = F.regexp_extract(col, pattern, 1)
    return F.when(found != "", found)


def _spaced_or_prefix(part: Column) -> Column:
    spaced = _group(part, r"^D (\d)")
    digits = _group(part, r"^D(\d+)")
    two = F.when(F.length(digits) >= 2, F.substring(digits, 1, 2).try_cast("int"))
    one = F.substring(digits, 1, 1).try_cast("int")
    code = F.when(two.between(10, 34) | (two == 99), two).when(one.between(1, 9), one)
    return F.when(spaced.isNotNull(), F.concat(F.lit("D"), spaced)).when(code.isNotNull(), F.concat(F.lit("D"), code.cast("string")))


def main_class(col: Column) -> Column:
    """`D 6480` -> D6, `D14138` -> D14, otherwise NULL; of a list, its first part."""
    return _spaced_or_prefix(F.trim(F.get(F.split(text_of(col), ","), F.lit(0))))


def all_classes(col: Column) -> Column:
    """The distinct classes of all comma-separated parts, sorted."""
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(F.split(text_of(col), ","), lambda p: _spaced_or_prefix(F.trim(p))))))


def strict_class(col: Column) -> Column:
    """Dnn if the whole number is 1-34 or 99, otherwise `D??`."""
    n = _group(F.trim(text_of(col)), r"(?i)^D\s*0*(\d+)").try_cast("int")
    return F.when(n.between(1, 34) | (n == 99), F.concat(F.lit("D"), F.lpad(n.cast("string"), 2, "0"))).otherwise("D??")


def lenient_class(col: Column) -> Column:
    """The first two digits as a class, or else the first one, or else Unknown."""
    digits = _group(F.trim(text_of(col)), r"^D\s*(\d+)")
    two, one = F.substring(digits, 1, 2).try_cast("int"), F.substring(digits, 1, 1).try_cast("int")
    known = F.when((F.length(digits) >= 2) & (two.between(1, 34) | (two == 99)), two).when(one.between(1, 9), one)
    return F.when(known.isNotNull(), F.concat(F.lit("D"), known.cast("string"))).otherwise("Unknown")


def padded_class(col: Column) -> Column:
    """Any number, padded to two digits, or `D??`."""
    n = _group(F.trim(text_of(col)), r"(?i)^D\s*0*(\d+)").try_cast("bigint")
    return F.when(n.isNotNull(), F.concat(F.lit("D"), F.when(n < 10, F.lpad(n.cast("string"), 2, "0")).otherwise(n.cast("string")))).otherwise("D??")


def padded_ids(col: Column) -> Column:
    """The ids of a comma-separated list as D and seven digits, sorted and distinct."""
    part = lambda p: F.regexp_replace(F.upper(p), r"\s+", "")
    shaped = F.transform(F.split(text_of(col), ","), lambda p: F.when(part(p).rlike(r"^D\d+$"), F.concat(F.lit("D"), F.lpad(F.substring(part(p), 2, 100), 7, "0"))))
    return F.array_sort(F.array_distinct(F.array_compact(shaped)))


def id_key(col: Column) -> Column:
    """The number after the first D, plus 10,000,000,000; NULL without one."""
    return _group(text_of(col), r"D0*(\d+)").try_cast("bigint") + F.lit(10_000_000_000)


def id_number(col: Column) -> Column:
    """The number without leading D and zeros."""
    return F.regexp_replace(text_of(col), "^D+", "").try_cast("bigint")


def id_text(col: Column) -> Column:
    return F.format_string("D%07d", col.cast("bigint"))


def id_gap(a: Column, b: Column) -> Column:
    return F.abs(id_number(a) - id_number(b)).cast("int")


def unpadded_id(col: Column) -> Column:
    return F.regexp_replace(col, "^D0+", "D")


def view_type(descriptions: Column) -> Column:
    """perspective before front before overview, over all descriptions."""
    says = lambda pattern: F.exists(descriptions, lambda x: x.rlike(pattern))
    return F.when(says(r"(?i)\bperspective\b"), "perspective").when(says(r"(?i)\bfront\s+(view|elevation|elevational|plan)\b"), "front").otherwise("overview")


def image_path(root: str, name: Column) -> Column:
    """root/year/name, with the year from the second dash-separated part."""
    return F.concat_ws("/", F.lit(root), F.substring(F.get(F.split(name, "-"), F.lit(1)), 1, 4), name)


def year_of_path(paths: Column) -> Column:
    """The year folder of the first path of a map, or `unknown`."""
    return F.coalesce(_group(F.get(F.map_values(paths), F.lit(0)), r"/images/(\d{4})/"), F.lit("unknown"))


def literal_list(col: Column) -> Column:
    """The strings of a list written as a Python literal, NULL if it is none. Quoted commas are kept."""
    shape = r"""^\s*\[\s*((?:'[^']*'|"[^"]*")\s*(?:,\s*(?:'[^']*'|"[^"]*")\s*)*)?,?\s*\]\s*$"""
    items = F.transform(F.regexp_extract_all(col, F.lit(r"""('[^']*'|"[^"]*")"""), F.lit(1)), lambda x: F.substring(x, F.lit(2), F.length(x) - 2))
    return F.when(col.rlike(shape), items)


def matched(col: Column, patterns: list[str]) -> Column:
    """Those patterns, as text, that the column matches, ignoring case."""
    return F.array_compact(F.array(*[F.when(text_of(col).rlike("(?i)" + p), F.lit(p)) for p in patterns]))


def reason_bucket(col: Column, high: list[str] = HIGH_SIMILAR, exact: list[str] = EXACT) -> Column:
    return F.when(F.size(matched(col, high)) > 0, "high_similar").when(F.size(matched(col, exact)) > 0, "exact_match").otherwise("similar")


def word_pattern(words: list[str]) -> str:
    """One case-insensitive pattern for any of the words, whole, taken literally."""
    return r"(?i)\b(" + "|".join(re.sub(r"([^\w\s])", r"\\\1", w) for w in words) + r")\b"


def exactness(judgment: Column, reason: Column, words: list[str] | None = None) -> Column:
    """Yes is split by its reason; other verdicts stay."""
    return F.when(judgment == "Yes", F.when(text_of(reason).rlike(word_pattern(words or EXACT_WORDS)), "Yes_exact").otherwise("Yes_nonexact")).otherwise(judgment)


def has_spaced_word(col: Column, words: list[str] | None = None) -> Column:
    """Whether a word stands between spaces or at an end; no other border counts."""
    text, found = F.lower(text_of(col)), F.lit(False)
    for w in words or EXACT_WORDS:
        found |= text.contains(f" {w} ") | text.startswith(f"{w} ") | text.endswith(f" {w}")
    return found


def words_present(col: Column, words: list[str]) -> Column:
    return F.array_compact(F.array(*[F.when(text_of(col).rlike(word_pattern([w])), F.lit(w)) for w in words]))


def yes_no(col: Column) -> Column:
    word = F.lower(F.trim(text_of(col)))
    return F.when(word == "yes", 1).when(word == "no", 0)


def shortened(col: Column, width: int) -> Column:
    return F.when(F.length(col) > width, F.concat(F.substring(col, 1, width - 3), F.lit("..."))).otherwise(col)


def threshold_tag(t: float, digits: int = 2) -> str:
    """.80 -> 080, or with three digits .900 -> 0900."""
    return f"{t:.{digits}f}".replace(".", "")


def threshold_tags(x: Column, digits: int = 2) -> Column:
    return F.regexp_replace(F.format_string(f"%.{digits}f", x), r"\.", "")
