"""Fill-in-middle transformation by a two-pass streaming matcher.

A text is a row of units, the matches of a pattern (lines, unless told otherwise). The first pass counts them; a hash of
the document's id then gives two ranks, and the second pass moves a lazy iterator over the same matches to both of them.
Neither pass keeps a unit or a position besides the two that are asked for, so memory does not grow with the units.

What stands before the lower rank is the prefix, what stands between the ranks the middle, the rest the suffix. Forms:
`psm` is <P>prefix<S>suffix<M>middle, `spm` is <S>suffix<P>prefix<M>middle, `plain` the text itself. Texts that hold a
mark stay plain, and no mark begins with the end of another, so `restored` finds every mark where it was set.

Defined results: null and empty texts are plain, without units. A null id hashes like an empty one; rows that repeat an
id are cut by the same hash, each in its own text. Text outside all matches belongs to the next unit, or to the suffix.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import no_null, small_batches

LINES = r"[^\n]*\n|[^\n]+"
SEED = 7
#: Of a hundred documents, those that are rearranged, and of these, those in the form `spm`.
RATE, SPM = 100, 50
PREFIX, SUFFIX, MIDDLE = MARKS = "<P>", "<S>", "<M>"


def draws(doc_id: str, seed: int = SEED) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return tuple(int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))


def count_units(text: str, unit: re.Pattern) -> int:
    return sum(1 for _ in unit.finditer(text))


def ends_of(text: str, unit: re.Pattern, low: int, high: int) -> tuple[int, int]:
    """Where the low-th and the high-th unit end, counted from one; rank 0 is the beginning."""
    matches = unit.finditer(text)
    first = next(islice(matches, low - 1, None)).end() if low else 0
    second = next(islice(matches, high - low - 1, None)).end() if high > low else first
    return first, second


def rearranged(text: str, doc_id: str, unit: re.Pattern, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> tuple[int, str, str, int | None, int | None]:
    """Units, form, output, characters of the prefix and of the middle."""
    n = count_units(text, unit)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= rate or any(m in text for m in MARKS):
        return n, "plain", text, None, None
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = ends_of(text, unit, low, high)
    if h4 % 100 < spm:
        return n, "spm", "".join((SUFFIX, text[b:], PREFIX, text[:a], MIDDLE, text[a:b])), a, b - a
    return n, "psm", "".join((PREFIX, text[:a], SUFFIX, text[b:], MIDDLE, text[a:b])), a, b - a


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = LINES, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output; one row per row of docs."""
    small_batches(docs.sparkSession)
    pattern = re.compile(unit)
    source = docs.select(F.col(id_col).alias("doc_id"), no_null(F.col(id_col)).alias("name"), no_null(F.col(text_col)).alias("text"))

    def cut(batches):
        for batch in batches:
            n, forms, outputs, prefixes, middles = [], [], [], [], []
            for name, text in zip(batch.column(1), batch.column(2)):  # one text at a time
                for made, x in zip((n, forms, outputs, prefixes, middles), rearranged(text.as_py(), name.as_py(), pattern, seed, rate, spm)):
                    made.append(x)
            columns = [pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(prefixes, pa.int64()), pa.array(middles, pa.int64()), pa.array(outputs, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(cut, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from, by its marks."""

    def after(text: Column, mark: str) -> Column:
        return F.substring(text, F.instr(text, mark) + len(mark), F.length(text))

    first, second = F.when(form == "psm", PREFIX).otherwise(SUFFIX), F.when(form == "psm", SUFFIX).otherwise(PREFIX)
    body = F.substring(output, F.length(first) + F.lit(1), F.length(output))
    front = F.when(form == "psm", F.substring_index(body, SUFFIX, 1)).otherwise(F.substring_index(body, PREFIX, 1))
    back = F.substring(body, F.length(front) + F.length(second) + F.lit(1), F.length(body))
    inner, middle = F.substring_index(back, MIDDLE, 1), after(back, MIDDLE)
    whole = F.when(form == "psm", F.concat(front, middle, inner)).otherwise(F.concat(inner, middle, front))
    return F.when(form == "plain", output).otherwise(whole)
