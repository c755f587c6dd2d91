"""Text primitives as Column expressions (all JVM-side)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F

#: Unicode white space, with the four separators that Java leaves out.
WS = r"[\s\x1c-\x1f]"
WORD = r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)?"


#: The same characters one by one.
SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(c: Column) -> Column:
    """Without white space at the ends; looks at each end once, where a
    pattern would try every run of spaces to its end."""
    return F.btrim(c, F.lit(SPACES))


def squeeze(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return strip(F.regexp_replace(c, rf"(?U){WS}+", " "))


def casefold(c: Column) -> Column:
    """Lower case with ss for ß: full case folding for all but some 320 rare
    letters, without leaving the engine."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def casefold_exact(c: Column) -> Column:
    """Full Unicode case folding, over Arrow batches."""

    @F.pandas_udf("string")
    def fold(texts: pd.Series) -> pd.Series:
        return texts.str.casefold()

    return fold(c)


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, rf"(?U)(?<=[.!?]){WS}+|\n+", -1), strip), lambda x: x != "")


def paragraphs(c: Column, closing: str = "") -> Column:
    """Split at blank lines; the corpus pipeline uses ``closing="+"``."""
    return F.filter(F.transform(F.split(c, rf"(?U)\n{WS}*\n{closing}", -1), strip), lambda x: x != "")


def ngrams(words: Column, n: int) -> Column:
    """Word n-grams joined by a space; ``words`` should be a plain column."""
    last = F.size(words) - (n - 1)
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def chars(text: Column) -> Column:
    return F.array_remove(F.split(text, "", -1), "")


def char_ngrams(letters: Column, n: int) -> Column:
    """Character n-grams; ``letters`` is a plain column made by ``chars``."""
    last = F.size(letters) - (n - 1)
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(letters, i, n), ""))).otherwise(F.array().cast("array<string>"))


def overlap(source: Column, target: Column) -> Column:
    """Share of the distinct ``source`` tokens found in ``target``; 1 if there are none."""
    own = F.array_distinct(source)
    return F.when(F.size(own) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(own, target)) / F.size(own))


def hex_int(hexed: Column, digits: int) -> Column:
    return F.conv(F.substring(hexed, 1, digits), 16, 10).cast("long")


def in_range(value: Column, low: Column, high: Column) -> Column:
    """A null bound fails."""
    return F.coalesce(value.between(low, high), F.lit(False))


def canonical_json(df_columns: list[str]) -> Column:
    return F.to_json(F.struct(*sorted(df_columns)), {"ignoreNullFields": "false"})


def month(ts: Column) -> Column:
    """UTC month of epoch seconds; none or 0 means now."""
    return F.date_format(F.timestamp_seconds(F.when(F.coalesce(ts, F.lit(0.0)) == 0, F.unix_timestamp().cast("double")).otherwise(ts)), "yyyy-MM")


def occurrences(text: Column, part: str) -> Column:
    """How often ``part`` occurs, counted without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def unfenced(content: Column) -> Column:
    """What a fenced code block holds; any other content as it is, trimmed."""
    plain = strip(content)
    return F.when(F.startswith(plain, F.lit("```")), F.regexp_replace(F.regexp_replace(plain, r"(?s)\A[^\n]*\n", ""), r"(?s)```(?!.*```).*\z", "")).otherwise(plain)


def missing_keys(content: Column, required: list[str]) -> Column:
    """The ``required`` keys that a JSON object lacks, in order; null if the
    content is no object."""
    keys = F.json_object_keys(content)
    return F.when(keys.isNotNull(), F.array_sort(F.array_except(F.array(*[F.lit(k) for k in required]), keys)))


def same_keys(content: Column, wanted: list[str]) -> Column:
    """Whether a JSON object has exactly the ``wanted`` keys."""
    keys = F.json_object_keys(content)
    return F.coalesce((F.size(F.array_except(keys, F.array(*[F.lit(k) for k in wanted]))) == 0) & (F.size(missing_keys(content, wanted)) == 0), F.lit(False))


def percent(part: Column, whole: Column) -> Column:
    """A share as a percentage from 0 to 100; 0 of nothing."""
    return F.when(F.coalesce(whole, F.lit(0.0)) <= 0, F.lit(0.0)).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100.0 * part / whole)))
