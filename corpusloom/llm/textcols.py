"""Column expressions the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SPACE = r"[\x20\x09-\x0D]+"


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def space_words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order."""
    return F.array_remove(F.split(text, SPACE, -1), "")


def removed(text: Column, pattern: str) -> Column:
    """How many characters of ``text`` lie in matches of ``pattern``."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def ascii_lower(text: Column) -> Column:
    """A-Z only; other letters keep their case.  Costly: for small inputs."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def row_parts(df: DataFrame, of: str = "") -> list[Column]:
    """All columns of ``df``, or of its rows kept as the struct ``of``, as
    values that can be hashed."""
    cols = [(F.col(f"{of}.`{c}`" if of else f"`{c}`"), kind) for c, kind in df.dtypes]
    return [F.to_json(F.struct(c.alias("c"))) if kind.startswith(("map", "variant")) else c for c, kind in cols]


def row_hash(df: DataFrame, of: str = "") -> Column:
    """A hash over all columns; a null is not the same as an absent value."""
    parts = row_parts(df, of)
    return F.xxhash64(*parts, *[c.isNull() for c in parts])


def row_digest(df: DataFrame) -> Column:
    """MD5 of all columns as text, for results that other engines repeat."""
    flat = [c if kind in ("string", "bigint", "int", "date", "boolean") else F.to_json(F.struct(c.alias("c"))) for c, kind in zip(row_parts(df), dict(df.dtypes).values())]
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x1e")) for c in flat]))
