"""Joins whose broadcast is decided by a measured size, never by hope."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Rows up to which a narrow keyed table may be broadcast.
BROADCAST_ROWS = 200_000


def within(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def join_keyed(left: DataFrame, right: DataFrame, key: str, how: str = "inner", *, rows: int = BROADCAST_ROWS, salts: int = 16) -> DataFrame:
    """Join a large, possibly skewed ``left`` to a table with unique ``key``s.

    ``right`` is broadcast when it is measured to be small.  Beyond that the
    join is salted: every left row gets a salt from its own hash and the
    right side is repeated once per salt, so a key that holds a third of
    all rows is spread over ``salts`` tasks.  Keys match null-safely.
    """
    other = right.withColumnRenamed(key, "_rk")
    if within(right, rows):
        return left.join(F.broadcast(other), F.col(key).eqNullSafe(F.col("_rk")), how).drop("_rk")
    salt = F.pmod(F.xxhash64(*[c for c, t in left.dtypes if not t.startswith(("map", "variant"))]), F.lit(salts))
    spread = other.withColumn("_rsalt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    on = F.col(key).eqNullSafe(F.col("_rk")) & (F.col("_salt") == F.col("_rsalt"))
    return left.withColumn("_salt", salt).join(spread, on, how).drop("_rk", "_salt", "_rsalt")


def join_counted(left: DataFrame, right: DataFrame, key: str | list[str], n: str, *, share: int = 500) -> DataFrame:
    """Inner join of ``left`` to a table with unique ``key``s (a column, or
    several) whose column ``n`` says how many rows of ``left`` have the key.

    A key with more than one in ``share`` of the rows would make one task
    large, so these keys, ``share`` at most, are broadcast and their rows
    stay where they are.  The other rows meet by shuffle.
    """
    bar = max(1, (right.agg(F.sum(n)).first()[0] or 0) // share)
    hot = right.where(F.col(n) > bar)
    if hot.isEmpty():
        return left.join(right, key)
    names = [key] if isinstance(key, str) else key
    rest = left.join(F.broadcast(hot.select(*names)), key, "left_anti").join(right.where(F.col(n) <= bar), key)
    return rest.unionByName(left.join(F.broadcast(hot), key).select(*rest.columns))


#: Keys of 16 bytes or less that are broadcast to filter wide rows in place.
KEY_ROWS = 2_000_000
#: Bits of the bitmap that stands in for more keys than that: 16 MB.
FILTER_BITS = 1 << 27
WORD_BITS = 1 << 15


def bitmap_marked(rows: DataFrame, keys: DataFrame, on: list[str], *, bits: int = FILTER_BITS) -> DataFrame:
    """``rows`` with ``_held``: false for those whose ``on`` columns are surely
    not among ``keys``, by a bitmap of ``bits`` bits that is broadcast
    whatever the number of keys.  No row moves."""
    place = lambda names: F.pmod(F.xxhash64(*names), F.lit(bits))
    at = keys.select(place(on).alias("p"))
    words = at.groupBy(F.floor(F.col("p") / WORD_BITS).alias("_word")).agg(F.bitmap_construct_agg(F.col("p") % WORD_BITS).alias("_bits"))
    placed = rows.withColumn("_p", place(on)).withColumn("_w", F.floor(F.col("_p") / WORD_BITS))
    byte = F.expr("cast(conv(hex(substring(_bits, cast(_p % 32768 div 8 as int) + 1, 1)), 16, 10) as int)")
    held = F.coalesce(byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (F.col("_p") % 8).cast("int"))) != 0, F.lit(False))
    return placed.join(F.broadcast(words), F.col("_w") == F.col("_word"), "left").withColumn("_held", held).drop("_p", "_w", "_word", "_bits")


def split_by_keys(rows: DataFrame, keys: DataFrame, on: list[str], *, bound: int | None = None, bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose ``on`` columns are among the distinct ``keys``, and the
    others; nulls are equal to each other.

    The rows are wide, so they should stay in place.  Up to ``bound`` keys
    are broadcast and no row moves.  More keys are hashed into a bitmap of
    ``bits`` bits, which is broadcast instead: rows that it does not hold are
    among the others and stay in place; only rows that it holds are shuffled
    to be compared with the keys themselves.
    """
    same = lambda: [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(on)]
    other = keys.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(on)])
    if within(keys, KEY_ROWS if bound is None else bound):
        small = F.broadcast(other)
        return rows.join(small, same(), "left_semi"), rows.join(small, same(), "left_anti")
    marked = bitmap_marked(rows, keys, on, bits=bits)
    maybe, out = marked.where("_held").drop("_held"), marked.where("NOT _held").drop("_held")
    far = other.hint("shuffle_hash")
    return maybe.join(far, same(), "left_semi"), out.unionByName(maybe.join(far, same(), "left_anti"))
