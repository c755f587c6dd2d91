"""Sharding by histogram sort.

Rows are ordered by (hash of the text, hash of the whole row).  Candidate
key boundaries (probes) are laid over the key space, the exact bytes below
each are counted across all partitions, and only the intervals that still
hold a shard border, or too many bytes for one task, get finer probes.
When every border is known to within the tolerance the splitters are final
and the rows are exchanged once.

Law ``bytes``: the shards' sizes differ from their mean by no more than
the tolerance plus one document.  Copies of a text are neighbours in the
order, so they share a shard unless a splitter falls inside their group.

Rows equal in every column share one key.  Where a border falls inside
such a run, or the run is too much for one task, it travels as one row and
a count, and the row is repeated over the slots that are due to it.

Defined cases: a null text has no bytes (size 16, the row overhead) and
crc 0 like an empty one; equal rows are parted like any others; an empty
table gives no rows; with fewer rows than shards some shards stay empty.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.llm.textcols import row_hash
from corpusloom.session import cut, values

SHARDS = 40
OVERHEAD = 16
TOLERANCE = 0.002
#: An interval of more than so many times the mean of the first round is refined even if no border is in it.
HEAVY = 4
DIGIT = 8
#: Rows of a run of equal rows that one task repeats at a time.
PIECE = 20_000


def _digit(level: Column, text_key: Column, row_key: Column, root_bits: int) -> Column:
    """The probe interval of a key at a level: level 0 has 2**root_bits
    intervals of the text key, levels 1-8 and 9-16 take eight bits more of
    the text key and of the row key."""
    def bits(key, shift, width):
        return F.call_function("shiftrightunsigned", key, shift).bitwiseAND(F.lit((1 << width) - 1))

    root = bits(text_key, F.lit(64 - root_bits), root_bits)
    text = bits(text_key, F.greatest(F.lit(0), F.lit(64 - root_bits) - level * DIGIT).cast("int"), DIGIT)
    row = bits(row_key, (F.lit(64 + 8 * DIGIT) - level * DIGIT).cast("int"), DIGIT)
    return F.when(level == 0, root).when(level <= 8, text).otherwise(row).cast("long")


def keyed(docs: DataFrame) -> DataFrame:
    """doc (the row), size, text_crc32, text_key, row_key.  All that is
    derived from a text is derived here, before the exchange, so a caller
    that selects no text moves none."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + OVERHEAD
    crc = F.crc32(F.coalesce("text", F.lit("")))
    return docs.select(F.struct("*").alias("doc"), size.alias("size"), crc.alias("text_crc32"), F.xxhash64("text").alias("text_key"), row_hash(docs).alias("row_key"))


def _descend(rows: DataFrame, splits: list[tuple], root_bits: int) -> DataFrame:
    """Move each row from the nodes that were split to their children.
    ``splits`` (node, base, level) has a row for each border and for each of
    the intervals, 2**root_bits / HEAVY at most, that are too large."""
    table = cut(values(rows.sparkSession, splits, "node long, base long, level int"))
    joined = rows.drop("base", "level").join(F.broadcast(table), "node", "left")
    child = F.col("base") + _digit(F.col("level"), F.col("text_key"), F.col("row_key"), root_bits)
    return joined.withColumn("node", F.coalesce(child, F.col("node")))


def splitters(keys: DataFrame, shards: int, tolerance: float) -> tuple[list[list[tuple]], list[tuple], list[tuple], int]:
    """Refine probes until every splitter meets the tolerance.

    Returns the rounds of splits, the final intervals as (node, shard, rows
    before it in its shard), the runs of equal rows that a border cuts or
    that are too much for one task as (node, shard, first slot, rows), and
    the bits of the first round.  Counts of at most 2**16 intervals and 256
    for each split reach the driver.
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    root_bits = min(16, max(10, (total >> 28).bit_length()))
    if not total:
        return [], [], [], root_bits
    want = [total * s / shards for s in range(1, shards)]
    slack, full = tolerance * total / shards, HEAVY * total / (1 << root_bits)
    rows, rounds, fresh = keys.withColumn("node", F.lit(0).cast("long")), [], 1
    leaves: dict[int, tuple] = {}  # node -> (order, bytes, rows, whether all rows are equal)
    split, place = [(0, fresh, 0)], {0: ()}
    fresh += 1 << root_bits
    while split:
        rounds.append(split)
        rows = _descend(rows, split, root_bits)
        bases = {base: (node, level) for node, base, level in split}
        seen = (
            rows.where("base IS NOT NULL")
            .groupBy("node", "base")
            .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), (F.min("text_key") == F.max("text_key")).alias("one"), (F.min("row_key") == F.max("row_key")).alias("same"))
            .collect()
        )
        made = {}
        for r in seen:
            parent, level = bases[r["base"]]
            place[r["node"]] = place[parent] + (r["node"] - r["base"],)
            leaves[r["node"]] = (place[r["node"]], r["bytes"], r["n"], r["one"] and r["same"])
            made[r["node"]] = max(level + 1, 9) if r["one"] else level + 1
        for node, _, _ in split:
            leaves.pop(node, None)
        split, below, w = [], 0, 0
        for node, (_, size, _, same) in sorted(leaves.items(), key=lambda x: x[1][0]):
            while w < len(want) and want[w] <= below:
                w += 1
            # The bytes below an interval are exact from the start, so one that was passed over stays so.
            if node in made and not same and made[node] <= 16 and (size > full or _cut_deep(below, size, want[w : w + 2], slack)):
                split.append((node, fresh, made[node]))
                fresh += 1 << DIGIT
            below += size
    final, runs, below, held, last, w = [], [], 0, 0, 0, 0
    for node, (_, size, n, same) in sorted(leaves.items(), key=lambda x: x[1][0]):
        while w < len(want) and want[w] <= below:
            w += 1
        if same and n > 1 and (size > full or _cut_deep(below, size, want[w : w + 2], slack)):
            unit, at = size // n, 0
            while at < n:
                shard = min(shards - 1, int((below + (at + 0.5) * unit) * shards // total))
                end = n if shard == shards - 1 else min(n, max(at + 1, math.ceil((want[shard] - below) / unit - 0.5)))
                held = held if shard == last else 0
                runs.append((node, shard, held, end - at))
                at, held, last = end, held + end - at, shard
        else:
            shard = min(shards - 1, int((below + size / 2) * shards // total))
            held = held if shard == last else 0
            final.append((node, shard, held))
            held, last = held + n, shard
        below += size
    return rounds, final, runs, root_bits


def _cut_deep(below: int, size: int, borders: list[float], slack: float) -> bool:
    """Whether an interval holds a border that neither of its ends meets."""
    if not borders or borders[0] >= below + size:
        return False
    return min(borders[0] - below, below + size - borders[0]) > slack or len(borders) > 1 and borders[1] < below + size


def shard_rows(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per document: doc (the row), size, text_crc32, shard, slot."""
    spark, rows = docs.sparkSession, keyed(docs)
    keys = cut(rows.select("size", "text_key", "row_key"))
    rounds, final, runs, root_bits = splitters(keys, shards, tolerance)
    rows = rows.withColumn("node", F.lit(0).cast("long"))
    for split in rounds:
        rows = _descend(rows, split, root_bits)
    table = cut(values(spark, final, "node long, shard int, before long"))
    order = Window.partitionBy("node").orderBy("text_key", "row_key")
    placed = rows.join(F.broadcast(table), "node").withColumn("slot", F.col("before") + F.row_number().over(order) - 1)
    placed = placed.select("doc", "size", "text_crc32", "shard", F.col("slot").cast("long"))
    if not runs:
        return placed
    # Equal rows can stand for each other: one of them is repeated over the run's slots, a piece at a time.
    table = F.broadcast(cut(values(spark, runs, "node long, shard int, first long, n long")))
    one = rows.join(table.select("node").distinct(), "node", "left_semi").groupBy("node").agg(*[F.first(c).alias(c) for c in ("doc", "size", "text_crc32")])
    pieces = one.join(table, "node").withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(PIECE).cast("long")))).repartition("node", "shard", "at")
    slot = F.explode(F.sequence(F.col("first") + F.col("at"), F.col("first") + F.least(F.col("at") + PIECE, "n") - 1))
    return placed.unionByName(pieces.select("doc", "size", "text_crc32", "shard", slot.alias("slot")))
