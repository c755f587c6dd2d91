"""Mixing sources to target weights.

Sizes are aggregated per source, each source gets a target and from it a
repetition rate, and every document is emitted ``floor(rate)`` times plus
one hash-seeded Bernoulli copy with the fraction as its probability.
One row per source and a hash per row leave the scan; documents are not
shuffled, but for one of each run of equal rows.

Defined cases: a null source is a source of its own and comes last; a null
or blank text has size 0 and is emitted like any other document of its
source (size-0 sources have rate 0); each of several equal rows draws for
itself; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.llm.textcols import row_digest
from corpusloom.plans.joins import join_keyed, split_by_keys
from corpusloom.plans.ranking import global_rank
from corpusloom.session import cut

WORDS = r"[^\x20\x09-\x0D]+"
CYCLE = (5, 2, 1)
SHARE = 1.5
CEILING = 2.0
SEED = "mix-1"
#: Equal rows that one task repeats at a time.
PIECE = 20_000


def word_count(text: Column, pattern: str = WORDS) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def draw(row_key: Column, nth: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) with 48 bits, fixed by seed, row and, of equal
    rows, which one it is."""
    key = F.concat_ws("|", F.lit(seed), row_key, nth)
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def targets(sizes: DataFrame, *, cycle=CYCLE, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """(source, source_size) -> (source, source_size, target, rate).

    Sources in code-point order, null last, weigh ``cycle`` repeating.  The
    targets share ``share`` of all sizes; those over ``ceiling`` times
    their source stop there and the excess is shared again by weight until
    none is above: a few passes over one row per source, of which only
    three sums reach the driver.
    """
    ranked = global_rank(sizes, [F.col("source").isNull().asc(), F.col("source").asc()], "_rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.pmod(F.col("_rank") - 1, F.lit(len(cycle))) + 1).cast("int"))
    table = cut(ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(ceiling)).alias("cap")))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    goal, level = share * total, 0.0
    capped = -1
    while True:
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        row = table.agg(
            F.count_if(full).alias("n"),
            F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)).alias("held"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("w"),
        ).first()
        if row["n"] == capped or not row["w"]:
            break
        capped, level = row["n"], (goal - row["held"]) / row["w"]
    target = F.least(F.col("cap"), F.lit(level) * F.col("weight"))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(ceiling)), target / F.col("source_size"))).otherwise(F.lit(0.0))
    return table.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def plan_mix(docs: DataFrame, *, pattern: str = WORDS, seed: str = SEED, **shares) -> DataFrame:
    """One row per document: the row itself as ``doc``, size, source_size,
    target (its source's) and copies, the times the mix emits it."""
    size = word_count(F.col("text"), pattern)
    own = docs.select(F.struct("*").alias("doc"), F.col("source").alias("source"), size.alias("size"), row_digest(docs).alias("row_key"))
    keys = cut(own.select("source", "size", "row_key"))
    sizes = keys.groupBy("source").agg(F.sum("size").alias("source_size"))
    again = cut(keys.groupBy("row_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("row_key"))
    numbered = own.withColumn("nth", F.lit(0).cast("long"))
    if not again.isEmpty():
        # Equal rows can stand for each other: one of them is repeated, and each repetition draws for itself.
        equal, single = split_by_keys(own, again, ["row_key"])
        one = equal.groupBy("row_key").agg(*[F.first(c).alias(c) for c in ("doc", "source", "size")], F.count(F.lit(1)).alias("n"))
        pieces = one.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(PIECE).cast("long")))).repartition("row_key", "at")
        spread = pieces.withColumn("nth", F.explode(F.sequence("at", F.least(F.col("at") + PIECE, "n") - 1)))
        numbered = single.withColumn("nth", F.lit(0).cast("long")).unionByName(spread.select("doc", "source", "size", "row_key", "nth"))
    joined = join_keyed(numbered, targets(sizes, **shares), "source")
    whole = F.floor("rate")
    copies = (whole + (draw(F.col("row_key"), F.col("nth"), seed) < F.col("rate") - whole).cast("long")).cast("long")
    return joined.select("doc", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus, in the columns of ``docs``: each document repeated
    as often as it was drawn."""
    planned = plan_mix(docs, **options).where("copies > 0")
    return planned.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("doc.*")
