"""How far the sources of a language differ in their use of terms.

Each (language, source) group has a smoothed frequency for every kept term
of its language, and two groups differ by the sum of the differences of
their frequencies.  That sum is never taken term by term: for every pair of
sources the distinct (count, count) combinations are tallied, and the
difference is evaluated once per combination times its multiplicity.  The
cells in which one or both counts are zero are not tallied but implied, by
how often each source has each count and by the number of kept terms.

Plan: one pass over the texts counts terms inside each partition, so a
source or a term that holds much of the corpus is a few rows per partition
when it is shuffled.  Counts of kept terms are checkpointed, dealt to tasks
by blocks of terms, and tallied there pair by pair; only distinct
combinations leave a task.

All arithmetic is exact, in longs and decimals.  Frequencies are integers,
``1 + floor(UNIT * (count + PRIOR) / (N + PRIOR * V))``.

Defined cases: null texts, languages and sources are empty ones, and empty
texts still make their group occur; repeated rows count as often as they
occur; a language without kept terms has pairs of value 0; very long texts
are counted in pieces; ties are ordered by item; a language with one source
has no pairs; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.session import cut

MIN_DOCS = 30
TOP = 50
UNIT = 1_000_000_000
PRIOR = 5
#: Bytes of a text that are split at once; terms of documents and distinct
#: terms that a task holds before it sends their sums on.
PIECE = 1 << 20
HELD = 2_000_000
WORDS = 1 << 20
#: Term counts of a language that one task tallies.
BLOCK = 200_000

_LETTER = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Numbers(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        return n


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text in pieces: runs of letters and of all
    characters beyond ASCII, with A-Z in lower case."""
    low = text.translate(_LETTER)
    start = 0
    while start < len(low):
        end = start + PIECE
        if end < len(low):
            space = low.find(b" ", end)
            end = len(low) if space < 0 else space
        yield low[start:end].split()
        start = end


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents by group,
    partial sums that are yet to be added up.  Every group also has a row
    whose term is null."""

    def summed(held: dict, ids: dict, parts: list) -> pa.RecordBatch:
        group, term, n = (np.concatenate(x) for x in zip(*parts))
        keys, place, docs = np.unique(group * len(ids) + term, return_inverse=True, return_counts=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, place, n)
        # every group once more, without a term
        own = pa.array(np.r_[keys // len(ids), np.arange(len(held))])
        langs, sources = (pa.array(x, pa.string()).take(own) for x in zip(*held))
        names = pa.array([*(t.decode("utf-8", "replace") for t in ids), None], pa.string())
        terms_ = names.take(pa.array(np.r_[keys % len(ids), np.full(len(held), len(ids))]))
        none = np.zeros(len(held), np.int64)
        return pa.RecordBatch.from_arrays([langs, sources, terms_, pa.array(np.r_[total, none]), pa.array(np.r_[docs, none])], ["lang", "source", "term", "n", "docs"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, parts, size = {}, Numbers(), [], 0
        for b in batches:
            langs, sources, texts = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)
            for i in range(b.num_rows):
                group = held.setdefault((langs[i], sources[i]), len(held))
                found = [np.fromiter(map(ids.__getitem__, piece), np.int64, len(piece)) for piece in terms(texts[i].as_py())]
                own, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
                parts.append((np.full(len(own), group, np.int64), own, n))
                size += len(own)
                if size > HELD or len(ids) > WORDS:
                    yield summed(held, ids, parts)
                    held, ids, parts, size = {}, Numbers(), [], 0
        if held:
            yield summed(held, ids, parts)

    part = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return part.mapInArrow(count, "lang string, source string, term string, n long, docs long")


def frequency(count: Column, total: Column, kept: Column) -> Column:
    """The smoothed integer frequency; exact for counts up to 10**18."""
    up = (count.cast("decimal(18,0)") + F.lit(PRIOR).cast("decimal(1,0)")) * F.lit(UNIT).cast("decimal(10,0)")
    down = total.cast("decimal(18,0)") + F.lit(PRIOR).cast("decimal(1,0)") * kept.cast("decimal(16,0)")
    return F.call_function("div", up, down) + F.lit(1)


def tally(counts: DataFrame, blocks: DataFrame) -> DataFrame:
    """(lang, a, b, n_a, n_b, times): how many terms both sources a < b of a
    language have, by the two counts.  ``blocks`` says into how many blocks
    the terms of each language are dealt."""

    def pairs(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        term, source = rows["term"].factorize()[0], rows["source"]
        names = sorted(source.unique())
        own = {s: g for s, g in rows.assign(term=term).groupby("source", sort=False)}
        held = {}
        for s in names:
            order = own[s]["term"].to_numpy().argsort()
            held[s] = own[s]["term"].to_numpy()[order], own[s]["n"].to_numpy()[order]
        ranks, out = np.unique(rows["n"].to_numpy()), []
        for i, a in enumerate(names):
            dense = np.zeros(term.max() + 1, np.int64)
            dense[held[a][0]] = held[a][1]
            for b in names[i + 1 :]:
                mine = dense[held[b][0]]
                both = mine > 0
                if not both.any():
                    continue
                # counts by their rank among this block's, so that a pair of them is one number
                cells, times = np.unique(np.searchsorted(ranks, mine[both]) * len(ranks) + np.searchsorted(ranks, held[b][1][both]), return_counts=True)
                out.append((a, b, ranks[cells // len(ranks)], ranks[cells % len(ranks)], times))
        sizes = [len(x[4]) for x in out]
        named = {k: np.repeat(np.array([x[i] for x in out], object), sizes) for i, k in enumerate("ab")}
        tallied = {k: np.concatenate([x[i] for x in out] or [np.zeros(0, np.int64)]) for i, k in ((2, "n_a"), (3, "n_b"), (4, "times"))}
        return pd.DataFrame({"lang": key[0], **named, **tallied})

    dealt = counts.select("lang", "source", "term", "n").join(F.broadcast(blocks) if blocks.count() <= 100_000 else blocks, "lang")
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block")
    found = dealt.select("lang", block, "source", "term", "n").groupBy("lang", "block").applyInPandas(pairs, "lang string, a string, b string, n_a long, n_b long, times long")
    return found.groupBy("lang", "a", "b", "n_a", "n_b").agg(F.sum("times").alias("times"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank).  Part ``pair``: the
    difference to each other source of the language.  Part ``term``: the
    ``top`` terms that the source has more of than its language."""
    # dealt by term, so that sums by group, sums by language and the choice of
    # terms all happen where the rows then are
    of_term = Window.partitionBy("lang", "term")
    added = count_terms(docs).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    ranked = added.select("lang", "source", "term", "n", F.sum("n").over(of_term).alias("lang_n"), F.sum("docs").over(of_term).alias("docs"), (F.row_number().over(of_term.orderBy("source")) == 1).alias("once"))
    kept = cut(ranked.where((F.col("docs") >= min_docs) | F.col("term").isNull()).drop("docs"))
    counts = kept.where("term IS NOT NULL")
    langs = cut(counts.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count(F.lit(1)).alias("rows"), F.count_if("once").alias("kept")))
    groups = kept.where("term IS NULL").select("lang", "source")
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("terms"))
    zero = F.lit(0).cast("long")
    groups = cut(
        groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left")
        .select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "terms", "kept", "lang_total")])
    )

    # pairs: what the tallied cells add to a sum in which every cell is implied
    side = lambda s: groups.select("lang", F.col("source").alias(s), F.col("total").alias(f"total_{s}"), F.col("terms").alias(f"terms_{s}"), *(["kept"] if s == "a" else []))
    both = cut(side("a").join(side("b"), "lang").where("a < b"))
    at = lambda s, n: frequency(n, F.col(f"total_{s}"), F.col("kept"))
    apart = lambda x, y: F.abs(at("a", x) - at("b", y))
    cells = tally(counts, langs.select("lang", F.ceil(F.col("rows") / BLOCK).cast("long").alias("blocks")))
    joint = cells.join(both, ["lang", "a", "b"]).select("lang", "a", "b", (F.col("times") * (apart(F.col("n_a"), F.col("n_b")) - apart(F.col("n_a"), zero) - apart(zero, F.col("n_b")) + apart(zero, zero))).alias("part"))
    margin = counts.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("times"))
    alone_a = margin.withColumnRenamed("source", "a").join(both, ["lang", "a"]).select("lang", "a", "b", (F.col("times") * apart(F.col("n"), zero)).alias("part"))
    alone_b = margin.withColumnRenamed("source", "b").join(both, ["lang", "b"]).select("lang", "a", "b", (F.col("times") * apart(zero, F.col("n"))).alias("part"))
    neither = both.select("lang", "a", "b", F.when(F.col("kept") > 0, (F.col("kept") - F.col("terms_a") - F.col("terms_b")) * apart(zero, zero)).otherwise(zero).alias("part"))
    summed = joint.unionByName(alone_a).unionByName(alone_b).unionByName(neither).groupBy("lang", "a", "b").agg(F.sum("part").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("way")
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = summed.select("lang", "value", ways).select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value").withColumn("rank", F.row_number().over(by))

    more = counts.join(F.broadcast(groups) if groups.count() <= 100_000 else groups, ["lang", "source"])
    ahead = frequency(F.col("n"), F.col("total"), F.col("kept")) - frequency(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    term = more.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), ahead.alias("value")).where("value > 0").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    return pair.unionByName(term)
