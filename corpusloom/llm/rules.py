"""Quality rules as a bitmask ledger.

Each rule is evaluated once per document.  The ledger keeps the
measurements and one bit per failed rule; a policy is a version name and
the mask of rules it enforces, so new policies and ablations are bitwise
work on the ledger and never read a text again.

Defined cases: null text counts as empty; an empty text fails
``too_short`` and nothing else; very long lines and texts are measured
whole; the row itself stays as ``doc``, so its other columns may have any
names; rows that are repeated have a line in the ledger each; an empty
table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.llm.textcols import SPACE, removed, space_words, text_of


@dataclass(frozen=True)
class Rule:
    """``fails`` is a SQL predicate over the measurements; null is a pass."""

    name: str
    fails: str


#: Bit i of ``failed`` belongs to rule i.  Append only: bits are stored.
RULES = (
    Rule("too_short", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("duplicate_lines", "n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines"),
    Rule("long_words", "word_chars > 15 * n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("few_letters", "2 * n_letters < word_chars"),
    Rule("shouting", "n_letters >= 100 AND 2 * n_upper > n_letters"),
    Rule("too_long", "n_words > 1000000"),
)

POLICIES = {
    "base-1": ("too_short", "repeated_windows"),
    "web-1": ("too_short", "repeated_windows", "symbols", "duplicate_lines", "long_words", "short_words", "few_letters"),
    "web-2": ("too_short", "repeated_windows", "symbols", "duplicate_lines", "long_words", "short_words", "few_letters", "shouting"),
    "web-3": ("too_short", "repeated_windows", "symbols", "duplicate_lines", "long_words", "short_words", "few_letters", "shouting", "too_long"),
}
PRODUCTION = "web-3"


def mask(*names: str, rules=RULES) -> int:
    order = [r.name for r in rules]
    return sum(1 << order.index(n) for n in names)


def covered(starts: Column, width: int) -> Column:
    """How many positions the windows at the sorted ``starts`` cover."""
    gaps = F.zip_with(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.slice(starts, 1, F.greatest(F.size(starts) - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(width)))
    return F.when(F.size(starts) > 0, F.aggregate(gaps, F.lit(width), lambda s, x: s + x)).otherwise(F.lit(0))


def with_repeated_words(rows: DataFrame, width: int = 3) -> DataFrame:
    """Adds n_repeat_words: words inside ``width``-word windows that occur
    twice or more in ``words``.

    Windows become 64-bit hashes.  Only a text whose hashes are not all
    distinct sorts its (hash, position) pairs, where equal hashes meet.
    Every step is a column of its own, because a lambda would evaluate an
    array expression inside it once for each element.
    """
    words, last = F.col("words"), F.size("words") - (width - 1)
    window = lambda i: F.struct(F.xxhash64(*[F.element_at(words, i + k) for k in range(width)]).alias("h"), i.alias("at"))
    rows = rows.withColumn("windows", F.when(last > 0, F.transform(F.sequence(F.lit(1), last), window)))
    once = F.size(F.array_distinct("windows.h")) == F.size("windows")
    rows = rows.withColumn("ordered", F.when(~once, F.array_sort("windows")))
    at = lambda i: F.get("ordered", i)["h"]
    twice = F.filter("ordered", lambda x, i: (at(i - 1) == x["h"]) | (at(i + 1) == x["h"]))
    rows = rows.withColumn("starts", F.array_sort(F.transform(twice, lambda x: x["at"])))
    return rows.withColumn("n_repeat_words", F.coalesce(covered(F.col("starts"), width), F.lit(0)).cast("long")).drop("windows", "ordered", "starts")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc, and a measurement per column): one pass, no shuffle."""
    t = text_of(text)
    base = docs.select(F.struct("*").alias("doc"), t.alias("t"), space_words(t).alias("words"), F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    letters = removed(F.col("t"), r"\p{L}+")
    return with_repeated_words(base).select(
        "doc",
        F.size("words").cast("long").alias("n_words"),
        (F.length("t") - removed(F.col("t"), SPACE)).cast("long").alias("word_chars"),
        removed(F.col("t"), r"[#*$%&|<>]+").cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        letters.cast("long").alias("n_letters"),
        removed(F.col("t"), r"\p{Lu}+").cast("long").alias("n_upper"),
    )


def ledger(docs: DataFrame, rules=RULES) -> DataFrame:
    """The measurements and ``failed``, one bit for each rule that failed."""
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measure(docs).withColumn("failed", bits)


def verdict(failed: Column, policy: str = PRODUCTION) -> Column:
    return failed.bitwiseAND(F.lit(mask(*POLICIES[policy])).cast("long")) == 0


def ablation(book: DataFrame, policies: dict = POLICIES, rules=RULES) -> DataFrame:
    """Per policy and rule: documents failed, and those that only this rule
    rejects, i.e. what dropping it would let through."""
    masks = {p: mask(*names, rules=rules) for p, names in policies.items()}
    counts, keys = [F.count(F.lit(1)).alias("n")], []
    for p, m in masks.items():
        for name in policies[p]:
            bit = mask(name, rules=rules)
            hit = F.col("failed").bitwiseAND(F.lit(m).cast("long"))
            keys.append((p, name, len(keys)))
            counts += [F.count_if(F.col("failed").bitwiseAND(F.lit(bit).cast("long")) != 0).alias(f"f{len(keys) - 1}"), F.count_if(hit == bit).alias(f"o{len(keys) - 1}")]
    row = book.agg(*counts)
    return row.select(F.inline(F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.col("n").alias("n_docs"), F.col(f"f{i}").alias("n_failed"), F.col(f"o{i}").alias("n_only")) for p, r, i in keys])))
