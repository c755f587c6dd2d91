"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item is cut into windows of ``WINDOW`` consecutive words
(a shorter item is one window) and every window into word shingles.
Shingles are ordered by rarity: their counts over all documents.  A
window can only occur where its rarest shingle occurs, so that one shingle
is the necessary prefix of its set, and it alone is joined against the
documents' shingles.  A match fixes where the window would have to start;
positional and length bounds discard it if that start lies before the
text or its end after it, and the words are then compared one by one.

Documents are read and cut three times, whatever the size of the benchmark:
to count its shingles, to match, and to count words.  Up to ``BLOCK`` rows
of a benchmark table are broadcast, and nothing but matches is shuffled.  A
larger table stays where it is: a bitmap of its shingles, of fixed size, is
broadcast instead, and only document shingles that it holds are shuffled to
meet the table, those of frequent shingles kept apart.

Keys use Unicode lower case, which only widens the candidates; the final
comparison lowers A-Z alone, as the contract has it.

Defined cases: null and wordless texts have no words and are clean;
wordless items have no window; a null item id counts as the id ""; rows
that repeat an id and a text get the same result; several items may
share a window and all count; either table may be empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.llm.textcols import ascii_lower, text_of
from corpusloom.plans.joins import bitmap_marked, join_counted, within
from corpusloom.session import cut

WINDOW = 13
SHINGLE = 5
#: Benchmark shingles, or windows and their items, up to which a table of them is broadcast.
BLOCK = 100_000
#: A document is contaminated if hits make up at least 1 / SHARE of its words.
SHARE = 20
#: Everything but digits, letters a-z and characters beyond ASCII.
GAP_LOWER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP_ANY = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column, gap: str) -> Column:
    return F.array_remove(F.split(text, gap, -1), "")


def shingle_key(words: Column, at: Column, length: int) -> Column:
    return F.xxhash64(*[F.get(words, at + k) for k in range(length)])


def item_windows(items: DataFrame, window: int = WINDOW, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(window, length, items): the distinct windows and who has them."""
    cut_up = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words_of(ascii_lower(text_of(text)), GAP_LOWER).alias("w")).where(F.size("w") > 0)
    length = F.least(F.lit(window), F.size("w"))
    starts = cut_up.select("item", "w", length.alias("length"), F.explode(F.sequence(F.lit(0), F.size("w") - length)).alias("s"))
    named = starts.select("item", "length", F.array_join(F.slice("w", F.col("s") + 1, F.col("length")), " ").alias("window"))
    return named.groupBy("window", "length").agg(F.collect_set("item").alias("items"))


def window_shingles(windows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """windows x their shingles: adds at (the shingle's place), size, key."""
    w = windows.withColumn("w", F.split(F.lower("window"), " ", -1)).withColumn("size", F.least(F.lit(shingle), F.col("length")))
    w = w.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("length") - F.col("size"))))
    key = F.lit(None).cast("long")
    for n in range(1, shingle + 1):
        key = F.when(F.col("size") == n, shingle_key(F.col("w"), F.col("at"), n)).otherwise(key)
    return w.withColumn("key", key).drop("w")


def doc_words(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, raw (the words as they stand), words (lower case)."""
    t = text_of("text")
    cut_up = docs.select("doc_id", F.xxhash64(t).alias("text_key"), words_of(t, GAP_ANY).alias("raw"))
    return cut_up.select("*", F.transform("raw", F.lower).alias("words"))


def at_shingles(words: DataFrame, sizes: list[int]) -> DataFrame:
    """``words`` x its shingles of each of the ``sizes``: adds pos and key."""
    last = F.size("words") - min(sizes)
    spread = words.select("*", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))).alias("pos"))
    pos = F.col("pos")
    if len(sizes) == 1:
        return spread.withColumn("key", shingle_key(F.col("words"), pos, sizes[0]))
    keys = [F.when(pos + n <= F.size("words"), shingle_key(F.col("words"), pos, n)) for n in sizes]
    return spread.withColumn("key", F.explode(F.array(*keys)))


def anchors(docs: DataFrame, windows: DataFrame, shingle: int = SHINGLE, block: int = BLOCK) -> tuple[DataFrame, list[int]]:
    """(key, n, windows): each window that may occur under its rarest shingle,
    which the documents have ``n`` times; and the sizes of these shingles."""
    spread = cut(window_shingles(windows, shingle))
    sizes = sorted(r["size"] for r in spread.select("size").distinct().collect())
    if not sizes:
        return spread.select("key", F.lit(0).cast("long").alias("n"), F.array().alias("windows")), sizes
    keys = cut(spread.select("key").distinct())
    seen = at_shingles(doc_words(docs), sizes).select("key")
    seen = seen.join(F.broadcast(keys), "key") if within(keys, block) else bitmap_marked(seen, keys, ["key"]).where("_held")
    counts = seen.groupBy("key").agg(F.count(F.lit(1)).alias("df"))
    # a shingle that no document has rules its window out
    rated = spread.join(counts, "key", "left").groupBy("window", "length", "items")
    rarest = rated.agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "key", "at")).alias("best")).where("best.df > 0")
    listed = F.collect_list(F.struct("window", "length", F.col("best.at").alias("at"), "items")).alias("windows")
    return cut(rarest.groupBy(F.col("best.key").alias("key")).agg(F.max("best.df").alias("n"), listed)), sizes


def union_length(spans: Column) -> Column:
    """How many positions the (s, length) spans, sorted by s, cover."""
    seed = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(acc, x):
        end = x["s"] + x["length"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(F.lit(0), end - F.greatest(x["s"], acc["end"]))).alias("n"))

    return F.aggregate(spans, seed, step, lambda acc: acc["n"])


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """(doc_id, text_key, n_hit, hit_items) of the documents that have any
    benchmark window."""
    table, sizes = anchors(docs, item_windows(items, window), shingle, block)
    # a table's row counts for each window and each item that it lists
    weight = table.agg(F.sum(F.aggregate("windows", F.lit(0), lambda n, w: n + 1 + F.size(w["items"])))).first()[0] if sizes else None
    if not weight:
        return docs.select("doc_id", F.lit(0).cast("long").alias("text_key"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("hit_items")).limit(0)
    # The join, or the bitmap, and the cut of the words around a match are one
    # generated loop: of a long text only matches with their surroundings leave
    # it.  A filter on the windows would become part of the join and break that.
    spread, lead = at_shingles(doc_words(docs), sizes), F.least(F.col("pos"), F.lit(window - 1))
    around = ["doc_id", "text_key", "pos", F.size("raw").alias("n_words"), lead.alias("lead"), F.slice("raw", F.col("pos") - lead + 1, F.lit(2 * window - 1)).alias("around")]
    if weight <= block:
        near = spread.join(F.broadcast(table.select("key", "windows")), "key").select("windows", *around)
    else:
        near = join_counted(cut(bitmap_marked(spread, table, ["key"]).where("_held").select("key", *around)), table, "key", "n")
    fits = lambda a: (F.col("lead") >= a["at"]) & (F.col("pos") - a["at"] + a["length"] <= F.col("n_words"))
    same = lambda a: ascii_lower(F.array_join(F.slice("around", F.col("lead") - a["at"] + 1, a["length"]), " ")) == a["window"]
    true = F.when(F.size("around") > 0, F.filter("windows", lambda a: F.when(fits(a), same(a)).otherwise(F.lit(False))))
    hits = near.select("doc_id", "text_key", F.transform(true, lambda a: F.struct((F.col("pos") - a["at"]).alias("s"), a["length"].alias("length"), a["items"].alias("items"))).alias("found"))
    # Sets, so that rows which repeat a document add nothing before they meet;
    # outer, as an inner explode would put its filter into the join.
    single = hits.select("doc_id", "text_key", F.explode_outer("found").alias("x")).select("doc_id", "text_key", F.when(F.col("x").isNotNull(), F.struct("x.s", "x.length")).alias("span"), F.explode_outer("x.items").alias("item"))
    grouped = single.groupBy("doc_id", "text_key").agg(F.collect_set("span").alias("spans"), F.collect_set("item").alias("items")).where(F.size("spans") > 0)
    return grouped.select("doc_id", "text_key", union_length(F.array_sort("spans")).alias("n_hit"), F.array_sort("items").alias("hit_items"))


def judge(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = SHARE, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: a row per document."""
    found = cut(occurrences(docs.select("doc_id", "text"), items, window, block=block))
    t = text_of("text")
    own = docs.select("doc_id", F.xxhash64(t).alias("text_key"), F.size(words_of(t, GAP_ANY)).cast("long").alias("n_words"))
    other = found.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    small = within(found)
    joined = own.join(F.broadcast(other) if small else other, on, "left")
    hit, names = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("hit_items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        ((hit > 0) & (hit * share >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = SHARE, block: int = BLOCK) -> DataFrame:
    """``docs`` without the contaminated ones."""
    found = cut(occurrences(docs.select("doc_id", "text"), items, window, block=block))
    t = text_of("text")
    own = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("_doc_id"), F.xxhash64(t).alias("_text_key"))
    other = found.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "n_hit")
    on = F.col("_doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key"))
    over = F.col("n_hit") * share >= F.size(words_of(F.coalesce("doc.text", F.lit("")), GAP_ANY))
    joined = own.join(F.broadcast(other) if within(found) else other, on, "left")
    return joined.where(F.col("n_hit").isNull() | ~over).select("doc.*")
