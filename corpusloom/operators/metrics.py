"""Corpus metrics: lexical, structural, validity, diversity, length."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.functions.text import casefold, in_range, ngrams, overlap, paragraphs, sentences, tokens
from corpusloom.session import cut

# Bucket edges and the opening word classes.
PARAGRAPH_EDGES = (20, 50, 100, 200, 400)
SENTENCE_EDGES = (5, 10, 20, 30, 50)
OPENINGS = {
    "pronoun": ["i", "we", "you", "he", "she", "they", "it"],
    "article": ["a", "an", "the"],
    "conjunction": ["and", "but", "or", "so", "yet"],
    "question": ["what", "when", "where", "who", "why", "how"],
}


def folded(text: Column) -> Column:
    return F.transform(tokens(text), casefold)


def with_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("tokens", folded(F.coalesce(F.col(text), F.lit(""))))


def feature_counts(docs: DataFrame, low: int = 1, high: int = 3) -> DataFrame:
    """(feature, n): word n-grams over the corpus, counted map-side first."""
    words = with_tokens(docs).select("tokens")
    out = None
    for n in range(low, high + 1):
        part = words.select(F.explode(ngrams(F.col("tokens"), n)).alias("feature"))
        out = part if out is None else out.union(part)
    return out.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))


def hash_buckets(docs: DataFrame, dim: int, low: int = 1, high: int = 3) -> DataFrame:
    """(bucket, n): word n-grams by blake2b-8 of the n-gram, big endian,
    modulo ``dim`` (no JVM builtin).  A task counts in ``dim`` numbers, so no
    n-gram leaves it and it holds no more whatever its input."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        @functools.lru_cache(1 << 17)
        def bucket(feature: str) -> int:
            return int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "big") % dim

        total = [0] * dim
        for batch in batches:
            for words in batch["tokens"]:
                for n in range(low, high + 1):
                    for gram in zip(*[words[k:] for k in range(n)]):
                        total[bucket(" ".join(gram))] += 1
        yield pd.DataFrame({"bucket": range(dim), "n": total}).query("n > 0")

    return with_tokens(docs).select("tokens").mapInPandas(counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def frequencies(counts: DataFrame, key: str) -> DataFrame:
    total = counts.agg(F.sum("n")).first()[0] or 1
    return counts.select(key, (F.col("n") / F.lit(float(total))).alias("f"))


def l2(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: the distance of two sparse frequency vectors."""
    both = a.withColumnRenamed("f", "fa").join(b.withColumnRenamed("f", "fb"), key, "full_outer")
    d = F.coalesce("fa", F.lit(0.0)) - F.coalesce("fb", F.lit(0.0))
    return both.agg(F.sqrt(F.coalesce(F.sum(d * d), F.lit(0.0))).alias("lexical_l2"))


def lexical_l2(a: DataFrame, b: DataFrame, dim: int = 4096, features: DataFrame | None = None, low: int = 1, high: int = 3) -> DataFrame:
    """Distance over hashed n-grams, or over the listed ``features`` only.
    Hashed n-grams are counted by bucket where their text is."""
    sides = []
    for docs in (a, b):
        if features is not None:
            sides.append(frequencies(cut(feature_counts(docs, low, high).join(features.select("feature").distinct(), "feature")), "feature"))
        else:
            sides.append(frequencies(cut(hash_buckets(docs, dim, low, high)), "bucket"))
    return l2(*sides, "feature" if features is not None else "bucket")


def bucket(n: Column, edges: tuple) -> Column:
    out = F.lit(0)
    for e in edges:
        out = out + (n >= e).cast("int")
    return out


def opening(word: Column) -> Column:
    out = F.when(word.rlike(r"^\p{Nd}+$"), F.lit("number")).otherwise(F.lit("other"))
    for name in reversed(OPENINGS):
        out = F.when(word.isin(OPENINGS[name]), F.lit(name)).otherwise(out)
    return out


def structure(docs: DataFrame) -> DataFrame:
    """(kind, bucket, n): paragraph and sentence length buckets, openings."""
    t = F.coalesce("text", F.lit(""))
    par = docs.select(F.explode(paragraphs(t)).alias("x")).select(F.lit("paragraph").alias("kind"), bucket(F.size(tokens(F.col("x"))), PARAGRAPH_EDGES).cast("string").alias("bucket"))
    sent = docs.select(F.explode(sentences(t)).alias("x")).select(folded(F.col("x")).alias("w")).where(F.size("w") > 0)
    lengths = sent.select(F.lit("sentence").alias("kind"), bucket(F.size("w"), SENTENCE_EDGES).cast("string").alias("bucket"))
    opens = sent.select(F.lit("opening").alias("kind"), opening(F.get("w", F.lit(0))).alias("bucket"))
    return par.union(lengths).union(opens).groupBy("kind", "bucket").agg(F.count(F.lit(1)).alias("n"))


def all_buckets(spark) -> DataFrame:
    names = [("paragraph", str(i)) for i in range(len(PARAGRAPH_EDGES) + 1)] + [("sentence", str(i)) for i in range(len(SENTENCE_EDGES) + 1)] + [("opening", x) for x in [*OPENINGS, "number", "other"]]
    return spark.createDataFrame(names, "kind string, bucket string")


def structural(a: DataFrame, b: DataFrame) -> DataFrame:
    """(kind, js): base-2 Jensen-Shannon distance of each histogram; an
    empty histogram counts as uniform."""
    rows = all_buckets(a.sparkSession)
    for name, docs in (("p", a), ("q", b)):
        h = structure(docs).withColumnRenamed("n", f"n{name}")
        w = Window.partitionBy("kind")
        rows = rows.join(h, ["kind", "bucket"], "left").withColumn(f"n{name}", F.coalesce(f"n{name}", F.lit(0)))
        total = F.sum(f"n{name}").over(w)
        rows = rows.withColumn(name, F.when(total == 0, 1.0 / F.count(F.lit(1)).over(w)).otherwise(F.col(f"n{name}") / total))
    m = (F.col("p") + F.col("q")) / 2
    half = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log2(F.col(x) / m)).otherwise(0.0)
    return rows.groupBy("kind").agg(F.sqrt(F.greatest(F.lit(0.0), (F.sum(half("p")) + F.sum(half("q"))) / 2)).alias("js"))


def script_rate(text: Column) -> Column:
    """Share of letters that are not Latin; 0 without letters."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return F.when(letters == 0, F.lit(0.0)).otherwise(1 - F.length(F.regexp_replace(text, r"[^\p{L}]|[^\p{IsLatin}]", "")) / letters)


def language_integrity(docs: DataFrame, low: float | None, high: float | None) -> DataFrame:
    """One row: the mean share of other scripts, and whether it is in range.
    An empty table has no mean and is an error."""
    mean = F.avg(script_rate(F.coalesce("text", F.lit(""))))
    none = F.raise_error(F.lit("language integrity of no texts")).cast("double")
    mean = docs.agg(F.when(F.count(F.lit(1)) > 0, mean).otherwise(none).alias("mean_script_rate"))
    return mean.withColumn("language_integrity", in_range(F.col("mean_script_rate"), F.lit(low).cast("double"), F.lit(high).cast("double")))


def repeated_start(text: Column, run: int = 3) -> Column:
    """Whether ``run`` sentences in a row begin with the same word."""
    firsts = F.filter(F.transform(sentences(text), lambda s: F.get(folded(s), F.lit(0))), lambda w: w.isNotNull())
    longest = F.aggregate(
        firsts,
        F.struct(F.lit("").alias("w"), F.lit(0).alias("n"), F.lit(0).alias("top")),
        lambda s, w: F.struct(w.alias("w"), F.when(s["w"] == w, s["n"] + 1).otherwise(1).alias("n"), F.greatest(s["top"], F.when(s["w"] == w, s["n"] + 1).otherwise(1)).alias("top")),
        lambda s: s["top"],
    )
    return longest >= run


def length_stats(docs: DataFrame, target: str | None = None) -> DataFrame:
    n = F.size(tokens(F.coalesce("text", F.lit("")))).cast("double")
    aggs = [F.avg(n).alias("mean"), F.percentile(n, F.lit(0.5)).alias("median"), F.min(n).alias("min"), F.max(n).alias("max")]
    if target:
        aggs.append(F.avg(F.abs(n - F.col(target))).alias("mae"))
    out = docs.agg(*aggs)
    return out.select(*[F.coalesce(c, F.lit(0.0)).alias(c) for c in out.columns])


def facts_of(outline: Column) -> Column:
    """Supported facts, then quotations (a quotation repeats its fact)."""
    return F.flatten(F.transform(outline, lambda o: F.concat(F.coalesce(o["supported_facts"], F.array().cast("array<string>")), F.coalesce(o["quotations"], F.array().cast("array<string>")))))


#: Keys of an outline's objects that hold facts, in their order.
FACT_KEYS = ("supported_facts", "facts", "quotations")


def free_facts(rows: DataFrame, key: str, outline: str = "outline") -> DataFrame:
    """(key, facts) of outlines of any shape, as JSON text or VARIANT: null
    has none, a text is one, an object has those of FACT_KEYS in their
    order, a list those of its elements.  Numbers and truth values hold no
    facts.  ``key`` is unique.

    The tree is walked level by level inside the engine: every round spreads
    the lists and objects that are left over one more level, without a
    shuffle, and a fact remembers its way down, which orders it.
    """
    tree = F.col(outline) if dict(rows.dtypes)[outline] == "variant" else F.try_parse_json(outline)
    level = rows.select(key, F.array().cast("array<int>").alias("way"), tree.alias("v"))
    facts = None
    while True:
        kind = F.schema_of_variant("v")
        kinds = cut(level.where("v IS NOT NULL").withColumn("kind", kind))
        found = kinds.where("kind = 'STRING'").select(key, "way", F.try_variant_get("v", "$", "string").alias("fact"))
        facts = found if facts is None else facts.unionByName(found)
        lists = kinds.where("startswith(kind, 'ARRAY')").select(key, "way", F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("at", "child"))
        named = F.array(*[F.try_variant_get("v", f"$.{k}", "variant") for k in FACT_KEYS])
        objects = kinds.where("startswith(kind, 'OBJECT')").select(key, "way", F.posexplode(named).alias("at", "child"))
        level = lists.unionByName(objects).select(key, F.concat("way", F.array("at")).alias("way"), F.col("child").alias("v"))
        if kinds.where("startswith(kind, 'ARRAY') OR startswith(kind, 'OBJECT')").isEmpty():
            break
    own = facts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("way", "fact"))), lambda x: x["fact"]).alias("facts"))
    return rows.select(key).join(own, key, "left").select(key, F.coalesce("facts", F.array().cast("array<string>")).alias("facts"))


def fact_recall(pairs: DataFrame, bar: float = 0.8) -> DataFrame:
    """(text, facts): share of facts covered by their own text; 1 if none."""
    spread = with_tokens(pairs).select("tokens", F.explode("facts").alias("fact"))
    return spread.agg(F.coalesce(F.avg((overlap(folded(F.col("fact")), F.col("tokens")) >= bar).cast("double")), F.lit(1.0)).alias("fact_recall"))


def unsupported_rate(pairs: DataFrame, bar: float = 0.6, least: int = 4) -> DataFrame:
    """Share of claims (sentences of ``least`` tokens) no fact supports."""
    hashed = lambda words: F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))
    # facts are folded once for a text, below the rows of its claims
    texts = pairs.select(F.transform("facts", lambda f: hashed(folded(f))).alias("facts"), F.coalesce("text", F.lit("")).alias("text"))
    claims = texts.select("facts", F.explode(sentences(F.col("text"))).alias("s")).withColumn("words", folded(F.col("s"))).where(F.size("words") >= least)
    rows = claims.select("facts", hashed(F.col("words")).alias("claim"))
    fewer = lambda f: F.least(F.size("claim"), F.size(f))
    backed = F.exists("facts", lambda f: F.when(fewer(f) == 0, 1.0).otherwise(F.size(F.array_intersect("claim", f)) / fewer(f)) >= bar)
    return rows.agg(F.coalesce(F.avg((~backed).cast("double")), F.lit(0.0)).alias("unsupported_rate"))


#: Words of a piece of documents whose n-grams a task counts at once, and n-grams that meet in a bucket.
PIECE, BUCKET = 1_000_000, 2_000_000
ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers whose every bit depends on all bits of ``x``."""
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
    return x ^ (x >> np.uint64(31))


def planes(x: np.ndarray) -> bytes:
    """Numbers as all their lowest bytes, then the next ones: the highest of
    small numbers are alike and compress to nothing."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()


def unplaned(data: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def two_largest(h: np.ndarray, doc: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each n-gram ``h`` the two entries with the largest counts, sorted
    by n-gram, the largest first; and which entries are the largest."""
    by = np.lexsort((-c, h))
    h, doc, c = h[by], doc[by], c[by]
    top = np.append(True, h[1:] != h[:-1])
    kept = top | np.append(False, top[:-1])
    return h[kept], doc[kept], c[kept], top[kept]


def lost_grams(words: DataFrame, order: int) -> DataFrame:
    """(nth, lost): how many of a document's n-grams of each order no other
    document has as often, of (nth, words) with words as 64-bit hashes;
    ``nth`` counts on within a partition.

    A piece of documents is counted where it lies.  What leaves the task is a
    row for each bucket of n-gram hashes, which holds the piece's two largest
    counts of each n-gram as sorted 64-bit hashes, and a bucket answers with
    a row of counts for each piece.  So the exchange takes some eight bytes
    for a different n-gram of a document, and nothing is joined back.
    """
    total = words.agg(F.sum(F.size("words"))).first()[0] or 0
    bits = max(0, (total - 1) // BUCKET).bit_length()
    piece, edges = PIECE, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(0, np.uint64)

    def counted(values: np.ndarray, lens: np.ndarray) -> Iterator[tuple]:
        doc, end = np.repeat(np.arange(len(lens), dtype=np.uint32), lens), np.repeat(np.cumsum(lens), lens)
        g = mixed(values)
        for n in range(1, order + 1):
            if n > 1:
                g = mixed(g[:-1] * ODD + values[n - 1 :])
            whole = np.arange(n, n + len(g)) <= end[: len(g)]
            h, d = g[whole], doc[: len(g)][whole]
            if not len(h):
                return
            by = np.argsort(h, kind="stable")
            h, d = h[by], d[by]
            new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])))
            h, d, c, _ = two_largest(h[new], d[new], np.diff(np.append(new, len(h))).astype(np.int32))
            at = np.concatenate([[0], np.searchsorted(h, edges), [len(h)]])
            for b, (low, high) in enumerate(zip(at, at[1:])):
                if low < high:
                    own = h[low:high]
                    yield n, b, len(lens), planes(np.append(own[:1], np.diff(own))), planes(d[low:high]), planes(c[low:high])

    names = ["first", "n", "bucket", "docs", "h", "doc", "c"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nth = batch.column(0).to_numpy()
            lens = pc.list_value_length(batch.column(1)).to_numpy()
            values = batch.column(1).flatten().to_numpy().view(np.uint64)
            ends = np.cumsum(lens)
            low, past = 0, 0
            while low < len(lens):
                high = max(low + 1, int(np.searchsorted(ends, past + piece, "right")))
                rows = [(nth[low], *r) for r in counted(values[past : ends[high - 1]], lens[low:high])]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)
                low, past = high, int(ends[high - 1])

    def clipped(part: pd.DataFrame) -> pd.DataFrame:
        base = np.append(0, np.cumsum(part["docs"]))
        h = np.concatenate([np.cumsum(unplaned(x, np.uint64), dtype=np.uint64) for x in part["h"]])
        doc = np.concatenate([unplaned(x, np.uint32) + start for x, start in zip(part["doc"], base)])
        h, doc, c, top = two_largest(h, doc, np.concatenate([unplaned(x, np.int32) for x in part["c"]]))
        second = np.where(np.append(top[1:], True), 0, np.append(c[1:], 0))
        lost = np.bincount(doc[top], (c - second)[top], base[-1]).astype(np.int32)
        return pd.DataFrame({"first": part["first"], "n": part["n"], "lost": [planes(lost[i:j]) for i, j in zip(base, base[1:])]})

    def summed(part: pd.DataFrame) -> pd.DataFrame:
        lost = np.zeros((len(part["lost"].iloc[0]) // 4, order), np.int64)
        for n, x in zip(part["n"], part["lost"]):
            lost[:, n - 1] += unplaned(x, np.int32)
        return pd.DataFrame({"nth": part["first"].iloc[0] + np.arange(len(lost)), "lost": list(lost)})

    rows = words.select("nth", "words").mapInArrow(spread, "first long, n int, bucket int, docs int, h binary, doc binary, c binary")
    answers = rows.groupBy("n", "bucket").applyInPandas(clipped, "first long, n int, lost binary")
    return answers.groupBy("first").applyInPandas(summed, "nth long, lost array<long>")


def bleu_vs_rest(docs: DataFrame, key: str, text: str = "text", order: int = 4) -> DataFrame:
    """(key, bleu): each document against all others, without a cross join.

    A document's count of an n-gram is clipped at the largest count among
    the others.  That takes something away only from the one document that
    alone has the largest count of all: the distance to the second.  So an
    n-gram's two largest counts are all that is needed, and map tasks pass on
    no more than two of each.  64 bits stand for an n-gram.  The closest
    other length comes from the histogram of lengths.
    """
    hashes = with_tokens(docs, text).select(key, F.transform("tokens", lambda w: F.xxhash64(w)).alias("words"))
    words = cut(hashes.withColumn("nth", F.monotonically_increasing_id()))
    lengths = words.select(key, "nth", F.size("words").alias("len"))
    hist = lengths.groupBy("len").agg(F.count(F.lit(1)).alias("k"))
    w = Window.orderBy("len")  # one row for each distinct length
    prev, nxt = F.lag("len").over(w), F.lead("len").over(w)
    near = hist.select("len", F.when(F.col("k") > 1, F.col("len")).when(nxt.isNull() | (F.col("len") - prev <= nxt - F.col("len")), F.coalesce(prev, nxt)).otherwise(nxt).alias("r"))
    rows = lengths.join(near, "len").join(lost_grams(words, order), "nth", "left")
    lost = lambda o: F.coalesce(F.get("lost", F.lit(o - 1)), F.lit(0))
    logs = [F.when(F.col("len") >= o, F.log((F.col("len") - o + 2 - lost(o)) / (F.col("len") - o + 2))).otherwise(0.0) for o in range(1, order + 1)]
    brevity = F.when(F.col("len") > F.col("r"), 1.0).otherwise(F.exp(1 - F.col("r") / F.col("len")))
    bleu = brevity * F.exp(sum(logs[1:], logs[0]) / F.least(F.lit(order), "len"))
    return rows.select(key, F.when(F.col("len") > 0, F.coalesce(bleu, F.lit(0.0))).otherwise(0.0).alias("bleu"))


def self_bleu(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    return bleu_vs_rest(docs, key, text).agg(F.when(F.count(F.lit(1)) < 2, 0.0).otherwise(F.avg("bleu")).alias("self_bleu"))


def collapse(self_bleu_: Column, repetition: Column, script: Column) -> Column:
    """Whether a corpus fails the fixed collapse thresholds."""
    return ~((self_bleu_ <= 0.95) & (repetition <= 0.9) & (script <= 0.15))


def calibration(docs: DataFrame, key: str) -> DataFrame:
    """One row of quantiles: BLEU, repetition and script rate at 2.5 and
    97.5 %, paragraph and sentence lengths at 10, 50 and 90 %."""
    ends, mids = F.array(F.lit(0.025), F.lit(0.975)), F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))
    t = F.coalesce("text", F.lit(""))
    row = bleu_vs_rest(docs, key).agg(F.percentile("bleu", ends).alias("self_bleu"))
    row = row.crossJoin(docs.agg(F.percentile(repeated_start(t).cast("double"), ends).alias("repetition"), F.percentile(script_rate(t), ends).alias("script_rate")))
    for name, cutter in (("paragraph_length", paragraphs), ("sentence_length", sentences)):
        row = row.crossJoin(docs.select(F.explode(cutter(t)).alias("x")).agg(F.percentile(F.size(tokens(F.col("x"))).cast("double"), mids).alias(name)))
    return row
