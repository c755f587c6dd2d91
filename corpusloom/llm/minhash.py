"""Near-duplicates by HyperMinHash registers.

A document is the set of its distinct ``WIDTH``-word shingles, hashed to 64
bits.  The top bits of a hash choose one of ``REGISTERS`` buckets; of the
smallest remainder in a bucket the register keeps the number of leading
zeros and ``MANTISSA`` bits after them, two bytes in all.  A bucket without
shingles copies the register of the first occupied one in a fixed random
order of its own, so that short texts have meaningful registers too.

Four registers make a band, 32 bands a document.  Two sets of Jaccard
similarity J agree in a register with probability J, so a pair at 0.8 has no
band in common with probability (1 - 0.8**4)**32 < 5e-8.

Documents with equal sets are one set from the start.  Sets are then linked
in two steps:

* the star: in each band the set with the smallest hash is the band's hub;
  each set is compared with the most similar of its hubs.  That joins groups
  of copies with one comparison a set.
* the rest: in bands whose sets still belong to several components, sets of
  different components are compared register by register, in tiles of
  ``TILE`` sets, so a large band is many tasks and no task holds a band.
  A tile returns links that join its components, never its pairs.

Either way a pair must pass the estimate of its similarity, which takes the
chance collisions of compressed registers out of the share of equal ones and
leaves a margin of six standard deviations, and is then confirmed on the
whole sets.  No pair of copies of one text is ever made, and pairs within a
component are left out.

Rows that are joined on a hot key (a band, a hub, a component or a set of
many copies) are a few longs and meet a table in which the key is unique,
so Spark's skew join splits them.

Defined cases: null, empty and blank texts have no shingles and link with
nothing; a text with fewer words than a shingle is one shingle; rows that
are repeated and equal texts share a set; null ids are ignored when the
smallest id of a component is taken (all null: null) and never kept; very
long texts are hashed whole, in pieces; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.plans.joins import split_by_keys
from corpusloom.session import cut

WIDTH = 2
LOW, HIGH = 80, 100
REGISTERS = 128
MANTISSA = 10
BAND = 4
TILE = 512
SEED = 42
PIECE = 1 << 20
#: Distinct words whose hashes a task remembers.
WORDS = 1 << 17
_GOLD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class WordHashes(dict):
    """Hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= WORDS:
            self.clear()
        self[word] = h = xxh64_intdigest(word, SEED)
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text, A-Z in lower case, in pieces."""
    start = 0
    while start < len(text):
        end = start + PIECE
        while end < len(text) and text[end] not in b"\x20\x09\x0a\x0b\x0c\x0d":
            end += 1
        yield text[start:end].lower().split()
        start = end


def shingles(text: bytes | None, known: WordHashes, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    parts = [np.fromiter(map(known.__getitem__, w), np.uint64, len(w)) for w in pieces(text or b"")]
    words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    if not len(words):
        return words
    n = max(1, len(words) - width + 1)
    h = np.full(n, min(width, len(words)), np.uint64)
    for i in range(min(width, len(words))):
        h = mixed(h * _GOLD + words[i : i + n])
    return np.unique(h)


def _order(registers: int) -> np.ndarray:
    """For every bucket the order in which it looks for an occupied one."""
    rng = np.random.default_rng(SEED)
    return np.stack([rng.permutation(registers) for _ in range(registers)])


def registers(hashes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The compressed registers of a set that is not empty."""
    m = len(order)
    left = 64 - (m.bit_length() - 1)
    bucket = (hashes >> np.uint64(left)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    least = hashes[first] & np.uint64((1 << left) - 1)
    fraction, exponent = np.frexp(least.astype(np.float64))
    value = np.where(least == 0, (left + 1) << MANTISSA, ((left - exponent) << MANTISSA) + ((2 * fraction - 1) * (1 << MANTISSA)).astype(np.int64))
    out, held = np.zeros(m, np.int64), np.zeros(m, bool)
    out[bucket[first]], held[bucket[first]] = value, True
    empty = np.flatnonzero(~held)
    if len(empty):
        out[empty] = out[order[empty, held[order[empty]].argmax(axis=1)]]
    return out.astype(np.uint16)


def collision(n: float, m: int = REGISTERS) -> float:
    """The probability that registers of two unrelated sets of ``n`` shingles
    are equal: over all values of a register, the squared probability that
    the smallest of n / m uniform numbers has it."""
    per = max(1.0, n / m)
    # the smallest is hardly ever 2**24 times smaller than expected
    zeros = np.arange(min(64, int(np.log2(per)) + 24))[:, None]
    low = 2.0 ** -(zeros + 1) * (1 + np.arange(1 << MANTISSA)[None, :] / (1 << MANTISSA))
    high = low + 2.0 ** -(zeros + 1) / (1 << MANTISSA)
    with np.errstate(divide="ignore"):
        above = lambda x: np.exp(per * np.log1p(-x))
        return float(((above(low) - above(high)) ** 2).sum())


@lru_cache
def collisions(m: int = REGISTERS) -> tuple[np.ndarray, np.ndarray]:
    """``collision`` by the logarithm of a set's size, as a table."""
    sizes = np.arange(0, 41)
    return sizes, np.array([collision(2.0**k, m) for k in sizes])


def corrected(equal: np.ndarray, n: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """The similarity of sets of about ``n`` shingles that have this share of
    equal registers, less what chance collisions add to it."""
    c = np.interp(np.log2(np.maximum(1, n)), *collisions(m))
    return (equal - c) / (1 - c)


def bar(low: int = LOW, high: int = HIGH, m: int = REGISTERS) -> float:
    """What the estimate of a pair to be linked will not fall below, by six
    standard deviations."""
    j = low / high
    return j - 6 * (j * (1 - j) / m) ** 0.5


def sketch(docs: DataFrame, width: int = WIDTH, m: int = REGISTERS) -> DataFrame:
    """(doc_id, text_key, n, key_a, key_b, registers): checkpointed, one row
    per document; the keys name its set."""
    kind = dict(docs.dtypes)["doc_id"]

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, order = WordHashes(), _order(m)
        for b in batches:
            n, a, c, regs = [], [], [], []
            for text in b.column(2):
                h = shingles(text.as_py(), known, width)
                n.append(len(h))
                with np.errstate(over="ignore"):
                    a.append(int(h.sum(dtype=np.uint64)) - (1 << 63))
                    c.append(int(mixed(h * _GOLD).sum(dtype=np.uint64)) - (1 << 63))
                regs.append(registers(h, order).tobytes() if len(h) else None)
            columns = [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(regs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "n", "key_a", "key_b", "registers"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.col("text").cast("binary").alias("text"))
    return cut(rows.mapInArrow(marked, f"doc_id {kind}, text_key long, n long, key_a long, key_b long, registers binary"))


def equal_share(a: pd.Series, b: pd.Series, m: int = REGISTERS) -> np.ndarray:
    flat = lambda s: np.frombuffer(b"".join(s), np.uint16).reshape(-1, m)
    return (flat(a) == flat(b)).mean(axis=1)


def estimated(m: int = REGISTERS):
    """A column function: the similarity that two sets' registers suggest."""

    @F.pandas_udf("double")
    def similarity(a: pd.Series, b: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(corrected(equal_share(a, b, m), n.to_numpy(), m))

    return similarity


def near_sizes(a: Column, b: Column, low: int = LOW, high: int = HIGH) -> Column:
    """Sets whose sizes are further apart can't be as similar."""
    return F.least(a, b) * high >= F.greatest(a, b) * low


def linked(pairs: DataFrame, content: DataFrame, low: int = LOW, high: int = HIGH) -> DataFrame:
    """The (a, b) of ``pairs`` whose whole sets are similar enough."""
    of = lambda s: content.select(F.col("set_id").alias(s), F.col("hashes").alias(f"hashes_{s}"))
    both = pairs.join(of("b"), "b").join(of("a"), "a")
    shared = F.size(F.array_intersect("hashes_a", "hashes_b"))
    return both.where(high * shared >= low * (F.size("hashes_a") + F.size("hashes_b") - shared)).select("a", "b")


def roots(edges: DataFrame) -> DataFrame:
    """(node, root) for every end of an edge: labels spread to neighbours and
    jump along pointers, one checkpoint a round."""
    both = cut(edges.union(edges.select("b", "a")).distinct())
    state = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")))
    while True:
        near = both.join(state.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("seen"))
        spread = state.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "seen").alias("root"))
        ups = spread.select(F.col("node").alias("root"), F.col("root").alias("up"))
        jumped = cut(spread.join(ups, "root").select("node", "old", F.least("root", "up").alias("root")))
        state = jumped.select("node", "root")
        if jumped.where("old <> root").isEmpty():
            return state


def tops(parents: DataFrame) -> DataFrame:
    """(a, b) with b the last of the parents above a.  Every a has one
    parent, whose hash is smaller, so no chain comes back to itself."""
    while True:
        above = parents.select(F.col("a").alias("b"), F.col("b").alias("next"))
        jumped = cut(parents.join(above, "b", "left").select("a", F.coalesce("next", "b").alias("b"), F.col("next").isNotNull().alias("moved")))
        parents = jumped.select("a", "b")
        if jumped.where("moved").isEmpty():
            return parents


def merged(state: DataFrame, edges: DataFrame) -> DataFrame:
    """``state`` (set_id, root) with the roots joined by ``edges`` made one."""
    left, right = (state.select(F.col("set_id").alias(s), F.col("root").alias(f"root_{s}")) for s in "ab")
    between = edges.join(left, "a").join(right, "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).where("a <> b").distinct()
    new = roots(between).select(F.col("node").alias("root"), F.col("root").alias("up"))
    return cut(state.join(new, "root", "left").select("set_id", F.coalesce("up", "root").alias("root")))


def tiles(rows: DataFrame) -> DataFrame:
    """``rows`` (band, size, set_id, ...) dealt into tiles (band, x, y): a
    band of up to ``TILE`` sets is one tile; a larger one is dealt into parts
    by the sets' hashes, and each two parts are a tile."""
    rows = rows.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("size") / TILE)).cast("int"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("set_id", F.lit(1)), F.col("parts")).cast("int"))
    met = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(k, F.col("part")).alias("x"), F.greatest(k, F.col("part")).alias("y")))).alias("met")
    return rows.select("*", met).select("met.*", *rows.columns).drop("parts", "size")


def per_tile(of: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """``of`` for each tile of a partition that is sorted by tile."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            if not len(b):
                continue
            key = b[["band", "x", "y"]].to_numpy()
            start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
            # one answer for all tiles of a batch: most are small or empty
            made = [x for x in (of(b.iloc[i:j]) for i, j in zip(start[:-1], start[1:])) if len(x)]
            if made:
                yield pd.concat(made, ignore_index=True)
            rest = b.iloc[start[-1] :]
        if rest is not None and len(rest):
            yield of(rest)

    return run


def candidates(rows: pd.DataFrame, m: int, low: int, high: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, others, estimates) of a tile: the rows of other components that
    may be as similar to row i as is asked.  A pair counts in the first band
    that both sets have, so in one tile of all."""
    part, root, n = (rows[c].to_numpy() for c in ("part", "root", "n"))
    flat = np.frombuffer(b"".join(rows["registers"]), np.uint16).reshape(-1, m)
    x, y, k = (rows[c].iloc[0] for c in ("x", "y", "k"))
    least, right = bar(low, high, m), np.flatnonzero(part == y)
    for i in np.flatnonzero(part == x):
        other = right[right > i] if x == y else right
        other = other[(root[other] != root[i]) & (np.minimum(n[other], n[i]) * high >= np.maximum(n[other], n[i]) * low)]
        if len(other):
            same = flat[other] == flat[i]
            guess = corrected(same.mean(axis=1), n[other], m)
            use = (same.reshape(len(other), -1, BAND).all(axis=2).argmax(axis=1) == k) & (guess >= least)
            if use.any():
                yield i, other[use], guess[use]


def tile_links(rows: pd.DataFrame, m: int, low: int, high: int) -> pd.DataFrame:
    """(a, b): links that join all components of a tile which its similar
    pairs join.  Pairs are confirmed on the whole sets, the likeliest first,
    and left out once their components are one."""
    found = list(candidates(rows, m, low, high))
    out = []
    if found:
        ids, names = rows["set_id"].to_numpy(), np.unique(rows["root"].to_numpy(), return_inverse=True)[1]
        up = np.arange(names.max() + 1)
        sizes = rows["n"].to_numpy()
        codes = np.unique(np.concatenate(rows["hashes"].to_list()), return_inverse=True)[1]
        ends = np.cumsum(sizes)
        mark = np.zeros(codes.max() + 1, bool)

        def top(k: int) -> int:
            while up[k] != k:
                up[k] = k = up[up[k]]
            return k

        for i, other, _ in sorted(found, key=lambda f: -f[2].max()):
            own = codes[ends[i] - sizes[i] : ends[i]]
            mark[own] = True
            for j in other:
                a, b = top(names[i]), top(names[j])
                if a != b:
                    shared = int(mark[codes[ends[j] - sizes[j] : ends[j]]].sum())
                    if high * shared >= low * (sizes[i] + sizes[j] - shared):
                        up[max(a, b)] = min(a, b)
                        out.append((ids[i], ids[j]))
            mark[own] = False
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def rest_links(rows: DataFrame, content: DataFrame, m: int = REGISTERS, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(a, b): links between components within bands.  ``rows`` are (band, k,
    size, set_id, root, n, registers), k being the band's place.

    The registers say first which sets of a tile have a pair that may be
    similar; only these come together again with their whole sets.  What
    leaves a tile are members and links that join its components, never its
    pairs.
    """
    tile = ["band", "x", "y"]
    facts = ["k", "part", "set_id", "root", "n", "registers"]

    def members(rows: pd.DataFrame) -> pd.DataFrame:
        used = sorted({int(j) for i, other, _ in candidates(rows, m, low, high) for j in (i, *other)})
        return rows.iloc[used]

    def placed(df: DataFrame) -> DataFrame:
        return df.repartition(*tile).sortWithinPartitions(*tile)

    kept = placed(tiles(rows).select(*tile, *facts)).mapInPandas(per_tile(members), "band long, x int, y int, k int, part int, set_id long, root long, n long, registers binary")
    whole = cut(kept).join(content, "set_id").select(*tile, *facts, "hashes")
    return placed(whole).mapInPandas(per_tile(lambda rows: tile_links(rows, m, low, high)), "a long, b long")


def set_components(sets: DataFrame, docs: DataFrame, width: int = WIDTH, low: int = LOW, high: int = HIGH, m: int = REGISTERS) -> DataFrame:
    """(set_id, root) of the sets that are linked to others.  ``sets`` are
    (set_id, n, text_key, registers); the texts are read in ``docs``."""
    hashes = F.transform(F.sequence(F.lit(0), F.lit(m // BAND - 1)), lambda k: F.xxhash64(k, F.expr("registers").substr(k * (2 * BAND) + 1, F.lit(2 * BAND))))
    bands = sets.select("set_id", F.posexplode(hashes).alias("k", "band"))
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("band")
    active = cut(bands.join(shared, "band"))
    members = cut(sets.join(active.select("set_id").distinct(), "set_id").select("set_id", "n", "registers", "text_key"))
    content = whole_sets(members, docs, width)

    # the star: every set and the most similar of the hubs of its bands
    hubs = active.groupBy("band").agg(F.min(F.struct(F.xxhash64("set_id"), F.col("set_id"))).alias("hub")).select("band", F.col("hub.set_id").alias("b"))
    pairs = active.join(hubs, "band").where("set_id <> b").select(F.col("set_id").alias("a"), "b").distinct()
    side = lambda s: members.select(F.col("set_id").alias(s), F.col("n").alias(f"n_{s}"), F.col("registers").alias(f"registers_{s}"))
    pairs = pairs.join(side("b"), "b").join(side("a"), "a").where(near_sizes(F.col("n_a"), F.col("n_b"), low, high))
    guess = pairs.select("a", "b", estimated(m)("registers_a", "registers_b", "n_a").alias("s")).where(F.col("s") >= bar(low, high, m))
    best = cut(guess.groupBy("a").agg(F.max_by("b", F.struct("s", -F.col("b"))).alias("b")))
    up = tops(cut(linked(best, content, low, high)))
    state = cut(members.select("set_id").join(up.select(F.col("a").alias("set_id"), "b"), "set_id", "left").select("set_id", F.coalesce("b", "set_id").alias("root")))

    # the rest: pairs of different components in a band
    rooted = active.join(state, "set_id")
    several = rooted.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("size")).where("x < y").select("band", "size")
    rows = rooted.join(several, "band").join(members.select("set_id", "n", "registers"), "set_id")
    edges = cut(rest_links(rows, content, m, low, high))
    return state if edges.isEmpty() else merged(state, edges)


def whole_sets(members: DataFrame, docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(set_id, hashes): checkpointed shingle sets of ``members``, hashed
    again from the texts that their ``text_key`` names, where they lie."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                piece = b.slice(at, 256)
                sets = [shingles(t.as_py(), known, width).view(np.int64) for t in piece.column(1)]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(sets, pa.list_(pa.int64()))], ["text_key", "hashes"])

    texts = docs.select(F.xxhash64("text").alias("text_key"), F.col("text").cast("binary").alias("text"))
    wanted, _ = split_by_keys(texts, members.select("text_key"), ["text_key"])
    found = wanted.dropDuplicates(["text_key"]).mapInArrow(hashed, "text_key long, hashes array<long>")
    return cut(members.select("set_id", "text_key").join(found, "text_key").select("set_id", "hashes"))


def clusters(docs: DataFrame, width: int = WIDTH, low: int = LOW, high: int = HIGH, m: int = REGISTERS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per document."""
    rows = sketch(docs, width, m)
    keys = ["n", "key_a", "key_b"]
    # a number for every distinct set, fixed by the checkpoint
    sets = cut(
        rows.where("n > 0").groupBy(*keys)
        .agg(F.min("doc_id").alias("least"), F.min("text_key").alias("text_key"), F.first("registers").alias("registers"))
        .withColumn("set_id", F.monotonically_increasing_id())
    )
    state = set_components(sets, docs, width, low, high, m)
    of = sets.select(*keys, "set_id", "least").join(state, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    tops = of.groupBy("root").agg(F.min("least").alias("component_id"))
    named = of.join(tops, "root").select(*keys, "component_id")
    inside = rows.where("n > 0").select("doc_id", *keys).join(named, keys).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return inside.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
