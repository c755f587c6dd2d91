"""SimHash near-duplicates by a binary-trie self-join.

Fingerprints of 64 bits link at ``budget`` or fewer differing bits, and the
linked groups are the connected components.

The self-join walks a binary trie over the distinct fingerprints two nodes
at a time: a pair of nodes at the same depth carries the number of bits in
which its prefixes differ and is dropped as soon as that exceeds the
budget; equal children cost nothing, crossed children cost one.  When the
bits left fit into the budget all below is linked at once.

To share the trie among tasks it is rotated: of four 16-bit blocks, two
fingerprints within three bits agree in at least one, so in the trie whose
top levels are that block the pair stays together below one node of depth
16.  Each fingerprint thus goes to four nodes, and tasks own whole nodes.  A
node with many times its share of fingerprints is rotated once more in its
lower 48 bits (four blocks of 12), so it is split over up to 4 x 4096
nodes of depth 28, again without losing a pair.

Tasks return a spanning forest of the links they find, never all pairs;
the forests are joined by label propagation with pointer jumping on
checkpointed tables.

Defined cases: null, empty and blank texts have fingerprint zero and link
like any other; equal texts share a fingerprint; null ids are ignored when
the smallest id of a component is taken (all null: null); an empty table
gives no rows; very long texts are hashed whole in blocks of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.llm.textcols import row_hash
from corpusloom.plans.joins import join_counted, split_by_keys
from corpusloom.session import cut

SHINGLE = 3
SEED = 42
BUDGET = 3
BLOCKS = 4
#: A node of the rotated trie with more fingerprints than this, and more than
#: eight times the mean, is rotated again.
HOT = 2048
#: Below this many fingerprints on both sides a pair of nodes is compared directly.
LEAF = 8


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned SimHash of a whole text."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-1])]
    ends = ends[width - 1 :] or [len(joined)]
    n, counts = len(ends), np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        h = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[k : k + (1 << 16)], ends[k : k + (1 << 16)])], np.uint64)
        counts += np.unpackbits(h.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprint_udf(width: int = SHINGLE, seed: int = SEED):
    @F.pandas_udf("long")
    def signed(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, width, seed) for t in texts], np.uint64).view(np.int64))

    return signed


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union the links a-b into ``label``, a forest of smallest members."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        if not len(a):
            break
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def trie_links(keys: np.ndarray, depth: int, budget: int = BUDGET, chunk: int = 1 << 21) -> np.ndarray:
    """Label each of the sorted distinct ``keys`` (uint64) with the smallest
    index it is linked to, among keys that share their first ``depth`` bits.

    Nodes are index ranges; pairs of nodes are rows (lo, hi, lo2, hi2,
    differing bits).  Work lists longer than ``chunk`` go depth first, so
    memory stays bounded.
    """
    label = np.arange(len(keys), dtype=np.int64)
    if len(keys) < 2:
        return label
    top = keys >> np.uint64(64 - depth) if depth else np.zeros(len(keys), np.uint64)
    lo = np.flatnonzero(np.r_[True, top[1:] != top[:-1]])
    hi = np.r_[lo[1:], len(keys)]
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    stack = [(depth, np.stack([lo, hi, lo, hi, np.zeros_like(lo)]))]
    while stack:
        d, p = stack.pop()
        if p.shape[1] > chunk:
            stack += [(d, p[:, i : i + chunk]) for i in range(0, p.shape[1], chunk)]
            continue
        # pairs whose remaining bits fit into the budget are linked throughout
        whole = p[4] + (64 - d) <= budget
        small = ((p[1] - p[0]) <= LEAF) & ((p[3] - p[2]) <= LEAF) & ~whole
        if whole.any():
            q = p[:, whole]
            first, last = np.r_[q[0], q[2]], np.r_[q[1], q[3]]
            size = last - first
            at = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            merge(label, np.r_[np.repeat(first, size), q[0]], np.r_[at, q[2]])
        if small.any():
            q = p[:, small]
            n1, n2 = q[1] - q[0], q[3] - q[2]
            size = n1 * n2
            row = np.repeat(np.arange(len(size)), size)
            k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            i, j = q[0][row] + k // n2[row], q[2][row] + k % n2[row]
            near = (i < j) & (popcount(keys[i] ^ keys[j]) <= budget)
            merge(label, i[near], j[near])
        p = p[:, ~(whole | small)]
        if not p.shape[1]:
            continue
        own = p[0] == p[2]
        bit = np.uint64(1 << (63 - d))
        mask = np.uint64((1 << 64) - (1 << (63 - d)))

        def middle(lo, hi):
            return np.clip(np.searchsorted(keys, (keys[lo] & mask) | bit), lo, hi)

        m1, m2 = middle(p[0], p[1]), middle(p[2], p[3])
        cross = ~own
        children = [
            np.stack([p[0], m1, p[2], m2, p[4]]),
            np.stack([m1, p[1], m2, p[3], p[4]]),
            np.stack([p[0], m1, m2, p[3], p[4] + 1]),
            np.stack([m1, p[1], p[2], m2, p[4] + 1])[:, cross],
        ]
        p = np.concatenate(children, axis=1)
        p = p[:, (p[1] > p[0]) & (p[3] > p[2]) & (p[4] <= budget) & ~((p[0] == p[2]) & (p[1] - p[0] < 2))]
        if p.shape[1]:
            stack.append((d + 1, p))
    return label


def rotate(fp: Column, bits: int) -> Column:
    if not bits:
        return fp
    return F.shiftleft(fp, bits).bitwiseOR(F.shiftrightunsigned(fp, 64 - bits))


def _second(key: Column, sub: int) -> Column:
    """``key`` with its lower 48 bits rotated left by 12 * sub."""
    if not sub:
        return key
    low = key.bitwiseAND(F.lit((1 << 48) - 1))
    turned = F.shiftleft(low, 12 * sub).bitwiseOR(F.shiftrightunsigned(low, 48 - 12 * sub)).bitwiseAND(F.lit((1 << 48) - 1))
    return F.shiftleft(F.shiftrightunsigned(key, 48), 48).bitwiseOR(turned)


def links(fps: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(a, b): a spanning forest, per task, of the links between the
    distinct fingerprints in column ``fp``."""
    if budget >= BLOCKS:
        raise ValueError(f"the rotated trie finds all links up to {BLOCKS - 1} differing bits")
    spun = fps.select("fp", F.posexplode(F.array(*[rotate(F.col("fp"), 16 * b) for b in range(BLOCKS)])).alias("block", "key"))
    spun = spun.withColumn("top", F.shiftrightunsigned("key", 48))
    n = fps.count()
    nodes = spun.groupBy("block", "top").agg(F.count(F.lit(1)).alias("n"))
    # at most BLOCKS * 65536 / 8 nodes can hold eight times the mean
    hot = F.broadcast(nodes.where(F.col("n") > max(HOT, 8 * n // 65536)).select("block", "top", F.lit(True).alias("hot")))
    spun = spun.join(hot, ["block", "top"], "left")
    subs = F.when(F.col("hot"), F.array(*[F.struct(F.lit(s).alias("sub"), _second(F.col("key"), s).alias("key")) for s in range(4)])).otherwise(F.array(F.struct(F.lit(-1).alias("sub"), F.col("key").alias("key"))))
    dealt = spun.select("fp", "block", F.inline(subs).alias("sub", "key"))
    node = F.when(F.col("sub") < 0, F.shiftrightunsigned("key", 48)).otherwise(F.shiftrightunsigned("key", 36))
    parts = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // 500_000)
    dealt = dealt.withColumn("node", node).repartition(parts, "block", "sub", "node").select("fp", "key", (F.col("block") * 8 + F.col("sub")).alias("trie"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True)
        trie = rows["trie"].to_numpy()
        for t in np.unique(trie):
            own = rows[trie == t]
            keys, fp = own["key"].to_numpy().view(np.uint64), own["fp"].to_numpy()
            order = np.argsort(keys, kind="stable")
            keys, fp = keys[order], fp[order]
            label = trie_links(keys, 16 if t % 8 == 7 else 28, budget)
            linked = label != np.arange(len(label))
            if linked.any():
                yield pd.DataFrame({"a": fp[linked], "b": fp[label[linked]]})

    return dealt.mapInPandas(walk, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(fp, root) for every end of an edge: root is the same throughout a
    component.  Labels spread to neighbours and jump along pointers.  The
    hub of a star and the root of a giant component are hot keys, so both
    joins go by counts."""
    both = cut(edges.union(edges.select("b", "a")).distinct())
    state = cut(both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select(F.col("a").alias("fp"), F.least("a", "m").alias("root"), "n"))
    if state.isEmpty():
        return state.select("fp", "root")
    while True:
        near = join_counted(both, state.withColumnRenamed("fp", "b"), "b", "n").groupBy("a").agg(F.min("root").alias("seen"))
        spread = cut(state.join(near, state["fp"] == near["a"]).select("fp", "n", F.col("root").alias("old"), F.least("root", "seen").alias("root")))
        under = spread.groupBy("root").agg(F.count(F.lit(1)).alias("k"))
        ups = cut(spread.select(F.col("fp").alias("root"), F.col("root").alias("up")).join(under, "root"))
        jumped = cut(join_counted(spread, ups, "root", "k").select("fp", "n", "old", F.least("root", "up").alias("root")))
        changed = not jumped.where("old <> root").isEmpty()
        state = jumped.select("fp", "root", "n")
        if not changed:
            return state.select("fp", "root")


def marked(docs: DataFrame, width: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, text_key, fp) of every document: all that is needed of it."""
    return cut(docs.select("doc_id", F.xxhash64("text").alias("text_key"), fingerprint_udf(width, seed)(F.col("text")).alias("fp")))


def named(rows: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(fp, n, component_id, first): for each fingerprint of the ``marked``
    rows how many have it, and of its component the smallest id and the
    first (none, doc_id, text_key), ids before nulls."""
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    counted = cut(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"), F.min(first).alias("first")))
    linked = cut(components(links(counted.select("fp"), budget)).join(counted, "fp"))
    tops = cut(linked.groupBy("root").agg(F.count(F.lit(1)).alias("k"), F.min("least").alias("_least"), F.min("first").alias("_first")))
    of = join_counted(linked.select("fp", "root"), tops, "root", "k").select("fp", "_least", "_first", F.lit(True).alias("_linked"))
    own = counted.join(of, "fp", "left")
    return cut(own.select("fp", "n", F.when(F.col("_linked"), F.col("_least")).otherwise(F.col("least")).alias("component_id"), F.coalesce("_first", "first").alias("first")))


def clusters(docs: DataFrame, budget: int = BUDGET, width: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp, component_id): one row per document."""
    rows = marked(docs, width, seed)
    return join_counted(rows, named(rows, budget), "fp", "n").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, budget: int = BUDGET, width: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``docs`` with one document of each component: that with the smallest
    id, of equal ids that with the smallest text hash, without any id only
    if none has one.  Of rows that repeat its id and text one stays.

    No text is shuffled but those of repeated rows: what goes is named by
    id and text hash, and the documents are filtered where they are.
    """
    rows = marked(docs, width, seed)
    placed = join_counted(rows, named(rows, budget), "fp", "n")
    one = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & F.col("text_key").eqNullSafe(F.col("first.text_key"))
    judged = cut(placed.groupBy("doc_id", "text_key").agg(F.first(one).alias("one"), F.count(F.lit(1)).alias("n")).where("NOT one OR n > 1"))
    gone, again = judged.where("NOT one").select("doc_id", "text_key"), judged.where("one").select("doc_id", "text_key")
    own = docs.select(F.struct("*").alias("doc"), "doc_id", F.xxhash64("text").alias("text_key"))
    on = ["doc_id", "text_key"]
    _, left = split_by_keys(own, gone, on)
    if again.isEmpty():
        return left.select("doc.*")
    repeated, left = split_by_keys(left, again, on)
    order = row_hash(docs, "doc")
    best = repeated.groupBy(*on).agg(F.min_by("doc", order).alias("doc"))
    return left.select("doc.*").unionByName(best.select("doc.*"))
