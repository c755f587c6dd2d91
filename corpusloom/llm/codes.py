"""Product codes of vectors by filtering Lloyd iterations.

A vector is scaled to integers and cut into equal parts; each part position
has a codebook that starts as that part of the vectors with the smallest
ids and is refined in rounds.  All arithmetic is exact, so the codes do not
depend on how Spark has dealt the rows.

Every partition builds, once, kd-trees over its parts: implicit balanced
trees whose nodes keep their bounding box, sum and count.  The trees are
checkpointed as rows.  A round walks each tree from its root with all
entries of the codebook: in a node, the entry nearest to the middle of the
box eliminates every entry that no point of the box can be nearer to; a
node with a single entry left is assigned as a whole from its cached sum
and count, and only in the leaves are points compared.  Sums and counts are
added up by Spark, and one row for each part, entry and component reaches
the driver.

Defined cases: vectors that are null, empty, or hold null or non-finite
components are dropped, as are vectors whose length is not that of the
vector with the smallest id, and all when that length is not divisible by
the number of parts (an error names it).  With fewer vectors than entries
each codebook has as many entries as there are vectors.  Null ids come last
and equal ids in the order of their vectors.  Rows that are repeated count
as often as they occur.  Null labels are one label.  Components of any
finite size are exact (beyond 2**28 after scaling in unbounded integers,
slowly); errors beyond the largest long are given as the largest long.  An
empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.plans.joins import join_keyed
from corpusloom.session import cut

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096.0
#: Vectors in a tree, and the most points of a leaf.
TREE = 1 << 15
LEAF = 16
#: Scaled components below this keep squared distances within a long.
SAFE = 1 << 28
LIMB = 48
TOP = (1 << 63) - 1


def scaled(x: np.ndarray, scale: float = SCALE) -> np.ndarray:
    """floor(scale * x), exactly: longs where all are small, else integers
    without bound.  The scale is a power of two, so the product is exact."""
    y = np.floor(x * scale)
    if not y.size or np.abs(y).max() < SAFE:
        return y.astype(np.int64)
    return np.array([int(v) for v in y.ravel()], object).reshape(y.shape)


def grow(points: np.ndarray) -> dict:
    """A balanced kd-tree over the rows of ``points``.

    Level d has 2**d nodes and node k holds the rows from n*k >> d to
    n*(k+1) >> d of the permuted points, so children need no pointers.
    Each level splits every node at the middle of its widest dimension.
    """
    n = len(points)
    order, levels, depth = np.arange(n), [], 0
    while True:
        at = np.array([n * k >> depth for k in range((1 << depth) + 1)])
        held = points[order]
        low, high = (f.reduceat(held, at[:-1], axis=0) for f in (np.minimum, np.maximum))
        levels.append({"at": at, "low": low, "high": high, "sum": np.add.reduceat(held, at[:-1], axis=0)})
        if n >> depth <= LEAF:
            return {"points": held, "order": order, "levels": levels}
        node = np.repeat(np.arange(1 << depth), np.diff(at))
        widest = np.array((high - low).argmax(axis=1))
        key = held[np.arange(n), widest[node]]
        if key.dtype == object:
            key = np.unique(key, return_inverse=True)[1]
        order = order[np.lexsort((key, node))]
        depth += 1


def walk(tree: dict, book: np.ndarray):
    """Yield (entry, from, to, sum) for whole subtrees and (entries, from,
    to, None) for compared points, which together cover the tree."""
    points, levels = tree["points"], tree["levels"]
    wide = points.dtype == object or book.dtype == object
    book = book.astype(object) if wide else book
    norm = (book * book).sum(axis=1)
    index = np.arange(len(book))
    nodes, alive = np.array([0]), np.ones((1, len(book)), bool)
    for depth, level in enumerate(levels):
        low, high = level["low"][nodes], level["high"][nodes]
        low, high = (low.astype(object), high.astype(object)) if wide else (low.astype(np.int64), high.astype(np.int64))
        far = ((low + high)[:, None, :] - 2 * book[None, :, :]) ** 2
        far = far.sum(axis=2)
        far[~alive] = far.max() + 1
        best = np.array(far.argmin(axis=1))
        step = book[None, :, :] - book[best][:, None, :]
        corner = np.where(step > 0, high[:, None, :], low[:, None, :])
        # squared distance of the corner to the entry, less that to the best one
        ahead = norm[None, :] - norm[best][:, None] - 2 * (corner * step).sum(axis=2)
        alive &= ~((ahead > 0) | ((ahead == 0) & (index[None, :] > best[:, None])))
        single = alive.sum(axis=1) == 1
        at = level["at"]
        for k, entry in zip(nodes[single], alive[single].argmax(axis=1)):
            yield int(entry), at[k], at[k + 1], level["sum"][k]
        nodes, alive = nodes[~single], alive[~single]
        if not len(nodes):
            return
        if depth == len(levels) - 1:
            size = at[nodes + 1] - at[nodes]
            row = np.repeat(np.arange(len(nodes)), size)
            place = np.repeat(at[nodes], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            p = points[place].astype(object if wide else np.int64)
            d = ((p[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
            d[~alive[row]] = d.max() + 1
            entry = np.array(d.argmin(axis=1))
            ends = np.cumsum(size)
            for k, a, b in zip(nodes, ends - size, ends):
                yield entry[a:b], at[k], at[k + 1], None
            return
        nodes, alive = np.repeat(2 * nodes, 2) + np.tile([0, 1], len(nodes)), np.repeat(alive, 2, axis=0)


def assign(tree: dict, book: np.ndarray) -> np.ndarray:
    """The entry of each point, in the order in which the tree was given them."""
    entries = np.empty(len(tree["points"]), np.int64)
    for entry, a, b, _ in walk(tree, book):
        entries[a:b] = entry
    out = np.empty_like(entries)
    out[tree["order"]] = entries
    return out


def gather(tree: dict, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts, sums) of each entry's points."""
    counts, sums = np.zeros(len(book), np.int64), np.zeros(book.shape, tree["levels"][0]["sum"].dtype)
    for entry, a, b, whole in walk(tree, book):
        if whole is not None:
            counts[entry] += b - a
            sums[entry] += whole
        else:
            counts += np.bincount(entry, minlength=len(book))
            np.add.at(sums, entry, tree["points"][a:b].astype(sums.dtype))
    return counts, sums


def _small(a: np.ndarray) -> np.ndarray:
    return a if a.dtype == object or (len(a) and np.abs(a).max() >= 1 << 31) else a.astype(np.int32)


def packed(tree: dict) -> bytes:
    """The tree as bytes; points and boxes of 32 bits where they fit."""
    slim = [{"at": x["at"].astype(np.int32), "low": _small(x["low"]), "high": _small(x["high"]), "sum": x["sum"]} for x in tree["levels"]]
    return pickle.dumps({"points": _small(tree["points"]), "order": tree["order"].astype(np.int32), "levels": slim}, protocol=5)


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """``value`` as (place, long) with value = sum of long << LIMB * place."""
    at = 0
    while not -TOP - 1 <= value <= TOP:
        yield at, value & ((1 << LIMB) - 1)
        value >>= LIMB
        at += 1
    yield at, value


def forest(vectors: DataFrame, dim: int, parts: int = PARTS, scale: float = SCALE) -> DataFrame:
    """(ids, labels, trees): checkpointed rows, each with the packed trees of
    up to ``TREE`` vectors, one tree for each part position."""
    width = dim // parts

    def built(ids: list, labels: list, blocks: list) -> pa.RecordBatch:
        x = scaled(np.concatenate(blocks), scale)
        trees = [packed(grow(np.ascontiguousarray(x[:, j * width : (j + 1) * width]))) for j in range(parts)]
        named = [pa.chunked_array(c).combine_chunks() for c in (ids, labels)]
        lists = [pa.ListArray.from_arrays([0, len(c)], c) for c in named]
        return pa.RecordBatch.from_arrays([*lists, pa.array([trees], pa.list_(pa.binary()))], ["ids", "labels", "trees"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, blocks, n = [], [], [], 0
        for b in batches:
            for start in range(0, b.num_rows, TREE):
                piece = b.slice(start, TREE)
                if n and n + piece.num_rows > TREE:
                    yield built(ids, labels, blocks)
                    ids, labels, blocks, n = [], [], [], 0
                ids.append(piece.column(0))
                labels.append(piece.column(1))
                blocks.append(piece.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
                n += piece.num_rows
        if n:
            yield built(ids, labels, blocks)

    kinds = dict(vectors.dtypes)
    return cut(vectors.mapInArrow(build, f"ids array<{kinds['vec_id']}>, labels array<{kinds['label']}>, trees array<binary>"))


def update(trees: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """One round: every part to its nearest entry, every entry to the floor
    of the mean of its parts; entries without parts stay."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = [[0, np.zeros(b.shape, object)] for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for row in batch["trees"]:
                for j, blob in enumerate(row):
                    n, s = gather(pickle.loads(blob), books[j])
                    counts[j] += n
                    total[j][1] += s.astype(object)
        rows = []
        for j, n in enumerate(counts):
            for e in np.flatnonzero(n):
                rows.append((j, int(e), -1, 0, int(n[e])))
                rows += [(j, int(e), i, at, v) for i, s in enumerate(total[j][1][e]) for at, v in _limbs(int(s))]
        yield pd.DataFrame(rows, columns=["part", "entry", "place", "limb", "value"])

    added = trees.select("trees").mapInPandas(add, "part int, entry int, place int, limb int, value long")
    # one row for each part, entry and component: bounded by the codebooks
    summed = added.groupBy("part", "entry", "place", "limb").agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("value")).collect()
    whole: dict[tuple[int, int, int], int] = {}
    for r in summed:
        key = (r["part"], r["entry"], r["place"])
        whole[key] = whole.get(key, 0) + (int(r["value"]) << LIMB * r["limb"])
    out = []
    for j, book in enumerate(books):
        new = book.astype(object)
        for e in range(len(book)):
            if n := whole.get((j, e, -1), 0):
                new[e] = [whole[j, e, i] // n for i in range(book.shape[1])]
        out.append(_narrow(new))
    return out


def _narrow(a: np.ndarray) -> np.ndarray:
    return a.astype(np.int64) if all(-SAFE <= v < SAFE for v in a.ravel()) else a.astype(object)


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components by part, entry and place."""
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()


def train(spark: SparkSession, vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE) -> tuple[DataFrame | None, list[np.ndarray]]:
    """The ``forest`` of the kept vectors and the trained codebooks; (None,
    []) if no vector is kept."""
    value = F.col("embedding").cast("array<double>")
    whole = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int").alias("label")
    kept = vectors.select("vec_id", label, value.alias("embedding")).where(value.isNotNull() & (F.size(value) > 0) & whole)
    order = [F.col("vec_id").asc_nulls_last(), F.col("embedding")]
    first = kept.orderBy(*order).first()
    if first is None:
        return None, []
    dim = len(first["embedding"])
    if dim % parts:
        raise ValueError(f"vectors of {dim} components can't be cut into {parts} equal parts")
    kept = kept.where(F.size("embedding") == dim)
    seeds = scaled(np.array([r["embedding"] for r in kept.orderBy(*order).limit(entries).collect()], float), scale)
    books = [_narrow(seeds[:, j * dim // parts : (j + 1) * dim // parts]) for j in range(parts)]
    trees = forest(kept, dim, parts, scale)
    for _ in range(rounds):
        books = update(trees, books)
    return trees, books


def encode(trees: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, code, error): the final assignment of every vector."""
    vec, label = (dict(trees.dtypes)[c][len("array<") : -1] for c in ("ids", "labels"))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, labels = b.column(0).slice(i, 1).flatten(), b.column(1).slice(i, 1).flatten()
                codes, error = np.empty((len(ids), len(books)), np.uint8 if len(books[0]) <= 256 else np.uint16), np.zeros(len(ids), object)
                for j, blob in enumerate(b.column(2)[i].as_py()):
                    tree = pickle.loads(blob)
                    entry = assign(tree, books[j])
                    codes[:, j] = entry
                    wide = tree["points"].dtype == object or books[j].dtype == object
                    kind = object if wide else np.int64
                    gap = (tree["points"].astype(kind) - books[j].astype(kind)[entry[tree["order"]]]) ** 2
                    error[tree["order"]] += gap.sum(axis=1)
                text = [codes[k].tobytes().hex() for k in range(len(ids))] if codes.dtype == np.uint8 else ["".join(f"{c:04x}" for c in row) for row in codes]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(text, pa.string()), pa.array([min(int(e), TOP) for e in error], pa.int64())], ["vec_id", "label", "code", "error"])

    return trees.mapInArrow(coded, f"vec_id {vec}, label {label}, code string, error long")


def compress(spark: SparkSession, vectors: DataFrame, **how) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256): one row
    per kept vector."""
    trees, books = train(spark, vectors, **how)
    if trees is None:
        kinds = dict(vectors.dtypes)
        return spark.createDataFrame([], f"vec_id {kinds['vec_id']}, label {kinds.get('label', 'int')}, code string, error long, label_error long, codebooks_sha256 string")
    coded = cut(encode(trees, books))
    total = F.least(F.sum(F.col("error").cast("decimal(20,0)")), F.lit(TOP).cast("decimal(30,0)")).cast("long")
    by_label = coded.groupBy("label").agg(total.alias("label_error"))
    return join_keyed(coded, by_label, "label").withColumn("codebooks_sha256", F.lit(digest(books)))
