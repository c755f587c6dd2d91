"""Further comparisons of a generated corpus with a human one: character
F-scores, token shifts, overused tokens, Frechet distance and MAUVE.

These are defined in published work, not by the engine this library follows,
so each definition is stated in full with its function.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.operators.metrics import with_tokens
from corpusloom.session import cut

#: Character n-grams up to this order, and how much more recall counts than precision.
ORDER, BETA = 6, 2.0
#: Share of the generated texts that an overused token is in at least.
FLOOR = 0.02
TOP = 1000
CLUSTERS, ROUNDS, SCALE, MIXES = 64, 20, 5.0, 25


def chrf(pairs: DataFrame, key: str, made: str = "generated", human: str = "human", order: int = ORDER, beta: float = BETA) -> DataFrame:
    """(key, chrf): the F-score, from 0 to 100, of the character n-grams of a
    text against its reference, white space left out.

    Precision and recall are averaged over the orders that both texts have;
    without any the score is 0.  N-grams are counted as multisets, one order
    at a time where their pair is, and never leave it; a null text is an
    empty one.
    """

    def of_pair(x: str, y: str) -> float:
        p, r = [], []
        for n in range(1, min(order, len(x), len(y)) + 1):
            a, b = (Counter([t[i : i + n] for i in range(len(t) - n + 1)]) for t in (x, y))
            both = sum(min(k, b[g]) for g, k in a.items() if g in b)
            p.append(both / (len(x) - n + 1))
            r.append(both / (len(y) - n + 1))
        p, r = (sum(v) / len(v) if v else 0.0 for v in (p, r))
        return 100 * (1 + beta**2) * p * r / (beta**2 * p + r) if p + r > 0 else 0.0

    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([of_pair(*t) for t in zip(x, y)], dtype=float)

    letters = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"(?U)\s+", "")
    return pairs.select(key, score(letters(made), letters(human)).alias("chrf"))


def overused(made: DataFrame, human: DataFrame, floor: float = FLOOR) -> DataFrame:
    """(token, made_share, human_share, ratio, rank): tokens that at least
    ``floor`` of the generated texts hold, by how much larger that share is
    than the share of human texts.  A token that no human text holds has no
    ratio and ranks first; ties rank by the larger share, then the token."""
    sizes = [max(1, d.count()) for d in (made, human)]
    held = [with_tokens(d).select(F.explode(F.array_distinct("tokens")).alias("token"), F.lit(i).alias("side")) for i, d in enumerate((made, human))]
    count = held[0].unionByName(held[1]).groupBy("token").agg(F.count_if(F.col("side") == 0).alias("m"), F.count_if(F.col("side") == 1).alias("h"))
    share = count.select("token", (F.col("m") / sizes[0]).alias("made_share"), (F.col("h") / sizes[1]).alias("human_share")).where(F.col("made_share") >= floor)
    ratio = F.col("made_share") / F.nullif(F.col("human_share"), F.lit(0.0))
    # at most the tokens of a text over ``floor`` pass, whatever the number of texts
    by = Window.orderBy(F.desc_nulls_first("ratio"), F.desc("made_share"), "token")
    return share.withColumn("ratio", ratio).withColumn("rank", F.row_number().over(by))


def token_frequencies(made: DataFrame, human: DataFrame) -> DataFrame:
    """(token, f, g): shares of all tokens, human and generated; cut."""
    used = [with_tokens(d).select(F.explode("tokens").alias("token"), F.lit(i).alias("side")) for i, d in enumerate((human, made))]
    count = cut(used[0].unionByName(used[1]).groupBy("token").agg(F.count_if(F.col("side") == 0).alias("h"), F.count_if(F.col("side") == 1).alias("m")))
    h, m = count.agg(F.sum("h"), F.sum("m")).first()
    return count.select("token", (F.col("h") / float(h or 1)).alias("f"), (F.col("m") / float(m or 1)).alias("g"))


def token_shifts(made: DataFrame, human: DataFrame, top: int = TOP) -> DataFrame:
    """(token, relative, share, cumulative, rank): the ``top`` tokens that
    make up most of the squared distance of the two token distributions:
    their frequency relative to the human one, null where that is none, and
    their share of the squared distance, alone and with all before.  Equal
    shares are ordered by token."""
    d = token_frequencies(made, human).withColumn("square", F.pow(F.col("g") - F.col("f"), 2))
    total = d.agg(F.sum("square")).first()[0] or 1.0
    first = d.orderBy(F.desc("square"), "token").limit(top)
    by = Window.orderBy(F.desc("square"), "token")  # over ``top`` rows
    share = F.col("square") / total
    return first.select("token", (F.col("g") / F.nullif(F.col("f"), F.lit(0.0)) - 1).alias("relative"), share.alias("share"), F.sum(share).over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("cumulative"), F.row_number().over(by).alias("rank"))


def token_divergence(made: DataFrame, human: DataFrame) -> DataFrame:
    """One row: the Jensen-Shannon divergence, base 2, of the tokens."""
    part = lambda p: F.when(F.col(p) > 0, F.col(p) * F.log2(2 * F.col(p) / (F.col("f") + F.col("g")))).otherwise(0.0)
    return token_frequencies(made, human).agg(F.coalesce(F.sum((part("f") + part("g")) / 2), F.lit(0.0)).alias("jsd"))


def moments(vectors: DataFrame) -> DataFrame:
    """(side, i, j, n, mean, cov): the unbiased covariance of components i
    and j of the ``v`` of each ``side``, and the mean of component i.

    Each task adds up its rows' sums and products, about the first mean that
    it sees, and sends on one row per side and component; Spark adds those
    up exactly as Chan's rule for merging moments says.
    """

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        for b in batches:
            for side, rows in b.groupby("side"):
                x = np.stack(rows["v"].to_numpy()).astype(float)
                n, mean = len(x), x.mean(axis=0)
                m2 = (x - mean).T @ (x - mean)
                if side in held:
                    k, old, so_far = held[side]
                    gap = mean - old
                    mean, m2 = old + gap * n / (k + n), so_far + m2 + np.outer(gap, gap) * k * n / (k + n)
                    n += k
                held[side] = [n, mean, m2]
        for side, (n, mean, m2) in held.items():
            yield pd.DataFrame({"side": side, "i": np.arange(len(mean)), "n": n, "mean": [mean.tolist()] * len(mean), "m2": m2.tolist()})

    parts = cut(vectors.select("side", "v").mapInPandas(add, "side int, i int, n long, mean array<double>, m2 array<double>"))
    own = parts.select("side", "i", "n", F.get("mean", F.col("i")).alias("m"))
    # a row for each side and component, so as many as two vectors have
    whole = F.broadcast(own.groupBy("side", "i").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean")))
    flat = parts.select("side", "i", "n", "mean", F.posexplode("m2").alias("j", "m2")).select("side", "i", "j", "n", "m2", F.get("mean", F.col("i")).alias("a"), F.get("mean", F.col("j")).alias("b"))
    flat = flat.join(whole.withColumnRenamed("mean", "mean_i"), ["side", "i"]).join(whole.select("side", F.col("i").alias("j"), F.col("mean").alias("mean_j")), ["side", "j"])
    product = F.sum(F.col("m2") + F.col("n") * (F.col("a") - F.col("mean_i")) * (F.col("b") - F.col("mean_j")))
    return flat.groupBy("side", "i", "j").agg(F.sum("n").alias("n"), F.first("mean_i").alias("mean"), (product / F.greatest(F.lit(1), F.sum("n") - 1)).alias("cov"))


def frechet(x: DataFrame, y: DataFrame) -> DataFrame:
    """One row: the Frechet distance of two corpora's vectors ``v``, each
    taken as a normal distribution: |m1 - m2|^2 + tr(S1 + S2 - 2 (S1 S2)^1/2).
    Two matrices of the vectors' width reach the driver, no vector does."""
    both = x.select(F.lit(0).alias("side"), "v").unionByName(y.select(F.lit(1).alias("side"), "v"))
    rows = moments(both).toPandas()
    if set(rows["side"]) != {0, 1} or rows["n"].min() < 2:
        raise ValueError("each corpus needs two vectors")
    d = int(rows["i"].max()) + 1
    mean, cov = np.zeros((2, d)), np.zeros((2, d, d))
    at = rows["side"].to_numpy(), rows["i"].to_numpy(), rows["j"].to_numpy()
    cov[at] = rows["cov"]
    mean[at[:2]] = rows["mean"]
    w, q = np.linalg.eigh(cov[0])
    root = q * np.sqrt(np.maximum(w, 0)) @ q.T
    cross = np.sqrt(np.maximum(np.linalg.eigvalsh(root @ cov[1] @ root), 0)).sum()
    value = float(((mean[0] - mean[1]) ** 2).sum() + np.trace(cov[0]) + np.trace(cov[1]) - 2 * cross)
    return x.sparkSession.range(1).select(F.lit(value).alias("frechet"))


def nearest(centres: np.ndarray):
    @F.pandas_udf("int")
    def index(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        norm = (centres * centres).sum(axis=1)
        for vs in batches:
            yield pd.Series((norm - 2 * np.stack(vs.to_numpy()).astype(float) @ centres.T).argmin(axis=1) if len(vs) else [], dtype="int32")

    return index


def quantised(pooled: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS) -> np.ndarray:
    """The centres of k-means over ``v``: the first are the vectors whose
    positions have the smallest hashes; a centre without vectors stays.
    ``rounds`` passes at most, each of which sends k sums to the driver."""
    start = pooled.orderBy(F.xxhash64("side", "pos"), "side", "pos").limit(k).select("v").collect()
    centres = np.array([r["v"] for r in start], float)
    for _ in range(rounds):

        def add(batches: Iterator[pd.DataFrame], centres=centres) -> Iterator[pd.DataFrame]:
            n, total = np.zeros(len(centres), np.int64), np.zeros_like(centres)
            norm = (centres * centres).sum(axis=1)
            for b in batches:
                if len(b):
                    x = np.stack(b["v"].to_numpy()).astype(float)
                    own = (norm - 2 * x @ centres.T).argmin(axis=1)
                    n += np.bincount(own, minlength=len(centres))
                    np.add.at(total, own, x)
            yield pd.DataFrame({"c": np.flatnonzero(n), "n": n[n > 0], "s": total[n > 0].tolist()})

        parts = pooled.select("v").mapInPandas(add, "c int, n long, s array<double>")
        width = range(centres.shape[1])
        sums = parts.groupBy("c").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in width]).alias("s")).collect()
        new = centres.copy()
        for r in sums:
            new[r["c"]] = np.array(r["s"]) / r["n"]
        if np.allclose(new, centres, rtol=0, atol=1e-12):
            break
        centres = new
    return centres


def frontier(p: np.ndarray, q: np.ndarray, scale: float = SCALE, mixes: int = MIXES) -> float:
    """The area under the divergence frontier of two histograms: for mixtures
    r = w p + (1 - w) q the points exp(-scale KL(q|r)), exp(-scale KL(p|r)),
    with both ends, joined by lines."""

    def kl(a: np.ndarray, b: np.ndarray) -> float:
        use = a > 0
        return float((a[use] * np.log(a[use] / b[use])).sum())

    inner = [w * p + (1 - w) * q for w in np.linspace(0, 1, mixes + 2)[1:-1]]
    points = sorted([(0.0, 1.0), (1.0, 0.0), *((np.exp(-scale * kl(q, r)), np.exp(-scale * kl(p, r))) for r in inner)], key=lambda t: (t[0], -t[1]))
    x, y = np.array(points).T
    return float((np.diff(x) * (y[1:] + y[:-1]) / 2).sum())


def mauve(x: DataFrame, y: DataFrame, k: int = CLUSTERS, centres: np.ndarray | None = None) -> DataFrame:
    """One row: MAUVE of two corpora of vectors (pos, v): both are quantised
    by the same ``k`` centres and their histograms compared at all weights
    of the two kinds of error.  1 for equal histograms."""
    pooled = cut(x.select(F.lit(0).alias("side"), "pos", "v").unionByName(y.select(F.lit(1).alias("side"), "pos", "v")))
    if pooled.select("side").distinct().count() < 2:
        raise ValueError("each corpus needs a vector")
    centres = quantised(pooled, k) if centres is None else centres
    count = {(r["side"], r["c"]): r["n"] for r in pooled.groupBy("side", nearest(centres)(F.col("v")).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}
    p, q = (np.array([count.get((s, c), 0) for c in range(len(centres))], float) for s in (0, 1))
    return x.sparkSession.range(1).select(F.lit(frontier(p / p.sum(), q / q.sum())).alias("mauve"))


def win_rates(judged: DataFrame) -> DataFrame:
    """(dimension, wins, rate) of rows (dimension, won: MADE, HUMAN or TIE):
    the share of each quality on which the generated text won, ties half."""
    worth = F.when(F.col("won") == "MADE", 1.0).when(F.col("won") == "TIE", 0.5).otherwise(0.0)
    return judged.groupBy("dimension").agg(F.sum(worth).alias("wins"), F.avg(worth).alias("rate"))


def foreign_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: the share of texts that hold a letter that is not Latin."""
    return docs.agg(F.coalesce(F.avg(F.coalesce(F.col(text), F.lit("")).rlike(r"[\p{L}&&[^\p{IsLatin}]]").cast("double")), F.lit(0.0)).alias("foreign_share"))
