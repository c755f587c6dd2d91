"""Toxicity by a subsequence string-kernel SVM with Nyström landmarks.

The kernel compares two strings by the letter triples they share as
subsequences, contiguous or gapped: a triple that spans s letters weighs
``DECAY ** s``, spans stop at ``SPAN``.  An insult written with inserted
characters, stretched, or carried by an unseen suffix still shares most of
its triples with the insult that was learnt.

A text is read as sentences; in each, every run of one to ``WORDS`` words is
a string of its own, so an insult may be a word or a phrase.  Words longer
than ``WIDTH`` (all of a sentence, in scripts without spaces) are read
through overlapping windows.  Letters with separators between them
(b-l-o-c-k, b l o c k) are also read as one word.

A few hundred landmark strings, picked from the labelled texts, span the
Nyström feature space; a squared-hinge SVM is trained in it.  Labels are
per text, not per string, so training alternates: strings that speak for
toxic texts and no clean text comes near, and the best-scoring one of each
toxic text, stand for it, also with characters inserted or doubled; the
worst strings of clean texts are negatives (a multiple-instance SVM).  What
a text's words say together - the worst margin, how many are over the line,
and their density - goes through a logistic curve fitted on the same texts.

Because the kernel is a dot product of triple weights, the landmark
expansion folds into one weight per triple.  Scoring takes the weights of
all triples of a text once, and running sums of them give the margin of
every string in it, however they overlap: time in proportion to the text.

Defined cases: null, empty and letterless texts score as a text with no
evidence; labels without a document, null labels, null ids and repeated
labels are harmless; of rows that repeat an id one is learnt from; with no
labelled text, or one class only, all texts get the base rate as their
score; texts over ``LONGEST`` characters are scored whole but not learnt
from; other columns may have any names; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.session import cut

#: Labelled texts of each class that are fitted, chosen by hash of the id, and how long they may be.
SAMPLE = 2000
LONGEST = 100_000
#: How many characters of both classes together are fitted: bounds the fit's memory.
CHARACTERS = 16_000_000
LANDMARKS = 256
DECAY, SPAN = 0.7, 6
LETTERS = 64
#: Longer words are read through windows of this length, half overlapping.
WIDTH = 16
#: Words in a string, and letters, with the gaps, in one of several words.
WORDS, REACH = 3, 24
ROUNDS = 4
FOLDS = 5
PAIRS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
GAP = 1
#: Separators beyond ASCII: spaces, quotes, dashes, dots, and those of CJK text.
SIGNS = np.array([*range(0x80, 0xAA), 0xAB, 0xAC, 0xAD, *range(0xAE, 0xB5), *range(0xB6, 0xBA), 0xBB, 0xBF, 0xD7, 0xF7, *range(0x2000, 0x2070), *range(0x3000, 0x3004), *range(0x3008, 0x3012), 0xFF01, 0xFF0C, 0xFF0E, 0xFF1A, 0xFF1B, 0xFF1F], np.uint32)
ENDS = np.array([*map(ord, ".!?\n\r"), 0x3002, 0xFF01, 0xFF1F, 0x2026], np.uint32)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point of the basic plane its letter code, whether it
    separates, and whether it ends a sentence."""
    points = np.arange(1 << 16, dtype=np.uint32)
    code = np.where((points >= 97) & (points <= 122), points - 95, 28 + points % (LETTERS - 28)).astype(np.uint8)
    digit = (points >= 48) & (points <= 57)
    apart = (points < 128) & ~digit & ((points < 97) | (points > 122)) | np.isin(points, SIGNS)
    code[apart] = GAP
    return code, apart, np.isin(points, ENDS)


CODE, APART, ENDING = _tables()


def letters(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes of a text in lower case, each run of separators one GAP,
    and whether a GAP ends a sentence."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    # letters beyond the basic plane share the codes of its last block
    points = np.where(points < 1 << 16, points, 0xE000 + points % 0x1000)
    code, apart = CODE[points], APART[points]
    keep = np.ones(len(code), bool)
    keep[1:] = ~(apart[1:] & apart[:-1])
    first = np.flatnonzero(keep)
    ends = np.maximum.reduceat(ENDING[points], first) & apart[first] if len(first) else np.zeros(0, bool)
    return code[first], ends


class Reading:
    """The strings of a text: ``code``, with SPAN blanks at its end, and for
    each word its start and the ends of the strings that begin there."""

    def __init__(self, text: str | None):
        code, ends = letters(text or "")
        word = code != GAP
        edge = np.diff(np.r_[0, word.astype(np.int8), 0])
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        # runs of three or more single letters are read as one word as well, behind the text
        alone = (end - start == 1).astype(np.int8)
        turn = np.diff(np.r_[0, alone, 0])
        spelt = [code[start[a:b]] for a, b in zip(np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)) if b - a > 2]
        whole, at = [code, np.zeros(SPAN, np.uint8)], len(code) + SPAN
        stop = np.cumsum(ends)[start] if len(start) else start
        sentence = list(stop)
        extra = []
        for k, s in enumerate(spelt):
            extra.append((at, at + len(s), -1 - k))
            whole += [s, np.zeros(SPAN, np.uint8)]
            at += len(s) + SPAN
        self.code = np.concatenate(whole)
        if extra:
            start, end, sentence = np.r_[start, [e[0] for e in extra]], np.r_[end, [e[1] for e in extra]], [*sentence, *(e[2] for e in extra)]
        sentence = np.array(sentence, np.int64)
        self.words = len(start)
        long = end - start > WIDTH
        firsts, lasts, owner = [start[~long]], [end[~long]], [np.flatnonzero(~long)]
        for w in np.flatnonzero(long):
            k = np.arange(start[w], end[w] - WIDTH // 2, WIDTH // 2)
            firsts.append(k)
            lasts.append(np.minimum(k + WIDTH, end[w]))
            owner.append(np.full(len(k), w))
        for more in range(1, WORDS):
            a = np.arange(max(0, len(start) - more))
            ok = (sentence[a] == sentence[a + more]) & (end[a + more] - start[a] <= REACH)
            firsts.append(start[a[ok]])
            lasts.append(end[a[ok] + more])
            owner.append(a[ok])
        self.first, self.last, self.owner = (np.concatenate(x).astype(np.int32) for x in (firsts, lasts, owner))

    def string(self, k: int) -> bytes:
        return self.code[self.first[k] : self.last[k]].tobytes()


#: Of a string of n letters, the length of its vector of triples.
NORMS = np.sqrt(np.maximum(1e-12, [sum(max(0, n - b) * DECAY ** (2 * (b + 1)) for _, b in PAIRS) for n in range(REACH + SPAN + 2)]))


def matrix(strings: list[bytes]) -> np.ndarray:
    """Strings as rows of codes, each followed by blanks."""
    size = max(map(len, strings), default=0) + SPAN
    return np.frombuffer(b"".join(s.ljust(size, b"\0") for s in strings), np.uint8).reshape(len(strings), size)


def triples(code: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(triple ids, whether each lies inside its string, weight)."""
    code = code.astype(np.int32)
    n = code.shape[1] - SPAN
    for a, b in PAIRS:
        x, y, z = code[:, :n], code[:, a : a + n], code[:, b : b + n]
        yield (x * LETTERS + y) * LETTERS + z, z > 0, DECAY ** (b + 1)


def expand(strings: list[bytes], table: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Kernel sums of strings against the columns of ``table``, whose rows
    are triples; ``place`` gives a triple's row, 0 for none."""
    code = matrix(strings)
    total = np.zeros((len(strings), table.shape[1]))
    for ids, inside, w in triples(code):
        total += w * (table[place[ids]] * inside[..., None]).sum(axis=1)
    return total / NORMS[[len(s) for s in strings], None]


def landmark_table(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Normalised triple weights of each landmark, a row for each triple
    that any of them has after a row of zeros, and the triples' places."""
    code, size, parts = matrix(strings), NORMS[[len(s) for s in strings]], []
    for ids, inside, w in triples(code):
        r, c = np.nonzero(inside)
        parts.append((ids[r, c], r, w / size[r]))
    ids, r, w = (np.concatenate(x) for x in zip(*parts))
    own = np.unique(ids)
    place = np.zeros(LETTERS**3, np.int32)
    place[own] = np.arange(1, len(own) + 1)
    table = np.zeros((len(own) + 1, len(strings)), np.float32)
    np.add.at(table, (place[ids], r), w)
    return table, place


#: Words with a margin below this say nothing.
SILENT = -1.0


def evidence(words: int, margins: np.ndarray) -> tuple[float, float, float]:
    """What the words of a text say together: the worst margin, how many
    different ones are over the line, and how dense they are."""
    m = np.unique(np.round(margins[margins > SILENT], 4))
    if not len(m):
        return SILENT, 0.0, 0.0
    over = (1 / (1 + np.exp(-4 * m))).sum()
    return float(m.max()), float(np.log1p(over)), float(np.log1p(100 * over / (words + 10)))


@dataclass
class Model:
    """Folded triple weights with bias, and the logistic curve over a
    text's evidence; or just a constant score when there was nothing to
    learn from."""

    weights: np.ndarray | None
    bias: float = 0.0
    curve: np.ndarray | None = None
    constant: float = 0.0

    def margins(self, read: Reading) -> np.ndarray:
        """The margin of every string: differences of running sums."""
        code = read.code.astype(np.int32)
        n = len(code) - SPAN
        total = np.zeros(len(read.first))
        if n <= 0 or not len(total):
            return total + self.bias
        for b in range(2, SPAN):
            low = code[:n] * (LETTERS * LETTERS) + code[b : b + n]
            own = sum(self.weights[low + code[a : a + n] * LETTERS] for a in range(1, b))
            sums = np.zeros(n + 1)
            np.cumsum(own, dtype=np.float64, out=sums[1:])
            stop = np.clip(read.last - b, read.first, n)
            total += DECAY ** (b + 1) * (sums[stop] - sums[read.first])
        return total / NORMS[read.last - read.first] + self.bias

    def worst(self, read: Reading) -> np.ndarray:
        """The largest margin of the strings that begin at each word."""
        out = np.full(read.words, -np.inf)
        np.maximum.at(out, read.owner, self.margins(read))
        return out

    def evidence(self, text: str | None) -> tuple[float, float, float]:
        read = Reading(text)
        return evidence(read.words, self.worst(read))

    def probability(self, evidences: list[tuple]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(evidences), self.constant)
        x = np.c_[np.array(evidences, float).reshape(-1, 3), np.ones(len(evidences))]
        return 1 / (1 + np.exp(-np.clip(x @ self.curve, -30, 30)))

    def score(self, texts: list[str | None]) -> np.ndarray:
        return self.probability([() if self.weights is None else self.evidence(t) for t in texts])


def svm(x: np.ndarray, y: np.ndarray, c: np.ndarray, steps: int = 30) -> tuple[np.ndarray, float]:
    """Squared-hinge SVM in the primal, by Newton steps on the active set."""
    x1 = np.c_[x, np.ones(len(x))]
    w = np.zeros(x1.shape[1])
    ridge = np.r_[np.ones(x.shape[1]), 1e-3]
    for _ in range(steps):
        on = y * (x1 @ w) < 1
        a = x1[on]
        new = np.linalg.solve((a * c[on, None]).T @ a + np.diag(ridge), (a * c[on, None]).T @ y[on])
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w[:-1], float(w[-1])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Logistic regression with Platt's smoothed targets, by Newton steps
    with a line search; the last weight is the intercept."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    x1, w = np.c_[(x - mean) / scale, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    penalty = np.r_[np.full(x.shape[1], ridge), 1e-6]

    def loss(w: np.ndarray) -> float:
        z = x1 @ w
        return float((np.logaddexp(0, z) - t * z).sum() + (penalty * w * w).sum() / 2)

    now = loss(w)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        slope = x1.T @ (p - t) + penalty * w
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(penalty + 1e-9), slope)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > now - 1e-4 * size * (slope @ step):
            size /= 2
        if size <= 1e-6 or np.abs(size * step).max() < 1e-8:
            break
        w = w - size * step
        now = loss(w)
    return np.r_[w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum()]


def disturbed(unit: bytes, rng: np.random.Generator) -> list[bytes]:
    """``unit`` with one character inserted, and with one doubled."""
    i, j = (int(rng.integers(1, max(2, len(unit)))) for _ in range(2))
    other = bytes([int(rng.choice([GAP, GAP, 18, 25, 27, 28]))])
    return [unit[:i] + other + unit[i:], unit[:j] + unit[j - 1 : j] + unit[j:]]


def log_odds(with_one: int, with_zero: int, n1: int, n0: int) -> float:
    return np.log((with_one + 0.5) / (n1 + 1)) - np.log((with_zero + 0.5) / (n0 + 1))


def first_guess(reads: list[Reading], y: np.ndarray) -> list[dict[bytes, float]]:
    """For each text its strings of one word with a guess at how much they
    speak for toxic texts, and its phrases that several toxic texts share:
    log-odds of texts' letter fourgrams, averaged over a word, and of whole
    words and phrases."""
    gap = bytes([GAP])

    def cut_words(r: Reading) -> tuple[set[bytes], set[bytes]]:
        strings = {r.string(k) for k in range(len(r.first))}
        phrases = {s for s in strings if gap in s}
        return strings - phrases, phrases

    seen: Counter[bytes] = Counter()
    for r, label in zip(reads, y):
        if label:
            seen.update(cut_words(r)[1])
    shared = {s for s, n in seen.items() if n > 2}
    del seen
    bags = [own | (phrases & shared) for own, phrases in map(cut_words, reads)]
    n1, n0 = int(y.sum()), int((1 - y).sum())
    grams, whole = (Counter(), Counter()), (Counter(), Counter())
    cut_up: dict[bytes, list[bytes]] = {}
    for bag, label in zip(bags, y):
        for s in bag:
            if s not in cut_up and s not in shared:
                cut_up[s] = [s[k : k + 4] for k in range(max(1, len(s) - 3))]
        grams[label].update({g for s in bag for g in cut_up.get(s, ())})
        whole[label].update(bag)
    odds = {g: log_odds(grams[1][g], grams[0][g], n1, n0) for g in grams[1] | grams[0]}
    known: dict[bytes, float] = {}
    for s, gs in cut_up.items():
        known[s] = sum(odds[g] for g in gs) / len(gs) * min(1, len(gs) / 2)
    for s in whole[1]:
        if whole[1][s] > 2:
            known[s] = max(known.get(s, -9.0), log_odds(whole[1][s], whole[0][s], n1, n0))
    return [{s: known[s] for s in bag if s in known} for bag in bags]


def fit(texts: list[str], labels: list[int], landmarks: int = LANDMARKS) -> Model:
    y = np.array(labels, int)
    if len(y) == 0 or y.min() == y.max():
        return Model(None, constant=float(y.mean()) if len(y) else 0.0)
    rng = np.random.default_rng(7)
    reads = [Reading(t) for t in texts]
    usable = [i for i, r in enumerate(reads) if r.words]
    toxic, clean = [i for i in usable if y[i]], [i for i in usable if not y[i]]
    if not toxic or not clean:
        return Model(None, constant=float(y.mean()))
    guess = first_guess(reads, y)
    top = lambda g: max(g, key=lambda s: (g[s], s))
    line = max(max(guess[i].values()) for i in clean)
    sure = [s for i in toxic for s in sorted(guess[i]) if guess[i][s] > line]
    positive, hard = sure + [top(guess[i]) for i in toxic], {top(guess[i]) for i in clean}
    any_word = lambda i: reads[i].string(int(rng.integers(len(reads[i].first))))
    plain = {any_word(i) for i in clean for _ in range(2)}
    some = lambda s, n: [sorted(s)[k] for k in rng.permutation(len(s))[:n]]
    marks = [s for s, _ in Counter(positive).most_common(landmarks // 2)]
    marks += some(hard - set(marks), landmarks // 4)
    marks += some(plain - set(marks), landmarks - len(marks))
    del guess
    table, place = landmark_table(marks)
    gram = expand(marks, table, place)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    use = values > 1e-6 * values.max()
    whiten = vectors[:, use] / np.sqrt(values[use])
    cache: dict[bytes, np.ndarray] = {}

    def features(strings: list[bytes]) -> np.ndarray:
        new = sorted({s for s in strings if s not in cache})
        for k in range(0, len(new), 256):
            cache.update(zip(new[k : k + 256], (expand(new[k : k + 256], table, place) @ whiten).astype(np.float32)))
        return np.array([cache[s] for s in strings], float)

    for _ in range(ROUNDS):
        negative, often = sorted(hard | plain), Counter(positive)
        bent = [v for s, _ in often.most_common(200) if len(s) > 4 for v in disturbed(s[:REACH], rng)]
        x = features([*often, *negative, *bent])
        target = np.r_[np.ones(len(often)), -np.ones(len(negative)), np.ones(len(bent))]
        weight = np.sqrt(np.array(list(often.values()), float))
        cost = 1000 * np.r_[weight / weight.sum(), np.full(len(negative), 1 / len(negative)), np.full(len(bent), 0.5 / max(1, len(bent)))]
        v, bias = svm(x, target, cost)
        model = Model((table @ (whiten @ v).astype(np.float32))[place], bias)
        best = {i: reads[i].string(int(model.margins(reads[i]).argmax())) for i in usable}
        positive, hard = sure + [best[i] for i in toxic], hard | {best[i] for i in clean}
    model.curve = logistic(np.array([evidence(r.words, model.worst(r)) for r in reads]), np.where(y == 1, 1, -1))
    return model


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; fold 0 is never learnt from."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(FOLDS))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, longest: int = LONGEST, characters: int = CHARACTERS) -> Model:
    """Fit on at most ``sample`` labelled texts of each class outside fold
    0, of at most ``longest`` characters, taken in the order of a hash of the
    id, so the same at every run.  Only ids and hashes are joined to choose
    them, only the chosen texts come together, in one task on an executor,
    and only the model's weights reach the driver.  ``characters`` bounds
    the chosen texts as a whole, half of them for each class: the fit takes
    some 25 bytes of memory for each."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold(F.col("doc_id")) != 0))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    keys = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.coalesce(F.length("text"), F.lit(0)).alias("n")).where(F.col("n") <= longest)
    known = cut(keys.join(usable, "doc_id").groupBy("doc_id").agg(F.min(F.struct("text_key", "toxic", "n")).alias("x")).select("doc_id", "x.*"))
    order = F.xxhash64(F.lit("toxicity"), F.col("doc_id"))
    # of each class half of the characters, text by text while they last; the window sees ``sample`` narrow rows
    so_far = F.sum("n").over(Window.orderBy(order, "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    part = [known.where(F.col("toxic") == c).orderBy(order, "doc_id").limit(sample).withColumn("so_far", so_far).where(F.col("so_far") <= characters // 2).drop("so_far", "n") for c in (0, 1)]
    picked = F.broadcast(cut(part[0].unionByName(part[1])).withColumnRenamed("doc_id", "id").withColumnRenamed("text_key", "key"))
    rows = docs.select("doc_id", "text").join(picked, (F.col("doc_id") == F.col("id")) & F.xxhash64("text").eqNullSafe(F.col("key")))
    rows = rows.groupBy("doc_id").agg(F.first(F.coalesce("text", F.lit(""))).alias("text"), F.first(F.col("toxic").cast("int")).alias("toxic"))

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sorted({r for b in batches for r in b[["doc_id", "text", "toxic"]].itertuples(index=False, name=None)})
        m = fit([r[1] for r in own], [r[2] for r in own])
        yield pd.DataFrame({"weights": [None if m.weights is None else m.weights.astype(np.float32).tobytes()], "bias": [m.bias], "curve": [None if m.curve is None else m.curve.tolist()], "constant": [m.constant]})

    got = rows.repartition(1).mapInPandas(learn, "weights binary, bias double, curve array<double>, constant double").collect()
    if not got or got[0]["weights"] is None:
        return Model(None, constant=got[0]["constant"] if got else 0.0)
    return Model(np.frombuffer(bytes(got[0]["weights"]), np.float32), got[0]["bias"], np.array(got[0]["curve"]))


def score_udf(spark, model: Model):
    shared = spark.sparkContext.broadcast((model.weights, model.bias, model.curve, model.constant))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = Model(*shared.value)
        for texts in batches:
            yield pd.Series(m.score(texts.tolist()))

    return score


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc (the row), held_out, score, predicted."""
    udf = score_udf(docs.sparkSession, train(docs, labels, sample))
    rows = docs.select(F.struct("*").alias("doc"), (fold(F.col("doc_id")) == 0).alias("held_out"), udf(F.col("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without those predicted toxic."""
    return scored(docs, labels, sample).where("predicted = 0").select("doc.*")
