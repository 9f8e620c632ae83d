"""Operator 9: toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of a lexicon (given insults, and words and stems learned from the labelled rows), how
near to second-person words they stand, rates of capitals, of punctuation, and of obfuscated words. Trees
are fitted on the driver to a bounded sample of labelled rows, and applied where the documents are.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, doc_crc, materialise, require

# A starting lexicon of insults, and second-person words.
INSULTS = frozenset("idiot idiots moron morons stupid dumb scum trash garbage loser losers pathetic worthless disgusting clown clowns fool fools ugly filthy vermin pig pigs jerk creep freak coward liar imbecile dimwit dumbass bastard bitch crap damn shut hate die kill".split())
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre usted ustedes tú ti".split())
FEATURES = ("given_density", "given_count", "given_kinds", "learned_density", "learned_count", "learned_kinds", "near_second", "second_density", "capitals", "shouted", "exclamations", "questions", "punctuation", "obfuscated", "obfuscated_lexicon", "words")
WORDS_NEAR = 5
#: Lengths of the beginnings of words that are learned beside whole words, since insults are inflected.
STEMS = (4, 5, 6, 7)
_BREAK = str.maketrans({c: " " for c in ".,;:!?\"'()[]{}<>|/\\-_…«»“”„¿¡"})
_DISGUISED = re.compile(r"(?<!\S)(?=\S*[A-Za-z])[A-Za-z]*[0-9@$*!+][A-Za-z0-9@$*!+]*[A-Za-z][A-Za-z0-9@$*!+]*(?!\S)")
_PLAIN = str.maketrans("013457@$!+", "oieastasit")


def features(text: str | None, learned: frozenset[str] | set[str]) -> list[float]:
    """The values of FEATURES for a text; an empty one has zeros."""
    text = text or ""
    words = text.lower().translate(_BREAK).split()
    n = len(words)
    if not text:
        return [0.0] * len(FEATURES)
    hits = [i for i, w in enumerate(words) if w in INSULTS or w in learned or w[:4] in learned or w[:5] in learned or w[:6] in learned or w[:7] in learned]
    given = [words[i] for i in hits if words[i] in INSULTS]
    new = [words[i] for i in hits if words[i] not in INSULTS]
    near = sum(any(w in SECOND for w in words[max(0, i - WORDS_NEAR) : i + WORDS_NEAR + 1]) for i in hits)
    second = sum([w in SECOND for w in words])
    disguised = _DISGUISED.findall(text)
    unmasked = sum(plain in INSULTS or plain in learned for plain in (d.lower().translate(_PLAIN).replace("*", "") for d in disguised))
    m, k = max(1, n), len(text)
    raw = text.split()
    return [
        100 * len(given) / m, math.log1p(len(given)), math.log1p(len(set(given))),
        100 * len(new) / m, math.log1p(len(new)), math.log1p(len(set(new))),
        near / max(1, len(hits)), 100 * second / m,
        sum(map(str.isupper, raw)) / max(1, len(raw)), sum([w[0].isupper() for w in raw]) / max(1, len(raw)),
        100 * text.count("!") / k, 100 * text.count("?") / k, 100 * sum(map(text.count, ".,;:-*#$%&")) / k,
        100 * len(disguised) / m, math.log1p(unmasked), math.log1p(n),
    ]


class Trees:
    """Gradient-boosted regression trees for the logistic loss, over binned features."""

    def __init__(self, depth: int = 3, rounds: int = 80, rate: float = 0.15, least: float = 2.0, bins: int = 64):
        self.depth, self.rounds, self.rate, self.least, self.bins = depth, rounds, rate, least, bins
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, m = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(m)]
        # besides quantiles, a cut just above the commonest value, which may fill most bins
        edges = [np.unique(np.append(e, np.linspace(x[:, j].min(), x[:, j].max(), 18)[1:-1])) for j, e in enumerate(edges)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        width = max(len(e) for e in edges) + 1
        p = min(max(y.mean(), 1e-6), 1 - 1e-6)
        self.base = math.log(p / (1 - p))
        f = np.full(n, self.base)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-f))
            g, h = q - y, q * (1 - q)
            size = 2 ** (self.depth + 1) - 1
            feature, cut, value = np.full(size, -1), np.zeros(size), np.zeros(size)
            at = np.zeros(n, dtype=np.int64)
            for node in range(size):
                rows = np.flatnonzero(at == node)
                if not len(rows):
                    continue
                gs, hs = g[rows].sum(), h[rows].sum()
                value[node] = -self.rate * gs / (hs + 1)
                if node >= 2**self.depth - 1:
                    continue
                best = (1e-6, -1, 0)
                for j in range(m):
                    gl = np.cumsum(np.bincount(binned[rows, j], g[rows], width))[:-1]
                    hl = np.cumsum(np.bincount(binned[rows, j], h[rows], width))[:-1]
                    ok = (hl >= self.least / 10) & (hs - hl >= self.least / 10)
                    gain = np.where(ok, gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1), 0)
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (gain[k], j, k)
                if best[1] >= 0 and best[2] < len(edges[best[1]]):
                    feature[node], cut[node] = best[1], edges[best[1]][best[2]]
                    at[rows] = 2 * node + 1 + (x[rows, best[1]] > cut[node])
            self.trees.append((feature, cut, value))
            f += self._apply(self.trees[-1], x)
        return self

    def _apply(self, tree, x: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        at, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        for _ in range(self.depth):
            j = feature[at]
            at = np.where(j >= 0, 2 * at + 1 + (x[rows, np.maximum(j, 0)] > cut[at]), at)
        return value[at]

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((self._apply(t, x) for t in self.trees), np.zeros(len(x)))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing least-squares fit by pooling adjacent violators: points for interpolation."""
    at, place, size = np.unique(score, return_inverse=True, return_counts=True)  # equal scores are one point
    blocks: list[list[float]] = []  # [weight, mean, first score, last score]
    for s, w, total in zip(at, size, np.bincount(place, y)):
        blocks.append([float(w), total / w, float(s), float(s)])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            b = blocks.pop()
            a = blocks[-1]
            a[1], a[0], a[3] = (a[1] * a[0] + b[1] * b[0]) / (a[0] + b[0]), a[0] + b[0], b[3]
    xs, ys = [], []
    for _, mean, a, b in blocks:
        xs += [a, b] if b > a else [a]
        ys += [mean, mean] if b > a else [mean]
    return np.array(xs), np.array(ys)


class Model:
    """`learned` words, `trees` fitted to the rows that aren't `held`, and the calibration's points, fitted to those that are."""

    def __init__(self, learned: set[str], x: np.ndarray, y: np.ndarray, held: np.ndarray):
        self.learned = frozenset(learned)
        self.prior = float((y.sum() + 1) / (len(y) + 2)) if len(y) else 0.0
        self.trees = None
        if len(y) and 0 < y.sum() < len(y):
            if not 0 < y[~held].sum() < (~held).sum() or not 0 < y[held].sum() < held.sum():
                held = np.zeros(len(y), dtype=bool)  # too few rows to set some aside
            self.trees = Trees().fit(x[~held], y[~held])
            some = held if held.any() else ~held
            # a row of each label at the ends, so that no block is certain
            margins = self.trees.margin(x[some])
            self.points = isotonic(np.concatenate((margins, [margins.min() - 1, margins.max() + 1])), np.concatenate((y[some], [0.0, 1.0])))

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.prior)
        return np.clip(np.interp(self.trees.margin(x), *self.points), 0.0, 1.0)


def held_out(column: str = "doc_id"):
    """The hold-out rule: crc32 of the id as text, modulo 4, is 2."""
    return F.pmod(doc_crc(column), F.lit(4)) == 2


def _feature_rows(rows: DataFrame, learned: set[str], keep: str) -> DataFrame:
    """`keep` (a column, long or double) and the features (array) of the column `text`."""

    def run(batches):
        for batch in batches:
            x = [features(t, learned) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=[keep, "x"])

    rows = rows.select(keep, "text")
    return arrow_map(rows, run, f"{keep} {rows.schema[keep].dataType.simpleString()}, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", fit_rows: int = 20_000, learned_words: int = 200) -> Model:
    """A model from `fit_rows` labelled rows at most (the first by hash of their id), and `learned_words` words and stems at most.

    Labels of a repeated id: 1 if any is; texts of one: the first in order. Labels, ids and texts that are null are left
    out. A third of the rows, by hash of their text (so that copies stay together), are set aside for the calibration:
    neither words nor trees are learned from them.
    """
    require(docs, doc_id, text)
    require(labels, doc_id, label)
    y = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("k")).agg(F.max(F.col(label).cast("int")).alias("y"))
    y = y.orderBy(F.xxhash64(F.col("k").cast("string")), "k").limit(fit_rows)
    # broadcast: fit_rows rows of two numbers
    rows = docs.select(F.col(doc_id).alias("k"), F.col(text).alias("text")).where("text is not null").join(F.broadcast(y), "k")
    rows = rows.groupBy("k").agg(F.max("y").cast("double").alias("y"), F.min("text").alias("text"))
    rows = materialise(rows.select("y", (F.pmod(F.xxhash64("text"), F.lit(3)) == 0).alias("held"), "text"), "toxicity-fit")
    learned = learn_words(rows.where("not held"), learned_words)
    got = _feature_rows(rows.withColumn("row", F.col("y").cast("int") + F.when(F.col("held"), 2).otherwise(0)), learned, "row").collect()  # fit_rows rows of some numbers
    x = np.array([r["x"] for r in got], dtype=float).reshape(len(got), len(FEATURES))
    row = np.array([r["row"] for r in got], dtype=np.int64)
    return Model(learned, x, (row % 2).astype(float), row >= 2)


def learn_words(rows: DataFrame, most: int) -> set[str]:
    """Words and stems that tell texts with y = 1 from those with 0: `most` at most."""
    texts = rows.dropDuplicates(["text"])  # copies of a text say no more than one
    n = {r["y"]: r["n"] for r in texts.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = n.get(1.0, 0), n.get(0.0, 0)
    if not (bad and good):
        return set()
    words = F.split(F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " ")), " ")
    stems = F.flatten(F.transform(words, lambda w: F.array(w, *[F.left(w, F.lit(n)) for n in STEMS])))
    each = texts.select("y", F.explode(F.array_distinct(F.filter(stems, lambda w: F.length(w) >= min(STEMS)))).alias("w"))
    counts = each.groupBy("w").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    odds = F.log((F.col("a") + 0.5) / (bad + 1)) - F.log((F.col("b") + 0.5) / (good + 1))
    # of a fiftieth of the toxic texts at least, and ten times as frequent there
    found = counts.where((F.col("a") >= max(3, 0.02 * bad)) & (odds >= math.log(10))).select("w", (odds * F.col("a")).alias("o")).orderBy(F.desc("o"), "w").limit(10 * most)
    likely = {r["w"]: None for r in found.collect()}
    # a stem stands for all that begin with it
    return set([w for w in likely if not any(w[:n] in likely for n in STEMS if n < len(w))][:most])


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score (0 to 1), predicted (1 from `threshold` on).

    Whole texts are read; null and empty ones are scored as texts without words; repeated rows stay; an
    empty table gives an empty result. Without rows of both labels every score is the share of label 1.
    """
    require(docs, doc_id, text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for batch in batches:
            x = np.array([features(t, m.learned) for t in batch.column(2).to_pylist()], dtype=float).reshape(-1, len(FEATURES))
            s = m.scores(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return arrow_map(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
