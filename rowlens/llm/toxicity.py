"""Toxicity by multiple-instance learning.

Only documents have labels. A sentence has a logistic score from its words and
word beginnings; a document is toxic unless none of its sentences is:
``P = 1 - prod(1 - p_sentence)`` (noisy-or). The weights are fitted by following
the likelihood of the document labels through that product, so the sentences
that make a document toxic are found without ever being labelled.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, pieces, text_or_empty, written

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W_]+")
PREFIXES = (3, 4, 5, 6)
#: Bounds of the fit: labelled documents of each class, features.
SAMPLE_EACH, FEATURES = 8_000, 8_192
#: Bytes of text whose sentences leave a task together; features of sentences that a step of the fit takes at once.
PIECE_BYTES, HELD = 1 << 20, 1 << 18
#: Steps of the fit, their size, and the prior's weight, which counts for less the more documents there are.
#: Features that a task counts before it passes the counts on.
COUNTED = 100_000
ITERATIONS, RATE, PRIOR = 500, 0.15, 0.3
#: Folds and documents of each class (at most) by which the threshold is set, what a clean document above it counts, the prior's weight.
FOLDS, CALIBRATE_EACH, CLEAN_COUNTS, PRIOR_DOCS = 4, 2_000, 5.0, 10.0


def word_features(word: str) -> list[str]:
    """A word and its beginnings (marked with a trailing star)."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) >= n)]


class Model(dict):
    """Weights of features, and of words as they are asked for; ``bias`` is a sentence's, ``cut`` the log-odds that score 0.5."""

    MOST = 200_000

    def __init__(self, weights: dict[str, float], bias: float, cut: float = 0.0):
        super().__init__()
        self.weights, self.bias, self.cut = weights, bias, cut

    def __reduce__(self):
        return Model, (self.weights, self.bias, self.cut)

    def __missing__(self, word: str) -> float:
        if len(self) >= self.MOST:
            self.clear()
        get = self.weights.get
        v = self[word] = sum(get(f, 0.0) for f in word_features(word))
        return v

    def sentences(self, text: str) -> Iterator[tuple[int, int, float]]:
        """(start, end, logit) of each sentence with words; each distinct word counts once."""
        for m in SENTENCE.finditer(text):
            words = WORD.findall(m[0])
            if words:
                found = {w: v for w in words if (v := self[w])}
                yield m.start(), m.end(), self.bias + sum(sorted(found.values()))

    def score(self, text: str) -> tuple[float, int]:
        """Noisy-or of all sentences, its log-odds moved by ``cut``, and how many are toxic by themselves; no words: 0."""
        quiet, offending = 0.0, 0
        for _, _, z in self.sentences(text.lower()):
            quiet += math.log1p(math.exp(z)) if z < 30 else z  # -log(1 - p)
            offending += z >= 0
        if not quiet:
            return 0.0, 0
        odds = quiet if quiet > 30 else math.log(math.expm1(quiet))
        return 1 / (1 + math.exp(min(700.0, self.cut - odds))), offending


def training_ids(labels: DataFrame, each: int = SAMPLE_EACH) -> DataFrame:
    """doc_id and toxic of at most ``each`` labelled documents of each class, none of the held-out fifth.

    Which ones depends on a hash of the id alone. A document with several labels is toxic if one says so.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    rows = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(fold != 0).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    parts = [rows.filter(c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each) for c in ("toxic = 1", "toxic <> 1")]
    return parts[0].unionAll(parts[1])


def training_texts(docs: DataFrame, labels: DataFrame, each: int = SAMPLE_EACH) -> DataFrame:
    """toxic, fold (by the text: equal ones share it) and the whole text of the training documents."""
    ids = F.broadcast(training_ids(labels, each))  # at most 2 * each rows of two numbers
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(ids, "doc_id").select("text", "toxic", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold"))


def instances(text: str) -> Iterator[set[str]]:
    """The distinct words of each sentence that has some."""
    for m in SENTENCE.finditer(text.lower()):
        if words := set(WORD.findall(m[0])):
            yield words


def select_features(texts: DataFrame, most: int = FEATURES) -> DataFrame:
    """The ``most`` features whose document counts tell the classes apart best (signed root of the log-likelihood ratio)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def partial() -> pa.RecordBatch:
            names = sorted(counts[0].keys() | counts[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[f] for f in names], pa.int64()) for c in counts)], ["f", "n0", "n1"])
            for c in counts:
                c.clear()
            return out

        for b in batches:
            for toxic, text in zip(b.column("toxic"), b.column("text"), strict=True):
                words = set().union(*instances(text.as_py()))
                counts[toxic.as_py() == 1].update({f for w in words for f in word_features(w)})
                if len(counts[0]) + len(counts[1]) >= COUNTED:
                    yield partial()
        yield partial()
        give_back()

    sums = texts.mapInArrow(run, "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    totals = texts.agg(F.count_if(F.col("toxic") != 1), F.count_if(F.col("toxic") == 1)).first()
    t0, t1 = (float(max(1, n)) for n in totals)
    scored = sums.filter("n0 + n1 >= 4")
    p1, p0, p = f"n1 / {t1}D", f"n0 / {t0}D", f"(n0 + n1) / {t0 + t1}D"
    part = lambda n, a: f"CASE WHEN {n} > 0 THEN {n} * ln({a} / ({p})) ELSE 0D END"
    return scored.withColumn("g", F.expr(f"{part('n1', p1)} + {part('n0', p0)}")).orderBy(F.desc("g"), "f").limit(most).select("f")


def bags(texts: DataFrame, names: list[str]) -> DataFrame:
    """toxic, fold and the sentences of each text as indices into ``names``.

    Equal sentences of a text are one of ``rows``, which stands ``times`` times;
    ``bare`` counts the sentences with none of the features.
    """
    index = {f: i for i, f in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}

        def found(word: str) -> list[int]:
            if (v := known.get(word)) is None:
                if len(known) >= COUNTED:
                    known.clear()
                v = known[word] = [i for f in word_features(word) if (i := index.get(f)) is not None]
            return v

        for b in (x for whole in batches for x in pieces(whole, "text", PIECE_BYTES)):
            rows, times, bare = [], [], []
            for text in b.column("text"):
                n = Counter(tuple(sorted(i for w in words for i in found(w))) for words in instances(text.as_py()))
                bare.append(n.pop((), 0))
                order = sorted(n)
                rows.append(pa.array(order, pa.list_(pa.int32())))
                times.append([n[r] for r in order])
            ends = pa.array(np.cumsum([0, *map(len, rows)]), pa.int32())
            rows = pa.ListArray.from_arrays(ends, pa.concat_arrays(rows))
            yield pa.RecordBatch.from_arrays([b.column("toxic"), b.column("fold"), rows, pa.array(times, pa.list_(pa.int32())), pa.array(bare, pa.int64())], ["toxic", "fold", "rows", "times", "bare"])
        give_back()

    return texts.mapInArrow(run, "toxic int, fold int, rows array<array<int>>, times array<int>, bare long")


class Bags:
    """Sentences as indices of features, flat: those of a document lie together."""

    def __init__(self, toxic, fold, per_doc, times, bare, sizes, cols):
        self.toxic, self.fold, self.per_doc, self.times, self.bare, self.sizes, self.cols = toxic, fold, per_doc, times, bare, sizes, cols
        self.ends = np.cumsum(np.append(0, sizes))
        self.doc_of = np.repeat(np.arange(len(toxic), dtype=np.int32), per_doc)
        self.blocks = _blocks(self.ends)

    @classmethod
    def of(cls, sample: pa.Table) -> Bags:
        one = sample.combine_chunks()
        rows = one.column("rows").combine_chunks()
        inner = rows.flatten()
        # the buffers of a slice begin elsewhere, so all are taken from what flatten() gives
        lengths = [pa.compute.list_value_length(x).to_numpy() for x in (rows, inner)]
        times = one.column("times").combine_chunks().flatten().to_numpy().astype(float)
        return cls((one.column("toxic").to_numpy() == 1).astype(float), one.column("fold").to_numpy(), lengths[0], times, one.column("bare").to_numpy().astype(float), lengths[1], inner.flatten().to_numpy())

    def part(self, use: np.ndarray) -> Bags:
        """Those of the documents in ``use``."""
        mine = use[self.doc_of]
        return Bags(self.toxic[use], self.fold[use], self.per_doc[use], self.times[mine], self.bare[use], self.sizes[mine], self.cols[np.repeat(mine, self.sizes)])

    def both(self) -> bool:
        return len(self.toxic) > 0 and self.toxic.min() < self.toxic.max()

    def quiet(self, theta: np.ndarray, bias: float, z: np.ndarray | None = None) -> np.ndarray:
        """-log P(not toxic) of each document; ``z`` takes the logits of the sentences."""
        z = np.zeros(len(self.sizes)) if z is None else z
        for lo, hi in self.blocks:
            z[lo:hi] = bias + np.add.reduceat(theta[self.cols[self.ends[lo] : self.ends[hi]]], self.ends[lo:hi] - self.ends[lo])
        return np.bincount(self.doc_of, self.times * np.logaddexp(0, z), len(self.toxic)) + self.bare * np.logaddexp(0, bias)

    def weights(self, n_features: int) -> tuple[np.ndarray, float]:
        """Weights and bias that follow the likelihood of the documents' labels; both classes count the same."""
        n, toxic, ends = len(self.toxic), self.toxic, self.ends
        each = np.where(toxic > 0, 0.5 / toxic.sum(), 0.5 / (n - toxic.sum()))
        theta, bias = np.zeros(n_features), -3.0
        m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
        z = np.zeros(len(ends) - 1)
        for step in range(1, ITERATIONS + 1):
            quiet = self.quiet(theta, bias, z)
            # d(-log likelihood)/d quiet: 1 where clean, -(1 - p) / p where toxic
            slope = each * np.where(toxic > 0, -np.exp(-quiet) / np.maximum(-np.expm1(-quiet), 1e-9), 1.0)
            ds = slope[self.doc_of] * self.times / (1 + np.exp(-z))
            g = np.append(PRIOR / n * theta, ds.sum() + (slope * self.bare).sum() / (1 + np.exp(-bias)))
            for lo, hi in self.blocks:
                g[:-1] += np.bincount(self.cols[ends[lo] : ends[hi]], np.repeat(ds[lo:hi], np.diff(ends[lo : hi + 1])), n_features)
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            move = RATE * (1 - step / (ITERATIONS + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
            theta, bias = theta - move[:-1], bias - move[-1]
        return theta, float(bias)


def threshold(own: Bags, n_features: int, each: int = CALIBRATE_EACH) -> float:
    """The log-odds of a document from which on it is called toxic.

    Documents are scored by weights fitted on the other folds, since weights
    flatter the documents that they were fitted on, the more so the fewer there
    are. The cut is where the share of toxic documents above it, less
    CLEAN_COUNTS times that of clean ones, is largest, drawn towards even odds as
    PRIOR_DOCS documents would. At most ``each`` documents of a class take part.
    """
    rank = np.where(own.toxic > 0, np.cumsum(own.toxic), np.cumsum(1 - own.toxic))
    own = own.part(rank <= each)
    odds = np.full(len(own.toxic), -np.inf)
    for k in range(FOLDS):
        rest = own.part(own.fold != k)
        if rest.both():
            odds[own.fold == k] = log_odds(own.part(own.fold == k).quiet(*rest.weights(n_features)))
    order = np.argsort(-odds, kind="stable")
    up = np.cumsum(own.toxic[order]) / own.toxic.sum() - CLEAN_COUNTS * np.cumsum(1 - own.toxic[order]) / (1 - own.toxic).sum()
    last = np.append(odds[order][1:] < odds[order][:-1], True)  # a cut does not part equal scores
    best = int(np.argmax(np.where(last, up, -np.inf)))
    ends = odds[order][best : best + 2]
    cut = float(np.clip(ends[np.isfinite(ends)], -5, 5).mean()) if up[best] > 0 and np.isfinite(ends[0]) else 0.0
    return cut * own.toxic.sum() / (own.toxic.sum() + PRIOR_DOCS)


def log_odds(quiet: np.ndarray) -> np.ndarray:
    """log(p / (1 - p)) of p = 1 - exp(-quiet)."""
    return np.where(quiet > 30, quiet, np.log(np.maximum(np.expm1(np.minimum(quiet, 30)), 1e-300)))


def fit(docs: DataFrame, labels: DataFrame, each: int = SAMPLE_EACH, most: int = FEATURES) -> Model:
    """A model from the labels outside the held-out fifth.

    The fit takes the whole texts of at most ``2 * each`` labelled documents.
    Without labels of both classes every text scores 0.
    """
    texts = written(training_texts(docs, labels, each), "toxicity")
    names = sorted(r.f for r in select_features(texts, most).collect())
    own = Bags.of(bags(texts, names).toArrow())  # 2 * each rows at most
    if not len(names) or not own.both():
        return Model({}, -40.0)
    theta, bias = own.weights(len(names))
    return Model({f: float(w) for f, w in zip(names, theta, strict=True) if abs(w) > 1e-3}, bias, threshold(own, len(names)))


def _blocks(ends: np.ndarray) -> list[tuple[int, int]]:
    """[lo, hi) of neighbouring sentences with about HELD features together, one sentence at least."""
    out, lo = [], 0
    while lo < len(ends) - 1:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + HELD, "right")) - 1)
        out.append((lo, hi))
        lo = hi
    return out


def scorer(model: Model):
    """A column function: text -> struct of score and n_offending; a null text scores as an empty one."""

    @F.pandas_udf(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("n_offending", T.LongType())]))
    def run(texts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([model.score(t or "") for t in texts], columns=["score", "n_offending"])
        give_back()
        return out

    return run


def held_out(name: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 0 modulo 5; a null id is in no fold."""
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted and n_offending of every row, from its whole text alone."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.select("doc_id", scorer(model)("text").alias("s"))
    return rows.select("doc_id", held_out().alias("held_out"), "s.score", (F.col("s.score") >= 0.5).cast("int").alias("predicted"), "s.n_offending")


def offending(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """doc_id, start, end (characters) and probability of the sentences that make documents toxic."""
    bar = math.log(least / (1 - least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, s, e, 1 / (1 + math.exp(-z))) for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) for s, e, z in model.sentences(t.lower()) if z >= bar]
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], ["doc_id", "start", "end", "probability"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, start long, end long, probability double")
