"""Operator 7: toxicity by subword-bag embeddings and a linear softmax.

A word is the bag of its character n-grams (three to five, with borders) and of
itself, hashed into ``buckets`` rows of an embedding table; a piece of text is
the average of its words' rows, and a linear softmax of two classes reads the
average.  Table and softmax are trained jointly in numpy, so an unseen
misspelling falls among the words whose n-grams it shares.  A run of more than
``LONGEST`` letters and digits is read as consecutive words of ``PART``
characters that overlap by the longest n-gram but one, so every n-gram of the
run counts, wherever it stands.

A document is cut into pieces of at most ``piece_words`` words, so
that a few insults in a long text are not averaged away.  Its score is that of
its most toxic pieces on a logistic curve that is even where the F measure is best on
fitting rows kept for it, each class weighted to its share of all labels to learn from.

Fitting reads at most ``fit_docs`` labelled documents of either class, those
with the smallest hash of their id; every other step covers all documents.

Defined results: a null or empty text, or one without words, is scored as a text
with no evidence; without labels of both classes every score is the share of
toxic labels, 0 without labels.  Repeated rows get the same score; rows with
several labels learn from the greatest; empty tables give none; extra columns
are not read.
"""

from __future__ import annotations

import re

import numpy as np
from xxhash import xxh32_intdigest
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import whole_text
from memlake.llm.language import fold

WORDS = re.compile(r"[^\W_]+")
GRAMS = (3, 4, 5)
#: characters of the longest word read as one, and of the words that longer runs are cut into
LONGEST, PART = 40, 12
_WORDS_HELD = 500_000


def words_of(text: str) -> list[str]:
    """Words of a text; only the ends of a run are borders, so inner parts of a long one are marked with ``_``."""
    out = []
    for run in WORDS.findall(text.lower()):
        if len(run) <= LONGEST:
            out.append(run)
            continue
        last = len(run) - PART
        starts = [*range(0, last, PART - max(GRAMS) + 1), last]
        out += [("_" if at else "") + run[at:at + PART] + ("_" if at < last else "") for at in starts]
    return out


def word_buckets(word: str, buckets: int) -> list[int]:
    """Rows of a word: itself and its n-grams, with borders where it is not cut (``_``)."""
    edged = ("" if word[:1] == "_" else "<") + word.strip("_") + ("" if word[-1:] == "_" else ">")
    bags = [word] + [edged[i:i + n] for n in GRAMS for i in range(len(edged) - n + 1)]
    return [xxh32_intdigest(b.encode("utf-8", "surrogatepass")) % buckets for b in bags]


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of the slices ``starts[i] : starts[i] + sizes[i]``, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class SubwordSoftmax:
    """Embeddings (buckets x dim) and softmax (dim x 2), and the curve from evidence to scores.

    Rows of n-grams seen in fewer than ``min_docs`` fitting documents stay zero
    and say nothing.
    """

    def __init__(self, dim: int = 8, buckets: int = 1 << 18, piece_words: int = 24, min_docs: int = 3,
                 epochs: int = 8, rate: float = 0.4, seed: int = 5):
        self.dim, self.buckets, self.piece_words, self.min_docs = dim, buckets, piece_words, min_docs
        self.epochs, self.rate, self.seed = epochs, rate, seed
        self.table = np.zeros((buckets, dim), dtype=np.float32)
        self.softmax = np.zeros((dim, 2))
        self.bias = np.zeros(2)
        self.curve = (0.0, 0.0)
        self.share = 0.0
        self.trained = False
        self._forget()

    def __getstate__(self):
        return {**self.__dict__, "_margin": {}, "_sums": np.zeros((0, 2)), "_worth": None}

    def _forget(self) -> None:
        """Drop what was derived from the table: the row margins and the words met so far."""
        self._margin: dict[str, int] = {}
        self._sums, self._worth = np.zeros((0, 2)), None

    def pieces(self, count: int) -> np.ndarray:
        """Starts of the pieces of a text of ``count`` words, of nearly equal length."""
        n = -(-count // self.piece_words)
        return np.arange(0, count, -(-count // n)) if count else np.empty(0, np.int64)

    def train(self, texts: list[str], labels: list[int], stands_for: tuple[float, float] = (1.0, 1.0)) -> "SubwordSoftmax":
        """Mini-batches of documents; a document's margin is a soft maximum over its pieces, sharper each round.

        A fifth of the documents is kept for the curve, where a document of class
        y counts as the ``stands_for[y]`` labelled documents that it was drawn from.
        """
        y = np.asarray(labels, dtype=int)
        self.share = float(y.mean()) if len(y) else 0.0
        if not len(y) or y.min() == y.max():
            return self
        index: dict[str, int] = {}
        docs = [np.array([index.setdefault(w, len(index)) for w in words_of(t)], dtype=np.int64) for t in texts]
        rows = [word_buckets(w, self.buckets) for w in index]
        sizes = np.array([len(r) for r in rows])
        starts = np.concatenate(([0], np.cumsum(sizes)))
        flat = np.array([b for r in rows for b in r], dtype=np.int64)
        rng = np.random.default_rng(self.seed)
        order = rng.permutation(len(y))
        fit_on, curve_on = order[len(order) // 5:], order[:len(order) // 5]
        if min(np.bincount(y[curve_on], minlength=2).min(), np.bincount(y[fit_on], minlength=2).min()) == 0:
            fit_on = curve_on = order
        seen = np.zeros(self.buckets, dtype=np.int32)
        for d in fit_on:
            words = np.unique(docs[d])
            if len(words):
                seen[np.unique(flat[_ragged(starts[words], sizes[words])])] += 1
        live = seen >= self.min_docs
        self.softmax = rng.normal(0, 0.5, (self.dim, 2))
        past = np.full(self.buckets, 1e-6)
        weight = np.array([0.5 / max(1e-6, 1 - self.share), 0.5 / max(1e-6, self.share)])
        for epoch in range(self.epochs):
            sharp = 1.0 + epoch * 0.5
            for at in range(0, len(fit_on), 48):
                if at == 0:
                    rng.shuffle(fit_on)
                batch = [d for d in fit_on[at:at + 48] if len(docs[d])]
                if not batch:
                    continue
                words, where = np.unique(np.concatenate([docs[d] for d in batch]), return_inverse=True)
                span = sizes[words]
                bag = flat[_ragged(starts[words], span)]
                edge = np.concatenate(([0], np.cumsum(span)[:-1]))
                vectors = np.add.reduceat(self.table[bag], edge, axis=0)
                cuts, piece_doc, begin = [], [], 0
                for i, d in enumerate(batch):
                    own = self.pieces(len(docs[d]))
                    cuts.append(own + begin)
                    piece_doc.append(np.full(len(own), i))
                    begin += len(docs[d])
                cuts, piece_doc = np.concatenate(cuts), np.concatenate(piece_doc)
                lengths = np.diff(np.append(cuts, begin))
                grams = np.add.reduceat(span[where], cuts)
                means = np.add.reduceat(vectors[where], cuts, axis=0) / grams[:, None]
                slope = self.softmax[:, 1] - self.softmax[:, 0]
                margin = means @ slope + self.bias[1] - self.bias[0]
                first = np.concatenate(([0], np.flatnonzero(np.diff(piece_doc)) + 1))
                top = np.maximum.reduceat(margin, first)[piece_doc]
                soft = np.exp(sharp * (margin - top))
                soft /= np.add.reduceat(soft, first)[piece_doc]
                pooled = np.add.reduceat(soft * margin, first)
                label = y[batch]
                error = (1 / (1 + np.exp(-np.clip(pooled, -30, 30))) - label) * weight[label]
                push = error[piece_doc] * soft
                each = np.repeat(push / grams, lengths)
                total = np.bincount(where, weights=each, minlength=len(words))
                touched, back = np.unique(bag, return_inverse=True)
                spread = np.bincount(back, weights=np.repeat(total, span), minlength=len(touched))
                grad = spread[:, None] * slope * live[touched][:, None]
                past[touched] += (grad * grad).sum(axis=1)
                self.table[touched] -= (self.rate * grad / np.sqrt(past[touched])[:, None]).astype(np.float32)
                move = 0.05 * (push[:, None] * means).sum(axis=0)
                self.softmax[:, 1] -= move
                self.softmax[:, 0] += move
                self.bias += 0.01 * push.sum() * np.array([1.0, -1.0])
        self.trained = True
        self._forget()
        self.curve = _curve(np.array([self.evidence(texts[d]) for d in curve_on]), y[curve_on],
                            np.asarray(stands_for, dtype=float)[y[curve_on]])
        return self

    def _known(self, words: list[str]) -> np.ndarray:
        """Places of the words in the table of margins, which holds words as they come up."""
        if len(self._margin) + len(words) > max(_WORDS_HELD, len(words)):
            self._margin, self._sums = {}, np.zeros((0, 2))
        place, slope = self._margin, self.softmax[:, 1] - self.softmax[:, 0]
        fresh = [w for w in dict.fromkeys(words) if w not in place]
        if fresh:
            bags = [word_buckets(w, self.buckets) for w in fresh]
            sizes = np.array([len(b) for b in bags])
            edge = np.cumsum(sizes) - sizes
            worth = self.table @ slope if self._worth is None else self._worth
            self._worth = worth
            sums = np.add.reduceat(worth[[r for b in bags for r in b]], edge)
            at = len(place)
            if at + len(fresh) > len(self._sums):
                self._sums = np.concatenate([self._sums, np.zeros((len(self._sums) + len(fresh) + 1024, 2))])
            self._sums[at:at + len(fresh)] = np.stack([sums, sizes], axis=1)
            place.update(zip(fresh, range(at, at + len(fresh))))
        return np.fromiter(map(place.__getitem__, words), dtype=np.int64, count=len(words))

    def evidence(self, text: str) -> float:
        """Mean margin of the two most toxic pieces."""
        words = words_of(text)
        if not words:
            return 0.0
        at = self._known(words)
        sums = np.add.reduceat(self._sums[at], self.pieces(len(words)), axis=0)
        margin = np.sort(sums[:, 0] / sums[:, 1])[::-1] + float(self.bias[1] - self.bias[0])
        return float(margin[:2].mean())

    def score(self, text: str) -> float:
        if not self.trained:
            return self.share
        a, b = self.curve
        return float(1 / (1 + np.exp(-np.clip(a * self.evidence(text) + b, -30, 30))))


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and height of a logistic curve on one number, by Newton's method, lightly penalised."""
    mean = np.average(x, weights=weight)
    scale = float(np.sqrt(np.average((x - mean) ** 2, weights=weight))) or 1.0
    z = np.stack([x / scale, np.ones(len(x))], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (weight * (p - y)) + np.array([0.1, 0.0]) * w
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag([0.1, 1e-6])
        w -= np.clip(np.linalg.solve(hess, grad), -2, 2)
    a, b = max(float(w[0]), 0.0) / scale, float(w[1])
    # the even score is put where the F measure is greatest
    best, cut, toxic = -1.0, 0.0, (weight * y).sum()
    for t in np.unique(x):
        chosen = x >= t
        f = 2 * (weight * y)[chosen].sum() / max(1, weight[chosen].sum() + toxic)
        if f > best:
            below = x[x < t]
            best, cut = f, (t + below.max()) / 2 if len(below) else t - 1.0
    return (a, -a * cut) if a > 0 else (a, b)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, *, doc_id: str = "doc_id", text: str = "text",
        label: str = "toxic", fit_docs: int = 3_000, **model) -> SubwordSoftmax:
    """A model of at most ``fit_docs`` documents of either class; the even score is put by the share of the classes in ``labels``."""
    known = labels.where(learn & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(
        F.max(label).cast("int").alias("y"))
    texts = docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    by_hash = known.withColumn("h", F.xxhash64(F.col("doc_id").cast("string")))
    chosen = None
    for y in (0, 1):
        part = by_hash.where(F.col("y") == y).orderBy("h", "doc_id").limit(fit_docs)
        chosen = part if chosen is None else chosen.unionByName(part)
    # rows that repeat an id give one text, so no more than the chosen documents reach the driver
    rows = texts.join(F.broadcast(chosen.select("doc_id", "y", "h")), "doc_id").groupBy("doc_id", "y", "h").agg(
        F.min_by("text", F.xxhash64("text")).alias("text")).toPandas()
    rows = rows.sort_values(["h", "doc_id", "text"]).reset_index(drop=True)
    stands_for = tuple(max(1.0, counts.get(y, 0) / fit_docs) for y in (0, 1))
    return SubwordSoftmax(**model).train(rows["text"].tolist(), rows["y"].astype(int).tolist(), stands_for)


def rate(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
         parts: int = 5, held_out: int = 0, fit_docs: int = 3_000, **model) -> DataFrame:
    """``doc_id, held_out, score, predicted``; learns from the folds other than ``held_out``."""
    fitted = fit(docs, labels, fold(doc_id, parts) != held_out, doc_id=doc_id, text=text, label=label,
                 fit_docs=fit_docs, **model)
    slim = docs.select(F.col(doc_id).cast("string").alias("doc_id"), (fold(doc_id, parts) == held_out).alias("held_out"),
                       whole_text(text).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(fitted)  # buckets x dim numbers, whatever the corpus

    def run(batches):
        model = sent.value
        for batch in batches:
            score = [model.score(t) for t in batch["text"]]
            yield batch[["doc_id", "held_out"]].assign(score=score, predicted=[int(s >= 0.5) for s in score])

    return slim.mapInPandas(run, "doc_id string, held_out boolean, score double, predicted int").withColumn(
        "doc_id", F.col("doc_id").cast(docs.schema[doc_id].dataType))
