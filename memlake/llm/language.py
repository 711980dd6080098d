"""Operator 3: language identification by rank-order profiles.

A profile is the list of a language's most frequent letter n-grams (one to
three letters, word borders included), by rank.  A document is ranked alike over
its whole text, and the language with the smallest out-of-place distance wins:
the sum, over the document's n-grams, of the difference of ranks, or of the
profile's length where the n-gram is missing there.

Profiles are fitted on at most ``fit_docs`` documents a language, those with the
smallest hash of their id out of a range of hashes that holds about twice as many,
and counted in parallel; the counts of a part of the
corpus are merged by addition.  Languages are few, so profiles go to the tasks
with the code.

``score`` is the winner's closeness, 1 for a text ranked exactly as its profile
and 0 for one that shares no n-gram with it.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
so is every text if there is nothing to learn from.  Ties of frequency go to the
smaller n-gram code, ties of distance to the language first in code-point
order.  Repeated rows get the same result; empty tables give none; extra columns
are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm.common import bounded_broadcast, whole_text
from memlake.session import materialize

UNKNOWN = "und"
ORDERS = (1, 2, 3)
_BITS = 21
_LETTERS = np.zeros(0x110000, dtype=bool)


def _letters() -> np.ndarray:
    """Which code points are letters; filled once a worker."""
    if not _LETTERS[ord("a")]:
        _LETTERS[:] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _LETTERS


def coded(text: str) -> np.ndarray:
    """Lower-case letters as numbers, runs of anything else as one 0; empty without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    letter = _letters()[codes]
    if not letter.any():
        return np.empty(0, np.int64)
    codes = np.where(letter, codes, 0)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return np.concatenate(([0], codes[keep], [0]))


def gram_counts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n-gram codes, ascending, and their counts; n-grams of a border alone are left out."""
    found = []
    for n in ORDERS:
        if len(codes) >= n:
            gram = codes[:len(codes) - n + 1].copy()
            for i in range(1, n):
                gram = (gram << _BITS) | codes[i:len(codes) - n + 1 + i]
            if n == 3:
                gram = gram[codes[1:-1] != 0]
            found.append(gram)
    return np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.int64),) * 2


def ranked(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent n-grams, most frequent first."""
    real = grams != 0
    grams, counts = grams[real], counts[real]
    if len(counts) > size:
        least = np.partition(counts, -size)[-size]
        grams, counts = grams[counts >= least], counts[counts >= least]
    return grams[np.argsort(-counts, kind="stable")][:size]


class Profiles:
    def __init__(self, profiles: dict[str, np.ndarray], size: int):
        self.names, self.size = sorted(profiles), size
        grams = np.unique(np.concatenate([np.empty(0, np.int64), *profiles.values()]))
        ranks = np.full((len(self.names), len(grams) + 1), size, dtype=np.int64)
        for i, name in enumerate(self.names):
            ranks[i, np.searchsorted(grams, profiles[name])] = np.arange(len(profiles[name]))
        self.grams, self.ranks = grams, ranks

    def predict(self, text: str) -> tuple[str, float]:
        codes = coded(text)
        if not len(codes) or not self.names:
            return UNKNOWN, 0.0
        own = ranked(*gram_counts(codes), self.size)
        at = np.searchsorted(self.grams, own)
        at[at == len(self.grams)] = 0
        known = self.grams[at] == own if len(self.grams) else np.zeros(len(own), bool)
        theirs = self.ranks[:, np.where(known, at, -1)]
        place = np.arange(len(own))
        distance = np.where(theirs < self.size, np.abs(theirs - place), self.size).sum(axis=1)
        best = int(np.argmin(distance))
        return self.names[best], float(1.0 - distance[best] / (self.size * len(own)))


def _count_part(batches):
    totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def add(lang, grams, counts):
        if lang in totals:
            grams = np.concatenate([totals[lang][0], grams])
            counts = np.concatenate([totals[lang][1], counts])
            grams, where = np.unique(grams, return_inverse=True)
            counts = np.bincount(where, weights=counts).astype(np.int64)
        totals[lang] = (grams, counts)

    for batch in batches:
        for lang, group in batch.groupby("lang"):
            for start in range(0, len(group), 64):
                add(lang, *gram_counts(np.concatenate([coded(t) for t in group["text"].iloc[start:start + 64]])))
    for lang, (grams, counts) in totals.items():
        yield pd.DataFrame({"lang": lang, "gram": grams, "n": counts})


def fit(docs: DataFrame, labelled: Column, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
        fit_docs: int = 3_000, size: int = 1_200, broadcast_rows: int = 500_000) -> Profiles:
    """Profiles of the languages named in the ``labelled`` rows, of at most ``fit_docs`` documents each.

    Rows alike in id and text are one document there, and each counts.  Only ``size`` rows a language reach the driver.
    """
    rows = docs.where(labelled & F.col(lang).isNotNull() & F.col(doc_id).isNotNull()).select(
        F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), whole_text(text).alias("text"))
    keyed = rows.select("doc_id", "lang", F.xxhash64(F.col("doc_id").cast("string")).alias("h"), F.xxhash64("text").alias("t"))
    documents = materialize(keyed.groupBy("lang").agg(F.count("*").alias("documents")), "language-counts")
    # a hash range of about twice the sample, applied before the shuffle, so that a frequent language is not ordered whole
    share = F.lit(2.0 * fit_docs) / F.col("documents")
    sized = keyed.join(bounded_broadcast(documents, documents.count(), broadcast_rows), "lang").where(
        F.pmod("h", F.lit(1 << 40)) <= share * F.lit(float(1 << 40)))
    first = Window.partitionBy("lang").orderBy("h", "doc_id", "t")
    chosen = sized.distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= fit_docs)
    chosen = materialize(chosen.select(F.col("doc_id").alias("of"), F.col("lang").alias("in"), "t"), "language-sample")
    same = (F.col("doc_id") == F.col("of")) & (F.xxhash64("text") == F.col("t")) & (F.col("lang") == F.col("in"))
    sample = rows.join(bounded_broadcast(chosen, chosen.count(), broadcast_rows), same, "left_semi").select("lang", "text")
    counts = sample.mapInPandas(_count_part, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = (counts.where("gram != 0").withColumn("rank", F.row_number().over(top))
            .where(F.col("rank") <= size).select("lang", "gram", "rank").toPandas())
    best = best.sort_values(["lang", "rank"])
    return Profiles({k: g["gram"].to_numpy(np.int64) for k, g in best.groupby("lang")}, size)


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; 0 for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(parts)), F.lit(0))


def identify(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", parts: int = 4,
             held_out: int = 2, fit_docs: int = 3_000, size: int = 1_200) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``; learns from the folds other than ``held_out``."""
    profiles = fit(docs, fold(doc_id, parts) != held_out, doc_id=doc_id, text=text, lang=lang, fit_docs=fit_docs, size=size)
    slim = docs.select(F.col(doc_id).cast("string").alias("doc_id"), (fold(doc_id, parts) == held_out).alias("held_out"),
                       whole_text(text).alias("text"))


    def run(batches):
        for batch in batches:
            found = [profiles.predict(t) for t in batch["text"]]
            yield batch[["doc_id", "held_out"]].assign(lang_pred=[f[0] for f in found], score=[f[1] for f in found])

    return slim.mapInPandas(run, "doc_id string, held_out boolean, lang_pred string, score double").withColumn(
        "doc_id", F.col("doc_id").cast(docs.schema[doc_id].dataType))


def accepted(docs: DataFrame, profiles: Profiles, *, text: str = "text", min_score: float = 0.25) -> DataFrame:
    """Rows of ``docs`` with a letter and, if there are profiles, a language scored at least ``min_score``.

    A text far from every profile is in none of the languages.
    """
    def accept(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            name, score = profiles.predict("" if t is None else t)
            out.append(name != UNKNOWN and score >= min_score if profiles.names else bool(len(coded(t or ""))))
        return pd.Series(out, dtype=bool)

    return docs.where(F.pandas_udf(accept, "boolean")(F.col(text)))
