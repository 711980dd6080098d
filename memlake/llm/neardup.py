"""Operator 1: n-gram Jaccard join by MinHash banding.

1. Each text becomes its set of word five-grams.  Equal sets form one *text*,
   known by a 128-bit digest; its rows are copies and need no comparison.
2. MinHash signatures are cut into bands.  The number of bands follows from the
   rows of a band and the recall wanted at the threshold.
3. Texts meet by band hash.  A bucket of any size is linked as a star to its
   smallest text; connected stars are the groups within which pairs are verified.
4. Inside a group every pair is verified on the full sets.  Large groups are cut
   into blocks, and each pair of blocks is one piece of work, so no task holds
   more than two blocks and no pair is written out.  What leaves a task is one
   row a text: how many documents it links to and one neighbour for the tree.
5. Connected verified links are the classes.

Defined results: null texts and texts without a word have no five-gram and stay
alone; texts of fewer than five words have one gram of all their words; repeated
rows are copies of each other; classes are named by their smallest id, rows with
null ids by the smallest non-null id of their class or null; an empty table
gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from memlake.llm.common import bounded_broadcast, whole_text
from memlake.llm.components import components
from memlake.session import materialize

WORDS = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_WORDS_HELD = 500_000
_SLICE = 512


def bands_for(threshold: float, recall: float, rows: int) -> int:
    """Bands of ``rows`` rows that find a pair at the threshold with the wanted probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold ** rows))


class Shingles:
    """Hashes of word n-grams, with a bounded table of word hashes."""

    def __init__(self, n: int):
        self.n, self._words = n, {}

    def __call__(self, text: str) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the word n-grams."""
        words = WORDS.findall(text.lower())
        if not words:
            return np.empty(0, np.uint64)
        held = self._words
        if len(held) > _WORDS_HELD:
            held.clear()
        for w in set(words):
            if w not in held:
                held[w] = xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        h = np.fromiter(map(held.__getitem__, words), dtype=np.uint64, count=len(words))
        n = min(self.n, len(h))
        with np.errstate(over="ignore"):
            out = h[:len(h) - n + 1].copy()
            for i in range(1, n):
                out = (out ^ (out >> np.uint64(29))) * _MIX + h[i:len(h) - n + 1 + i]
            out ^= out >> np.uint64(32)
            out *= _MIX
            out ^= out >> np.uint64(29)
        return np.unique(out)


def set_digest(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.astype("<u8").tobytes(), digest_size=16).digest()


def signatures(sets: list[np.ndarray], bands: int, rows: int, seed: int = 1) -> np.ndarray:
    """Band hashes (sets x bands) of non-empty sets, as signed 64-bit integers."""
    rng = np.random.default_rng(seed)
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.zeros((len(sets), bands), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for band in range(bands):
            mixed = np.full(len(sets), np.uint64(band + 1))
            for _ in range(rows):
                a, b = rng.integers(0, 1 << 63, 2, dtype=np.uint64)
                h = (flat ^ b) * (a | np.uint64(1))
                h ^= h >> np.uint64(32)
                low = np.minimum.reduceat(h, starts)
                mixed = (mixed ^ low) * _MIX
                mixed ^= mixed >> np.uint64(31)
            out[:, band] = mixed
    return out.view(np.int64)


def _sign(n: int, bands: int, rows: int):
    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingles(n)
        for batch in batches:
            for at in range(0, len(batch), _SLICE):
                part = batch.iloc[at:at + _SLICE]
                sets = [shingles(t) for t in part["text"]]
                full = [i for i, s in enumerate(sets) if len(s)]
                digest, found = [None] * len(sets), [None] * len(sets)
                if full:
                    sig = signatures([sets[i] for i in full], bands, rows)
                    for row, i in enumerate(full):
                        digest[i], found[i] = set_digest(sets[i]), sig[row]
                yield pd.DataFrame({"id": part["id"].to_numpy(), "h": part["h"].to_numpy(), "digest": digest, "bands": found})
    return sign


def _collect_sets(n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingles(n)
        for batch in batches:
            for at in range(0, len(batch), _SLICE):
                sets = [s for s in map(shingles, batch["text"].iloc[at:at + _SLICE]) if len(s)]
                yield pd.DataFrame({"digest": [set_digest(s) for s in sets], "grams": [s.view(np.int64) for s in sets]})
    return run


def shared_counts(a: list[np.ndarray], b: list[np.ndarray], columns: int = 8_192) -> np.ndarray:
    """Sizes of the intersections of every set of ``a`` with every set of ``b``."""
    flat = np.concatenate([*a, *b])
    owner = np.repeat(np.arange(len(a) + len(b)), [len(s) for s in (*a, *b)])
    _, gram, uses = np.unique(flat, return_inverse=True, return_counts=True)
    keep = uses[gram] > 1
    gram, owner = np.unique(gram[keep], return_inverse=True)[1], owner[keep]
    out = np.zeros((len(a), len(b)), dtype=np.float32)
    order = np.argsort(gram, kind="stable")
    gram, owner = gram[order], owner[order]
    for low in range(0, int(gram[-1]) + 1 if len(gram) else 0, columns):
        x, y = np.searchsorted(gram, (low, low + columns))
        grid = np.zeros((len(a) + len(b), columns), dtype=np.float32)
        grid[owner[x:y], gram[x:y] - low] = 1
        out += grid[:len(a)] @ grid[len(a):].T
    return out


def verified(sets: list[np.ndarray], block: np.ndarray, within: bool, threshold: float) -> np.ndarray:
    """Matrix of links: all pairs of one block, or the pairs across the two blocks of the group."""
    size = np.array([len(s) for s in sets], dtype=np.float64)
    n = len(sets)
    link = np.zeros((n, n), dtype=bool)
    share = threshold / (1 + threshold)
    if within:
        link = shared_counts(sets, sets) >= share * (size[:, None] + size[None, :]) - 1e-6
        np.fill_diagonal(link, False)
    else:
        left, right = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
        if len(left) and len(right) and block.min() != block.max():
            both = shared_counts([sets[i] for i in left], [sets[i] for i in right])
            both = both >= share * (size[left][:, None] + size[right][None, :]) - 1e-6
            link[np.ix_(left, right)] = both
            link[np.ix_(right, left)] = both.T
    return link


def _roots(link: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each row."""
    label = np.arange(len(link))
    while True:
        low = np.minimum(label, np.where(link, label[None, :], len(link)).min(axis=1))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _verify(threshold: float):
    columns = ["digest", "root", "links"]

    def group(rows: list[tuple]) -> pd.DataFrame:
        first, second = rows[0][1], rows[0][2]
        known: dict[bytes, tuple] = {}
        for r in rows:
            known.setdefault(r[4], r)
        rows = [known[d] for d in sorted(known)]
        sets = [np.asarray(r[6]).view(np.uint64) for r in rows]
        link = verified(sets, np.array([r[3] for r in rows]), first == second, threshold)
        copies = np.array([r[5] for r in rows], dtype=np.int64)
        root = _roots(link)
        some = np.flatnonzero(link.any(axis=1))
        return pd.DataFrame({"digest": [rows[i][4] for i in some], "root": [rows[root[i]][4] for i in some],
                             "links": (link[some] @ copies).astype(np.int64)}, columns=columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, key, ready, size = [], None, [], 0
        for batch in batches:
            for r in zip(*(batch[c] for c in ("comp", "first", "second", "block", "digest", "copies", "grams"))):
                if r[:3] != key:
                    if len(held) > 1:
                        ready.append(group(held))
                        size += len(ready[-1])
                        if size > 5_000:
                            yield pd.concat(ready)
                            ready, size = [], 0
                    held, key = [], r[:3]
                held.append(r)
        if len(held) > 1:
            ready.append(group(held))
        if ready:
            yield pd.concat(ready)
    return run


def _classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8,
             recall: float = 0.9995, rows: int = 5, block_texts: int = 256, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Per row ``id``, hash ``h`` of the text, ``digest`` of its set, class ``comp`` and ``class_id``, ``links``."""
    kind = docs.schema[doc_id].dataType
    slim = docs.select(F.col(doc_id).cast("string").alias("id"), whole_text(text).alias("text"))
    slim = slim.withColumn("h", F.xxhash64("text"))
    signed = materialize(slim.mapInPandas(
        _sign(n, bands_for(threshold, recall, rows), rows), "id string, h long, digest binary, bands array<long>")
        .withColumn("id", F.col("id").cast(kind)), "minhash")
    texts = materialize(signed.where("digest IS NOT NULL").groupBy("digest").agg(
        F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands")), "minhash-texts")

    band = texts.select("digest", F.explode("bands").alias("band"))
    # written before the join, so that Spark can split the rows of a large bucket over tasks
    buckets = materialize(band.groupBy("band").agg(F.min("digest").alias("head"), F.count("*").alias("n")).where("n > 1"),
                          "minhash-buckets")
    stars = band.join(buckets, "band").where("digest != head").select("digest", "head").distinct()
    comp = components(materialize(stars, "minhash-stars"), "digest", "head")

    sizes = comp.groupBy("comp").agg(F.ceil(F.count("*") / block_texts).cast("int").alias("blocks"))
    members = materialize(comp.join(sizes, "comp").join(texts.select("digest", "rep", "copies"),
                                                        F.col("node") == F.col("digest")).select(
        "digest", "rep", "copies", "comp", "blocks", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int").alias("block")),
        "minhash-members")
    wanted = members.select(F.col("rep").cast("string").alias("id")).distinct()
    some = slim.join(bounded_broadcast(wanted, members.count(), broadcast_rows), slim["id"].eqNullSafe(wanted["id"]), "left_semi")
    sets = some.select("text").mapInPandas(_collect_sets(n), "digest binary, grams array<long>")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = sets.join(members, "digest").withColumn("other", other).select(
        "comp", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"),
        "block", "digest", "copies", "grams")
    found = materialize(dealt.repartition("comp", "first", "second").sortWithinPartitions("comp", "first", "second")
                        .mapInPandas(_verify(threshold), "digest binary, root binary, links long"), "minhash-links")
    links = found.groupBy("digest").agg(F.sum("links").alias("links"))
    tree = components(materialize(found.where("digest != root").select("digest", "root").distinct(), "minhash-tree"),
                      "digest", "root")
    named = texts.select("digest", "rep", "copies").join(tree, F.col("digest") == F.col("node"), "left").withColumn(
        "comp", F.coalesce("comp", "digest")).join(links, "digest", "left")
    smallest = named.groupBy("comp").agg(F.min("rep").alias("class_id"))
    final = named.join(smallest, "comp").select(
        "digest", "comp", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("links"))
    return signed.select("id", "h", "digest").join(final, "digest", "left").select(
        "id", "h", "digest", "comp", F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("links", F.lit(0).cast("long")).alias("links"))


def classes(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, class_id, links`` of every document: its class, and how many other documents it links to."""
    return _classes(docs, **options).select(F.col("id").alias("doc_id"), "class_id", "links")


def one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", broadcast_rows: int = 1_000_000,
                **options) -> DataFrame:
    """``docs`` with one row of each class, that of the smallest id; rows without a word all stay.

    Rows are known by id and text, so rows that share an id but not their text
    are told apart; of rows alike in both one stays.
    """
    columns = docs.columns
    found = materialize(_classes(docs, doc_id=doc_id, text=text, broadcast_rows=broadcast_rows, **options)
                        .where("digest IS NOT NULL").select("id", "h", "comp"), "minhash-classes")
    first = found.groupBy("comp").agg(F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "h")).alias("first"))
    chosen = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("h") == F.col("first.h"))
    gone = materialize(found.join(first, "comp").where(~chosen).select(
        F.col("id").alias("__id"), F.col("h").alias("__gone")).distinct(), "minhash-gone")
    again = materialize(found.groupBy(F.col("id").alias("__id"), F.col("h").alias("__again")).count().where("count > 1")
                        .drop("count"), "minhash-again")
    marked = docs.withColumn("__h", F.xxhash64(whole_text(text)))
    same = F.col(doc_id).eqNullSafe(F.col("__id"))
    kept = marked.join(bounded_broadcast(gone, gone.count(), broadcast_rows), same & (F.col("__h") == F.col("__gone")), "left_anti")
    if not again.limit(1).count():
        return kept.select(*columns)
    repeated = same & (F.col("__h") == F.col("__again"))
    once = kept.join(again, repeated, "left_semi").dropDuplicates([doc_id, "__h"])
    return kept.join(again, repeated, "left_anti").unionByName(once).select(*columns)
