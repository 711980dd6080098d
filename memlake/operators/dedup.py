"""Near-duplicate detection and merging."""

from __future__ import annotations

import bisect
import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.functions.lexicon import CONTRACTIONS, STOP_TERMS, jvm_regex
from memlake.functions.text import (
    as_timestamp, distinct_tokens, fingerprint, jaccard, normalize_text, pair_similarity,
    round2, round2_value, tokenize, with_sized_similarity,
)
from memlake.operators.vector_search import nearest
from memlake.operators.windows import top_k
from memlake.session import materialize

DUPLICATE_THRESHOLD = 0.92


# -- inside one event --------------------------------------------------------

def _leads(threshold: float):
    @F.pandas_udf("array<int>")
    def leads(norms: pd.Series, lengths: pd.Series) -> pd.Series:
        """For each text of an event, the index of the accepted text it joins."""
        out = []
        for texts, sizes in zip(norms, lengths):
            if texts is None:
                out.append(None)
                continue
            token_sets = [distinct_tokens(t) for t in texts]
            accepted: list[int] = []       # lead index
            shown: list[int] = []          # index of the text the lead now carries
            lead_of = []
            for i in range(len(texts)):
                for slot, j in enumerate(shown):
                    if pair_similarity(texts[i], texts[j], token_sets[i], token_sets[j]) >= threshold:
                        lead_of.append(accepted[slot])
                        if sizes[i] > sizes[j]:
                            shown[slot] = i
                        break
                else:
                    accepted.append(i)
                    shown.append(i)
                    lead_of.append(i)
            out.append(lead_of)
        return pd.Series(out)
    return leads


def _merge_step(kept: Column, new: Column, columns: list[str]) -> Column:
    """One merge of two rows held as structs: ``kept`` came first."""
    longer = lambda c: F.when(
        F.length(new[c]) > F.length(kept[c]), new[c]).otherwise(kept[c])
    merged = {
        "content": longer("content"),
        "summary": longer("summary"),
        "importance": F.greatest(kept["importance"], new["importance"]),
        "confidence": round2(kept["confidence"] * F.lit(2 / 3) + new["confidence"] * F.lit(1 / 3)),
        "tags": F.array_union(kept["tags"], new["tags"]),
        "keywords": F.array_union(kept["keywords"], new["keywords"]),
        "entities": F.array_union(kept["entities"], new["entities"]),
    }
    return F.struct(*[merged.get(c, kept[c]).alias(c) for c in columns])


def dedup_within_event(df: DataFrame, threshold: float = DUPLICATE_THRESHOLD) -> DataFrame:
    """Merge rows of one event that restate an earlier row of that event.

    Rows are compared in segment order with the accepted rows, each under its
    merged text.  A group is the text of one event.  Only events in which two
    rows could be that similar are sent to Python.
    """
    cols = df.columns
    norm = normalize_text(F.col("content"))
    staged = df.withColumn("__norm", norm)
    staged = staged.withColumn("__toks", F.array_sort(F.array_distinct(tokenize(F.col("__norm")))))
    grouped = staged.groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct(
        "segment_index", F.struct(*cols).alias("row"), "__norm",
        F.array_join("__toks", " ").alias("bag"), F.size("__toks").alias("n")))).alias("rows"))
    # above 0.9, sets of fewer than ten tokens must be equal to be near-duplicates
    rows = F.col("rows")
    twins = F.size(F.array_distinct(F.transform(rows, lambda r: r["bag"]))) < F.size(rows)
    long_rows = F.size(F.filter(rows, lambda r: r["n"] >= 10)) >= 2
    maybe = (twins | long_rows) if threshold > 0.9 else (F.size(rows) > 1)
    grouped = grouped.withColumn("lead", _leads(threshold)(
        F.when(maybe, F.transform(rows, lambda r: r["__norm"])),
        F.when(maybe, F.transform(rows, lambda r: F.length(r["row"]["content"])))))
    items = F.transform(rows, lambda r, i: F.struct(
        r["row"].alias("row"), i.alias("i"),
        F.coalesce(F.get(F.col("lead"), i), i).alias("lead")))
    grouped = grouped.select(items.alias("items"))
    heads = F.filter(F.col("items"), lambda x: x["i"] == x["lead"])
    merged = F.transform(heads, lambda h: F.aggregate(
        F.filter(F.col("items"), lambda x: (x["lead"] == h["i"]) & (x["i"] != h["i"])),
        F.struct(*[h["row"][c].alias(c) for c in cols]),
        lambda acc, x: _merge_step(acc, x["row"], cols)))
    out = grouped.select(F.explode(merged).alias("m")).select("m.*")
    return out.withColumn("fingerprint", fingerprint(F.col("content")))


# -- similarity of given pairs ------------------------------------------------

def text_similarity(pairs: DataFrame, a: str = "text_a", b: str = "text_b",
                    out: str = "similarity") -> DataFrame:
    """Add the token similarity of two text columns."""
    from memlake.functions.text import similarity_of_texts

    return similarity_of_texts(pairs, a, b, out)


def relatedness(pairs: DataFrame) -> DataFrame:
    """Relatedness of rows carrying ``tokens/entities/domain`` with suffixes ``_a`` and ``_b``.

    0.5 token Jaccard + 0.3 entity overlap + 0.2 same domain.
    """
    ta, tb = F.array_distinct("tokens_a"), F.array_distinct("tokens_b")
    values = lambda c: F.transform(c, lambda e: F.lower(e["value"]))
    staged = pairs.withColumns({
        "__j": jaccard(ta, tb), "__ea": values("entities_a"), "__eb": values("entities_b")})
    shared = F.size(F.filter("__ea", lambda v: F.array_contains(F.col("__eb"), v)))
    entity = F.least(F.lit(1.0), (shared + 0.5) / F.greatest(
        F.size("__ea"), F.size("__eb"), F.lit(1)))
    domain = F.when(F.col("domain_a") == F.col("domain_b"), 1.0).otherwise(0.0)
    return staged.withColumn(
        "relatedness", F.col("__j") * 0.5 + entity * 0.3 + domain * 0.2).drop("__j", "__ea", "__eb")


# -- all near-duplicate pairs of a scope --------------------------------------

def _size_classes(threshold: float, size: int) -> tuple[list[int], list[int]]:
    """First sizes of the classes up to ``size``, and the parts that a set is cut into in each.

    A set and a larger one of at least this Jaccard index lie in one class or in two neighbouring ones.  They
    differ in fewer tokens than the parts of the smaller one's class, so they agree on the whole of some part.
    """
    starts, parts = [1], []
    while starts[-1] <= size:
        after = math.floor(starts[-1] / threshold + 1e-6) + 1
        small, large = after - 1, math.floor((after - 1) / threshold + 1e-6)
        parts.append(math.floor((small + large) * (1 - threshold) / (1 + threshold) + 1e-6) + 1)
        starts.append(after)
    return starts[:-1], parts


_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _part_keys(hashes: np.ndarray, sums: np.ndarray, of_class: int, parts: int) -> np.ndarray:
    """A key for each part of sorted token hashes: what the part holds, its place and its class."""
    cuts = -(-np.arange(parts + 1, dtype=np.int64) * (1 << 32) // parts) if parts > 1 else np.array([0, 1 << 32])
    edges = np.searchsorted(hashes >> np.uint64(32), cuts.astype(np.uint64))
    x = sums[edges[1:]] - sums[edges[:-1]]
    x = (x ^ (np.arange(parts, dtype=np.uint64) + np.uint64(of_class << 32)) * _MIX[0]) * _MIX[1]
    return (x ^ (x >> np.uint64(31))) * _MIX[2]


class _TokenHashes(dict):
    """64-bit hashes by token; those of the 100,000 seen first are kept."""

    def __missing__(self, token: bytes) -> int:
        found = int.from_bytes(hashlib.blake2b(token, digest_size=8).digest(), "little")
        if len(self) < 100_000:
            self[token] = found
        return found


SET_COLUMNS = {"digest": "binary", "n": "int", "hashes": "array<long>", "short": "string", "own": "array<long>", "lower": "array<long>"}


def _token_sets(few: float, bound: float, long_bound: float):
    """Digest, token hashes and keys in place of ``text``, the last column, in lower case with contractions expanded.

    ``own`` are the keys of a set in its size class, ``lower`` those in the class below; sets of at most ``few``
    tokens have keys for ``bound`` too, of three or more for ``long_bound``.
    """
    plain = bytes(c if c in b"abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))
    stop = {t.encode() for t in STOP_TERMS}
    known = _TokenHashes()
    longs = pa.list_(pa.int64())
    types = [pa.binary(), pa.int32(), longs, pa.string(), longs, longs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds: dict[float, tuple[list[int], list[int]]] = {}

        def keys(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            sums = np.zeros(len(h) + 1, dtype=np.uint64)
            np.cumsum(h, out=sums[1:])
            found: tuple[list, list] = ([], [])
            for family, (limit, wanted) in enumerate(((bound, len(h) <= few), (long_bound, len(h) >= 3))):
                if not wanted:
                    continue
                if limit not in bounds or bounds[limit][0][-1] < len(h):
                    bounds[limit] = _size_classes(limit, 2 * len(h))
                starts, parts = bounds[limit]
                own = bisect.bisect_right(starts, len(h)) - 1
                for out, c in zip(found, (own, own - 1)):
                    if c >= 0:  # parts of under two tokens are often empty and tell less than single tokens
                        out.append(_part_keys(h, sums, 2 * c + family, parts[c]) if 2 * parts[c] <= starts[c] or parts[c] == 1
                                   else (h ^ np.uint64(2 * c + family)) * _MIX[1])
            none = np.empty(0, dtype=np.uint64)
            return tuple(np.concatenate([none, *k]).view(np.int64) for k in found)

        def of(text: str | None) -> tuple:
            if text is None:
                return None, 0, None, None, None, None
            words = text.encode().translate(plain).split()
            norm = b" ".join(words)
            distinct = set(words) - stop
            h = np.sort(np.fromiter(map(known.__getitem__, distinct), dtype=np.uint64, count=len(distinct)))
            own, lower = keys(h) if len(h) else (None, None)
            return hashlib.sha256(norm).digest(), len(h), h.view(np.int64), norm.decode() if len(h) <= few else None, own, lower

        for batch in batches:
            for start in range(0, batch.num_rows, 500):  # few texts at once, so that a worker stays small
                part = batch.slice(start, 500)
                found = zip(*map(of, part.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], *(pa.array(c, type=t) for c, t in zip(found, types))],
                    names=[*part.schema.names[:-1], *SET_COLUMNS])
    return run


@F.pandas_udf(T.IntegerType())
def shared_tokens(a: pd.Series, b: pd.Series) -> pd.Series:
    """How many items two arrays of distinct hashes share."""
    return pd.Series([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, b)], dtype="int32")


def _expanded(text: Column) -> Column:
    """Lower case with contractions expanded; only texts that hold one go through all the patterns."""
    low = out = F.lower(text)
    for pattern, replacement in CONTRACTIONS:
        out = F.regexp_replace(out, jvm_regex(pattern), replacement)
    return F.when(F.contains(low, F.lit("'")), out).otherwise(low)


PARITY_WORDS = 8


@F.pandas_udf(T.ArrayType(T.LongType()))
def token_parities(hashes: pd.Series) -> pd.Series:
    """512 bits of each set, every one the parity of its tokens that fall there.

    Two sets differ in at least as many tokens as their bits differ, whatever their size.
    """
    def of(h) -> np.ndarray:
        spots = np.asarray(h, dtype=np.int64).view(np.uint64) >> np.uint64(55)
        odd = (np.bincount(spots.astype(np.int64), minlength=64 * PARITY_WORDS) & 1).astype(np.uint8)
        return np.packbits(odd).view(np.int64)
    return pd.Series([of(h) for h in hashes])


def tokens_apart(a: str, b: str) -> Column:
    """How many tokens two sets with these parities differ in at least."""
    apart = F.lit(0)
    for i in range(PARITY_WORDS):
        apart = apart + F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))))
    return apart


def near_dup_pairs(df: DataFrame, scope: list[str], threshold: float = DUPLICATE_THRESHOLD, *,
                   id_col: str = "id", text_col: str = "content", scorer=None, keys=None) -> DataFrame:
    """Near-duplicate pairs within ``scope``; ids must be unique.

    Texts with the same normal form are joined to their smallest id as a star
    (``kind = 'copy'``), never pairwise; the smallest ids are then compared
    with each other (``kind = 'similar'``).  Candidates come from an exact
    partition of all tokens: two sets with Jaccard ≥ t differ in few tokens, so of one
    part more than that they hold the same tokens in at least one; texts meet by
    such a part, of about 1 / (1 − t) tokens, and not by single words.

    ``scorer`` may replace the similarity: a callable from two text columns to a
    score column.  The token filter says nothing about another score, so its
    caller gives ``keys`` as well: a callable from the text column to an array
    of blocking keys, of which any pair that reaches ``threshold`` shares one.
    """
    if (scorer is None) != (keys is None):
        raise ValueError("a scorer needs blocking keys, and keys a scorer")
    long_bound = threshold - 0.005
    bound = (threshold - 0.005 - 0.4) / 0.6
    if bound <= 0 and scorer is None:
        raise ValueError("near_dup_pairs needs a threshold above 0.41")
    few = max(2.0, 2 / bound) if bound > 0 else 2.0
    prepared = df.select(*scope, F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if scorer is not None:
        prepared = prepared.select(*scope, "id", F.unhex(F.sha2(normalize_text(F.col("text")), 256)).alias("digest"), "text")
    else:
        kinds = dict(prepared.dtypes) | SET_COLUMNS
        schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*scope, "id", *SET_COLUMNS])
        prepared = prepared.withColumn("text", _expanded(F.col("text"))).mapInArrow(_token_sets(few, bound, long_bound), schema)
    # written once: copies, keys and the check of what meets read it
    prepared = materialize(prepared, "near-dup")
    heads = prepared.groupBy(*scope, "digest").agg(F.min("id").alias("rep"))
    copies = prepared.select(*scope, "id", "digest").join(heads, [*scope, "digest"]).where(
        F.col("id") != F.col("rep")).select(
        *scope, F.col("rep").alias("id_a"), F.col("id").alias("id_b"),
        F.lit(1.0).alias("similarity"), F.lit("copy").alias("kind"))
    reps = prepared.join(heads.select(F.col("rep").alias("id")), "id", "left_semi").withColumnRenamed("id", "rep")

    if scorer is not None:
        sides = reps.select(*scope, "rep", "text", F.array_distinct(keys(F.col("text"))).alias("keys")).withColumn(
            "key", F.explode("keys"))
        a, b = sides.alias("a"), sides.alias("b")
        meet = (F.col("a.rep") < F.col("b.rep")) & (
            F.element_at(F.array_intersect("a.keys", "b.keys"), 1) == F.col("a.key"))
        for c in [*scope, "key"]:
            meet = meet & (F.col(f"a.{c}") == F.col(f"b.{c}"))
        scored = a.join(b, meet).select(*[F.col(f"a.{c}").alias(c) for c in scope], F.col("a.rep").alias("id_a"),
                                        F.col("b.rep").alias("id_b"), scorer(F.col("a.text"), F.col("b.text")).alias("similarity"))
        return copies.unionByName(scored.where(F.col("similarity") >= threshold).withColumn("kind", F.lit("similar")))

    reps = materialize(reps.where(F.col("n") > 0).select(*scope, "rep", "n", "own", "lower"), "near-dup-keys")
    own = reps.select(*scope, "rep", "n", F.explode("own").alias("key"))
    lower = reps.select(*scope, "rep", "n", F.explode("lower").alias("key"))
    every = own.withColumn("larger", F.lit(False)).unionByName(lower.withColumn("larger", F.lit(True)))
    a, b = own.alias("a"), every.alias("b")
    condition = ((F.col("b.larger") | (F.col("a.rep") < F.col("b.rep")))
                 & (F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * min(bound, long_bound) - 1e-9))
    for c in [*scope, "key"]:
        condition = condition & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    met = a.join(b, condition).select(
        *[F.col(f"a.{c}").alias(c) for c in scope],
        F.least("a.rep", "b.rep").alias("id_a"), F.greatest("a.rep", "b.rep").alias("id_b")).distinct()
    pairs = materialize(met, "near-dup-met")
    sets = prepared.select("id", F.col("short"), "hashes").join(
        pairs.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct(), "id", "left_semi")
    for side in "ab":
        pairs = pairs.join(sets.select(
            F.col("id").alias(f"id_{side}"), F.col("short").alias(f"norm_{side}"),
            F.col("hashes").alias(f"tokens_{side}")), f"id_{side}")
    # compared once and written: filters and scores read the counts
    pairs = materialize(pairs.select(
        *scope, "id_a", "id_b", "norm_a", "norm_b", F.size("tokens_a").alias("n_a"), F.size("tokens_b").alias("n_b"),
        shared_tokens("tokens_a", "tokens_b").alias("shared")), "near-dup-compared")
    jac = F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))
    # settle the Jaccard bound first; few short texts remain for the character part
    pairs = pairs.where(jac >= F.when(F.least("n_a", "n_b") >= 3, long_bound).otherwise(bound) - 1e-9)
    scored = with_sized_similarity(pairs, "norm_a", "norm_b", F.col("n_a"), F.col("n_b"), jac)
    similar = scored.where(F.col("similarity") >= threshold).select(
        *scope, "id_a", "id_b", "similarity", F.lit("similar").alias("kind"))
    return copies.unionByName(similar)


# -- merging a group of duplicates ---------------------------------------------

_NONE = 101  # state "nothing merged yet" of the confidence fold


@lru_cache(maxsize=1)
def _confidence_table() -> np.ndarray:
    """next[state, x]: confidence in hundredths after merging ``x`` into ``state``."""
    table = np.empty((102, 101), dtype=np.int32)
    for x in range(101):
        for state in range(101):
            table[state, x] = round(
                100 * round2_value((state / 100) * (2 / 3) + (x / 100) * (1 / 3)))
        table[_NONE, x] = x
    return table


def _fold_runs(keys: list[str]):
    schema_cols = [*keys, "first_at", "first_id", "value", "steps"]

    def fold(batches):
        """Fold each run of equal keys; the runs at both ends of a partition may
        continue elsewhere and are emitted as state maps."""
        table = _confidence_table()
        current, steps, head, first_run = None, None, None, True
        for batch in batches:
            rows = []
            key_values = list(zip(*[batch[k].tolist() for k in keys]))
            for key, at, ident, x in zip(key_values, batch["at"].tolist(), batch["id"].tolist(),
                                         batch["hundredths"].tolist()):
                if key != current:
                    if current is not None:
                        rows.append(_run(current, head, steps, first_run))
                        first_run = False
                    current, head, steps = key, (at, ident), np.arange(102)
                steps = table[steps, x]
            if rows:
                yield pd.DataFrame(rows, columns=schema_cols)
        if current is not None:
            yield pd.DataFrame([_run(current, head, steps, True)], columns=schema_cols)

    def _run(key, head, steps, open_ended):
        return (*key, *head, int(steps[_NONE]), steps.tolist() if open_ended else None)
    return fold


def merged_confidence(df: DataFrame, keys: list[str], order: tuple[str, str] = ("created_at", "id"),
                      value: str = "confidence") -> DataFrame:
    """Confidence of each key after merging its rows one by one in order.

    The running value is rounded to hundredths after each step (⅔ old + ⅓ new),
    so a stretch of rows acts as a map on 101 states.  Rows are range-sorted by
    key and order, which splits a hot key over many tasks; each task folds its
    stretch into one map and the few maps per key are composed at the end.
    """
    at, ident = order
    ranged = df.select(*keys, F.unix_micros(at).alias("at"), F.col(ident).alias("id"), F.round(
        F.coalesce(F.col(value), F.lit(0.5)) * 100).cast("int").alias("hundredths"))
    ranged = ranged.repartitionByRange(*keys, "at", "id").sortWithinPartitions(*keys, "at", "id")
    types = dict(df.dtypes)
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + [
        "first_at bigint", "first_id string", "value int", "steps array<int>"])
    runs = ranged.mapInPandas(_fold_runs(keys), schema)
    parts = runs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(
        "first_at", "first_id", "value", "steps"))).alias("runs"))
    composed = F.aggregate("runs", F.lit(_NONE), lambda state, r: F.coalesce(
        F.get(r["steps"], state), r["value"]))
    return parts.select(*keys, (composed / F.lit(100.0)).alias("confidence"))


def merge_memories(df: DataFrame, keys: list[str],
                   order: tuple[str, str] = ("created_at", "id")) -> DataFrame:
    """Merge all rows with equal ``keys`` into one.

    Longest content and summary, highest importance, folded confidence, summed
    access counts, saved if any was, first-seen union of tags, keywords and
    entities, latest timestamp, everything else from the first row.
    """
    first = F.struct(*order)
    longest = lambda c: F.min_by(c, F.struct(-F.length(c), *order))
    known = {"content", "summary", "importance", "confidence", "access_count", "saved", "tags",
             "keywords", "entities", order[0], *keys}
    others = [c for c in df.columns if c not in known]
    plain = df.groupBy(*keys).agg(
        F.min_by(F.struct(*others), first).alias("__first"),
        longest("content").alias("content"), longest("summary").alias("summary"),
        F.max(F.coalesce("importance", F.lit(0.5))).alias("importance"),
        F.sum(F.coalesce("access_count", F.lit(0))).alias("access_count"),
        F.bool_or(F.coalesce("saved", F.lit(False))).alias("saved"),
        F.max(order[0]).alias(order[0]), F.count("*").alias("merged_rows"))

    def labelled(column: str, kind: int, as_entity: bool) -> Column:
        return F.transform(column, lambda v, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("pos"),
            (v["type"] if as_entity else F.lit("")).alias("type"),
            (v["value"] if as_entity else v).alias("value")))

    listed = df.select(*keys, *order, F.explode(F.concat(
        labelled("tags", 0, False), labelled("keywords", 1, False), labelled("entities", 2, True)
    )).alias("e")).select(*keys, *order, "e.*")
    seen = listed.groupBy(*keys, "kind", "type", "value").agg(
        F.min(F.struct(*order, "pos")).alias("seen"))
    lists = seen.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(
        "kind", "seen", "type", "value"))).alias("all"))
    of_kind = lambda kind: F.filter("all", lambda e: e["kind"] == kind)
    values = lambda kind: F.transform(of_kind(kind), lambda e: e["value"])
    lists = lists.select(
        *keys, values(0).alias("tags"), values(1).alias("keywords"),
        F.transform(of_kind(2), lambda e: F.struct(
            e["type"].alias("type"), e["value"].alias("value"))).alias("entities"))
    out = plain.join(merged_confidence(df, keys, order), keys).join(lists, keys, "left")
    return out.select(
        *keys, "__first.*", "content", "summary", "importance", "confidence", "access_count",
        "saved", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"),
        F.coalesce("entities", F.array().cast("array<struct<type:string,value:string>>")).alias(
            "entities"), order[0], "merged_rows")


# -- against stored memories ----------------------------------------------------

def dedup_fingerprint(df: DataFrame) -> DataFrame:
    """Keep the first row of every (session, fingerprint)."""
    return top_k(df, ["session_id", "fingerprint"], [F.asc("created_at"), F.asc("id")], 1,
                 rank="__rn").drop("__rn")


def dedup_embedding(candidates: DataFrame, existing: DataFrame,
                    threshold: float = DUPLICATE_THRESHOLD) -> DataFrame:
    """Best cosine match of each candidate among the stored rows of its session.

    Returns every candidate id with ``existing_id, similarity, is_duplicate``.
    """
    best = nearest(candidates, existing, 1, scope=["session_id"], query_id="id", floor=0.0)
    best = best.where(F.col("cosine") > 0).select(
        F.col("query_id").alias("id"), F.col("item_id"), "cosine")
    duplicate = F.coalesce(F.col("cosine") >= threshold, F.lit(False))
    return candidates.select("id").join(best, "id", "left").select(
        "id", F.when(duplicate, F.col("item_id")).alias("existing_id"),
        F.coalesce("cosine", F.lit(0.0)).alias("similarity"), duplicate.alias("is_duplicate"))


def duplicate_checks(candidates: DataFrame, existing: DataFrame,
                     threshold: float = DUPLICATE_THRESHOLD) -> DataFrame:
    """Verdict per candidate: fingerprint match first, then embedding.

    Factual rows are dropped on a fingerprint match only.  All candidates are
    compared with ``existing`` as it stands before the batch.
    """
    known = existing.where(F.col("fingerprint") != "").groupBy("session_id", "fingerprint").agg(
        F.min_by("id", F.struct("created_at", "id")).alias("same_id"))
    checked = candidates.select("id", "session_id", "memory_type", "fingerprint", "embedding").join(
        known, ["session_id", "fingerprint"], "left")
    open_rows = checked.where(F.col("same_id").isNull() & (F.col("memory_type") != "factual"))
    near = dedup_embedding(open_rows, existing, threshold).select(
        "id", F.col("existing_id").alias("near_id"), "similarity", "is_duplicate")
    by_print = F.col("same_id").isNotNull()
    by_vector = F.coalesce("is_duplicate", F.lit(False))
    return checked.join(near, "id", "left").select(
        "id", "memory_type", F.coalesce("same_id", "near_id").alias("existing_id"),
        F.when(by_print, 1.0).otherwise(F.coalesce("similarity", F.lit(0.0))).alias("similarity"),
        F.when(by_print, "fingerprint").when(by_vector, "embedding").otherwise("none").alias("reason"))


def dedup_candidates(candidates: DataFrame, existing: DataFrame,
                     threshold: float = DUPLICATE_THRESHOLD) -> DataFrame:
    """Candidates that are new, one per (session, fingerprint)."""
    fresh = duplicate_checks(candidates, existing, threshold).where(F.col("reason") == "none")
    return dedup_fingerprint(candidates.join(fresh.select("id"), "id", "left_semi"))


# -- texts still to be embedded ---------------------------------------------------

def embedding_key(text: Column, model: str) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(model), text), 256)


def embedding_ttl_hours(text: Column) -> Column:
    """How long a stored vector stays valid: short texts 6 h, memories 30 d, others 7 d."""
    labelled = F.lit(False)
    for kind in ("factual:", "semantic:", "episodic:"):
        labelled = labelled | F.contains(F.lower(text), F.lit(kind))
    return F.when(F.length(text) < 24, 6).when(labelled, 720).otherwise(168)


def unseen_texts(df: DataFrame, embedded: DataFrame, as_of, *, text_col: str = "text",
                 model: str = "default") -> DataFrame:
    """Distinct texts without a valid vector.

    ``embedded`` holds ``key`` and ``embedded_at``.
    """
    wanted = df.select(F.col(text_col).alias("text"), embedding_key(F.col(text_col), model).alias("key"))
    wanted = wanted.dropDuplicates(["key"]).withColumn("ttl", embedding_ttl_hours(F.col("text")))
    age = (F.unix_millis(as_timestamp(as_of)) - F.unix_millis("embedded_at")) / 3600000.0
    valid = (wanted["key"] == embedded["key"]) & (age < F.col("ttl"))
    return wanted.join(embedded, valid, "left_anti").select("key", "text")


def embed_texts(texts: DataFrame, embed) -> DataFrame:
    """Run a caller's embedding function over ``unseen_texts`` output.

    ``embed`` maps a list of strings to a list of vectors (``None`` allowed)
    and is called once per Arrow batch.
    """
    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "embedding": embed(batch["text"].tolist())})
    return texts.mapInPandas(run, "key string, embedding array<float>")


# -- results of several channels ----------------------------------------------------

def merge_by_id(df: DataFrame, keys: list[str] = ["query_id", "id"]) -> DataFrame:  # noqa: B006
    """Union the sources of one memory found by several channels, keep the best signals.

    Input columns: the keys, ``channel`` (order of the channels), ``source``,
    ``vector_score, keyword_score, graph_score`` and any base columns, taken
    from the first channel.
    """
    signals = ["vector_score", "keyword_score", "graph_score"]
    base = [c for c in df.columns if c not in {*keys, *signals, "channel", "source"}]
    aggs = [F.max(F.coalesce(s, F.lit(0.0))).alias(s) for s in signals]
    if base:
        aggs.append(F.min_by(F.struct(*base), "channel").alias("__base"))
    sources = F.array_distinct(F.transform(
        F.sort_array(F.collect_set(F.struct("channel", "source"))), lambda e: e["source"]))
    out = df.groupBy(*keys).agg(*aggs, sources.alias("sources"))
    return out.select(*keys, *(["__base.*"] if base else []), *signals, "sources")
