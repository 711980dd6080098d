"""Operator 12: ranked lexical search by pipelined term partitioning.

1. Texts are cut into terms once.  Of every document the index keeps its length and
   the counts of the terms that some item holds.  Documents are dealt to *shards* of
   about ``shard_docs`` rows and numbered there in the order of their ids.
2. Terms belong to *owners* by their document share, the rarest first.
3. Items form *bundles* of at most about ``bundle_items``.  A bundle visits the owners
   one after another, in every shard at once: a stage is a cogroup of the bundles,
   with the sparse document accumulators that they carry, and the postings of the
   stage's owner, by bundle and shard.  All contributions are 64-bit integers.
4. An accumulator leaves once what it holds and all that later owners can add (the
   greatest contribution of each term anywhere) is less than the kth score reached
   in its shard.  Such a document has a lower score than ``k`` others, so a later
   owner that starts it anew can't bring it back: the result is exact.
5. The shards' first ``k`` of each item are merged.

A group of a cogroup holds one shard and one bundle, so its size does not grow with
the corpus, and neither copies nor frequent terms fill a single task.

Defined results: null texts have no term; every row is a document of its own, also
with a null or repeated id (null ids come last among equals); every item row is
ranked on its own; items or documents without a term, and scores of 0, give no row;
empty tables give an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm.common import bounded_broadcast, whole_text
from memlake.session import materialize, scratch_dir

SHARD_DOCS, BUNDLE_ITEMS = 8_192, 256
#: an owner holds the terms with a document share of up to 1/256, 1/32, 1/4, and the rest
SHARES = (256, 32, 4)
VOCABULARY_BYTES = 16_000_000
#: ASCII that is no letter or digit parts terms; capital A to Z are lower-cased
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    """Terms of a text in order, in UTF-8 (bytes above 127 are all parts of terms)."""
    return text.encode("utf-8").translate(_FOLD).split()


def _count(wanted):
    """Length of every text and the counts of its wanted terms (all terms where ``wanted`` is None)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = None if wanted is None else wanted.value
        for batch in batches:
            length, terms, counts, ends = [], [], [], [0]
            for text in batch.column("text"):
                found = terms_of(text.as_py())
                length.append(len(found))
                for term, tf in Counter(found).items():
                    if keep is None or term in keep:
                        terms.append(term.decode("utf-8"))
                        counts.append(tf)
                ends.append(len(terms))
            at = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in batch.schema.names if c != "text"), pa.array(length, pa.int64()),
                 pa.ListArray.from_arrays(at, pa.array(terms, pa.string())), pa.ListArray.from_arrays(at, pa.array(counts, pa.int64()))],
                names=[*(c for c in batch.schema.names if c != "text"), "n", "terms", "counts"])
    return run


def _counted(rows: DataFrame, wanted=None) -> DataFrame:
    """``rows`` with ``n, terms, counts`` in place of ``text``."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(_count(wanted), f"{kinds}, n long, terms array<string>, counts array<long>")


_STATE = ("bundle int, shard int, items array<long>, i_slot array<int>, i_term array<long>, i_owner array<int>, i_weight array<long>, "
          "i_top array<long>, a_slot array<int>, a_doc array<long>, a_score array<long>")


def _visit(owner: int, last: bool, k: int):
    """One stage: the accumulators of a bundle in a shard meet the postings of an owner."""
    columns = [c.split()[0] for c in _STATE.split(", ")]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        bundle = left.iloc[0]
        posted = right["term"].to_numpy(dtype=np.int64)
        order = np.argsort(posted, kind="stable")
        posted, doc, value = posted[order], right["number"].to_numpy(dtype=np.int64)[order], right["value"].to_numpy(dtype=np.int64)[order]
        slot, term, of, weight, top = (np.asarray(bundle[c], dtype=np.int64) for c in ("i_slot", "i_term", "i_owner", "i_weight", "i_top"))
        a_slot, a_doc, a_score = (np.asarray(bundle[c], dtype=np.int64) for c in ("a_slot", "a_doc", "a_score"))
        docs = np.unique(np.concatenate([doc, a_doc]))
        doc, a_at = np.searchsorted(docs, doc), np.searchsorted(docs, a_doc)
        low, high = np.searchsorted(posted, term, "left"), np.searchsorted(posted, term, "right")
        later = np.bincount(slot[of > owner], weights=(weight * top)[of > owner].astype(np.float64), minlength=len(bundle["items"]))
        here = np.flatnonzero(of == owner)
        here = here[np.argsort(slot[here], kind="stable")]
        per, held = np.searchsorted(slot[here], np.arange(len(bundle["items"]) + 1)), np.searchsorted(a_slot, np.arange(len(bundle["items"]) + 1))
        out = [], [], []
        for s in range(len(bundle["items"])):
            score = np.zeros(len(docs), np.int64)
            score[a_at[held[s]:held[s + 1]]] = a_score[held[s]:held[s + 1]]
            for i in here[per[s]:per[s + 1]]:
                score[doc[low[i]:high[i]]] += weight[i] * value[low[i]:high[i]]
            at = np.flatnonzero(score)
            if len(at) > k:
                line = np.partition(score[at], len(at) - k)[len(at) - k]
                at = at[score[at] + later[s] * (1 + 1e-9) >= line]
                if last:  # document numbers follow ids, so equal scores are settled here
                    at = np.sort(at[np.lexsort((at, -score[at]))[:k]])
            out[0].append(np.full(len(at), s))
            out[1].append(docs[at])
            out[2].append(score[at])
        s, d, v = (np.concatenate(o) if o else np.empty(0, np.int64) for o in out)
        if last:
            return pd.DataFrame({"item": np.asarray(bundle["items"])[s.astype(int)], "number": d, "score": v})
        return pd.DataFrame([[*bundle[columns[:-3]], s.astype(np.int32), d, v]], columns=columns)
    return run


def ranked(documents: DataFrame, items: DataFrame, *, k: int = 10, doc_id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text", shard_docs: int = SHARD_DOCS, bundle_items: int = BUNDLE_ITEMS,
           shares: tuple[int, ...] = SHARES, vocabulary_bytes: int = VOCABULARY_BYTES, broadcast_rows: int = 200_000) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` highest-scoring documents of each item."""
    spark = documents.sparkSession
    asked = materialize(_counted(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("item_id"),
                                              whole_text(item_text).alias("text"))), "lexical-items")
    vocabulary = asked.select(F.explode("terms").alias("term")).distinct()
    size = vocabulary.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0
    wanted = None  # above the limit all terms are counted and those of items are kept by a join
    if size <= vocabulary_bytes:
        wanted = spark.sparkContext.broadcast(frozenset(r["term"].encode("utf-8") for r in vocabulary.collect()))
    shards = max(1, -(-documents.count() // shard_docs))
    counted = _counted(documents.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text")), wanted)
    index = materialize(counted.repartition(shards, F.monotonically_increasing_id()).sortWithinPartitions(
        F.asc_nulls_last("doc_id")).withColumn("number", F.monotonically_increasing_id()), "lexical-index")
    total = index.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    count, length = total["documents"], max(1, total["length"])

    # in longs: m = 100 - 90 + (90 n N) div L; value = (10^9 tf) div (1000 tf + 8 m)
    lengths = F.lit(10) + F.expr(f"(90L * n * {count}L) div {length}L")
    entries = index.select("number", lengths.alias("m"), F.inline(F.arrays_zip(F.col("terms").alias("word"), F.col("counts").alias("tf")))
                           ).select("number", "word", F.expr("(1000000000L * tf) div (1000L * tf + 8L * m)").alias("value"))
    found = entries.groupBy("word").agg(F.count("*").alias("df"), F.max("value").alias("top"))
    owner = sum(((F.col("df") * share > count).cast("int") for share in shares), F.lit(0))
    weight = F.floor(F.lit(1_000.0) * F.log((2.0 * count + 2) / (2.0 * F.col("df") + 1)))
    terms = materialize(vocabulary.join(found, F.col("term") == F.col("word")).select(
        "word", F.monotonically_increasing_id().alias("term"), owner.alias("owner"), weight.cast("long").alias("weight"), "top"),
        "lexical-terms")
    small = terms.count()

    bundles = max(1, -(-asked.count() // bundle_items))
    uses = asked.select("item", F.pmod(F.xxhash64("item"), F.lit(bundles)).cast("int").alias("bundle"),
                        F.explode("terms").alias("word")).join(bounded_broadcast(terms, small, broadcast_rows), "word")
    carried = F.array_sort(F.collect_list(F.struct("item", "term", "owner", "weight", "top")))
    heads = uses.groupBy("bundle").agg(carried.alias("uses"), F.array_sort(F.collect_set("item")).alias("items"))
    none = F.array().cast("array<long>")
    state = heads.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(index.select(
        F.max(F.shiftright("number", 33))).first()[0] or 0)).cast("array<int>"))).select(
        "bundle", "shard", "items", F.expr("transform(uses, u -> cast(array_position(items, u.item) - 1 as int))").alias("i_slot"),
        *[F.col(f"uses.{c}").alias(f"i_{c}") for c in ("term", "owner", "weight", "top")],
        none.cast("array<int>").alias("a_slot"), none.alias("a_doc"), none.alias("a_score"))
    state = materialize(state, "lexical-bundles")

    spread = uses.select("word", "term", "owner", "bundle").distinct()
    postings = scratch_dir(spark, "lexical-postings")
    entries.join(bounded_broadcast(spread, small * bundles, broadcast_rows), "word").select(
        "owner", "bundle", F.shiftright("number", 33).cast("int").alias("shard"), "term", "number", "value").write.partitionBy(
        "owner").parquet(postings)
    kinds = "bundle int, shard int, term long, number long, value long, owner int"
    for stage in range(len(shares) + 1):
        last = stage == len(shares)
        posted = spark.read.schema(kinds).parquet(postings).where(F.col("owner") == stage)
        state = materialize(state.groupBy("bundle", "shard").cogroup(posted.groupBy("bundle", "shard")).applyInPandas(
            _visit(stage, last, k), "item long, number long, score long" if last else _STATE), f"lexical-stage-{stage}")

    best = state.withColumn("place", F.rank().over(Window.partitionBy("item").orderBy(F.desc("score")))).where(F.col("place") <= k)
    named = best.join(index.select("number", "doc_id"), "number").withColumn("rank", F.row_number().over(
        Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "number"))).where(F.col("rank") <= k)
    return named.join(asked.select("item", "item_id"), "item").select(
        "item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
