"""Ordered greedy grouping by shared tokens, exact for buckets of any size.

The rule: rows of a bucket are taken in order; each is united with later rows it
shares a token with, in order, unless the united group would exceed ``cap``.

A step depends on all before it, but only through groups, and two facts bound
what a step can see: a full group takes part in no further step, and a pair once
too large stays so.  So a bucket is worked through in windows of
``window_rows`` consecutive rows.  Besides its own rows a window needs, of every
token and group size, the first ``ahead`` later rows whose groups are not full.
A row that would have to look past the last of these ends the window early, and
the next window starts with it; with ``ahead`` above ``cap`` that next window
always gets past it.  Window and look-ahead bound the memory of a task; they
don't change the groups.

All buckets advance by one window a round, and a bucket of up to ``window_rows``
rows is done after the first.  State is written to the shared folder each round:
final rows leave, open rows keep the first position and the size of their group.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.operators.windows import top_k
from memlake.session import materialize


class Window:
    """Rows of one window with what lies ahead of them, and the groups they are in."""

    def __init__(self, cap: int):
        self.cap = cap
        self.root: dict[int, int] = {}      # group -> group it went into
        self.size: dict[int, int] = {}
        self.group: dict[int, int] = {}     # row -> group it came with
        self.postings: dict = defaultdict(list)
        self.skips: dict = {}
        self.horizon: dict = defaultdict(dict)

    def add(self, position: int, group: int, size: int, words) -> None:
        self.group[position] = group
        self.root.setdefault(group, group)
        self.size.setdefault(group, size)
        for word in words:
            self.postings[word].append(position)

    def find(self, group: int) -> int:
        while self.root[group] != group:
            self.root[group] = self.root[self.root[group]]
            group = self.root[group]
        return group

    def _live(self, word, at: int) -> int:
        """First place of the posting list from ``at`` on whose group is not full; full ones are passed once."""
        rows, skip = self.postings[word], self.skips[word]
        path = []
        while at < len(rows):
            if skip[at] == at:
                if self.size[self.find(self.group[rows[at]])] < self.cap:
                    break
                skip[at] = at + 1
            path.append(at)
            at = skip[at]
        for p in path:
            skip[p] = at
        return at

    def _reach(self, words, group: int) -> float:
        """Last position up to which all rows that still fit the group are known."""
        free = self.cap - self.size[group]
        return min((last for w in words if w in self.horizon for s, last in self.horizon[w].items() if s <= free),
                   default=float("inf"))

    def run(self, sources: list[tuple[int, list]]) -> int | None:
        """Unite from every source in order; the source that has to look further ahead, if any."""
        for word, rows in self.postings.items():
            rows.sort()
            self.skips[word] = list(range(len(rows)))
        for position, words in sources:
            group = self.find(self.group[position])
            if self.size[group] >= self.cap:
                continue
            words = [w for w in words if len(self.postings[w]) > 1 or w in self.horizon]
            heads = []
            for w in words:
                at = self._live(w, bisect_right(self.postings[w], position))
                if at < len(self.postings[w]):
                    heads.append((self.postings[w][at], w, at))
            heapq.heapify(heads)
            bounded = any(w in self.horizon for w in words)
            last = None
            while self.size[group] < self.cap:
                if bounded and (not heads or heads[0][0] > self._reach(words, group)):
                    if heads or self._reach(words, group) < float("inf"):
                        return position
                if not heads:
                    break
                row, word, at = heads[0]
                at = self._live(word, at + 1)
                if at < len(self.postings[word]):
                    heapq.heapreplace(heads, (self.postings[word][at], word, at))
                else:
                    heapq.heappop(heads)
                if row == last:
                    continue
                last, other = row, self.find(self.group[row])
                if other != group and self.size[group] + self.size[other] <= self.cap:
                    low, high = min(group, other), max(group, other)
                    self.root[high] = low
                    self.size[low] += self.size[high]
                    group = low
        return None


def greedy_groups(tokens: list, cap: int) -> list[int]:
    """Group of each row of one bucket (its first row), rows in bucket order."""
    window = Window(cap)
    for i, words in enumerate(tokens):
        window.add(i, i, 1, set(words))
    window.run([(i, sorted(set(words))) for i, words in enumerate(tokens)])
    return [window.find(i) for i in range(len(tokens))]


def _whole(cap: int):
    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position")
        position = pdf["position"].to_numpy()
        return pd.DataFrame({"bucket": pdf["bucket"], "position": position,
                             "head": position[greedy_groups(list(pdf["words"]), cap)]})
    return group


def _advance(cap: int, ahead: int):
    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        window, bucket = Window(cap), pdf["bucket"].iloc[0]
        inside, later = pdf[pdf["inside"]].sort_values("position"), pdf[~pdf["inside"]]
        for r in (*inside.itertuples(index=False), *later.itertuples(index=False)):
            window.add(r.position, r.head, r.size, r.words)
        for (word, size), own in later.groupby([later["words"].map(lambda w: w[0]), "size"]):
            if len(own) >= ahead:
                window.horizon[word][size] = int(own["position"].max())
        sources = [(r.position, list(r.words)) for r in inside.itertuples(index=False)]
        stopped = window.run(sources)
        old = list(window.root)
        new = [window.find(g) for g in old]
        size = [window.size[g] for g in new]
        nowhere = -1 if stopped is None else stopped
        return pd.DataFrame({"bucket": bucket, "head": old, "into": new, "total": size, "stopped": nowhere})
    return group


def token_groups(rows: DataFrame, cap: int, window_rows: int, ahead: int | None = None) -> DataFrame:
    """``bucket, position, head`` of ``bucket, position, words``: the first position of each row's group.

    Positions count the rows of a bucket from 1; ``words`` are distinct.
    """
    ahead = ahead or 4 * cap
    if ahead <= cap:
        raise ValueError("the look-ahead must exceed the cap")
    rows = materialize(rows.select("bucket", "position", "words"), "group-rows")
    ends = materialize(rows.groupBy("bucket").agg(F.max("position").alias("rows")), "group-ends")
    large = materialize(ends.where(F.col("rows") > window_rows).select("bucket", "rows"), "group-large")
    # a large bucket has more than window_rows rows, so these are few; still they are joined, not collected
    small = rows.join(large, "bucket", "left_anti").groupBy("bucket").applyInPandas(
        _whole(cap), "bucket string, position long, head long")
    done = [materialize(small, "group-small")]
    live = rows.join(large, "bucket", "left_semi").withColumns({"head": F.col("position"), "size": F.lit(1)})
    progress = large.withColumn("start", F.lit(1).cast("long"))
    while progress.limit(1).count():
        live = materialize(live, "group-live")
        open_ = live.where(F.col("size") < cap).join(progress, "bucket").where(F.col("position") >= F.col("start"))
        inside = open_.where(F.col("position") < F.col("start") + window_rows).select(
            "bucket", "position", "head", "size", "words", F.lit(True).alias("inside"))
        wanted = inside.select("bucket", F.explode("words").alias("word")).distinct()
        after = open_.where(F.col("position") >= F.col("start") + window_rows).select(
            "bucket", "position", "head", "size", F.explode("words").alias("word")).join(wanted, ["bucket", "word"], "left_semi")
        near = top_k(after, ["bucket", "word", "size"], [F.asc("position")], ahead, rank="__rn").select(
            "bucket", "position", "head", "size", F.array("word").alias("words"), F.lit(False).alias("inside"))
        moved = materialize(inside.unionByName(near).groupBy("bucket").applyInPandas(
            _advance(cap, ahead), "bucket string, head long, into long, total int, stopped long"), "group-moved")
        stops = moved.groupBy("bucket").agg(F.max("stopped").alias("stopped"))
        ahead_of = progress.join(stops, "bucket", "left").select("bucket", "rows", F.when(
            F.col("stopped") >= 0, F.col("stopped")).otherwise(F.col("start") + window_rows).alias("start"))
        progress = materialize(ahead_of.where("start <= rows"), "group-progress")
        placed = live.join(moved.select("bucket", "head", "into", "total"), ["bucket", "head"], "left").select(
            "bucket", "position", "words", F.coalesce("into", "head").alias("head"), F.coalesce("total", "size").alias("size"))
        placed = materialize(placed, "group-placed")
        open_buckets = progress.select("bucket")
        final = placed.where(F.col("size") >= cap).unionByName(
            placed.where(F.col("size") < cap).join(open_buckets, "bucket", "left_anti"))
        done.append(final.select("bucket", "position", "head"))
        live = placed.where(F.col("size") < cap).join(open_buckets, "bucket", "left_semi")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out
