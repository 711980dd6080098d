"""Column builders for text: tokens, normal forms, overlap and similarity."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.functions.lexicon import (
    CONSOLIDATION_STOP_WORDS, CONTRACTIONS, CONFLICT_STOP_WORDS, ROUND_CUTS, STOP_TERMS,
    WHITE_SPACE_CHARS, jvm_regex,
)

_STOP = "(?<![a-z0-9])(?:" + "|".join(STOP_TERMS) + ")(?![a-z0-9])"


def as_timestamp(as_of) -> Column:
    """``as_of`` given as a Column, datetime or string, as a timestamp Column."""
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def hours_between(earlier: Column, later: Column) -> Column:
    """Elapsed hours, from whole milliseconds."""
    return (F.unix_millis(later) - F.unix_millis(earlier)) / F.lit(3600000.0)


_CUTS = "array(" + ", ".join(f"{c!r}D" for c in ROUND_CUTS) + ")"


def round2(x: Column) -> Column:
    """Clamp to [0, 1] at two decimals, rounding on the exact binary value.

    Pass a plain column: ``x`` is used several times.
    """
    y = F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    n = F.floor(y * 100 + 0.5).cast("int")
    cuts = F.expr(_CUTS)
    overshoot = (n >= 1) & (y < F.get(cuts, n - 1))
    return (n - F.when(overshoot, 1).otherwise(0)) / F.lit(100.0)


def round6(x: Column) -> Column:
    """Six decimals; hides differences in floating-point summation order.

    The cut lies a hair below the half, so sums that should be exact halves
    round the same way whatever their last bit.
    """
    return F.floor(x * 1000000 + 0.5001) / F.lit(1000000.0)


def with_rounded(df, **raw: Column):
    """Add two-decimal score columns; the raw value is staged so it is computed once."""
    staged = df.withColumns({f"__{name}": expr for name, expr in raw.items()})
    rounded = staged.withColumns({name: round2(F.col(f"__{name}")) for name in raw})
    return rounded.drop(*[f"__{name}" for name in raw])


def trim_space(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE_CHARS))


def split_words(text: Column) -> Column:
    """Split on single blanks, no empty strings."""
    return F.array_remove(F.split(F.trim(text), " +"), "")


def tokenize(text: Column) -> Column:
    """Lower-case ``[a-z0-9]+`` terms without stop terms; repeats are kept."""
    words = F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")
    return split_words(F.regexp_replace(words, _STOP, " "))


def normalize_text(text: Column) -> Column:
    """Lower case, contractions expanded, punctuation dropped, blanks collapsed."""
    out = F.lower(text)
    for pattern, replacement in CONTRACTIONS:
        out = F.regexp_replace(out, jvm_regex(pattern), replacement)
    return F.trim(F.regexp_replace(out, "[^a-z0-9]+", " "))


def _content_words(text: Column, stop_words: list[str]) -> Column:
    words = F.regexp_replace(F.lower(text), "[^a-z0-9_]+", " ")
    # shorter than three characters, or a stop word
    drop = f"(?<![a-z0-9_])(?:[a-z0-9_]{{1,2}}|{'|'.join(stop_words)})(?![a-z0-9_])"
    return F.array_distinct(split_words(F.regexp_replace(words, drop, " ")))


def conflict_tokens(text: Column) -> Column:
    return _content_words(text, CONFLICT_STOP_WORDS)


def content_tokens(text: Column) -> Column:
    return _content_words(text, CONSOLIDATION_STOP_WORDS)


def summarize_140(text: Column) -> Column:
    return F.when(F.length(text) <= 140, text).otherwise(
        F.concat(F.substring(text, 1, 137), F.lit("...")))


def fingerprint(text: Column) -> Column:
    return F.array_join(F.array_sort(tokenize(text)), " ")


def count_contained(text: Column, terms: list[str]) -> Column:
    """How many of ``terms`` occur as substrings."""
    total = F.lit(0)
    for term in terms:
        total = total + F.contains(text, F.lit(term)).cast("int")
    return total


def contains_any(text: Column, terms: list[str]) -> Column:
    found = F.lit(False)
    for term in terms:
        found = found | F.contains(text, F.lit(term))
    return found


def matches(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    return text.rlike(jvm_regex(pattern, ignore_case))


def count_matching(text: Column, patterns: list[str]) -> Column:
    """How many patterns match at least once; ``text`` is lower case."""
    total = F.lit(0)
    for pattern in patterns:
        total = total + matches(text, pattern).cast("int")
    return total


def query_overlap(query_tokens: Column, content_token_list: Column) -> Column:
    """Query terms, repeats included, present among the content terms.

    Both sides should be plain columns.  The size test refers to the content
    column a second time, which keeps the optimizer from moving its definition
    into the lambda, where it would run once per query term.
    """
    shared = F.size(F.filter(query_tokens, lambda t: F.array_contains(content_token_list, t)))
    return F.when(F.size(content_token_list) > 0, shared).otherwise(0)


def keyword_score(query_tokens: Column, content_token_list: Column) -> Column:
    return F.least(F.lit(1.0), query_overlap(query_tokens, content_token_list) / F.lit(5.0))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard index of two arrays of distinct items; 0 when both are empty."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, 0.0).otherwise(shared / union)


def longest_common_run(a: str, b: str) -> int:
    """Length of the longest common substring.

    Every prefix of a common substring is common too, so the length is found
    by bisection over sets of fixed-length slices.
    """
    if len(a) > len(b):
        a, b = b, a
    low, high = 0, len(a)
    while low < high:
        size = (low + high + 1) // 2
        slices = {a[i:i + size] for i in range(len(a) - size + 1)}
        if any(b[i:i + size] in slices for i in range(len(b) - size + 1)):
            low = size
        else:
            high = size - 1
    return low


@F.pandas_udf(T.IntegerType())
def common_run_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Arrow-batched longest common substring; null inputs are skipped."""
    return pd.Series(
        [None if x is None or y is None else longest_common_run(x, y) for x, y in zip(a, b)],
        dtype="Int32")


def with_similarity(df, a_norm: str, b_norm: str, a_tokens: str, b_tokens: str,
                    out: str = "similarity"):
    """Token similarity of two normalized texts held in columns of ``df``.

    Jaccard of the distinct tokens.  When either side has fewer than three
    tokens, 0.6 Jaccard + 0.4 longest common substring / longer length; only
    those rows are sent to Python.
    """
    at, bt = F.col(a_tokens), F.col(b_tokens)
    df = df.withColumn("__jac", jaccard(at, bt))
    return with_sized_similarity(df, a_norm, b_norm, F.size(at), F.size(bt), F.col("__jac"), out).drop("__jac")


def with_sized_similarity(df, a_norm: str, b_norm: str, a_size: Column, b_size: Column, jac: Column,
                          out: str = "similarity"):
    """:func:`with_similarity` of texts whose tokens are counted and compared already."""
    an, bn = F.col(a_norm), F.col(b_norm)
    short = (a_size < 3) | (b_size < 3)
    both_empty = (a_size == 0) & (b_size == 0)
    needs_run = short & ~both_empty
    df = df.withColumn("__run", common_run_length(F.when(needs_run, an), F.when(needs_run, bn)))
    longer = F.greatest(F.length(an), F.length(bn))
    run_share = F.when(longer == 0, 1.0).otherwise(F.col("__run") / longer)
    raw = F.when(both_empty, F.when(an == bn, 1.0).otherwise(0.0)).when(
        short, jac * 0.6 + run_share * 0.4).otherwise(jac)
    return with_rounded(df, **{out: raw}).drop("__run")


def similarity_of_texts(df, a: str, b: str, out: str = "similarity"):
    """:func:`with_similarity` starting from two raw text columns."""
    df = df.withColumns({"__an": normalize_text(F.col(a)), "__bn": normalize_text(F.col(b))})
    df = df.withColumns({
        "__at": F.array_distinct(tokenize(F.col("__an"))),
        "__bt": F.array_distinct(tokenize(F.col("__bn"))),
    })
    return with_similarity(df, "__an", "__bn", "__at", "__bt", out).drop(
        "__an", "__bn", "__at", "__bt")


# -- the same similarity for a handful of strings already inside a task ------

def round2_value(x: float) -> float:
    """Two-decimal rounding of one Python float, as :func:`round2`."""
    return bisect.bisect_right(ROUND_CUTS, x) / 100


def pair_similarity(a_norm: str, b_norm: str, a_tokens: set, b_tokens: set) -> float:
    """Similarity of two normalized texts, as :func:`with_similarity`."""
    if not a_tokens and not b_tokens:
        return 1.0 if a_norm == b_norm else 0.0
    shared = len(a_tokens & b_tokens)
    overlap = shared / (len(a_tokens) + len(b_tokens) - shared)
    if len(a_tokens) < 3 or len(b_tokens) < 3:
        longer = max(len(a_norm), len(b_norm))
        run = longest_common_run(a_norm, b_norm) / longer if longer else 1.0
        return round2_value(overlap * 0.6 + run * 0.4)
    return round2_value(overlap)


def distinct_tokens(norm: str) -> set:
    """Distinct tokens of a normalized text."""
    return set(norm.split()) - _STOP_SET


_STOP_SET = frozenset(STOP_TERMS)
