"""Small document tables with the awkward cases: nulls, empties, long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

#: names that the operators use inside, with values that must not leak in
EXTRA = ["id", "h", "key", "copies", "taken", "size", "score", "hash", "pos", "spans", "base", "bucket", "digest", "lang_pred", "row"]
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          + ", ".join(f"{c} string" for c in EXTRA))
EN = "the of and to in is that with for was are this from by on not be at or as it we they have".split()
FR = "le la les des une et que pour dans avec est sur qui ne pas au plus par ce il elle nous vous être".split()


def prose(rng: random.Random, count: int, words=EN) -> str:
    out = [rng.choice(words) if rng.random() < 0.4 else "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(3, 9)))
           for _ in range(count)]
    return " ".join(out)


def frame(spark, rows):
    """Rows of (doc_id, text[, lang[, source]])."""
    full = []
    for r in rows:
        doc_id, text, lang, source = (*r, *("en", "s0")[len(r) - 2:]) if len(r) < 4 else r
        full.append((doc_id, text, lang, source, None if text is None else len(text), *["x"] * len(EXTRA)))
    return spark.createDataFrame(full, SCHEMA)


def awkward(seed: int = 3) -> list[tuple]:
    """(doc_id, text, lang, source) with every special case once or more."""
    rng = random.Random(seed)
    base = prose(rng, 120)
    words = base.split()
    rows = [(i, prose(rng, rng.randint(1, 150), FR if i % 3 == 0 else EN), "fr" if i % 3 == 0 else "en", f"s{i % 4}")
            for i in range(24)]
    rows += [(30, base, "en", "s1"), (31, base, "en", "s2"), (31, base, "en", "s2"),
             (32, " ".join(words[:60] + ["changed"] + words[61:]), "en", None),
             (33, base.upper() + "!!", None, "s1"), (40, None, None, None), (41, "", "en", "s1"), (42, "   \n\t ", "en", "s0"),
             (43, "12 34 !! ??", "en", "s0"), (44, "a", "en", "s3"), (45, "one two three", "en", "s3"), (46, "one two three", "en", "s3"),
             (47, "é" * 900, "fr", "s0"), (48, "ab" * 30_000, "en", "s0"), (49, prose(rng, 9_000), "en", "s1"),
             (None, base + " tail", "en", "s1"), (None, prose(rng, 30), None, None), (50, "\U0001F600\u0001 \x00 x" * 40, "en", "s2")]
    rng.shuffle(rows)
    return rows
