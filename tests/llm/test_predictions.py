"""Language and toxicity: definitions on small texts, and held-out accuracy."""

import random
import zlib
from collections import Counter

import numpy as np
from corpus import EN, FR, awkward, frame, prose
from memlake.llm import language, toxicity
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def brute_profile(texts, size):
    counts = Counter()
    for t in texts:
        counts.update(brute_grams(t))
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))][:size]


def brute_grams(text):
    letters = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    if not letters:
        return Counter()
    line = "\0" + "\0".join(letters) + "\0"
    out = Counter()
    for n in (1, 2, 3):
        for i in range(len(line) - n + 1):
            gram = line[i:i + n]
            if n == 1 and gram == "\0" or n == 3 and gram[1] == "\0":
                continue
            code = 0
            for c in gram:
                code = code << 21 | ord(c)
            out[code] += 1
    return out


def brute_predict(text, profiles, size):
    grams = brute_grams(text)
    if not grams or not profiles:
        return "und", 0.0
    own = [g for g, _ in sorted(grams.items(), key=lambda x: (-x[1], x[0]))][:size]
    best = min(sorted(profiles), key=lambda k: sum(
        abs(i - profiles[k].index(g)) if g in profiles[k] else size for i, g in enumerate(own)))
    away = sum(abs(i - profiles[best].index(g)) if g in profiles[best] else size for i, g in enumerate(own))
    return best, 1 - away / (size * len(own))


def held(doc_id, parts, which):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % parts == which or doc_id is None and which == 0


def test_language_against_its_definition(spark):
    rows = [r for r in awkward() if r[1] is None or len(r[1]) < 5_000]
    size = 60
    got = language.identify(frame(spark, rows), size=size).collect()
    learn = [r for r in rows if r[2] is not None and r[0] is not None and not held(r[0], 4, 2)]
    profiles = {k: brute_profile([r[1] or "" for r in learn if r[2] == k], size) for k in {r[2] for r in learn}}
    want = Counter((r[0], held(r[0], 4, 2), p, round(s, 9)) for r in rows for p, s in [brute_predict(r[1] or "", profiles, size)])
    assert Counter((r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 9)) for r in got) == want
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_without_labels_or_rows(spark):
    rows = [(1, "some text", None, "s"), (2, None, None, "s")]
    got = language.identify(frame(spark, rows)).collect()
    assert {(r["doc_id"], r["lang_pred"], r["score"]) for r in got} == {(1, "und", 0.0), (2, "und", 0.0)}
    assert language.identify(frame(spark, rows).where("false")).count() == 0
    none = language.Profiles({}, 10)
    assert [r["doc_id"] for r in language.accepted(frame(spark, rows), none).collect()] == [1]


def test_accepted_keeps_prose_and_drops_the_rest(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, 80, FR if i % 2 else EN), "fr" if i % 2 else "en", "s") for i in range(20)]
    rows += [(50, "12 34 ** !!", "en", "s"), (51, "", "en", "s"), (52, None, "en", "s"), (53, "жщюя жщя южщ " * 20, None, "s")]
    docs = frame(spark, rows)
    from pyspark.sql import functions as F
    kept = language.accepted(docs, language.fit(docs.where("doc_id < 20"), F.lit(True)))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(20)) and kept.columns == docs.columns


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.97


def test_words_share_subwords_with_their_misspellings():
    model = toxicity.SubwordSoftmax(min_docs=2, epochs=10)
    rng = random.Random(2)
    texts, labels = [], []
    for i in range(400):
        words = prose(rng, 60).split()
        if i % 4 == 0:
            words[rng.randrange(60)] = rng.choice(["dreadful", "wretched"])
        texts.append(" ".join(words))
        labels.append(int(i % 4 == 0))
    model.train(texts, labels)
    clean = prose(rng, 60)
    assert model.score(clean + " dreadfull") > 0.5 > model.score(clean)
    long = prose(rng, 5_000)
    assert model.score(long + " wretched " + prose(rng, 2_000)) > model.score(long)
    again = toxicity.SubwordSoftmax(min_docs=2, epochs=10).train(texts, labels)
    assert again.score(clean) == model.score(clean)
    assert all(0 <= model.score(t) <= 1 for t in ("", "!!", "é", "x" * 100_000))


def test_a_toxic_term_counts_anywhere_in_a_long_run():
    for run in ("abcdefghij" * 8 + "dreadful" + "klmnopqrst" * at for at in (0, 3, 40)):
        edged = f"<{run}>"
        grams = {edged[i:i + n] for n in toxicity.GRAMS for i in range(len(edged) - n + 1)}
        seen = {b for w in toxicity.words_of(run) for b in toxicity.word_buckets(w, 1 << 40)}
        assert {toxicity.xxh32_intdigest(g) for g in grams} <= seen
        longest = max(len(toxicity.word_buckets(w, 9)) for w in toxicity.words_of(run))
        assert longest < 130
    rng = random.Random(3)
    texts = [prose(rng, 60) + (" dreadful" if i % 4 == 0 else "") for i in range(400)]
    model = toxicity.SubwordSoftmax(min_docs=2, epochs=10).train(texts, [int(i % 4 == 0) for i in range(400)])
    for before in (30, 45, 61, 200):
        pad = ("zq" * before)[:before]
        assert model.evidence(pad + "dreadful" + pad) > model.evidence(pad + pad) + 0.5, before
        assert model.score(pad + "dreadful" + pad) > 0.5 > model.score(prose(rng, 60)), before


def test_the_even_score_does_not_depend_on_how_many_rows_are_kept(spark):
    rng = random.Random(4)
    kinds = [("murky", 0)] * 300 + [("murky", 1)] * 50 + [("dreadful", 1)] * 50 + [("plain", 0)] * 700
    rows = [(i, prose(rng, 12) + f" {word}") for i, (word, _) in enumerate(kinds)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(kinds)], "doc_id long, toxic int")
    for kept in (2_000, 100):
        model = toxicity.fit(docs, labels, F.lit(True), fit_docs=kept)
        share = {w: np.mean([model.score(t) >= 0.5 for _, t in rows if t.endswith(w)]) for w in ("dreadful", "murky", "plain")}
        assert share["dreadful"] > 0.9 and share["plain"] < 0.1, (kept, share)
        assert share["murky"] < 0.3, (kept, share)  # one in seven is toxic, more than half of the 100 and 100 kept


def test_toxicity_without_labels_and_with_awkward_rows(spark):
    rows = awkward()
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(1, 0, 0), (2, 1, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for table in (labels, labels.where("false")):
        got = toxicity.rate(docs, table).collect()
        assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
        assert {r["score"] for r in got} == {0.0} and {r["predicted"] for r in got} == {0}
        assert all(r["held_out"] == held(r["doc_id"], 5, 0) for r in got)
    assert toxicity.rate(docs.where("false"), labels).count() == 0


def test_toxicity_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.rate(docs, labels, epochs=5).join(labels, "doc_id").where("held_out").toPandas()
    positive, negative = (got.loc[got["toxic"] == y, "score"].to_numpy() for y in (1, 0))
    assert np.mean([(negative < s).mean() + 0.5 * (negative == s).mean() for s in positive]) > 0.9
    assert (got["predicted"] == got["toxic"]).mean() > 0.92
