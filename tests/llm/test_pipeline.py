"""The pipeline: planted cases go, clean documents stay to the mix."""

import os
import random
import sys

from corpus import FR, awkward, frame, prose

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def planted(rng):
    items = [(1, prose(rng, 40)), (2, prose(rng, 30)), (3, None)]
    clean = [(i, prose(rng, 90, FR if i % 3 == 0 else ["the", "of", "and", "to"]), "fr" if i % 3 == 0 else "en", f"s{i % 3}")
             for i in range(40)]
    words = clean[4][1].split()
    copies = [(100, clean[4][1], "en", "s1"), (101, " ".join(words[:45] + ["other"] + words[46:]), "en", "s2")]
    leaked = [(110, prose(rng, 50) + " " + items[0][1] + " " + prose(rng, 50), "en", "s0")]
    private = [(120, prose(rng, 50) + " write to jane.roe@mail.example.org " + prose(rng, 50), "en", "s0")]
    junk = [(130, "12 99 -- ++", "en", "s0"), (131, None, "en", "s0"), (132, "", None, None)]
    return items, clean, copies, leaked, private, junk


def test_stages(spark, tmp_path):
    items, clean, copies, leaked, private, junk = planted(random.Random(6))
    docs = frame(spark, clean + copies + leaked + private + junk).select(*[c.split()[0] for c in COLUMNS.split(", ")])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        left = stage(spark, left, str(tmp_path))
        if name != "mixing":
            assert left.columns == docs.columns
        seen[name] = {r["doc_id"]: r for r in left.collect()}
        assert left.count() == len(seen[name])
    ids = {r[0] for r in clean}
    assert set(seen["language"]) == ids | {100, 101, 110, 120}
    assert set(seen["ngram_jaccard"]) == ids | {110, 120}
    assert set(seen["decontamination"]) == ids | {120} == set(seen["personal_data"])
    assert "[email]" in seen["personal_data"][120]["text"] and "jane" not in seen["personal_data"][120]["text"]
    assert all(seen["personal_data"][r[0]]["text"] == r[1] for r in clean)
    result = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["copies"]) for r in result} == {(d, r["copies"]) for d, r in seen["mixing"].items()}
    assert sum(r["taken"] for r in result) > sum(len(r["text"].split()) for r in seen["personal_data"].values())


def test_stages_take_awkward_rows_and_empty_tables(spark, tmp_path):
    spark.createDataFrame([(1, prose(random.Random(1), 40))], "item_id long, text string").write.parquet(
        str(tmp_path / "benchmark.parquet"))
    for docs in (frame(spark, awkward()), frame(spark, awkward()).where("false")):
        left = docs
        for name, stage in corpus_pipeline.STAGES:
            alone = stage(spark, docs, str(tmp_path))
            left = stage(spark, left, str(tmp_path))
            if name != "mixing":
                assert alone.columns == left.columns == docs.columns
            assert alone.count() >= left.count() or name == "mixing"
