"""Near duplicates, leaks and repeated passages against brute force."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import pytest

from corpus import awkward, frame, prose
from memlake.llm import components, decontaminate, neardup, repeats


def shingle_set(text):
    words = re.findall(r"\w+", (text or "").lower())
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_classes(rows):
    """Class (smallest known id) and links of each row, by comparing all pairs."""
    sets = [shingle_set(r[1]) for r in rows]
    label = list(range(len(rows)))
    links = [0] * len(rows)
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j]
             and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
        low, high = sorted((label[i], label[j]))
        label = [low if x == high else x for x in label]
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        out.append((r[0], min(ids) if sets[i] and ids else r[0], links[i]))
    return Counter(out)


def near_rows(seed):
    rng, rows = random.Random(seed), awkward(seed)
    for c in range(6):
        words = prose(rng, 90).split()
        for m in range(rng.randint(2, 14)):
            changed = list(words)
            for _ in range(rng.randint(0, 4)):
                changed[rng.randrange(90)] = "x" + str(rng.randrange(50))
            rows.append((100 + 20 * c + m, " ".join(changed), "en", "s1"))
    return rows


@pytest.mark.parametrize("block", [256, 3])
def test_classes_and_links(spark, block):
    rows = near_rows(5)
    found = neardup.classes(frame(spark, rows), block_texts=block, recall=0.999999)
    assert found.columns == ["doc_id", "class_id", "links"]
    assert Counter(tuple(r) for r in found.collect()) == brute_classes(rows)


def test_classes_do_not_depend_on_partitions_or_broadcasts(spark):
    rows = near_rows(6)
    one = neardup.classes(frame(spark, rows).repartition(1)).collect()
    many = neardup.classes(frame(spark, rows).repartition(7), broadcast_rows=0).collect()
    assert Counter(map(tuple, one)) == Counter(map(tuple, many))


def test_one_document_of_each_class_stays(spark):
    rows = near_rows(7) + [(7, "the same id but another text " + prose(random.Random(1), 40), "en", "s1")]
    kept = neardup.one_of_each(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    texts = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    classes = Counter()
    label = brute_classes(rows)
    del label
    sets = {r: shingle_set(r[1]) for r in rows}
    kept_rows = [r for r in set(rows) if (r[0], r[1]) in texts]
    # no two kept rows are near duplicates, every row is near a kept one or chained to it, wordless rows all stay
    for i, a in enumerate(kept_rows):
        for b in kept_rows[:i]:
            if sets[a] and sets[b]:
                assert len(sets[a] & sets[b]) < 0.8 * len(sets[a] | sets[b])
    want = len({c for _, c, _ in brute_classes([(i, r[1]) for i, r in enumerate(rows) if sets[r]])})
    assert sum(n for (d, t), n in texts.items() if shingle_set(t)) == want
    assert sum(n for (d, t), n in texts.items() if not shingle_set(t)) == sum(not sets[r] for r in rows)
    assert not classes


def test_bands_reach_the_recall():
    for threshold, recall, rows in ((0.8, 0.9995, 5), (0.5, 0.9, 3)):
        bands = neardup.bands_for(threshold, recall, rows)
        assert 1 - (1 - threshold ** rows) ** bands >= recall > 1 - (1 - threshold ** rows) ** (bands - 1)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(300, 299), (5, 5)]
    found = dict(components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect())
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {299: 299, 300: 299}
    assert found == want
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def leak_rows(rng, items):
    rows = awkward(9)
    for i, item in enumerate(items):
        words = item.split()
        for at in rng.sample(range(len(words)), min(len(words) // 12, 3)):
            words[at] = "swapped"
        rows.append((200 + i, prose(rng, rng.randint(0, 60)) + "\n" + " ".join(words) + ". " + prose(rng, 20), "en", "s0"))
    return rows


def brute_leaks(rows, items, window=16, share=0.8):
    out = set()
    for doc_id, text, *_ in rows:
        doc = re.findall(r"[^\W_]+", (text or "").lower())
        for item_id, item in items:
            words = re.findall(r"[^\W_]+", (item or "").lower())
            if not words:
                continue
            for diag in range(-len(words), len(doc)):
                equal = [0 <= diag + i < len(doc) and doc[diag + i] == w for i, w in enumerate(words)]
                inside = [e for i, e in enumerate(equal) if 0 <= diag + i < len(doc)]
                best = max((sum(inside[s:s + window]) for s in range(max(1, len(inside) - window + 1))), default=0)
                if best >= min(math.ceil(share * window), len(words)):
                    out.add((doc_id, item_id))
    return out


@pytest.mark.parametrize("words, changed", [(16, 3), (15, 2), (14, 1), (13, 0)])
def test_masks_meet_every_placement(words, changed):
    """All overlaps that the rule accepts: 16 words or, at the end of a text, 13 to 15, of which 13 agree."""
    for places in itertools.combinations(range(words), changed):
        assert any(all(at + j not in places for j, on in enumerate(mask) if on == "1")
                   for mask in decontaminate.MASKS for at in range(words - len(mask) + 1)), places


def test_substituted_passages_in_long_texts(spark):
    rng = random.Random(12)
    item = [f"w{i}" for i in range(16)]
    rows, want = [], set()
    for d in range(60):
        words, count = list(item), rng.randint(2, 4)
        for at in rng.sample(range(16), count):
            words[at] = "other"
        filler = [rng.choice(item) for _ in range(3_000)]
        rows.append((d, " ".join(filler + ["x"] * 16 + words + ["x"] * 16 + filler), "en", "s0"))
        if count <= 3:
            want.add(d)
    rows += [(100 + n, " ".join(item[:n]), "en", "s0") for n in (11, 12, 13, 15)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    want |= {d for d, _ in brute_leaks([r for r in rows if r[0] >= 100], [(1, " ".join(item))])} | {113, 115}
    for limit in (2_000_000, 0):
        found = {r["doc_id"] for r in decontaminate.find(frame(spark, rows), bench, broadcast_rows=limit).collect()}
        assert found == want


@pytest.mark.parametrize("limit", [2_000_000, 0])
def test_leaks(spark, limit):
    rng = random.Random(4)
    texts = [prose(rng, n) for n in (40, 60, 25, 13)]
    rows = [r for r in leak_rows(rng, texts) if r[1] is None or len(r[1]) < 5_000]
    rows += [(400, "so A short Item of seven words here, then", "en", "s0"), (401, "a short item of six words here", "en", "s0")]
    items = [*enumerate(texts), (10, "a short item of seven words here"), (11, None), (12, ""), (13, "Zyzzyva"),
             (14, "one two three"), (None, prose(rng, 30))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find(frame(spark, rows), bench, broadcast_rows=limit).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == brute_leaks(rows, items)
    assert len(found) == len({(r["doc_id"], r["item_id"]) for r in found}) >= 4
    clean = decontaminate.without_leaks(frame(spark, rows), bench, broadcast_rows=limit)
    bad = {d for d, _ in brute_leaks(rows, items)}
    assert Counter(r["doc_id"] for r in clean.collect()) == Counter(r[0] for r in rows if r[0] not in bad)
    assert clean.columns == frame(spark, rows).columns


def test_masks_find_every_two_substitutions_in_twenty_words():
    from itertools import combinations
    masks = decontaminate.MASKS
    for gone in combinations(range(20), 2):
        assert any(all(not (on == "1" and p + j in gone) for j, on in enumerate(m)) for m in masks for p in range(20 - len(m) + 1))


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        mask = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                mask[i:i + length] = b"\1" * length
        kept = bytes(c for c, m in zip(d, mask) if not m)
        spans = sum(1 for i, m in enumerate(mask) if m and (not i or not mask[i - 1]))
        out.append((len(d), sum(mask), spans, hashlib.sha256(kept).hexdigest()))
    return out


def passage_rows(seed):
    rng = random.Random(seed)
    rows = [r for r in awkward(seed) if r[1] is None or len(r[1]) < 10_000]
    shared = [prose(rng, n) for n in (80, 120, 300, 64)]
    for i in range(30):
        parts = []
        for _ in range(rng.randint(1, 4)):
            p = rng.choice(shared)
            cut = rng.randint(0, 60)
            parts += [prose(rng, rng.randint(0, 30)), p[cut:len(p) - rng.randint(0, 60)]]
        rows.append((300 + i, "é".join(parts), "en", "s1"))
    rows += [(400, "aaaa" * 150, "en", "s0"), (401, "a" * 401, "en", "s0"), (402, "b" * 400, "en", "s0"), (403, "c" * 401, "en", "s0")]
    return rows


@pytest.mark.parametrize("seed,limit", [(1, 1_000_000), (2, 0)])
def test_repeated_passages(spark, seed, limit):
    rows = passage_rows(seed)
    found = repeats.without_repeats(frame(spark, rows), broadcast_rows=limit).collect()
    got = Counter((r["doc_id"], r["bytes"], r["bytes"] - len(r["kept"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest())
                  for r in found)
    assert got == Counter((r[0], *b) for r, b in zip(rows, brute_repeats([r[1] for r in rows], 400)))


def test_empty_tables(spark):
    none = frame(spark, awkward()).where("false")
    bench = spark.createDataFrame([(1, prose(random.Random(0), 40))], "item_id long, text string")
    assert neardup.classes(none).count() == 0 and neardup.one_of_each(none).count() == 0
    assert decontaminate.find(none, bench).count() == 0 and decontaminate.find(frame(spark, awkward()), bench.where("false")).count() == 0
    assert decontaminate.without_leaks(frame(spark, awkward()), bench.where("false")).count() == len(awkward())
    assert repeats.without_repeats(none).count() == 0


def test_leaks_of_items_with_null_or_repeated_ids(spark):
    words = [f"word{i}" for i in range(60)]
    texts = {None: " ".join(words[:20]), 7: " ".join(words[20:40])}
    items = spark.createDataFrame([*texts.items(), (7, " ".join(words[40:]))], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"so {texts[None]} then"), (2, f"so {texts[7]} then"), (3, " ".join(words[40:])), (4, "so then")],
                                 "doc_id long, text string")
    for rows in (2_000_000, 0):
        got = {tuple(r) for r in decontaminate.find(docs, items, broadcast_rows=rows).collect()}
        assert got == {(1, None, 20, 16), (2, 7, 20, 16), (3, 7, 20, 16)}
        assert [r["doc_id"] for r in decontaminate.without_leaks(docs, items, broadcast_rows=rows).collect()] == [4]
