"""Mixes, archives and fingerprints: exact targets, round trips and match guarantees."""

import gzip
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpus import awkward, frame, prose
from memlake.llm import mixing, warc, winnowing


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets by giving back what is over, again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    goal, target, open_ = share * sum(sizes.values()), dict.fromkeys(order, 0.0), set(order)
    while open_ and goal > 1e-9:
        total, over = sum(weight[s] for s in open_), set()
        for s in open_:
            target[s] = goal * weight[s] / total
        over = {s for s in open_ if target[s] > most * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = most * sizes[s]
        goal -= sum(target[s] for s in over)
        open_ -= over
    return target


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize("block", [4096, 16])
def test_mix_meets_targets(spark, block):
    rng = random.Random(8)
    rows = awkward() + [(1000 + i, prose(rng, rng.randint(1, 80)), "en", rng.choice(["s0", "s1", "ü", None, "S", "zz", "empty"]))
                        for i in range(600)]
    rows = [(d, "" if s == "empty" else t, lang, s) for d, t, lang, s in rows]
    out = mixing.mix(frame(spark, rows), block_rows=block).collect()
    sizes = defaultdict(int)
    for _, text, _, source in rows:
        sizes[source] += words(text)
    want, taken = brute_targets(sizes), defaultdict(int)
    assert Counter((r["doc_id"], r["size"]) for r in out) == Counter((d, words(t)) for d, t, *_ in rows)
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    for s, target in want.items():
        shortest = min((words(t) for _, t, _, x in rows if x == s and words(t)), default=0)
        assert abs(taken[s] - target) <= max(0.01 * target, shortest), (s, taken[s], target)
    again = mixing.mix(frame(spark, rows).repartition(5), block_rows=block).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))


def test_flight_keeps_totals_and_expectation():
    rng = np.random.default_rng(1)
    size = rng.integers(1, 400, 300).astype(float)
    p = np.full(300, 0.37)
    hits = np.zeros(300)
    for seed in range(200):
        flown = mixing.fly(p, size, np.random.default_rng(seed))
        assert ((flown > 0) & (flown < 1)).sum() <= 2
        assert abs(flown.sum() - p.sum()) < 1e-6 and abs(flown @ size - p @ size) < 1e-4
        hits += mixing.fly(p, size, np.random.default_rng(seed), land=True)
    assert abs(hits.mean() / 200 - 0.37) < 0.01 and 0.2 < (hits / 200).min() and (hits / 200).max() < 0.55


@pytest.mark.parametrize("seed", range(8))
def test_a_document_with_a_fifth_of_the_words_is_not_left_to_the_landing(seed):
    rng = np.random.default_rng(seed)
    size = np.concatenate([[5_000.0, 3_000.0], rng.integers(100, 700, 48)])
    for rate in (0.45, 0.6):
        p = np.full(50, rate)
        landed = [mixing.fly(p, size, np.random.default_rng([seed, i]), land=True) for i in range(60)]
        flown = mixing.fly(p, size, np.random.default_rng(seed))
        assert abs(flown @ size - p @ size) < 1e-4 and flown[0] in (0, 1)
        assert max(abs(x @ size - p @ size) for x in landed) < np.sort(size)[:6].sum()  # only short ones land
        assert abs(np.mean([x[0] for x in landed]) - rate) < 0.2


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_every_source_of_the_given_tables_is_near_its_target(spark, name):
    out = mixing.mix(spark.read.parquet(f"/root/testdata/{name}/documents.parquet")).collect()
    taken, target = defaultdict(int), {}
    for r in out:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - t) <= 0.01 * t for s, t in target.items())


def test_repeated_rows_share_their_copies(spark):
    """A third of the rows are one document; rows that differ in another column get fixed decisions."""
    rows = [(7, "five words are in here", "en", "s0")] * 120 + [(i, "some words " * (i % 9 + 1), "en", f"s{i % 2}") for i in range(100, 240)]
    docs = frame(spark, rows).withColumn("size", F.concat(F.lit("x"), F.monotonically_increasing_id().cast("string")))
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    first = Counter(map(tuple, mixing.mixed(docs, block_rows=32).collect()))
    assert first == Counter(map(tuple, mixing.mixed(docs.repartition(7), block_rows=32).collect()))
    target = {r["source"]: r["target"] for r in mixing.mix(docs, block_rows=32).collect()}
    for source in target:
        assert abs(sum(r[-1] for r in first.elements() if r[3] == source) - target[source]) <= 0.02 * target[source]
    assert all(r[-1] == r[-2] * words(r[1]) for r in first)


def test_mixed_documents_carry_their_columns(spark):
    rows = awkward()
    docs = frame(spark, rows)
    out = mixing.mixed(docs)
    assert out.columns == [c for c in docs.columns if c not in ("copies", "taken")] + ["copies", "taken"]
    got = out.collect()
    assert all(r["copies"] in (1, 2) and r["taken"] == r["copies"] * words(r["text"]) and r["size"] == "x" for r in got)
    chosen = Counter((r["doc_id"], r["size"], r["copies"]) for r in mixing.mix(docs).collect() if r["copies"])
    assert Counter((r["doc_id"], words(r["text"]), r["copies"]) for r in got) == chosen
    assert Counter(r["doc_id"] for r in mixing.mixed(docs.where("false")).collect()) == Counter()


def pages():
    rng = random.Random(2)
    shared, small = "<html>" + prose(rng, 60) + "</html>", "<p>tiny</p>"
    return [(5, "http://a/5", shared), (3, "http://a/3", shared), (9, None, shared), (3, "http://a/3", shared), (4, "u\r\nv", small),
            (6, "http://b", small), (7, "http://c", None), (8, "http://d", ""), (10, "http://e", "é" * 49 + "ab"),
            (11, "http://f", "é" * 49 + "ab"), (12, "http://g", "é" * 49 + "a"), (13, "http://h", "é" * 49 + "a"),
            (None, "http://i", "lone " * 40), (14, "http://j", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" * 5),
            (15, "http://k", prose(rng, 40_000)), (16, "http://l", "\n" * 120)]


def test_archives_round_trip(spark, tmp_path):
    rows = [(*p, "x", "y") for p in pages()]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string, id string, payload string")
    index = warc.write_archives(docs, f"file://{tmp_path}")
    got = index.collect()
    first = {}
    for page_id, _, html in pages():
        if html and len(html.encode()) >= 100 and page_id is not None:
            first[html] = min(first.get(html, page_id), page_id)
    want = Counter()
    for page_id, _, html in pages():
        data = (html or "").encode()
        refers = first.get(html) if html in first and first[html] != page_id else None
        want[(page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if refers is not None else "response", refers)] += 1
    number = lambda x: None if x is None else int(x)
    assert Counter((number(r["record_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], number(r["refers_to"]))
                   for r in got) == want
    assert all(r["intact"] for r in got)
    for r in got:  # the sidecar finds each record, alone
        record = warc.read_record(r["archive"], r["offset"], r["length"])
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n") and record.count(b"WARC-Record-ID") == 1
        if r["record_type"] == "response":
            assert hashlib.sha256(record[:-4].split(b"\r\n\r\n", 2)[2]).hexdigest() == r["payload_digest"]
    for name in {r["archive"] for r in got}:  # and a plain reader inflates the file as a whole
        whole = gzip.open(name.removeprefix("file:")).read()
        assert whole.count(b"WARC-Record-ID") == sum(r["archive"] == name for r in got)
    mono = [p for p in (tmp_path / "monolithic").iterdir() if p.suffix == ".gz"]
    assert sum(gzip.open(p).read().count(b"WARC-Record-ID") for p in mono) == len(rows)


def test_archives_without_pages(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.write_archives(none, f"file://{tmp_path}").count() == 0


def test_normaliser_reads_single_and_multi_member_files():
    records = [b"WARC/1.1\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(b), b) for b in (b"", b"x" * 3_000_000, b"\r\n\r\n")]
    one, many = gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records))
    assert list(warc._records(one)) == records == list(warc._records(many)) and list(warc._records(b"")) == []
    with pytest.raises(ValueError):
        list(warc._records(gzip.compress(b"".join(records)[:-6])))


def brute_winnow(text, k, w):
    codes = winnowing.points(text)
    h = [int(x) >> 32 for x in (winnowing.kgram_hashes(codes, k) if len(codes) else [])]
    kept = set()
    for s in range(max(0, len(h) - min(w, len(h)) + 1) if h else 0):
        part = h[s:s + w]
        kept.add(s + max(i for i, v in enumerate(part) if v == min(part)))
    return sorted(kept), [h[p] for p in sorted(kept)]


@pytest.mark.parametrize("k,w", [(1, 1), (5, 4), (7, 9), (24, 48), (24, 1)])
def test_winnowing_against_its_definition(k, w):
    rng = random.Random(k)
    for text in ["", "a", "aaaaaaaa" * 20, "abab" * 40, *["".join(rng.choice("abé\U0001F600") for _ in range(n)) for n in (3, 24, 30, 200)]]:
        positions, hashes = winnowing.winnow(winnowing.points(text), k, w)
        assert (positions.tolist(), hashes.tolist()) == brute_winnow(text, k, w)


def test_rolling_hashes_name_equal_grams():
    codes = winnowing.points("abcabcabxabc" * 3)
    for k in (1, 2, 3, 5, 11, 36, 50):
        seen = {}
        for i, h in enumerate(winnowing.kgram_hashes(codes, k).tolist()):
            assert seen.setdefault(codes[i:i + min(k, 36)].tobytes(), h) == h
        assert len(set(seen.values())) == len(seen)


def test_shared_passages_leave_a_shared_hash():
    rng = random.Random(3)
    for _ in range(50):
        passage = prose(rng, 40)[:24 + 48 - 1]
        a, b = (prose(rng, rng.randint(0, 30)) + passage + prose(rng, rng.randint(0, 30)) for _ in range(2))
        assert winnowing.likeness(winnowing.winnow(winnowing.points(a), 24, 48)[1], winnowing.winnow(winnowing.points(b), 24, 48)[1]) > 0


@pytest.mark.parametrize("buckets", [1, 3, 40])
def test_comparison_with_the_next_document(spark, buckets):
    rows = awkward()
    docs = frame(spark, rows)
    got = winnowing.compare_with_next(docs, buckets=buckets).collect()
    from pyspark.sql import functions as F
    order = [(r["doc_id"], r["t"]) for r in docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(
        F.coalesce("text", F.lit(""))).alias("tie")).orderBy(F.col("doc_id").asc_nulls_first(), "tie", "t").collect()]
    want = Counter()
    for (doc_id, text), (_, after) in zip(order, order[1:] + order[:1]):
        edited = text[:len(text) - len(text) // 2] + after[:len(text) // 2]
        own, then, new = (winnowing.winnow(winnowing.points(t), 24, 48) for t in (text, after, edited))
        want[(doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), winnowing.packed(own), winnowing.packed(new),
              winnowing.likeness(own[1], new[1]), winnowing.likeness(own[1], then[1]))] += 1
    assert Counter(map(tuple, got)) == want
    assert winnowing.compare_with_next(docs.where("false")).count() == 0
