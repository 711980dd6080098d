"""Personal data and secrets against plain Python."""

import random

import brute
from memlake.llm import boosting, pii, queries_b, secret_scan, spans
from memlake.llm.common import table
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, base string, spans string, candidates int"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"src{i % 4}", len(t or ""), "b", "s", 1) for i, t in enumerate(texts)], SCHEMA)


def check_base(rows, texts, want, kinds, names):
    for r in rows:
        found = want(texts[r["doc_id"]])
        base = brute.listed(found, kinds)
        assert r["base_sha256"] == brute.sha(base), (texts[r["doc_id"]][:80], base)
        for i, name in enumerate(names):
            assert r[f"n_{name}"] == sum(k == i for _, k, _ in found)
        if base:
            assert set(base.split(",")) <= set(r["spans"].split(","))


def digests(found, kinds, base):
    return found.select(
        "doc_id", *[spans.count_of(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(base)],
        spans.digest(F.col("base"), kinds).alias("base_sha256"), spans.listed(F.col("spans"), kinds).alias("spans")).collect()


def test_personal_data_of_near_misses(spark):
    texts = brute.noisy_texts(1, 300)
    rows = digests(pii.find(frame(spark, texts)), pii.KINDS, pii.BASE_KINDS)
    assert len(rows) == len(texts)
    check_base(rows, texts, brute.personal, pii.KINDS, pii.BASE_KINDS)


def test_secrets_of_near_misses(spark):
    texts = brute.noisy_texts(2, 300)
    rows = digests(secret_scan.scan(frame(spark, texts)), secret_scan.KINDS, secret_scan.KINDS[:3])
    assert len(rows) == len(texts)
    check_base(rows, texts, brute.secret, secret_scan.KINDS, secret_scan.KINDS[:3])


def test_queries_on_the_tables(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    check_base(queries_b.op4_pii(spark, sf).collect(), texts, brute.personal, pii.KINDS, pii.BASE_KINDS)
    check_base(queries_b.op6_secrets(spark, sf).collect(), texts, brute.secret, secret_scan.KINDS, secret_scan.KINDS[:3])


def test_redaction_removes_base_spans_and_keeps_columns(spark):
    texts = [None, "", "mail a@b.cd or 1.2.3.4", "nothing here", "+1 (555) 010-9999é 4111 1111 1111 1111"]
    out = {r["doc_id"]: r for r in pii.redact(frame(spark, texts)).collect()}
    assert out[0]["text"] is None and out[1]["text"] == ""
    assert out[2]["text"] == "mail [email] or [ip]" and out[2]["n_chars"] == len(out[2]["text"])
    assert out[3]["text"] == "nothing here" and out[4]["text"] == "[phone]é [card]"
    assert pii.redact(frame(spark, texts)).columns == frame(spark, texts).columns
    assert all((r["base"], r["spans"], r["candidates"]) == ("b", "s", 1) for r in out.values())


def test_widely_copied_values_are_told_from_owned_ones(spark):
    copied, owned = "ghp_" + "A1b2" * 10, "ghp_" + "Z9y8" * 10
    rows = [(i, f"x {copied} y", "en", f"src{i}", 0) for i in range(5)] + [(9, f"x {owned}", "en", "src1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"]: r["spans"] for r in secret_scan.scan(docs).collect()}
    assert [s["kind"] for s in out[9]] == [3] and out[9][0]["live"]
    assert all(out[i] == [] for i in range(5))


def test_empty_tables(spark):
    none = frame(spark, ["x"]).where("doc_id < 0")
    assert pii.find(none).count() == 0 and secret_scan.scan(none).count() == 0 and pii.redact(none).count() == 0


def test_trees_separate_counted_patterns():
    import numpy as np
    x = np.array([[0, 0], [0, 1], [1, 0], [1, 1]])
    good, bad = np.array([9., 90, 5, 200]), np.array([300., 2, 100, 1])
    score = boosting.Trees().fit(x, good, bad).score(x)
    assert score[1] > 0.9 and score[3] > 0.9 and score[0] < 0.2 and score[2] < 0.2
    assert boosting.precise_threshold(score, good, bad, 0.95) == score[[1, 3]].min()


def test_checked_candidates_are_added_however_many_fail(spark):
    rng = random.Random(6)

    def luhn(digits):
        return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0

    texts, want = [], []
    for i in range(600):
        digits = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        right = i % 20 == 0
        digits += next(d for d in "0123456789" if luhn(digits + d) == right)
        card = rng.choice("./_").join(digits[j:j + 4] for j in range(0, 16, 4))
        ssn = ("123" if right else rng.choice(["000", "666", "912"])) + f"-45-{rng.randrange(1, 10_000):04}"
        texts.append(f"pay {card} ssn {ssn}, left over")
        want.append(right)
    texts += ["account DE44 5001 0517 5407 3249 31 is new", "card 4111  1111  1111  1111 is doubled"]
    rows = {r["doc_id"]: [pii.KINDS[s["kind"]] for s in r["spans"]] for r in pii.find(frame(spark, texts)).collect()}
    assert [sorted(rows[i]) for i in range(600)] == [["card", "ssn"] if right else [] for right in want]
    assert rows[600] == ["iban"] and rows[601] == ["card"]


def kinds_of(found):
    return {r["doc_id"]: [pii.KINDS[s["kind"]] for s in r["spans"]] for r in found.collect()}


def test_trees_alone_let_unmarked_phones_in_and_turn_look_alikes_down(spark):
    """No word tells what the last two numbers are; only their format does."""
    rng = random.Random(3)
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    texts = [f"please call ({d(3)}) {d(3)}-{d(4)} soon" for _ in range(120)]
    texts += [f"your order {d(4)}.{d(3)}.{d(4)} went out" for _ in range(120)]
    texts += ["we met (212) 555-0147 there", "we met 2125.550.1470 there"]
    found = kinds_of(pii.find(frame(spark, texts)))
    assert found[240] == ["phone"] and found[241] == []
    assert all(found[i] == ["phone"] for i in range(120)) and not any(found[i] for i in range(120, 240))


def test_trees_alone_let_spelled_out_mail_in_and_turn_look_alikes_down(spark):
    rng = random.Random(4)
    w = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(4, 7)))
    texts = [f"contact {w()} (at) {w()} (dot) com today" for _ in range(120)]
    texts += [f"{w()} x{w()}(at){w()}.{w()}zz and so on" for _ in range(120)]
    texts += ["contact jane (at) home (dot) museum today", "we x(at)noon.sharpish and so on"]
    found = kinds_of(pii.find(frame(spark, texts)))
    assert found[240] == ["email"] and found[241] == []


def test_account_numbers_leave_1_modulo_97(spark):
    texts = ["DE89370400440532013000", "DE89370400440532013001", "GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 33",
             "card 4111.1111.1111.1112 fails", "id 123-45-6789 12"]
    assert kinds_of(pii.find(frame(spark, texts))) == {0: ["iban"], 1: [], 2: ["iban"], 3: [], 4: [], 5: ["ssn"]}
