"""Operator 4: personal data by candidate gradient boosting, in DataFrame expressions only.

Strict patterns (mail, address, card, phone) give the base spans, which always
stay.  High-recall generators propose further, overlapping candidates: the base
patterns' own failures, spelled-out mail, phones without country code, cards
with other separators, social security and bank account numbers.  Boosted
trees score each candidate from its format and context; a candidate is added
where its score reaches the threshold of its kind and it overlaps no base span.

No documents are marked, so the labels come from what the features don't see:

* cards, addresses, social security and account numbers: the check of their kind (Luhn,
  ranges, mod 97) is the label, and a candidate that fails it is never added;
* local phones: a word for telephones before the number is positive, a word for
  other numbers (order, part, price) negative, all else is unmarked; this word is
  no feature of theirs;
* spelled-out mail: a common top-level domain is positive, any other negative.

Trees are fitted on the marked candidates of one half.  On those of the other half
that overlap no base span the threshold of each kind is set, the lowest score with the
wanted precision; where they show no look-alike of a kind, its checked candidates pass.
For unmarked phones and unusual mail domains the trees thus decide alone.  Groups of
digits inside a card, an account or a social security number, passing or not, are no phones.

Features are small integers, so the counts of all patterns over all documents are a
table of bounded size (``PATTERNS`` rows at most for either half), the only thing
that reaches the driver.

Defined results: a null text is empty and has no span; repeated rows are
treated alike; an empty table gives an empty result; extra columns are ignored,
or kept by ``redact``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.llm import boosting, spans
from memlake.llm.common import whole_text
from memlake.session import materialize

#: fixed values: base patterns; possessive groups and look-behinds change no match, only keep them linear
_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: further generators
SPELLED = r"[A-Za-z0-9._%+-]{1,64}\x20?[\(\[](?:at|AT)[\)\]]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|[\(\[](?:dot|DOT)[\)\]])\x20?[A-Za-z0-9-]{1,63})+"
LOCAL_PHONE = r"(?<![0-9+.-])(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]?[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])"
LOOSE_CARD = r"(?<![0-9])[0-9]{4}(?:[\x20./_-]{1,2}[0-9]{4}){2}[\x20./_-]{1,2}[0-9]{1,7}(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"

KINDS = ["email", "ip", "card", "phone", "ssn", "iban"]
EMAIL_KIND, IP_KIND, CARD_KIND, PHONE_KIND, SSN_KIND, IBAN_KIND = range(6)
BASE_KINDS = KINDS[:4]
#: fixed words: what stands before telephone numbers, before other numbers, and common top-level domains
PHONE_WORDS = r"(?i)(?:call|tel|telephone|phone|mobile|cell|fax|dial|text|whatsapp)[\s.:#]*(?:me|us|no|nr|number)?\W*$"
NUMBER_WORDS = r"(?i)(?:order|invoice|isbn|part|serial|ref|reference|item|price|total|version|page|room|code|sku|lot|batch|case|ticket)[\s.:#]*(?:no|nr|number|id)?\W*$"
COMMON_DOMAINS = r"(?i)[.\)\]]\x20?(?:com|org|net|edu|gov|info|biz|io|ai|app|dev|de|fr|es|it|nl|uk|us|ca|au|in|jp|cn|br|ru|ch|at|eu)$"
CONTEXT_WORDS = r"(?i)(?:mail|contact|call|tel|phone|fax|card|visa|pay|account|iban|ssn|social|ip|address|host|server)\W*$"
#: levels of each feature, and with them the most patterns there can be
LEVELS = {"kind": 6, "length": 4, "digits": 5, "gaps": 3, "separator": 4, "cue": 2, "left": 3, "right": 3, "mixed": 2, "generator": 2}
PATTERNS = int(np.prod(list(LEVELS.values())))
_CANDIDATE = "array<struct<start:int,end:int,kind:int,x:array<int>,valid:boolean,label:int,half:int>>"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, F.lit("[^0-9]"), F.lit(""))


def luhn(digits: Column) -> Column:
    """Whether a string of ASCII digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d: d.cast("int"))
    doubled = F.transform(each, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def card_ok(match: Column) -> Column:
    digits = _digits(match)
    n = F.length(digits)
    return F.when((n >= 14) & (n <= 19), luhn(digits)).otherwise(False)


def ip_ok(match: Column) -> Column:
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
    return F.rlike(match, F.lit(rf"^{part}(?:\.{part}){{3}}$"))


def iban_ok(match: Column) -> Column:
    """15 to 34 characters whose number, letters as 10 to 35 and the first four last, leaves 1 modulo 97."""
    plain = F.regexp_replace(match, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 34), F.substring(plain, 1, 4))
    left = F.aggregate(F.split(turned, ""), F.lit(0), lambda r, c: F.when(c == "", r).when(
        F.rlike(c, F.lit("[0-9]")), (r * 10 + F.ascii(c) - 48) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97))
    return F.length(plain).between(15, 34) & (left == 1)


def phone_ok(match: Column) -> Column:
    return F.length(_digits(match)).between(10, 15)


def _raw(text: Column) -> dict[str, Column]:
    """Base patterns before their checks."""
    return {
        "email": spans.matches(text, EMAIL, EMAIL_KIND, guard=F.contains(text, F.lit("@"))),
        "ip": spans.matches(text, IP, IP_KIND, guard=F.rlike(text, F.lit(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"))),
        "card": spans.matches(text, CARD, CARD_KIND, guard=F.rlike(text, F.lit(r"[0-9](?:[\x20-]?[0-9]){12}")),
                              keep=lambda m: F.length(_digits(m)) >= 13),
        "phone": spans.matches(text, PHONE, PHONE_KIND, guard=F.contains(text, F.lit("+")))}


def _further(text: Column) -> dict[str, Column]:
    return {
        "spelled": spans.matches(text, SPELLED, EMAIL_KIND, guard=F.rlike(text, F.lit(r"[\(\[](?:at|AT)[\)\]]"))),
        "local": spans.matches(text, LOCAL_PHONE, PHONE_KIND),
        "loose": spans.matches(text, LOOSE_CARD, CARD_KIND),
        "ssn": spans.matches(text, SSN, SSN_KIND),
        "iban": spans.matches(text, IBAN, IBAN_KIND)}


def _valid(s: Column) -> Column:
    m, kind = s["match"], s["kind"]
    return (F.when(kind == EMAIL_KIND, F.rlike(m, F.lit(r"(?:\.|\)|\])\x20?[A-Za-z]{2,24}$")))
            .when(kind == IP_KIND, ip_ok(m)).when(kind == CARD_KIND, card_ok(m)).when(kind == PHONE_KIND, phone_ok(m))
            .when(kind == SSN_KIND, ~F.rlike(m, F.lit("^(?:000|666|9[0-9]{2})|-00-|-0000$"))).otherwise(iban_ok(m)))


def _label(s: Column, valid: Column, generator: int) -> Column:
    """1 for personal data, 0 for a look-alike, null where nothing tells."""
    marked = F.when(valid, 1).otherwise(0)
    if not generator:
        return marked
    words = F.when(~valid, 0).when(F.rlike(s["before"], F.lit(PHONE_WORDS)), 1).when(F.rlike(s["before"], F.lit(NUMBER_WORDS)), 0)
    domain = F.when(valid & F.rlike(s["match"], F.lit(COMMON_DOMAINS)), 1).otherwise(0)
    return F.when(s["kind"] == PHONE_KIND, words).when(s["kind"] == EMAIL_KIND, domain).otherwise(marked)


def _features(s: Column, after: Column, generator: int) -> Column:
    m, before = s["match"], s["before"]
    n, d = F.length(m), F.length(_digits(m))
    gaps = F.length(F.regexp_replace(m, F.lit("[A-Za-z0-9]"), F.lit("")))
    cue = F.when(F.rlike(before, F.lit(CONTEXT_WORDS)), 1).otherwise(0)
    bins = [
        s["kind"],
        F.when(n < 10, 0).when(n < 16, 1).when(n < 24, 2).otherwise(3),
        F.when(d == 0, 0).when(d < 10, 1).when(d < 14, 2).when(d < 17, 3).otherwise(4),
        F.when(gaps == 0, 0).when(gaps < 4, 1).otherwise(2),
        F.when(F.rlike(m, F.lit(r"[()\[\]]")), 3).when(F.contains(m, F.lit("-")), 2).when(F.contains(m, F.lit(" ")), 1).otherwise(0),
        F.when(s["kind"] == PHONE_KIND, 0).otherwise(cue) if generator else cue,
        F.when((before == "") | F.rlike(before, F.lit(r"[\s|,;:(\[]$")), 0).when(
            F.rlike(before, F.lit(r"[\p{L}\p{N}]$")), 1).otherwise(2),
        F.when(F.rlike(after, F.lit(r"^(?:$|[\s,;:!?)\]]|\.(?:\s|$))")), 0).when(F.rlike(after, F.lit(r"^[\p{L}\p{N}]")), 1).otherwise(2),
        F.when(F.rlike(m, F.lit("[A-Za-z]")), 1).otherwise(0),
        F.lit(generator)]
    return F.array(*[b.cast("int") for b in bins])


def _candidates(found: Column, text: Column, generator: int) -> Column:
    checked = F.transform(found, lambda s: F.struct(s.alias("s"), _valid(s).alias("valid")))
    return F.transform(checked, lambda c: F.struct(
        c["s"]["start"].alias("start"), c["s"]["end"].alias("end"), c["s"]["kind"].alias("kind"),
        _features(c["s"], F.substring(text, c["s"]["end"] + 1, F.lit(2)), generator).alias("x"), c["valid"].alias("valid"),
        _label(c["s"], c["valid"], generator).alias("label"),
        F.pmod(F.crc32(c["s"]["match"].cast("binary")), F.lit(2)).cast("int").alias("half")))


def propose(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` with ``base`` spans and scored-later ``candidates`` of each text."""
    clean = docs.withColumn("__clean", spans.clean(whole_text(text)))
    raw, more = _raw(F.col("__clean")), _further(F.col("__clean"))
    clean = clean.withColumns({f"__{k}": v for k, v in (raw | more).items()})
    base = F.concat(
        F.col("__email"), F.filter("__ip", lambda s: ip_ok(s["match"])),
        F.filter("__card", lambda s: card_ok(s["match"])), F.filter("__phone", lambda s: phone_ok(s["match"])))
    numbers = F.concat("__card", "__loose", "__ssn", "__iban")
    local = F.filter("__local", lambda s: ~spans.overlaps(s, numbers))
    every = F.concat(_candidates(F.concat("__email", "__ip", "__card", "__phone"), F.col("__clean"), 0),
                     _candidates(F.concat("__spelled", local, F.col("__loose"), F.col("__ssn"), F.col("__iban")), F.col("__clean"), 1))
    return clean.withColumns({
        "base": F.transform(base, lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))),
        "candidates": every.cast(_CANDIDATE)}).drop("__clean", *[f"__{k}" for k in raw | more])


def fit(proposed: DataFrame, precision: float = 0.9) -> tuple[boosting.Trees, list[float]]:
    """Trees and a threshold a kind, from the pattern counts of all marked candidates."""
    each = proposed.select(F.explode(F.transform(F.filter("candidates", lambda c: c["label"].isNotNull()), lambda c: F.struct(
        c["x"].alias("x"), c["half"].alias("half"), c["label"].alias("label"),
        (c["valid"] & ~spans.overlaps(c, F.col("base"))).alias("free")))).alias("c"))
    right, free = F.col("c.label") == 1, F.col("c.free")
    counts = each.groupBy("c.x", "c.half").agg(
        F.count_if(right).alias("good"), F.count_if(~right).alias("bad"),
        F.count_if(free & right).alias("free_good"), F.count_if(free & ~right).alias("free_bad")).collect()
    counts.sort(key=lambda r: (r["half"], list(r["x"])))
    x = np.array([r["x"] for r in counts], dtype=int).reshape(-1, len(LEVELS))
    half = np.array([r["half"] for r in counts], dtype=int)
    good, bad, free_good, free_bad = (np.array([r[c] for r in counts], dtype=float) for c in ("good", "bad", "free_good", "free_bad"))
    trees = boosting.Trees().fit(x[half == 0], good[half == 0], bad[half == 0])
    score = trees.score(x)

    def limit(kind: int) -> float:
        rows = (x[:, 0] == kind) & (half == 1) & (free_good + free_bad > 0)
        if not free_bad[rows].any():
            return 0.0
        # less a little, as Spark adds up the trees in another order
        return boosting.precise_threshold(score[rows], free_good[rows], free_bad[rows], precision) - 1e-9

    return trees, [limit(kind) for kind in range(len(KINDS))]


def select(proposed: DataFrame, trees: boosting.Trees, thresholds: list[float]) -> DataFrame:
    """Adds ``spans``: the base spans and the candidates chosen beside them."""
    limits = F.array(*[F.lit(t) for t in thresholds])

    def chosen(c: Column) -> Column:
        score = trees.column([F.get(c["x"], F.lit(i)) for i in range(len(LEVELS))])
        return c["valid"] & (score >= F.get(limits, c["kind"])) & ~spans.overlaps(c, F.col("base"))

    added = F.transform(F.filter("candidates", chosen), lambda c: F.struct(
        c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind")))
    return proposed.withColumn("spans", F.concat("base", F.array_distinct(added)))


def find(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, base, spans`` (arrays of start, end, kind) of every document."""
    slim = materialize(propose(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), text="text")
                       .select("doc_id", "base", "candidates"), "pii")
    return select(slim, *fit(slim)).select("doc_id", "base", "spans")


def redact(docs: DataFrame, *, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in brackets."""
    plain = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text"))
    # the patterns run again for the redaction: keeping their spans would keep a copy of every text
    chosen = select(propose(plain), *fit(propose(docs.select(F.col(text).alias("text")))))
    name = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    found = F.size("spans") > 0
    new = F.when(found, spans.replaced(whole_text("text"), F.col("spans"), lambda k: F.get(name, k))).otherwise(F.col("text"))
    out = chosen.select("row", found.alias("found"), new.alias("new"))
    put = {text: F.col("new")}
    if n_chars in docs.columns:
        put[n_chars] = F.when(F.col("found"), F.char_length("new").cast(docs.schema[n_chars].dataType)).otherwise(
            F.col("row")[n_chars])
    return out.select(*[put.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
