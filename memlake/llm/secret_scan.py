"""Operator 6: secret scans with corpus-wide ownership, in DataFrame expressions only.

Base patterns (assigned values, access keys, hex runs) always stay; further
generators propose tokens of known issuers, signed web tokens, private-key
headers and long mixed-case tokens.  The hash of each candidate's value is
counted over the whole corpus by distinct repositories and owners: a value seen
with many owners is a copied example, one that stays with a single owner looks
live.  Further candidates become spans only where they look live and overlap no
base span.

Values are counted after a partial aggregation by (hash, repository, owner), so
a value copied into a third of the corpus shuffles as few rows; results come
back by an equi-join on the row, not by collecting a value's rows.

Defined results: a null text is empty and has no span; null repositories and
owners count as one of their own; repeated rows are treated as rows of their
own with the same result; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.llm import spans
from memlake.llm.common import whole_text
from memlake.session import materialize

#: fixed values: base patterns
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
#: further generators
ISSUED = r"(?<![A-Za-z0-9_])(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})"
SIGNED = r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
PRIVATE = r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"
MIXED = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]{0,64}[0-9])(?=[^A-Z\s]{0,64}[A-Z])(?=[^a-z\s]{0,64}[a-z])[A-Za-z0-9+/_-]{32,}"

KINDS = ["assign", "access", "hex", "issued", "signed", "private", "mixed"]
BASE, MIXED_KIND = 3, 6
#: owners from which on a value counts as a copied example
EXAMPLE_OWNERS = 3


def _found(text: Column) -> Column:
    return F.concat(
        spans.matches(text, ASSIGN, 0, context=0, keep=lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 12),
        spans.matches(text, ACCESS, 1, context=0, guard=F.contains(text, F.lit("AKIA")), keep=lambda m: F.length(m) >= 18),
        spans.matches(text, HEX, 2, context=0),
        spans.matches(text, ISSUED, 3, context=0), spans.matches(text, SIGNED, 4, context=0),
        spans.matches(text, PRIVATE, 5, context=0), spans.matches(text, MIXED, 6, context=0))


def propose(docs: DataFrame, *, doc_id: str, text: str, repository: list[str], owner: str) -> DataFrame:
    """Slim rows: id, repository, owner, and the candidates with the hash of their value."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.to_json(F.struct(*repository)).alias("repository"),
        F.col(owner).cast("string").alias("owner"), spans.clean(whole_text(text)).alias("text"))
    found = rows.withColumn("found", _found(F.col("text"))).drop("text")
    value = lambda s: F.when(s["kind"] == 0, F.regexp_extract(s["match"], ASSIGN, 2)).otherwise(s["match"])
    return found.withColumn("found", F.transform("found", lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"),
        F.sha2(value(s).cast("binary"), 256).alias("hash")))).withColumn("row", F.monotonically_increasing_id())


def ownership(candidates: DataFrame) -> DataFrame:
    """``hash, repositories, owners, uses`` over the whole corpus."""
    per = candidates.groupBy("hash", "repository", "owner").agg(F.count("*").alias("uses"))
    by_owner = per.groupBy("hash", "owner").agg(F.count("*").alias("repositories"), F.sum("uses").alias("uses"))
    return by_owner.groupBy("hash").agg(
        F.sum("repositories").alias("repositories"), F.count("*").alias("owners"), F.sum("uses").alias("uses"))


def scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", repository: list[str] | None = None,
         owner: str = "source", example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """Per row ``doc_id, base, spans``; each span has ``start, end, kind, repositories, owners, live``."""
    slim = materialize(propose(docs, doc_id=doc_id, text=text, repository=repository or [owner], owner=owner), "secrets")
    each = slim.where(F.size("found") > 0).select("row", "repository", "owner", F.explode("found").alias("s")).select(
        "row", "repository", "owner", "s.*")
    # written before the join, so that Spark can split the rows of a widely copied value over tasks
    owned = materialize(ownership(each), "secret-owners")
    judged = each.join(owned, "hash").withColumn("live", F.col("owners") < example_owners)
    back = judged.groupBy("row").agg(F.collect_list(F.struct(
        "start", "end", "kind", "repositories", "owners", "live")).alias("judged"))
    out = slim.select("doc_id", "row").join(back, "row", "left")
    none = F.array().cast(back.schema["judged"].dataType)
    out = out.withColumn("judged", F.coalesce("judged", none))
    out = out.withColumn("base", F.filter("judged", lambda s: s["kind"] < BASE))
    out = out.withColumn("more", F.filter(
        "judged", lambda s: (s["kind"] >= BASE) & s["live"] & ~spans.overlaps(s, F.col("base"))))
    # a token of a known form is also a long mixed one: the form is named once
    named = F.filter("more", lambda s: s["kind"] != MIXED_KIND)
    out = out.withColumn("more", F.filter("more", lambda s: (s["kind"] != MIXED_KIND) | ~spans.overlaps(s, named)))
    return out.select("doc_id", "base", F.concat("base", "more").alias("spans"))
