"""Metadata graph and entity graph: construction and queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.config import GraphConfig
from memlake.functions import lexicon as lx
from memlake.functions import scoring as sc
from memlake.functions.text import matches
from memlake.operators.windows import top_k
from memlake.session import materialize

DEFAULTS = GraphConfig()


# -- metadata graph ------------------------------------------------------------

def graph_gate(df: DataFrame, config: GraphConfig = DEFAULTS) -> DataFrame:
    """Memories worth a place in the graph."""
    return df.where((F.length(F.trim("content")) > 0)
                    & (F.coalesce("importance", F.lit(0.0)) >= config.min_importance)
                    & (F.coalesce("confidence", F.lit(0.0)) >= config.min_confidence))


def _graph_terms(config: GraphConfig) -> Column:
    terms = F.transform("keywords", lambda k: F.lower(F.trim(k)))
    return F.slice(F.array_distinct(F.filter(terms, lambda t: F.length(t) >= 3)), 1, config.max_keywords)


def memory_keywords(df: DataFrame, config: GraphConfig = DEFAULTS) -> DataFrame:
    """Bridge ``(id, session_id, keyword, position)``."""
    return df.select("id", "session_id", F.posexplode(_graph_terms(config)).alias("position", "keyword"))


def memory_entities(df: DataFrame, config: GraphConfig = DEFAULTS) -> DataFrame:
    """Bridge ``(id, session_id, type, value)``; the first spelling of a value wins."""
    placed = F.transform("entities", lambda e, i: F.struct(
        F.lower(F.trim(e["type"])).alias("type"), F.trim(e["value"]).alias("value"), i.alias("pos")))
    usable = F.filter(placed, lambda e: (F.length(e["value"]) >= 3) & ~e["type"].isin(lx.NOISY_ENTITY_TYPES))
    df = df.select("id", "session_id", usable.alias("usable"))
    same = lambda a, b: (a["type"] == b["type"]) & (F.lower(a["value"]) == F.lower(b["value"]))
    first = F.filter("usable", lambda e: ~F.exists("usable", lambda o: same(o, e) & (o["pos"] < e["pos"])))
    return df.select("id", "session_id", F.explode(F.slice(first, 1, config.max_entities)).alias("e")).select(
        "id", "session_id", "e.type", "e.value")


def memory_tags(df: DataFrame) -> DataFrame:
    return df.select("id", "session_id", F.explode(F.array_distinct("tags")).alias("tag"))



def _edges(df: DataFrame, src: Column, rel: str, dst: Column, **props: Column) -> DataFrame:
    types = {"position": "int", "score": "double", "reason": "string", "cooccurrences": "bigint",
             "confidence": "double"}
    fields = [props.get(n, F.lit(None)).cast(t).alias(n) for n, t in types.items()]
    return df.select(src.alias("src"), F.lit(rel).alias("rel"), dst.alias("dst"), F.struct(*fields).alias("props"))


def node(label: str, value: Column | str) -> Column:
    return F.concat(F.lit(label + ":"), value)


def build_memory_graph(memories: DataFrame, events: DataFrame,
                       config: GraphConfig = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """Node table ``(node_id, label)`` and edge table ``(src, rel, dst, props)``.

    Edges and nodes are unique by key, as in a merge.
    """
    m = graph_gate(memories, config)
    memory = node("Memory", F.col("id"))
    keyword = memory_keywords(m, config)
    entity = memory_entities(m, config)
    kinds = [
        _edges(m, node("Session", F.col("session_id")), "HAS_MEMORY", memory),
        _edges(m, node("RawEvent", F.col("event_id")), "PRODUCED_MEMORY", memory),
        _edges(m.where(F.col("domain").isNotNull()), memory, "ABOUT", node("Domain", F.col("domain"))),
        _edges(m, memory, "IS_TYPE", node("MemoryType", F.col("memory_type"))),
        _edges(m, memory, "HAS_IMPORTANCE", node("ImportanceLevel", sc.importance_level(F.col("importance")))),
        _edges(m.where(F.col("sentiment").isNotNull()), memory, "HAS_SENTIMENT",
               node("Sentiment", F.col("sentiment"))),
        _edges(memory_tags(m), memory, "TAGGED_WITH", node("Tag", F.col("tag"))),
        _edges(keyword, memory, "HAS_KEYWORD", node("Keyword", F.col("keyword")), position=F.col("position")),
        _edges(entity, memory, "MENTIONS", node("Entity", F.concat("type", F.lit(":"), "value"))),
        _edges(m.select("id", F.explode(F.array_distinct("alternate_domains")).alias("domain")), memory,
               "COULD_BE_ABOUT", node("Domain", F.col("domain")), confidence=F.lit(0.3)),
        _edges(events, node("Session", F.col("session_id")), "HAS_EVENT", node("RawEvent", F.col("event_id"))),
    ]
    edges = kinds[0]
    for part in kinds[1:]:
        edges = edges.unionByName(part)
    # keys are unique within each kind already, except that one event may occur twice
    edges = edges.dropDuplicates(["src", "rel", "dst"])
    ends = edges.select(F.col("src").alias("node_id")).unionByName(edges.select(F.col("dst").alias("node_id")))
    nodes = ends.distinct().withColumn("label", F.substring_index("node_id", ":", 1))
    return nodes, edges


def keyword_frequency(bridge: DataFrame) -> DataFrame:
    return bridge.groupBy("keyword").agg(F.count("*").alias("frequency"))


def entity_occurrences(bridge: DataFrame) -> DataFrame:
    return bridge.groupBy("type", "value").agg(F.count("*").alias("occurrences"))


# -- similarity edges -------------------------------------------------------------
#
# Memories with the same set of keywords (or tags) have the same neighbours, so
# they are grouped under that set, the "signature".  Edges are kept between
# signatures; a group of copies costs one row, not all its pairs.

def signatures(bridge: DataFrame, item: str) -> DataFrame:
    """``id, signature, items`` of each memory."""
    sets = bridge.groupBy("id").agg(F.array_sort(F.collect_set(item)).alias("items"))
    return sets.withColumn("signature", F.sha2(F.array_join("items", "\u0001"), 256))


def similar_signatures(members: DataFrame, min_shared: int = 2) -> DataFrame:
    """Signature pairs sharing at least ``min_shared`` items: ``sig_a, sig_b, score``.

    ``sig_a <= sig_b``; equal ones stand for memories with the same set.  For a
    minimum of two the join key is a pair of items, so every joined row is a
    result and no single frequent item is ever paired out.
    """
    sets = members.groupBy("signature").agg(F.any_value("items").alias("items"), F.count("*").alias("n"))
    sets = sets.where(F.size("items") >= min_shared)
    own = sets.where(F.col("n") > 1).select(
        F.col("signature").alias("sig_a"), F.col("signature").alias("sig_b"), F.size("items").alias("score"))
    if min_shared >= 2:
        keys = F.flatten(F.transform("items", lambda x, i: F.transform(
            F.slice("items", i + 2, F.size("items")), lambda y: F.concat(x, F.lit("\u0001"), y))))
    else:
        keys = F.col("items")
    keyed = sets.select("signature", "items", F.explode(keys).alias("key"))
    a, b = keyed.alias("a"), keyed.alias("b")
    shared = F.array_intersect("a.items", "b.items")
    first = F.concat(F.element_at(shared, 1), F.lit("\u0001"), F.element_at(shared, 2)) \
        if min_shared >= 2 else F.element_at(shared, 1)
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.signature") < F.col("b.signature"))
                   & (F.size(shared) >= min_shared) & (first == F.col("a.key")))
    return own.unionByName(pairs.select(
        F.col("a.signature").alias("sig_a"), F.col("b.signature").alias("sig_b"), F.size(shared).alias("score")))


def similar_by_keywords(bridge: DataFrame, min_shared: int = 2) -> tuple[DataFrame, DataFrame]:
    """(members, signature edges) of memories sharing keywords."""
    members = signatures(bridge, "keyword")
    return members, similar_signatures(members, min_shared)


def similar_by_tags(bridge: DataFrame, min_shared: int = 2) -> tuple[DataFrame, DataFrame]:
    """(members, signature edges) of memories sharing tags."""
    members = signatures(bridge, "tag")
    return members, similar_signatures(members, min_shared)


def domain_links(memories: DataFrame) -> DataFrame:
    """``id, domain, links``: the links of a shared domain without a row each.

    All memories of a domain are linked to each other, so membership and the size
    of the domain hold every link; ``expand_domains`` lists those of given ids.
    """
    rows = memories.where(F.col("domain").isNotNull()).select("id", "domain").distinct()
    sizes = materialize(rows.groupBy("domain").agg((F.count("*") - 1).alias("links")), "domain-sizes")
    return rows.join(sizes, "domain").select("id", "domain", "links")


def expand_domains(links: DataFrame, ids: DataFrame, block_ids: int = 2_000, run_ids: int = 64) -> DataFrame:
    """``id, neighbour_id``: every link of the given ids.

    The rows grow with the square of a domain, so they are made block by block: a task lists
    the asked ids of one block beside the members of another.  Its rows name few ids, which a
    columnar writer keeps in dictionaries; without blocks each row would take the length of an id on disk.
    Members go by runs of ``run_ids`` past all asked ids, so that those in use stay in a core's cache.
    """
    asked = materialize(links.join(ids.select("id").distinct(), "id", "left_semi").select("domain", "id", "links"), "asked-links")
    cuts = materialize(asked.groupBy("domain").agg(
        F.ceil(F.count("*") / block_ids).cast("int").alias("parts"),
        F.ceil((F.max("links") + 1) / block_ids).cast("int").alias("blocks")), "domain-blocks")
    tasks = cuts.agg(F.sum(F.col("parts").cast("long") * F.col("blocks"))).first()[0] or 1

    def dealt(rows: DataFrame, own: str, own_count: str, other: str, other_count: str, out: str) -> DataFrame:
        spot = F.pmod(F.xxhash64("id"), F.col(own_count)).cast("int")
        lists = rows.select("domain", "id").join(cuts, "domain").withColumn(own, spot).groupBy(
            "domain", own, other_count).agg(F.collect_list("id").alias(out))
        return lists.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_count) - 1))).select(
            "domain", "part", "block", out).repartition(int(tasks), "domain", "part", "block")

    blocks = dealt(asked, "part", "parts", "block", "blocks", "asked").join(
        dealt(links, "block", "blocks", "part", "parts", "members"), ["domain", "part", "block"])
    starts = F.sequence(F.lit(1), F.size("members"), F.lit(run_ids))
    runs = blocks.select("asked", F.explode(F.transform(starts, lambda i: F.slice("members", i, run_ids))).alias("run"))
    return runs.select("run", F.explode("asked").alias("id")).select(
        "id", F.explode("run").alias("neighbour_id")).where("id != neighbour_id")


def similar_by_domain(memories: DataFrame, top_n: int = 5) -> DataFrame:
    """``id, neighbour_id, rank``: the most important other memories of the domain.

    Only the best ``top_n + 1`` rows of a domain can be anyone's neighbours.
    """
    best = top_k(memories.select("domain", F.col("id").alias("neighbour_id"), "importance"), ["domain"],
                 [F.desc("importance"), F.asc("neighbour_id")], top_n + 1, rank="spot")
    lists = best.groupBy("domain").agg(F.sort_array(F.collect_list(F.struct("spot", "neighbour_id"))).alias("best"))
    others = F.slice(F.filter("best", lambda b: b["neighbour_id"] != F.col("id")), 1, top_n)
    joined = memories.select("id", "domain").join(lists, "domain")
    return joined.select("id", F.posexplode(others).alias("rank", "b")).select(
        "id", F.col("b.neighbour_id").alias("neighbour_id"), (F.col("rank") + 1).alias("rank"))


def similar_memories(members: DataFrame, edges: DataFrame, memories: DataFrame, ids: DataFrame | None = None,
                     limit: int = 5) -> DataFrame:
    """``id, neighbour_id, rank``: the most important keyword neighbours of each memory.

    The best ``limit + 1`` members of each signature are enough to answer for
    every member, so hot signatures stay small.
    """
    rows = members.join(memories.select("id", "importance", "created_at"), "id")
    order = [F.desc("importance"), F.desc("created_at"), F.asc("id")]
    best = top_k(rows, ["signature"], order, limit + 1, rank="spot")
    both = edges.select("sig_a", "sig_b").unionByName(
        edges.where(F.col("sig_a") != F.col("sig_b")).select(
            F.col("sig_b").alias("sig_a"), F.col("sig_a").alias("sig_b")))
    reach = both.join(best, best["signature"] == both["sig_b"]).select(
        "sig_a", F.col("id").alias("neighbour_id"), "importance", "created_at")
    near = top_k(reach, ["sig_a"], [F.desc("importance"), F.desc("created_at"), F.asc("neighbour_id")],
                 limit + 1, rank="spot")
    lists = near.groupBy("sig_a").agg(F.sort_array(F.collect_list(F.struct("spot", "neighbour_id"))).alias("near"))
    asked = members if ids is None else members.join(ids.select("id").distinct(), "id", "left_semi")
    found = asked.join(lists, asked["signature"] == lists["sig_a"])
    others = F.slice(F.filter("near", lambda x: x["neighbour_id"] != F.col("id")), 1, limit)
    return found.select("id", F.posexplode(others).alias("rank", "x")).select(
        "id", F.col("x.neighbour_id").alias("neighbour_id"), (F.col("rank") + 1).alias("rank"))


def _pairs_within(sets: DataFrame, items: str, left: str, right: str) -> DataFrame:
    pairs = F.flatten(F.transform(items, lambda x, i: F.transform(
        F.slice(items, i + 2, F.size(items)), lambda y: F.struct(x.alias(left), y.alias(right)))))
    return sets.select(F.explode(pairs).alias("p")).select("p.*")


def keyword_cooccurrence(bridge: DataFrame) -> DataFrame:
    """``keyword_a < keyword_b`` and the number of memories holding both.

    Pairs are formed inside the (at most eight) keywords of one memory.
    """
    sets = bridge.groupBy("id").agg(F.array_sort(F.collect_set("keyword")).alias("items"))
    return _pairs_within(sets, "items", "keyword_a", "keyword_b").groupBy("keyword_a", "keyword_b").agg(
        F.count("*").alias("cooccurrences"))


def entity_cooccurrence(bridge: DataFrame) -> DataFrame:
    """Entity values mentioned by the same memory, counted."""
    sets = bridge.groupBy("id").agg(F.array_sort(F.collect_list("value")).alias("items"))
    pairs = _pairs_within(sets, "items", "value_a", "value_b").where(F.col("value_a") < F.col("value_b"))
    return pairs.groupBy("value_a", "value_b").agg(F.count("*").alias("cooccurrences"))


def domain_counts(memories: DataFrame) -> DataFrame:
    return memories.groupBy("domain").agg(F.count("*").alias("memories"))


def mention_counts(bridge: DataFrame) -> DataFrame:
    return bridge.groupBy("type", "value").agg(F.count("id").alias("mentions"))


def shared_keyword_clusters(bridge: DataFrame) -> DataFrame:
    """Per keyword in two memories or more, the distinct left plus right ends of its pairs.

    With n memories in id order every one but the last is a left end and every
    one but the first a right end.
    """
    counts = bridge.groupBy("keyword").agg(F.count("*").alias("n")).where(F.col("n") >= 2)
    return counts.select("keyword", ((F.col("n") - 1) * 2).alias("memory_count"))


# -- lookups ------------------------------------------------------------------------

def _best_per_key(rows: DataFrame, keys: list[str], limit: int) -> DataFrame:
    return top_k(rows, keys, [F.desc("importance"), F.desc("created_at"), F.asc("id")], limit)


def memories_by_domain(memories: DataFrame, wanted: DataFrame, limit: int = 10) -> DataFrame:
    """Best memories for each ``(session_id, domain)`` asked for."""
    return _best_per_key(memories.join(wanted, ["session_id", "domain"], "left_semi"),
                         ["session_id", "domain"], limit)


def memories_by_keyword(memories: DataFrame, bridge: DataFrame, wanted: DataFrame, limit: int = 10) -> DataFrame:
    """Best memories for each ``(session_id, keyword)`` asked for."""
    links = bridge.join(wanted, ["session_id", "keyword"], "left_semi").select("id", "keyword")
    return _best_per_key(memories.join(links, "id"), ["session_id", "keyword"], limit)


def memories_by_entity(memories: DataFrame, bridge: DataFrame, wanted: DataFrame, limit: int = 10) -> DataFrame:
    """Best memories for each ``(session_id, value)`` asked for."""
    links = bridge.join(wanted, ["session_id", "value"], "left_semi").select(
        "id", "value", F.col("type").alias("entity_type"))
    return top_k(memories.join(links, "id"), ["session_id", "value"],
                 [F.desc("importance"), F.desc("created_at"), F.asc("id"), F.asc("entity_type")], limit)


def graph_stats(memories: DataFrame, keywords: DataFrame, entities: DataFrame) -> DataFrame:
    """Per session: memories, distinct domains, keywords and entities (zero where none)."""
    base = memories.groupBy("session_id").agg(
        F.count("*").alias("memories"), F.count_distinct("domain").alias("domains"))
    words = keywords.groupBy("session_id").agg(F.count_distinct("keyword").alias("keywords"))
    things = entities.groupBy("session_id").agg(F.count_distinct("type", "value").alias("entities"))
    return base.join(words, "session_id", "left").join(things, "session_id", "left").select(
        "session_id", "memories", "domains", F.coalesce("keywords", F.lit(0)).alias("keywords"),
        F.coalesce("entities", F.lit(0)).alias("entities"))


# -- entity graph ---------------------------------------------------------------------

def _squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, lx.expand_white_space(r"\s+"), " "))


def extract_graph_entities(memories: DataFrame, limit: int = 12) -> DataFrame:
    """Typed entities of each memory: ``id, entity_id, name, type, source, position``.

    Passes run in order — domain, multi-word keywords, capitalised phrases,
    single capitalised words, task, preference and decision phrases — and an
    entity keeps its first pass.  At most ``limit`` per memory, persons first.
    """
    text = F.concat_ws(" ", F.when(F.length("content") > 0, F.col("content")),
                       F.when(F.length("summary") > 0, F.col("summary")))
    df = memories.select("id", "domain", "keywords", text.alias("text"))

    def entry(kind, name: Column, source: str) -> Column:
        return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("type"),
                        F.trim(name).alias("name"), F.lit(source).alias("source"))

    def phrases(pattern: str, ignore_case: bool) -> Column:
        return F.regexp_extract_all(F.col("text"), F.lit(lx.jvm_regex(pattern, ignore_case)), F.lit(1))

    domain = F.filter(F.array("domain"), lambda d: F.length(d) >= 2)
    multi = F.filter(F.coalesce("keywords", F.array().cast("array<string>")), lambda k: (
        (F.length(F.trim(k)) >= 3) & (F.length(F.trim(k)) <= 40) & F.contains(F.trim(k), F.lit(" "))))
    proper = phrases(lx.MULTI_PROPER_PATTERN, False)
    kind = lambda n: F.when(matches(n, lx.ORGANIZATION_PATTERN, True), "organization").otherwise("project")
    early = F.concat(
        F.transform(domain, lambda d: entry("topic", d, "domain")),
        F.transform(multi, lambda k: entry("topic", k, "keyword")),
        F.transform(proper, lambda n: entry(kind(n), n, "proper_noun")))
    usable = lambda es: F.filter(es, lambda e: (F.length(e["name"]) >= 2) & (F.length(e["name"]) <= 80))
    df = df.withColumn("__early", usable(early))
    keyed = lambda e: F.concat(e["type"], F.lit(":"), F.lower(_squeeze(e["name"])))
    df = df.withColumn("__ids", F.transform("__early", keyed))
    single = F.array_distinct(F.filter(phrases(lx.SINGLE_PROPER_PATTERN, False),
                                       lambda n: ~n.isin(lx.PROPER_SKIP)))
    # a word that is part of, or equal to, an entity seen so far is not a person
    seen = lambda n: F.exists("__ids", lambda i: F.endswith(i, F.concat(F.lit(":"), F.lower(n)))
                              | F.contains(i, F.concat(F.lit(" "), F.lower(n))))
    # (the size test keeps the definition of __ids out of the lambda)
    people = F.when(F.size("__ids") >= 0, F.filter(single, lambda n: ~seen(n)))
    late = lambda p, t, s: F.transform(phrases(p, True), lambda n: entry(t, _squeeze(n), s))
    df = df.withColumn("__all", F.concat(
        F.col("__early"), F.transform(people, lambda n: entry("person", n, "single_proper")),
        late(lx.TASK_PATTERN, "task", "task_signal"),
        late(lx.PREFERENCE_PATTERN, "preference", "preference_signal"),
        late(lx.DECISION_PHRASE_PATTERN, "decision", "decision_signal")))
    priority = F.array(*[F.lit(p) for p in lx.ENTITY_PRIORITY])
    placed = F.transform(usable(F.col("__all")), lambda e, i: F.struct(
        F.array_position(priority, e["type"]).alias("priority"), i.alias("pos"), keyed(e).alias("entity_id"),
        e["name"].alias("name"), e["type"].alias("type"), e["source"].alias("source")))
    df = df.withColumn("__placed", placed)
    first = F.filter("__placed", lambda e: ~F.exists(
        "__placed", lambda o: (o["entity_id"] == e["entity_id"]) & (o["pos"] < e["pos"])))
    chosen = F.slice(F.sort_array(first), 1, limit)
    return df.select("id", F.posexplode(chosen).alias("position", "e")).select(
        "id", "e.entity_id", "e.name", "e.type", "e.source", "position")


def extract_relationships(memories: DataFrame, entities: DataFrame, limit: int = 20) -> DataFrame:
    """Typed relationships of each memory: ``id, from_id, to_id, rel, confidence, source``.

    All ordered pairs among the (at most twelve) entities of a memory, plus
    one ``mentioned_in`` edge per entity; the best ``limit`` are kept.
    """
    text = F.concat_ws(" ", F.when(F.length("content") > 0, F.col("content")),
                       F.when(F.length("summary") > 0, F.col("summary")))
    cues = memories.select(
        "id", "memory_type", matches(text, lx.WORKS_ON_PATTERN, True).alias("works"),
        matches(text, lx.DEPENDS_ON_PATTERN, True).alias("depends"),
        matches(text, lx.COMPLETED_PATTERN, True).alias("done"))
    sets = entities.groupBy("id").agg(F.sort_array(F.collect_list(
        F.struct("position", "entity_id", "type"))).alias("es")).join(cues, "id")
    size = F.size("es")
    mentioned = F.transform("es", lambda e: F.struct(
        e["position"].cast("int").alias("ord"), e["entity_id"].alias("from_id"),
        F.concat(F.lit("memory:"), F.col("id")).alias("to_id"), e["type"].alias("f"), F.lit("memory").alias("t")))
    pairs = F.flatten(F.transform("es", lambda x, i: F.transform(
        F.slice("es", i + 2, size), lambda y: F.struct(
            (F.lit(1000) + x["position"] * 100 + y["position"]).cast("int").alias("ord"),
            x["entity_id"].alias("from_id"), y["entity_id"].alias("to_id"),
            x["type"].alias("f"), y["type"].alias("t")))))
    rows = sets.select("id", "memory_type", "works", "depends", "done",
                       F.explode(F.concat(mentioned, pairs)).alias("p")).select("*", "p.*").drop("p")
    f, t = F.col("f"), F.col("t")
    between = lambda a, b: (f == a) & (t == b)
    works, depends, done = F.col("works"), F.col("depends"), F.col("done")
    assigned = F.when(works, F.lit(0.55) + 0.20).otherwise(0.55)
    rules = [
        (t == "memory", F.lit("mentioned_in"), F.lit(0.5)),
        (between("person", "project"), F.lit("works_on"), F.when(works, F.lit(0.55) + 0.25).otherwise(0.55)),
        (between("person", "task"), F.when(done, "completed").otherwise("assigned_to"),
         F.when(done, assigned + 0.10).otherwise(assigned)),
        (between("person", "organization"), F.lit("belongs_to"), F.lit(0.60)),
        (between("person", "preference"), F.lit("prefers"), F.lit(0.70)),
        (between("person", "decision"), F.lit("decided"), F.lit(0.65)),
        (between("project", "task"), F.when(depends, "depends_on").otherwise("related_to"),
         F.when(depends, F.lit(0.55) + 0.15).otherwise(0.55)),
        (between("project", "project"), F.when(depends, "depends_on").otherwise("related_to"),
         F.when(depends, F.lit(0.45) + 0.25).otherwise(0.45)),
        (between("task", "task"), F.when(depends, "depends_on").otherwise("related_to"),
         F.when(depends, F.lit(0.40) + 0.30).otherwise(0.40)),
        ((f == "topic") | (t == "topic"), F.lit("related_to"), F.lit(0.40)),
    ]
    rel, confidence = F.lit("related_to"), F.lit(0.35)
    for condition, name, value in reversed(rules):
        rel = F.when(condition, name).otherwise(rel)
        confidence = F.when(condition, value).otherwise(confidence)
    rows = rows.withColumns({"rel": rel, "__c": confidence})
    boosted = (((F.col("memory_type") == "factual") & F.col("rel").isin("prefers", "decided"))
               | ((F.col("memory_type") == "episodic") & F.col("rel").isin("completed", "assigned_to")))
    rows = rows.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("__c") + F.when(
        boosted, 0.10).otherwise(0.0)))).where(F.col("confidence") >= 0.3)
    kept = top_k(rows, ["id"], [F.desc("confidence"), F.asc("ord")], limit, rank="__rn")
    source = F.when(F.col("t") == "memory", "baseline").otherwise("entity_pair")
    return kept.select("id", "from_id", "to_id", "rel", "confidence", source.alias("source"))


def upsert_graph(entities: DataFrame, relationships: DataFrame, memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merge per-memory extraction into one graph; the latest memory wins.

    Unknown relationship types are dropped; endpoints without an entity row
    (memory nodes) become nodes with null name and type.
    """
    when = memories.select("id", "created_at")
    order = F.struct("created_at", "id")
    nodes = entities.join(when, "id").groupBy("entity_id").agg(
        F.max_by(F.struct("name", "type", "source"), order).alias("v")).select("entity_id", "v.*")
    edges = relationships.where(F.col("rel").isin(lx.RELATIONSHIP_TYPES)).join(when, "id").groupBy(
        "from_id", "rel", "to_id").agg(F.max_by(F.struct("confidence", "source"), order).alias("v")).select(
        "from_id", "rel", "to_id", "v.*")
    ends = edges.select(F.col("from_id").alias("entity_id")).unionByName(
        edges.select(F.col("to_id").alias("entity_id"))).distinct()
    bare = ends.join(nodes, "entity_id", "left_anti").select(
        "entity_id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("type"),
        F.lit(None).cast("string").alias("source"))
    return nodes.unionByName(bare), edges


def related_entities(edges: DataFrame, nodes: DataFrame, ids: DataFrame, min_confidence: float = 0.0,
                     limit: int = 10) -> DataFrame:
    """Direct neighbours along outgoing edges, best first (at most 50 each)."""
    wanted = ids.select(F.col("entity_id").alias("from_id")).distinct()
    out = edges.join(wanted, "from_id", "left_semi").where(F.col("confidence") >= min_confidence)
    best = top_k(out, ["from_id"], [F.desc("confidence"), F.asc("to_id"), F.asc("rel")], min(50, limit))
    return best.join(nodes.select(F.col("entity_id").alias("to_id"), "name", "type"), "to_id").select(
        "from_id", "to_id", "name", "type", "rel", "confidence", "rank")


def graph_context(edges: DataFrame, ids: DataFrame | None = None, max_entities: int = 20,
                  max_relationships: int = 30) -> DataFrame:
    """Per memory: number of entities mentioned in it and of relationships among them.

    Relationships are found by joining the ordered entity pairs of a memory
    with the edge table on both ends at once.
    """
    links = edges.where(F.col("rel") == "mentioned_in").select(
        F.substr("to_id", F.lit(len("memory:") + 1)).alias("id"), F.col("from_id").alias("entity_id"),
        "confidence")
    if ids is not None:
        links = links.join(ids.select("id").distinct(), "id", "left_semi")
    held = top_k(links, ["id"], [F.desc("confidence"), F.asc("entity_id")], max_entities, rank="__rn")
    sets = held.groupBy("id").agg(F.collect_list("entity_id").alias("es"))
    pairs = F.flatten(F.transform("es", lambda x: F.transform("es", lambda y: F.struct(
        x.alias("from_id"), y.alias("to_id")))))
    wanted = sets.select("id", F.explode(pairs).alias("p")).select("id", "p.*")
    inner = edges.where(F.col("rel") != "mentioned_in").select("from_id", "to_id", "rel", "confidence")
    found = wanted.join(inner, ["from_id", "to_id"]).groupBy("id").agg(
        F.least(F.count("*"), F.lit(max_relationships)).alias("rel_count"))
    return sets.select("id", F.size("es").alias("entity_count")).join(found, "id", "left").select(
        "id", F.col("entity_count").cast("bigint").alias("entity_count"),
        F.coalesce("rel_count", F.lit(0)).alias("rel_count"))


def context_relationships(edges: DataFrame, ids: DataFrame, max_entities: int = 20,
                          max_relationships: int = 30) -> DataFrame:
    """The relationships counted by :func:`graph_context`, at most 30 per memory."""
    links = edges.where(F.col("rel") == "mentioned_in").select(
        F.substr("to_id", F.lit(len("memory:") + 1)).alias("id"), F.col("from_id").alias("entity_id"),
        "confidence").join(ids.select("id").distinct(), "id", "left_semi")
    held = top_k(links, ["id"], [F.desc("confidence"), F.asc("entity_id")], max_entities, rank="__rn")
    sets = held.groupBy("id").agg(F.collect_list("entity_id").alias("es"))
    pairs = F.flatten(F.transform("es", lambda x: F.transform("es", lambda y: F.struct(
        x.alias("from_id"), y.alias("to_id")))))
    wanted = sets.select("id", F.explode(pairs).alias("p")).select("id", "p.*")
    inner = edges.where(F.col("rel") != "mentioned_in")
    return top_k(wanted.join(inner, ["from_id", "to_id"]), ["id"],
                 [F.desc("confidence"), F.asc("from_id"), F.asc("to_id"), F.asc("rel")], max_relationships)


def remove_entities(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete nodes and every edge touching them."""
    gone = ids.select("entity_id").distinct()
    kept = nodes.join(gone, "entity_id", "left_anti")
    left = edges.join(gone.withColumnRenamed("entity_id", "from_id"), "from_id", "left_anti")
    left = left.join(gone.withColumnRenamed("entity_id", "to_id"), "to_id", "left_anti")
    return kept, left.select(*edges.columns)


def remove_relationships(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """Delete edges named by ``(from_id, rel, to_id)``."""
    return edges.join(keys.select("from_id", "rel", "to_id").distinct(), ["from_id", "rel", "to_id"], "left_anti")
