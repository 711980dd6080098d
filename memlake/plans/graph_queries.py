"""Registered queries over the metadata and entity graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions.text import round6
from memlake.operators import graph
from memlake.plans import inputs


def _entity_graph(spark, sf_dir):
    m = inputs.stored(spark, sf_dir)
    entities = graph.extract_graph_entities(m)
    return graph.upsert_graph(entities, graph.extract_relationships(m, entities), m)


def _gated(spark, sf_dir):
    """Memories that enter the metadata graph."""
    return graph.graph_gate(inputs.stored(spark, sf_dir))


def g01_graph_gate(spark, sf_dir):
    return graph.graph_gate(inputs.stored(spark, sf_dir)).select("id", "importance", "confidence")


def g02_memory_keywords(spark, sf_dir):
    return graph.memory_keywords(_gated(spark, sf_dir))


def g03_memory_entities(spark, sf_dir):
    return graph.memory_entities(_gated(spark, sf_dir))


def g04_graph_edges(spark, sf_dir):
    _, edges = graph.build_memory_graph(inputs.stored(spark, sf_dir), inputs.chat_events(spark, sf_dir))
    return edges.select("src", "rel", "dst", F.col("props.position").alias("position"),
                        F.col("props.confidence").alias("confidence"))


def g04_graph_nodes(spark, sf_dir):
    nodes, _ = graph.build_memory_graph(inputs.stored(spark, sf_dir), inputs.chat_events(spark, sf_dir))
    return nodes.groupBy("label").agg(F.count("*").alias("nodes"))


def g05_keyword_frequency(spark, sf_dir):
    return graph.keyword_frequency(graph.memory_keywords(_gated(spark, sf_dir)))


def g05_entity_occurrences(spark, sf_dir):
    return graph.entity_occurrences(graph.memory_entities(_gated(spark, sf_dir)))


def g06_extract_graph_entities(spark, sf_dir):
    return graph.extract_graph_entities(inputs.stored(spark, sf_dir))


def g07_extract_relationships(spark, sf_dir):
    m = inputs.stored(spark, sf_dir)
    return graph.extract_relationships(m, graph.extract_graph_entities(m)).withColumn(
        "confidence", round6(F.col("confidence")))


def g08_upsert_graph_nodes(spark, sf_dir):
    return _entity_graph(spark, sf_dir)[0]


def g08_upsert_graph_edges(spark, sf_dir):
    return _entity_graph(spark, sf_dir)[1].withColumn("confidence", round6(F.col("confidence")))


def _similar(members, edges):
    groups = members.groupBy("signature").agg(
        F.array_join(F.any_value("items"), "|").alias("items"), F.count("*").alias("n"))
    a = groups.select(F.col("signature").alias("sig_a"), F.col("items").alias("items_a"), F.col("n").alias("n_a"))
    b = groups.select(F.col("signature").alias("sig_b"), F.col("items").alias("items_b"), F.col("n").alias("n_b"))
    rows = edges.join(a, "sig_a").join(b, "sig_b")
    return rows.select(
        F.least("items_a", "items_b").alias("items_a"), F.greatest("items_a", "items_b").alias("items_b"), "score",
        F.when(F.col("sig_a") == F.col("sig_b"), F.col("n_a") * (F.col("n_a") - 1)).otherwise(
            F.col("n_a") * F.col("n_b") * 2).alias("memory_links"))


def g09_similar_by_keywords(spark, sf_dir):
    """Keyword sets sharing two keywords or more, with the memory links they stand for."""
    return _similar(*graph.similar_by_keywords(graph.memory_keywords(_gated(spark, sf_dir))))


def g10_similar_by_domain(spark, sf_dir):
    return graph.similar_by_domain(_gated(spark, sf_dir), 3)


def g10_domain_links(spark, sf_dir):
    return graph.domain_links(_gated(spark, sf_dir))


def g10_expand_domains(spark, sf_dir):
    """All domain links of the memories that are saved."""
    m = _gated(spark, sf_dir)
    return graph.expand_domains(graph.domain_links(m), m.where("saved"))


def g11_similar_by_tags(spark, sf_dir):
    return _similar(*graph.similar_by_tags(graph.memory_tags(_gated(spark, sf_dir))))


def g12_keyword_cooccurrence(spark, sf_dir):
    return graph.keyword_cooccurrence(graph.memory_keywords(_gated(spark, sf_dir)))


def g13_memories_by_domain(spark, sf_dir):
    m = _gated(spark, sf_dir)
    return graph.memories_by_domain(m, m.select("session_id", "domain").distinct(), 2).select(
        "session_id", "domain", "rank", "id")


def g13_memories_by_keyword(spark, sf_dir):
    m = _gated(spark, sf_dir)
    bridge = graph.memory_keywords(m)
    return graph.memories_by_keyword(m, bridge, bridge.select("session_id", "keyword").distinct(), 2).select(
        "session_id", "keyword", "rank", "id")


def g13_memories_by_entity(spark, sf_dir):
    m = _gated(spark, sf_dir)
    bridge = graph.memory_entities(m)
    return graph.memories_by_entity(m, bridge, bridge.select("session_id", "value").distinct(), 2).select(
        "session_id", "value", "rank", "id", "entity_type")


def g14_similar_memories(spark, sf_dir):
    m = _gated(spark, sf_dir)
    members, edges = graph.similar_by_keywords(graph.memory_keywords(m))
    return graph.similar_memories(members, edges, m)


def g15_graph_stats(spark, sf_dir):
    m = _gated(spark, sf_dir)
    return graph.graph_stats(m, graph.memory_keywords(m), graph.memory_entities(m))


def g16_related_entities(spark, sf_dir):
    nodes, edges = _entity_graph(spark, sf_dir)
    inner = edges.where("rel <> 'mentioned_in'")
    return graph.related_entities(inner, nodes, nodes, 0.4, 5).withColumn("confidence", round6(F.col("confidence")))


def g17_graph_context(spark, sf_dir):
    return graph.graph_context(_entity_graph(spark, sf_dir)[1])


def g18_remove_entities(spark, sf_dir):
    nodes, edges = _entity_graph(spark, sf_dir)
    kept, left = graph.remove_entities(nodes, edges, nodes.where("type = 'topic'"))
    return kept.groupBy("type").agg(F.count("*").alias("n")).select(
        F.concat(F.lit("node:"), F.coalesce("type", F.lit("-"))).alias("kind"), "n").unionByName(
        left.groupBy("rel").agg(F.count("*").alias("n")).select(F.concat(F.lit("edge:"), "rel").alias("kind"), "n"))


def g18_remove_relationships(spark, sf_dir):
    _, edges = _entity_graph(spark, sf_dir)
    left = graph.remove_relationships(edges, edges.where("confidence < 0.5"))
    return left.groupBy("rel").agg(F.count("*").alias("n"))


def g19_entity_cooccurrence(spark, sf_dir):
    return graph.entity_cooccurrence(graph.memory_entities(_gated(spark, sf_dir)))


def g19_domain_counts(spark, sf_dir):
    return graph.domain_counts(_gated(spark, sf_dir))


def g19_shared_keyword_clusters(spark, sf_dir):
    return graph.shared_keyword_clusters(graph.memory_keywords(_gated(spark, sf_dir)))


def g19_mention_counts(spark, sf_dir):
    return graph.mention_counts(graph.memory_entities(_gated(spark, sf_dir)))


QUERIES = {name: fn for name, fn in list(globals().items()) if name[:1] == "g" and name[1:3].isdigit()}
