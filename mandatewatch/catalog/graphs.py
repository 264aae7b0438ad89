"""Queries on the attack knowledge graph and the merchant graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from mandatewatch.catalog import views as v
from mandatewatch.catalog.registry import query
from mandatewatch.operators import graph, taxonomy
from mandatewatch.runtime import scratch_path
from mandatewatch.sources import writers

_V_KG = """
v_kg AS (
  SELECT attack_id AS src, 'delivery:' || delivery_vector AS dst, 'delivered_via' AS relation FROM v_taxonomy
  UNION ALL SELECT attack_id, 'mechanism_type:' || mechanism_type, 'has_mechanism' FROM v_taxonomy
  UNION ALL SELECT attack_id, 'source:' || UNNEST(grounding), 'grounded_in' FROM v_taxonomy
)"""


@query("attack_graph_edges", f"WITH {v.V_TAXONOMY}, {_V_KG} SELECT src, dst, relation FROM v_kg")
def attack_graph_edges(spark, sf_dir):
    return taxonomy.graph_edges(v.part_taxonomy(spark, sf_dir))


@query(
    "attack_graph_nodes",
    f"""
    WITH {v.V_TAXONOMY}, {_V_KG}
    SELECT attack_id AS id, 'attack' AS type, name, category, NULL AS value FROM v_taxonomy
    UNION ALL SELECT DISTINCT dst, split_part(dst, ':', 1), NULL, NULL, split_part(dst, ':', 2) FROM v_kg
    """,
)
def attack_graph_nodes(spark, sf_dir):
    return taxonomy.graph_nodes(v.part_taxonomy(spark, sf_dir))


@query(
    "shared_attack_tags",
    f"""
    WITH {v.V_TAXONOMY}
    SELECT b.attack_id AS candidate, a.attack_id FROM v_taxonomy a JOIN v_taxonomy b ON b.seq = a.seq + 1
    WHERE a.delivery_vector = b.delivery_vector AND a.mechanism_type = b.mechanism_type
    """,
)
def shared_attack_tags(spark, sf_dir):
    entries = v.part_taxonomy(spark, sf_dir)
    probes = entries.select(
        F.col("attack_id").alias("candidate"), v.text(F.lit("attack_"), F.col("seq") - 1).alias("attack_id"),
        "delivery_vector", "mechanism_type",
    )
    return taxonomy.shares_tags(probes, taxonomy.graph_edges(entries)).select("candidate", "attack_id")


_V_FEATURES = """
v_features AS (
  SELECT id, CASE WHEN type = 'merchant' THEN 1.0 ELSE 0.0 END::DOUBLE AS is_merchant,
         CASE WHEN type = 'acquirer' THEN 1.0 ELSE 0.0 END::DOUBLE AS is_acquirer,
         CASE WHEN type = 'beneficiary' THEN 1.0 ELSE 0.0 END::DOUBLE AS is_beneficiary,
         COALESCE(registered_days_ago, 0) / greatest((SELECT MAX(registered_days_ago) FROM v_nodes), 1)::DOUBLE AS age,
         CASE WHEN type = 'merchant' THEN CAST(is_fraud_ring_member AS INTEGER) ELSE -1 END AS label
  FROM v_nodes
)"""


@query(
    "merchant_node_features",
    f"WITH {v.V_GRAPH}, {_V_FEATURES} SELECT id, is_merchant, is_acquirer, is_beneficiary, round(age, 9) AS age, label FROM v_features",
)
def merchant_node_features(spark, sf_dir):
    nodes, _ = v.merchant_graph(spark, sf_dir)
    return graph.node_features(nodes).withColumn("age", F.round("age", 9))


@query("merchant_links", f"WITH {v.V_GRAPH} SELECT src, dst FROM v_links")
def merchant_links(spark, sf_dir):
    return graph.both_directions(v.merchant_graph(spark, sf_dir)[1])


_V_COMPONENTS = """
v_owned AS (
  SELECT src, dst FROM v_edges WHERE relation = 'owned_by' UNION SELECT dst, src FROM v_edges WHERE relation = 'owned_by'
),
v_reach(id, seen) AS (
  SELECT id, id FROM v_nodes UNION SELECT dst, seen FROM v_reach JOIN v_owned ON src = id
),
v_components AS (SELECT id, MIN(seen) AS component FROM v_reach GROUP BY id)"""

_V_MEANS = """
v_mean1 AS (SELECT dst AS id, AVG(is_merchant) AS m, AVG(is_acquirer) AS a, AVG(is_beneficiary) AS b, AVG(age) AS g
            FROM v_links JOIN v_features ON src = id GROUP BY dst),
v_mean2 AS (SELECT dst AS id, AVG(m) AS m, AVG(a) AS a, AVG(b) AS b, AVG(g) AS g FROM v_links JOIN v_mean1 ON src = id GROUP BY dst)"""


@query(
    "ring_features",
    f"""
    WITH RECURSIVE {v.V_GRAPH}, {_V_FEATURES}, {_V_MEANS}, {_V_COMPONENTS},
    hub AS (
      SELECT src AS id, relation, dst AS hub, COUNT(*) OVER (PARTITION BY relation, dst) - 1 AS peers,
             MAX(registered_days_ago) OVER (PARTITION BY relation, dst) - MIN(registered_days_ago) OVER (PARTITION BY relation, dst) AS spread
      FROM v_edges JOIN v_nodes ON src = id
    )
    SELECT f.id, round(f.age, 6) AS age, f.label, CAST((SELECT COUNT(*) FROM v_links l WHERE l.src = f.id) AS BIGINT) AS degree,
           a.hub AS acquirer_hub, CAST(a.peers AS BIGINT) AS acquirer_peers, a.spread AS acquirer_age_spread,
           o.hub AS owner_hub, CAST(o.peers AS BIGINT) AS owner_peers, o.spread AS owner_age_spread,
           CAST((SELECT COUNT(*) FROM v_components x WHERE x.component = c.component) AS BIGINT) AS community_size,
           round(m1.a, 6) AS mean1_is_acquirer, round(m1.b, 6) AS mean1_is_beneficiary, round(m1.g, 6) AS mean1_age, round(m1.m, 6) AS mean1_is_merchant,
           round(m2.a, 6) AS mean2_is_acquirer, round(m2.b, 6) AS mean2_is_beneficiary, round(m2.g, 6) AS mean2_age, round(m2.m, 6) AS mean2_is_merchant
    FROM v_features f JOIN hub a ON a.id = f.id AND a.relation = 'uses_acquirer' JOIN hub o ON o.id = f.id AND o.relation = 'owned_by'
    JOIN v_components c ON c.id = f.id JOIN v_mean1 m1 ON m1.id = f.id JOIN v_mean2 m2 ON m2.id = f.id
    WHERE f.label >= 0
    """,
)
def ring_features(spark, sf_dir):
    rows = graph.ring_features(*v.merchant_graph(spark, sf_dir))
    doubles = [f.name for f in rows.schema if f.dataType.typeName() == "double" and not f.name.startswith("is_")]
    return rows.withColumns({c: F.round(c, 6) for c in doubles})


@query("merchant_communities", f"WITH RECURSIVE {v.V_GRAPH}, {_V_COMPONENTS} SELECT id, component FROM v_components")
def merchant_communities(spark, sf_dir):
    nodes, edges = v.merchant_graph(spark, sf_dir)
    return graph.connected_components(nodes, edges.filter("relation = 'owned_by'"))


@query(
    "merchant_hop_depth",
    f"""
    WITH RECURSIVE {v.V_GRAPH},
    walk(id, depth) AS (
      SELECT id, 0 FROM v_nodes WHERE is_fraud_ring_member
      UNION SELECT dst, depth + 1 FROM walk JOIN v_links ON src = id WHERE depth < (SELECT COUNT(*) FROM v_nodes)
    )
    SELECT id, MIN(depth) AS depth FROM walk GROUP BY id
    """,
)
def merchant_hop_depth(spark, sf_dir):
    nodes, edges = v.merchant_graph(spark, sf_dir)
    return graph.hop_depth(nodes.filter("is_fraud_ring_member"), edges)


@query(
    "merchant_graph_counts",
    f"""
    WITH {v.V_GRAPH}
    SELECT type, is_fraud_ring_member AS ring, CAST(COUNT(*) AS BIGINT) AS n FROM v_nodes GROUP BY ALL
    UNION ALL SELECT 'edge', NULL, COUNT(*) FROM v_edges
    """,
)
def merchant_graph_counts(spark, sf_dir):
    return graph.graph_counts(*v.merchant_graph(spark, sf_dir))


@query(
    "merchant_graph_export",
    f"""
    WITH {v.V_GRAPH}
    SELECT 'edge' AS kind, src, dst, relation, NULL::BOOLEAN AS ring, NULL::INTEGER AS age FROM v_edges
    UNION ALL SELECT 'node', id, NULL, type, is_fraud_ring_member, registered_days_ago FROM v_nodes
    """,
)
def merchant_graph_export(spark, sf_dir):
    path = scratch_path(spark, "merchant-graph")
    writers.write_graph(*v.merchant_graph(spark, sf_dir), path)
    edges = spark.read.schema("src string, dst string, relation string").json(f"{path}/edges")
    stored = "id string, type string, is_fraud_ring_member boolean, registered_days_ago int"
    nodes = spark.read.schema(stored).json(f"{path}/nodes")
    none = lambda kind: F.lit(None).cast(kind)
    return edges.select(
        F.lit("edge").alias("kind"), "src", "dst", "relation", none("boolean").alias("ring"), none("int").alias("age")
    ).unionByName(
        nodes.select(
            F.lit("node").alias("kind"), F.col("id").alias("src"), none("string").alias("dst"), F.col("type").alias("relation"),
            F.col("is_fraud_ring_member").alias("ring"), F.col("registered_days_ago").alias("age"),
        )
    )
