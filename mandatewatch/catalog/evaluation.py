"""Queries that evaluate whole layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from mandatewatch.catalog import views as v
from mandatewatch.catalog.pairing import line_rounds
from mandatewatch.catalog.quality import _CONFUSION, _PRF, rounded, sql_auc
from mandatewatch.catalog.registry import query
from mandatewatch.catalog.sessions import _sql_phrase_score
from mandatewatch.functions.text import url_domain
from mandatewatch.plans.evaluation import content_layer_evaluation, metrics_gold
from mandatewatch.sources.readers import reference_phrases

_WORDS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9'']+'))"


@query(
    "content_layer_evaluation",
    f"""
    WITH {v.V_SESSIONS},
    p AS (SELECT agent_id, injection_payload_text AS body,
                 row_number() OVER (PARTITION BY {v.sql_domain("task_origin_url")} ORDER BY agent_id) AS k
          FROM v_sessions WHERE injection_payload_text <> ''),
    ref AS (SELECT DISTINCT {_WORDS.format("body")} AS own FROM p WHERE k <= 2),
    e AS (SELECT body, 1 AS label FROM p WHERE k > 2
          UNION ALL SELECT raw_utterance, 0 FROM v_sessions WHERE NOT injection_present),
    t AS (SELECT body, {_WORDS.format("body")} AS words, {_sql_phrase_score("body")} AS fixed FROM (SELECT DISTINCT body FROM e)),
    s AS (SELECT body, greatest(MAX(fixed), MAX(len(list_intersect(words, own))
                 / (len(words) + len(own) - len(list_intersect(words, own)))::DOUBLE)) AS score FROM t, ref GROUP BY body),
    x AS (SELECT label, score FROM e JOIN s USING (body)),
    c AS (SELECT {_CONFUSION.format(p="score >= 0.15", y="label")} FROM x),
    b AS (SELECT least(floor(score * 10), 9) AS bin, COUNT(*) AS m, AVG(score) AS conf, AVG(label::DOUBLE) AS rate FROM x GROUP BY 1)
    SELECT n, tp, fp, fn, tn, {_PRF}, (SELECT round(AVG(pow(score - label, 2)), 6) FROM x) AS brier,
           (SELECT round(SUM(m * abs(conf - rate)) / SUM(m), 6) FROM b) AS ece FROM c
    """,
)
def content_layer(spark, sf_dir):
    rows = v.sessions(spark, sf_dir)
    payloads = rows.filter("injection_payload_text <> ''").select(
        F.col("agent_id").alias("id"), url_domain(F.col("task_origin_url")).alias("domain"), F.col("injection_payload_text").alias("text")
    )
    benign = rows.filter("not injection_present").select(F.col("agent_id").alias("id"), F.col("raw_utterance").alias("text"))
    found = content_layer_evaluation(payloads, benign, reference_phrases(spark))
    return rounded(found, "precision", "recall", "f1", "brier", "ece")


@query(
    "metrics_gold",
    f"""
    WITH {v.V_SESSIONS}, {v.V_SCORED}, {v.V_GRAPH},
    c1 AS (SELECT slice, {_CONFUSION.format(p="prob >= 0.5", y="label")} FROM v_sliced GROUP BY slice),
    f1 AS (SELECT slice, AVG(CASE WHEN subtlety = 'benign' THEN CASE WHEN prob >= 0.5 THEN 1.0 ELSE 0.0 END END) AS fp_rate FROM v_sliced GROUP BY slice),
    m AS (SELECT 0 AS one, CAST(is_fraud_ring_member AS INTEGER) AS label, round(1 - registered_days_ago / 3000.0::DOUBLE, 6) AS prob
          FROM v_nodes WHERE type = 'merchant'),
    c2 AS (SELECT {_CONFUSION.format(p="prob >= 0.5", y="label")} FROM m)
    SELECT 'attack_1' AS section, slice AS name, n, {_PRF}, round(auc, 6) AS auc, round(fp_rate, 6) AS fp_rate_benign
    FROM c1 JOIN {sql_auc('v_sliced', 'prob', 'label', 'slice')} a USING (slice) JOIN f1 USING (slice) WHERE auc IS NOT NULL
    UNION ALL
    SELECT 'attack_2', 'merchants', n, {_PRF}, round(auc, 6), round(fp / NULLIF(fp + tn, 0)::DOUBLE, 6)
    FROM c2, {sql_auc('m', 'prob', 'label', 'one')} a
    UNION ALL
    SELECT 'round', CAST(line_number AS VARCHAR), CAST(COUNT(*) AS BIGINT), NULL,
           round(AVG(CASE WHEN injection_present THEN 1.0 ELSE 0.0 END), 6), NULL, NULL, NULL FROM v_sessions GROUP BY line_number
    """,
)
def gold(spark, sf_dir):
    nodes, _ = v.merchant_graph(spark, sf_dir)
    merchants = nodes.filter("type = 'merchant'").select(
        F.col("is_fraud_ring_member").cast("int").alias("label"), F.round(1 - F.col("registered_days_ago") / F.lit(3000.0), 6).alias("prob")
    )
    table = metrics_gold(v.scored_sessions(spark, sf_dir), merchants, line_rounds(spark, sf_dir))
    return rounded(table, "precision", "recall", "f1", "auc", "fp_rate_benign")
