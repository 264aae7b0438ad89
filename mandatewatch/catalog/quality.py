"""Queries on classifier quality, calibration and signal separation."""

from __future__ import annotations

from pyspark.sql import functions as F

from mandatewatch.catalog import views as v
from mandatewatch.catalog.registry import query
from mandatewatch.catalog.sessions import _sql_phrase_score
from mandatewatch.catalog.texts import V_CONTENT, document_scores
from mandatewatch.functions.policy import session_flagged
from mandatewatch.functions.scoring import gate_reading, verdict_consistent
from mandatewatch.functions.text import largest_inr_amount
from mandatewatch.operators import metrics
from mandatewatch.operators.drift import feature_drift
from mandatewatch.plans.fusion import attach_scores, content_score, metrics_table
from mandatewatch.plans.sessions import with_signals


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def labelled_documents(spark, sf_dir):
    labels = v.table(spark, sf_dir, "labels").select("doc_id", "quality")
    return document_scores(spark, sf_dir).join(labels, "doc_id")


_V_LABELLED = V_CONTENT + ", v_labelled AS (SELECT doc_id, content_score, quality FROM v_content JOIN labels USING (doc_id))"

_CONFUSION = """
CAST(COUNT(*) AS BIGINT) AS n,
CAST(SUM(CASE WHEN {p} AND {y} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(SUM(CASE WHEN {p} AND {y} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
CAST(SUM(CASE WHEN NOT {p} AND {y} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn, CAST(SUM(CASE WHEN NOT {p} AND {y} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn
"""

_PRF = """
round(COALESCE(tp / NULLIF(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(COALESCE(tp / NULLIF(tp + fn, 0)::DOUBLE, 0), 6) AS recall,
round(COALESCE(2 * tp / NULLIF(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1
"""


def sql_auc(source: str, score: str, label: str, by: str) -> str:
    """Subquery (by..., auc) from mean ranks."""
    return f"""
    (SELECT {by}, (SUM(CASE WHEN {label} = 1 THEN mean_rank ELSE 0 END) - SUM({label}) * (SUM({label}) + 1) / 2.0)
            / NULLIF(SUM({label}) * SUM(1 - {label}), 0) AS auc
     FROM (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY {score})
                     + (COUNT(*) OVER (PARTITION BY {by}, {score}) - 1) / 2.0 AS mean_rank FROM {source})
     GROUP BY {by})"""


@query(
    "content_quality",
    f"""
    WITH {_V_LABELLED}, c AS (SELECT {_CONFUSION.format(p="content_score >= 0.15", y="quality")} FROM v_labelled)
    SELECT n, tp, fp, fn, tn, {_PRF} FROM c
    """,
)
def content_quality(spark, sf_dir):
    rows = metrics.confusion(labelled_documents(spark, sf_dir), "content_score", "quality", threshold=0.15)
    return rounded(rows, "precision", "recall", "f1")


@query(
    "content_auc",
    f"WITH {_V_LABELLED}, k AS (SELECT *, 0 AS one FROM v_labelled) SELECT round(auc, 6) AS auc FROM {sql_auc('k', 'content_score', 'quality', 'one')}",
)
def content_auc(spark, sf_dir):
    return rounded(metrics.roc_auc(labelled_documents(spark, sf_dir), "content_score", "quality"), "auc")


@query(
    "content_calibration",
    f"""
    WITH {_V_LABELLED},
    b AS (SELECT CAST(least(floor(content_score * 10), 9) AS INTEGER) AS bin, COUNT(*) AS n, AVG(content_score) AS conf,
                 AVG(quality::DOUBLE) AS rate FROM v_labelled GROUP BY 1)
    SELECT (SELECT round(AVG(pow(content_score - quality, 2)), 6) FROM v_labelled) AS brier,
           round(SUM(n * abs(conf - rate)) / SUM(n), 6) AS ece FROM b
    """,
)
def content_calibration(spark, sf_dir):
    return rounded(metrics.calibration(labelled_documents(spark, sf_dir), "content_score", "quality"), "brier", "ece")


@query(
    "calibration_bins",
    f"""
    WITH {v.V_SESSIONS}, {v.V_SCORED}
    SELECT CAST(least(floor(prob * 10), 9) AS INTEGER) AS bin, CAST(COUNT(*) AS BIGINT) AS n,
           round(AVG(prob), 6) AS mean_confidence, round(AVG(label::DOUBLE), 6) AS observed_rate FROM v_scored GROUP BY 1
    """,
)
def calibration_bins(spark, sf_dir):
    bins = metrics.calibration_bins(v.scored_sessions(spark, sf_dir), "prob", "label")
    return rounded(bins.drop("squared_error"), "mean_confidence", "observed_rate")


@query(
    "sliced_quality",
    f"""
    WITH {v.V_SESSIONS}, {v.V_SCORED},
    c AS (SELECT slice, {_CONFUSION.format(p="prob >= 0.5", y="label")} FROM v_sliced GROUP BY slice),
    f AS (SELECT slice, AVG(CASE WHEN subtlety = 'benign' THEN CASE WHEN prob >= 0.5 THEN 1.0 ELSE 0.0 END END) AS fp_rate FROM v_sliced GROUP BY slice)
    SELECT slice, n, {_PRF}, round(auc, 6) AS auc, round(fp_rate, 6) AS fp_rate_benign
    FROM c JOIN {sql_auc('v_sliced', 'prob', 'label', 'slice')} a USING (slice) JOIN f USING (slice) WHERE auc IS NOT NULL
    """,
)
def sliced_quality(spark, sf_dir):
    table = metrics_table(v.scored_sessions(spark, sf_dir))
    return rounded(table, "precision", "recall", "f1", "auc", "fp_rate_benign")


def signal_rows(spark, sf_dir):
    rows = with_signals(v.sessions(spark, sf_dir))
    return rows.select(
        F.when(F.col("subtlety") == "n/a", "benign").otherwise(F.col("subtlety")).alias("subtlety"),
        F.col("injection_present").cast("int").alias("label"),
        *SIGNALS,
    )


SIGNALS = ("utterance_artifact_divergence", "constraint_drift", "ingestion_source_trust_score")

_V_LONG = f"""
{v.V_SESSIONS}, {v.V_SIGNALS}, {v.sql_divergence("v_div", "v_sessions", "agent_id", "raw_utterance", "signed_artifact_text")},
v_wide AS (
  SELECT CASE WHEN subtlety = 'n/a' THEN 'benign' ELSE subtlety END AS subtlety, CAST(injection_present AS INTEGER) AS label,
         round(lexical_divergence, 12) AS d, constraint_drift AS c, trust AS t FROM v_signals JOIN v_div USING (agent_id)
),
v_long AS (
  SELECT subtlety, label, 'utterance_artifact_divergence' AS signal, d AS score FROM v_wide
  UNION ALL SELECT subtlety, label, 'constraint_drift', c FROM v_wide
  UNION ALL SELECT subtlety, label, 'ingestion_source_trust_score', t FROM v_wide
),
v_long_sliced AS (
  SELECT *, UNNEST(CASE WHEN subtlety = 'benign' THEN ['overall', 'obvious', 'subtle'] ELSE ['overall', subtlety] END) AS slice FROM v_long
)"""


@query(
    "signal_spread",
    f"""
    WITH {_V_LONG}
    SELECT signal, slice, label, CAST(COUNT(score) AS BIGINT) AS n, round(AVG(score), 6) AS mean, round(stddev_pop(score), 6) AS std
    FROM v_long_sliced GROUP BY ALL
    """,
)
def signal_spread(spark, sf_dir):
    long = metrics.melt_signals(signal_rows(spark, sf_dir), ["subtlety", "label"], SIGNALS)
    return rounded(metrics.signal_spread(metrics.explode_slices(long)), "mean", "std")


@query(
    "signal_separation",
    f"""
    WITH {_V_LONG}, a AS {sql_auc('v_long_sliced', 'score', 'label', 'signal, slice')},
    w AS (SELECT signal, MAX(CASE WHEN slice = 'overall' THEN auc END) AS overall, MAX(CASE WHEN slice = 'obvious' THEN auc END) AS obvious,
                 MAX(CASE WHEN slice = 'subtle' THEN auc END) AS subtle FROM a GROUP BY signal)
    SELECT signal, round(overall, 6) AS overall, round(obvious, 6) AS obvious, round(subtle, 6) AS subtle,
           subtle < obvious - 0.1 AS subtle_is_harder,
           CASE WHEN signal = 'utterance_artifact_divergence' THEN 'lexical only' WHEN overall >= 0.85 THEN 'strong' WHEN overall >= 0.65 THEN 'partial' ELSE 'pivot' END AS reading
    FROM w
    """,
)
def signal_separation(spark, sf_dir):
    # Rounded so that equal texts tie in both engines.
    rows = signal_rows(spark, sf_dir).withColumn(SIGNALS[0], F.round(SIGNALS[0], 12))
    table = metrics.signal_auc_table(rows, SIGNALS, "label")
    # Sessions carry no embeddings, so the divergence has no semantic AUC.
    semantic = F.when(F.col("signal") != SIGNALS[0], F.col("overall"))
    read = table.withColumn("reading", gate_reading(semantic, F.col("overall")))
    return rounded(read, "overall", "obvious", "subtle")


@query(
    "round_report",
    f"""
    WITH {v.V_SESSIONS}, {v.V_SCORED},
    new AS (SELECT agent_id FROM v_sessions WHERE agent_registry_status = 'revoked'),
    c AS (SELECT {_CONFUSION.format(p="prob >= 0.5", y="label")},
                 AVG(CASE WHEN subtlety = 'benign' THEN CASE WHEN prob >= 0.5 THEN 1.0 ELSE 0.0 END END) AS fp_rate FROM v_scored),
    r AS (SELECT AVG(CASE WHEN prob >= 0.5 THEN 1.0 ELSE 0.0 END) AS new_recall
          FROM v_scored WHERE label = 1 AND agent_id IN (SELECT agent_id FROM new))
    SELECT n, {_PRF}, round(fp_rate, 6) AS fp_rate, round(new_recall, 6) AS new_session_recall FROM c, r
    """,
)
def round_report(spark, sf_dir):
    new = v.sessions(spark, sf_dir).filter("agent_registry_status = 'revoked'").select("agent_id")
    report = metrics.round_report(v.scored_sessions(spark, sf_dir), "prob", "label", new)
    return rounded(report, "precision", "recall", "f1", "fp_rate", "new_session_recall")


@query(
    "latency_summary",
    """
    WITH o AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, COUNT(*) OVER () AS n FROM events)
    SELECT CAST(MAX(n) AS BIGINT) AS n, round(AVG(value), 3) AS mean, round(MAX(CASE WHEN i = n // 2 THEN value END), 3) AS p50,
           round(MAX(CASE WHEN i = least(CAST(floor(n * 0.95::DOUBLE) AS BIGINT), n - 1) THEN value END), 3) AS p95,
           round(MAX(value), 3) AS max
    FROM o
    """,
)
def latency_summary(spark, sf_dir):
    return metrics.latency_summary(v.table(spark, sf_dir, "events"), "value")


@query(
    "verdict_consistency",
    f"""
    WITH {v.V_SESSIONS}, {v.V_SIGNALS}, {v.V_SCORES},
    v_content AS (SELECT agent_id, {_sql_phrase_score('body')} AS content
                  FROM (SELECT agent_id, COALESCE(NULLIF(injection_payload_text, ''), raw_utterance) AS body FROM v_sessions)),
    j AS (
      SELECT r.agent_id, len(reasons) > 0 AS flagged, m.prob AS model, k.prob AS merchant, content,
             CASE WHEN priority_code < '3' THEN 'HIGH' WHEN priority_code < '5' THEN 'MEDIUM' ELSE 'LOW' END AS level
      FROM v_rules r JOIN v_content USING (agent_id) LEFT JOIN v_model m USING (agent_id) LEFT JOIN v_merchant k ON k.domain = origin_domain
    ),
    h AS (SELECT *, CAST(flagged AS INTEGER) + CAST(COALESCE(model, 0) >= 0.5 AS INTEGER) + CAST(content >= 0.15 AS INTEGER)
                    + CAST(COALESCE(merchant, 0) >= 0.5 AS INTEGER) AS high FROM j),
    ok AS (SELECT level, CASE WHEN high = 0 THEN level = 'LOW' WHEN high >= 2 THEN level IN ('MEDIUM', 'HIGH') ELSE TRUE END AS ok FROM h)
    SELECT level, CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS passed,
           round(AVG(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 6) AS pass_rate FROM ok GROUP BY level
    """,
)
def verdict_consistency(spark, sf_dir):

    source = v.session_source(spark, sf_dir)
    level = F.when(F.col("priority_code") < "3", "HIGH").when(F.col("priority_code") < "5", "MEDIUM").otherwise("LOW")
    scored = attach_scores(source, v.model_scores(source), v.merchant_scores(spark, sf_dir))
    rows = scored.select(
        level.alias("level"), session_flagged().alias("flagged"), "model_prob",
        content_score().alias("content"), "merchant_prob",
    )
    ok = verdict_consistent(F.col("level"), F.col("flagged"), F.col("model_prob"), F.col("content"), F.col("merchant_prob"))
    return rows.withColumn("ok", ok).groupBy("level").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("ok").alias("passed"),
        F.round(F.avg(F.col("ok").cast("double")), 6).alias("pass_rate"),
    )


_DRIFTING = ("amount_cap", "tool_calls_made", "discount", "total_price", "amount")


@query(
    "feature_drift",
    f"""
    WITH {v.V_SESSIONS},
    v_cells AS (
      SELECT injection_present, UNNEST([{', '.join(f"'{c}'" for c in _DRIFTING)}]) AS feature,
             UNNEST([amount_cap, tool_calls_made, discount, total_price, {v.sql_amount("signed_artifact_text")}]::DOUBLE[]) AS value FROM v_sessions),
    v_counts AS (
      SELECT feature, value, COUNT(*) FILTER (WHERE NOT injection_present) AS a, COUNT(*) FILTER (WHERE injection_present) AS b
      FROM v_cells WHERE value IS NOT NULL GROUP BY ALL),
    v_running AS (
      SELECT *, lead(value) OVER w AS next, SUM(a) OVER w AS a_run, SUM(b) OVER w AS b_run,
             SUM(a) OVER (PARTITION BY feature) AS n_left, SUM(b) OVER (PARTITION BY feature) AS n_right
      FROM v_counts WINDOW w AS (PARTITION BY feature ORDER BY value))
    SELECT feature, CAST(MAX(n_left) AS BIGINT) AS n_left, CAST(MAX(n_right) AS BIGINT) AS n_right,
           round(MAX(abs(a_run / n_left - b_run / n_right)), 9) AS ks,
           round(SUM(COALESCE(abs(a_run / n_left - b_run / n_right) * (next - value), 0)), 6) AS wasserstein
    FROM v_running GROUP BY feature
    """,
)
def session_feature_drift(spark, sf_dir):
    """Clean against hijacked sessions, number by number."""
    rows = v.session_source(spark, sf_dir).select(
        "injection_present", F.col("mandate_scope.amount_cap").alias("amount_cap"), "tool_calls_made", "discount", "total_price",
        largest_inr_amount(F.col("signed_artifact_text")).alias("amount"),
    )
    drift = feature_drift(rows.filter("not injection_present"), rows.filter("injection_present"), _DRIFTING)
    return drift.withColumns({"ks": F.round("ks", 9), "wasserstein": F.round("wasserstein", 6)})
