"""Score fusion, risk levels, verdict checks and the risk payload."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mandatewatch.schemas import RISK_PAYLOAD

# Thresholds, bands and the payload version.
HIGH_THRESHOLD = 0.5
MEDIUM_THRESHOLD = 0.15
STRONG_AUC = 0.85
PARTIAL_AUC = 0.65
HARD_CASE_THRESHOLD = 0.65
SCHEMA_VERSION = "1.0"


def fused_score(model_prob: Column, merchant_prob: Column) -> Column:
    """Higher of the two supervised scores; an unknown merchant counts as 0, an unscored session has none."""
    return F.when(model_prob.isNotNull(), F.greatest(model_prob, F.coalesce(merchant_prob, F.lit(0.0))))


def risk_level(rules_flagged: Column, score: Column, content_score: Column) -> Column:
    """Level from the unrounded score."""
    return (
        F.when(rules_flagged | (score >= HIGH_THRESHOLD), "HIGH")
        .when((score >= MEDIUM_THRESHOLD) | (content_score >= MEDIUM_THRESHOLD), "MEDIUM")
        .otherwise("LOW")
    )


def verdict_consistent(
    level: Column, rules_flagged: Column, model_prob: Column, content_score: Column, merchant_prob: Column
) -> Column:
    """No high signal asks for LOW, two or more for MEDIUM or HIGH, one allows any."""
    high = (
        rules_flagged.cast("int")
        + F.coalesce(model_prob >= HIGH_THRESHOLD, F.lit(False)).cast("int")
        + (content_score >= MEDIUM_THRESHOLD).cast("int")
        + (F.coalesce(merchant_prob, F.lit(0.0)) >= HIGH_THRESHOLD).cast("int")
    )
    return F.when(high == 0, level == "LOW").when(high >= 2, level.isin("MEDIUM", "HIGH")).otherwise(F.lit(True))


def gate_reading(semantic_auc: Column, auc: Column) -> Column:
    return (
        F.when(semantic_auc.isNull(), "lexical only")
        .when(auc >= STRONG_AUC, "strong")
        .when(auc >= PARTIAL_AUC, "partial")
        .otherwise("pivot")
    )


def predicted(prob: Column, threshold: float = HIGH_THRESHOLD) -> Column:
    return (prob >= F.lit(threshold)).cast("int")


def payload(
    agent_id: Column,
    artifact_hash: Column,
    reasons: Column,
    model_prob: Column,
    content_score: Column,
    merchant_prob: Column,
) -> Column:
    """The nested risk record of one session."""
    flagged = F.size(reasons) > 0
    score = fused_score(model_prob, merchant_prob)
    return F.struct(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        agent_id.alias("agent_id"),
        artifact_hash.alias("intent_artifact_hash"),
        F.bround(score, 4).alias("session_risk_score"),
        risk_level(flagged, score, content_score).alias("risk_level"),
        F.struct(
            flagged.alias("rules_flagged"),
            reasons.alias("rules_reasons"),
            F.bround(model_prob, 4).alias("lightgbm_prob"),
            F.bround(content_score, 4).alias("content_score"),
            F.bround(merchant_prob, 4).alias("gnn_prob"),
        ).alias("contributing_signals"),
    )


def payload_json(record: Column) -> Column:
    """JSON text that keeps null fields, so an unknown merchant shows as null."""
    return F.to_json(record, {"ignoreNullFields": "false"})


def payload_violations(json_text: Column) -> Column:
    """Names of the contract terms a payload text breaks; empty when it conforms.

    A value of the wrong type parses to null and counts as broken. The merchant
    probability may be null, but its key has to be there.
    """
    record = F.from_json(json_text, RISK_PAYLOAD)
    signals = record["contributing_signals"]
    keys = F.json_object_keys(F.get_json_object(json_text, "$.contributing_signals"))
    checks = {
        "schema_version": record["schema_version"].isNull(),
        "agent_id": record["agent_id"].isNull(),
        "intent_artifact_hash": record["intent_artifact_hash"].isNull(),
        "session_risk_score": ~F.coalesce(record["session_risk_score"].between(0.0, 1.0), F.lit(False)),
        "risk_level": ~F.coalesce(record["risk_level"].isin("LOW", "MEDIUM", "HIGH"), F.lit(False)),
        "rules_flagged": signals["rules_flagged"].isNull(),
        "rules_reasons": signals["rules_reasons"].isNull(),
        "lightgbm_prob": signals["lightgbm_prob"].isNull(),
        "content_score": signals["content_score"].isNull(),
        "gnn_prob": ~F.coalesce(F.array_contains(keys, "gnn_prob"), F.lit(False)),
    }
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in checks.items()]))
