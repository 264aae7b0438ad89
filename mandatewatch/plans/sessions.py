"""Session rows: signals, flattened training rows and the transaction pairing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mandatewatch.functions.policy import PARSED, session_drift, session_source_trust, with_parsed
from mandatewatch.functions.text import blended_divergence, url_domain, with_lexical_divergence
from mandatewatch.operators.ranking import latest_by_key, zip_join


def relabel_benign(subtlety):
    return F.when(subtlety == "n/a", "benign").otherwise(subtlety)


def with_signals(sessions: DataFrame, semantic: str | None = None) -> DataFrame:
    """Fills the three session signals; ``semantic`` names a column with a semantic divergence."""
    meaning = F.col(semantic) if semantic else F.lit(None).cast("double")
    present = set(PARSED) <= set(sessions.columns)
    parsed = sessions if present else with_parsed(sessions)
    parsed = with_lexical_divergence(parsed, "raw_utterance", "signed_artifact_text", "_lexical")
    signals = parsed.withColumns(
        {
            "utterance_artifact_divergence": blended_divergence(F.col("_lexical"), meaning),
            "constraint_drift": session_drift(),
            "ingestion_source_trust_score": session_source_trust(),
        }
    )
    return signals.drop("_lexical", *([] if present else PARSED))


def flatten(sessions: DataFrame, *extra: str) -> DataFrame:
    """The 13 training columns of a session (texts, expiry and hash are left out) and ``extra`` ones."""
    return sessions.select(
        "agent_id",
        "agent_registry_status",
        F.col("mandate_scope.categories").alias("mandate_categories"),
        F.col("mandate_scope.amount_cap").alias("mandate_amount_cap"),
        F.col("mandate_scope.merchant_allowlist").alias("mandate_merchant_allowlist"),
        "task_origin_url",
        "content_sources_ingested",
        "utterance_artifact_divergence",
        "constraint_drift",
        "ingestion_source_trust_score",
        "hops_since_intent",
        "tool_calls_made",
        "injection_present",
        *extra,
    )


def current_sessions(rounds: DataFrame) -> DataFrame:
    """Base and later sessions by id, the later write winning."""
    latest = latest_by_key(rounds, "agent_id", ["priority"])
    return latest.withColumn("subtlety", relabel_benign(F.col("subtlety"))).drop("priority")


def legitimate(transactions: DataFrame) -> DataFrame:
    return transactions.filter(F.col("isFraud") == 0)


def with_identity(transactions: DataFrame, identity: DataFrame) -> DataFrame:
    """All transactions; identity columns are null where no identity row exists."""
    return transactions.join(identity, "TransactionID", "left")


def pair_with_transactions(sessions: DataFrame, transactions: DataFrame, seed: int) -> DataFrame:
    """Session k with legitimate transaction k; the transaction's own label is renamed."""
    renamed = legitimate(transactions).withColumnRenamed("isFraud", "ieee_cis_isFraud")
    return zip_join(sessions, "agent_id", renamed, "TransactionID", seed).drop("pair_rank")


def legitimate_domains(policy: DataFrame) -> DataFrame:
    return policy.select(F.explode("merchant_allowlist").alias("domain")).distinct()


def malicious_domains(sessions: DataFrame, legit: DataFrame) -> DataFrame:
    """Domains seen in hijacked sessions, without the known legitimate ones."""
    seen = sessions.filter("injection_present").select(
        F.explode(F.concat(F.array("task_origin_url"), "content_sources_ingested")).alias("url")
    )
    domains = seen.select(url_domain(F.col("url")).alias("domain")).filter("domain <> ''").distinct()
    return domains.join(legit, "domain", "left_anti")


def filter_sessions(
    index: DataFrame, subtlety: str | None = None, category: str | None = None, rules: str | None = None
) -> DataFrame:
    """Session list filters; an absent filter keeps everything. ``rules`` is flagged or clean."""
    out = index
    if subtlety:
        out = out.filter(F.col("subtlety") == subtlety)
    if category:
        out = out.filter(F.col("category") == category)
    if rules:
        out = out.filter(F.col("signals.rules_flagged") == F.lit(rules == "flagged"))
    return out
