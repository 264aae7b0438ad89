"""Mandate checks on a session row: drift, source trust and hard rules.

``with_parsed`` reads the amount and the domains of a session once; the checks
are then cheap expressions on those columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mandatewatch.functions.text import grouped_number, largest_inr_amount, quoted_list, url_domain

PARSED = ("signed_amount", "origin_domain", "allowed_domains", "source_domains")


def domains(values: Column) -> Column:
    return F.transform(F.coalesce(values, F.array().cast("array<string>")), url_domain)


def with_parsed(sessions: DataFrame) -> DataFrame:
    """Adds the signed amount (null if none is stated) and all normalised domains."""
    return sessions.withColumns(
        {
            "signed_amount": largest_inr_amount(F.col("signed_artifact_text")),
            "origin_domain": url_domain(F.col("task_origin_url")),
            "allowed_domains": domains(F.col("mandate_scope.merchant_allowlist")),
            "source_domains": domains(F.col("content_sources_ingested")),
        }
    )


def over_cap(amount: Column, cap: Column) -> Column:
    """A stated amount above the cap. A text without an amount breaks nothing."""
    return F.coalesce(amount > cap, F.lit(False))


def off_allowlist(origin: Column, allowed: Column) -> Column:
    return ~F.coalesce(F.array_contains(allowed, origin), F.lit(False))


def constraint_drift(amount: Column, cap: Column, origin: Column, allowed: Column) -> Column:
    """Share of the two checkable constraints that are violated."""
    return (over_cap(amount, cap).cast("int") + off_allowlist(origin, allowed).cast("int")) / F.lit(2.0)


def source_trust(sources: Column, allowed: Column) -> Column:
    """Share of ingested sources off the allowlist (higher is worse); repeated sources count."""
    untrusted = F.size(F.filter(sources, lambda d: ~F.array_contains(allowed, d)))
    return F.coalesce(F.try_divide(untrusted.cast("double"), F.size(sources)), F.lit(0.0))


def rule_reasons(amount: Column, cap: Column, origin: Column, allowed: Column, registry_status: Column) -> Column:
    """Named violations in fixed order; the texts are part of the contract."""
    # The three reason texts.
    breached = F.concat(
        F.lit("amount cap breached: signed INR "), grouped_number(amount), F.lit(" > cap INR "), grouped_number(cap)
    )
    merchant = F.concat(
        F.lit("task_origin_url domain '"),
        origin,
        F.lit("' not in merchant allowlist "),
        quoted_list(F.array_sort(F.array_distinct(allowed))),
    )
    status = F.concat(F.lit("agent_registry_status is '"), registry_status, F.lit("', not 'valid'"))
    return F.array_compact(
        F.array(
            F.when(over_cap(amount, cap), breached),
            F.when(off_allowlist(origin, allowed), merchant),
            F.when(registry_status != "valid", status),
        )
    )


def rules_flagged(amount: Column, cap: Column, origin: Column, allowed: Column, registry_status: Column) -> Column:
    """Whether any rule fires, without building the texts."""
    return over_cap(amount, cap) | off_allowlist(origin, allowed) | F.coalesce(registry_status != "valid", F.lit(False))


def _session_facts() -> tuple[Column, Column, Column, Column]:
    return F.col("signed_amount"), F.col("mandate_scope.amount_cap"), F.col("origin_domain"), F.col("allowed_domains")


def session_drift() -> Column:
    return constraint_drift(*_session_facts())


def session_source_trust() -> Column:
    return source_trust(F.col("source_domains"), F.col("allowed_domains"))


def session_rule_reasons() -> Column:
    return rule_reasons(*_session_facts(), F.col("agent_registry_status"))


def session_flagged() -> Column:
    return rules_flagged(*_session_facts(), F.col("agent_registry_status"))
