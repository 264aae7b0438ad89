"""Evaluation of whole layers: the content layer on sessions, and one table of all metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mandatewatch.functions.scoring import MEDIUM_THRESHOLD
from mandatewatch.operators.metrics import calibration, confusion, roc_auc
from mandatewatch.operators.phrase_match import content_scores
from mandatewatch.operators.ranking import reference_eval_split
from mandatewatch.plans.fusion import metrics_table
from mandatewatch.runtime import cut_lineage

# Fixed value: payloads of each domain that join the reference phrases.
HELD_OUT_PER_DOMAIN = 2


def content_layer_evaluation(payloads: DataFrame, benign: DataFrame, phrases: DataFrame) -> DataFrame:
    """One row of counts, precision, recall, F1, Brier score and calibration error.

    ``payloads`` are (id, domain, text) of hijacked sessions, ``benign`` (id,
    text) utterances, ``phrases`` (phrase). The first payloads of every domain
    join the phrases; all others and all utterances are scored against them.
    """
    reference, rest = reference_eval_split(payloads, "domain", "id", HELD_OUT_PER_DOMAIN)
    known = phrases.select("phrase").unionByName(reference.select(F.col("text").alias("phrase"))).distinct()
    rows = rest.select("text", F.lit(1).alias("label")).unionByName(benign.select("text", F.lit(0).alias("label")))
    rows = cut_lineage(rows)
    # Each distinct text is scored once.
    scored = rows.join(cut_lineage(content_scores(rows.select("text").distinct(), "text", "text", known, "phrase")), "text")
    scored = cut_lineage(scored.select("label", "content_score"))
    counts = confusion(scored, "content_score", "label", threshold=MEDIUM_THRESHOLD).withColumn("one", F.lit(1))
    return counts.join(calibration(scored, "content_score", "label").withColumn("one", F.lit(1)), "one").drop("one")


def metrics_gold(sessions: DataFrame, merchants: DataFrame | None, rounds: DataFrame) -> DataFrame:
    """(section, name, n, precision, recall, f1, auc, fp_rate_benign) of both attacks and all rounds.

    ``sessions`` are scored (subtlety, label, prob), ``merchants`` scored (label,
    prob) or absent, ``rounds`` (round, n, recall). What a section does not
    measure is null; without merchants attack 2 is one row of nulls.
    """
    number = lambda *names: [F.lit(None).cast("double").alias(c) for c in names]
    first = metrics_table(sessions).select(
        F.lit("attack_1").alias("section"), F.col("slice").alias("name"), "n", "precision", "recall", "f1", "auc", "fp_rate_benign"
    )
    if merchants is None:
        one = rounds.sparkSession.range(1)
        second = one.select(
            F.lit("attack_2").alias("section"), F.lit("merchants").alias("name"), F.lit(None).cast("bigint").alias("n"),
            *number("precision", "recall", "f1", "auc", "fp_rate_benign"),
        )
    else:
        named = merchants.withColumn("name", F.lit("merchants"))
        quality = confusion(named, "prob", "label", ["name"]).join(roc_auc(named, "prob", "label", ["name"]), "name")
        false_alarms = F.try_divide(F.col("fp").cast("double"), F.col("fp") + F.col("tn"))
        second = quality.select(
            F.lit("attack_2").alias("section"), "name", "n", "precision", "recall", "f1", "auc", false_alarms.alias("fp_rate_benign")
        )
    third = rounds.select(
        F.lit("round").alias("section"), F.col("round").cast("string").alias("name"), "n", *number("precision"),
        "recall", *number("f1", "auc", "fp_rate_benign"),
    )
    return first.unionByName(second).unionByName(third)
