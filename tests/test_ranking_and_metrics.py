import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mandatewatch.functions.scoring import gate_reading
from mandatewatch.operators import metrics, ranking
from mandatewatch.plans.sessions import legitimate, pair_with_transactions


@pytest.fixture(scope="module")
def strata(spark):
    # Two thirds of all rows share one stratum.
    return spark.createDataFrame([(i, "hot" if i % 3 else f"s{i % 7}") for i in range(900)], "id bigint, stratum string")


def test_hash_rank_is_the_global_rank(spark, strata):
    got = {r["id"]: r["rank"] for r in ranking.hash_rank(strata, "id", 42).collect()}
    order = sorted(range(900), key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))
    assert got == {key: rank for rank, key in enumerate(order, start=1)}


def test_folds_partition_rows_and_balance_strata(strata):
    rows = ranking.stratified_folds(strata, "id", "stratum").collect()
    assert sorted(r["id"] for r in rows) == list(range(900))
    sizes = Counter((r["stratum"], r["fold"]) for r in rows)
    for stratum in {r["stratum"] for r in rows}:
        per_fold = [sizes[(stratum, fold)] for fold in range(5)]
        assert max(per_fold) - min(per_fold) <= 1


def test_split_share_and_samples(strata):
    rows = ranking.stratified_split(strata, "id", "stratum").collect()
    totals, tests = Counter(r["stratum"] for r in rows), Counter(r["stratum"] for r in rows if r["is_test"])
    assert all(abs(tests[s] - 0.3 * n) <= 0.5 for s, n in totals.items())
    first = ranking.hash_sample(strata, "id", 10, 7).select("id").collect()
    again = ranking.hash_sample(strata.repartition(3), "id", 10, 7).select("id").collect()
    assert len(first) == 10 and set(first) == set(again)
    per_stratum = Counter(r["stratum"] for r in ranking.stratified_sample(strata, "id", "stratum", 4, 0).collect())
    assert set(per_stratum.values()) == {4}


def test_reference_eval_split_has_no_overlap(strata):
    reference, rest = ranking.reference_eval_split(strata, "stratum", "id", 2)
    kept, other = {r["id"] for r in reference.collect()}, {r["id"] for r in rest.collect()}
    assert not kept & other and len(kept | other) == 900 and len(kept) == 2 * strata.select("stratum").distinct().count()


def test_prefix_sums_match_running_totals(spark):
    rng = random.Random(1)
    rows = [(g, float(v), rng.randrange(10)) for g in ("hot", "cold") for v in rng.sample(range(10_000), 400 if g == "hot" else 20)]
    frame = spark.createDataFrame(rows, "g string, v double, n bigint")
    got = {(r["g"], r["v"]): r["n_before"] for r in ranking.prefix_sums(frame, ["g"], "v", ["n"]).collect()}
    assert got == {(g, v): sum(n2 for g2, v2, n2 in rows if g2 == g and v2 < v) for g, v, _ in rows}


def test_running_scan_with_one_group_of_nearly_all_rows(spark, monkeypatch):
    """99 % in one group: its rows spread over many ranges, none of more than a few times the size asked for."""
    monkeypatch.setattr(ranking, "RANGE_ROWS", 50)
    rng = random.Random(4)
    rows = [("hot", float(v), rng.randrange(10), float(rng.randrange(1000))) for v in rng.sample(range(100_000), 1980)]
    rows += [("cold", float(v), 1, float(v % 7)) for v in range(20)]
    frame = spark.createDataFrame(rows, "g string, v double, n bigint, m double").repartition(5)
    sizes = []
    cut = ranking.cut_lineage

    def noted(df):
        out = cut(df)
        if "_range" in df.columns:
            sizes.extend(r["count"] for r in out.groupBy("_range").count().collect())
        return out

    monkeypatch.setattr(ranking, "cut_lineage", noted)
    got = {(r["g"], r["v"]): (r["n_before"], r["m_before"], r["v_before"]) for r in ranking.prefix_sums(frame, ["g"], "v", ["n"], ["m", "v"]).collect()}
    assert len(sizes) > 25 and max(sizes) <= 200
    want, run = {}, {}
    for g, v, n, m in sorted(rows):
        before = run.get(g, (0, None, None))
        want[g, v] = before
        run[g] = (before[0] + n, m if before[1] is None else max(before[1], m), v)
    assert got == want


def test_feature_drift_equals_brute_force(spark):
    from mandatewatch.operators.drift import feature_drift

    rng = random.Random(6)
    left = [(rng.gauss(0, 1), float(rng.randrange(4)), None) for _ in range(300)] + [(None, float("nan"), None)]
    right = [(rng.gauss(0.4, 2), float(rng.randrange(5)), 1.0) for _ in range(170)]
    schema = "a double, b double, c double"
    got = {r["feature"]: r for r in feature_drift(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["a", "b", "c"]).collect()}
    for k, name in enumerate("ab"):
        one = sorted(r[k] for r in left if r[k] is not None and r[k] == r[k])
        two = sorted(r[k] for r in right)
        points = sorted(set(one + two))
        apart = [abs(sum(x <= p for x in one) / len(one) - sum(x <= p for x in two) / len(two)) for p in points]
        assert got[name]["n_left"] == len(one) and got[name]["ks"] == pytest.approx(max(apart))
        assert got[name]["wasserstein"] == pytest.approx(sum(d * (q - p) for d, p, q in zip(apart, points, points[1:])))
    assert (got["c"]["n_left"], got["c"]["n_right"], got["c"]["ks"], got["c"]["wasserstein"]) == (0, 170, None, None)


def test_latest_write_wins(spark):
    rows = [(1, "old", 0), (1, "new", 1), (2, "only", 0)] + [(3, "copy", 0)] * 50
    frame = spark.createDataFrame(rows, "id bigint, v string, p int")
    assert sorted((r["id"], r["v"]) for r in ranking.latest_by_key(frame, "id", ["p"]).collect()) == [(1, "new"), (2, "only"), (3, "copy")]


def test_pairing_uses_legitimate_rows_once_and_keeps_every_session(spark):
    transactions = spark.createDataFrame([(i, f, 1.0, "W") for i, f in enumerate([0, 1, 0, 1, 0, 0])], "TransactionID bigint, isFraud int, TransactionAmt double, ProductCD string")
    sample = ranking.hash_sample(legitimate(transactions), "TransactionID", 3, 42).collect()
    assert len(sample) == 3 and all(r["isFraud"] == 0 for r in sample)
    sessions = spark.createDataFrame([(f"a{i}",) for i in range(6)], "agent_id string")
    rows = pair_with_transactions(sessions, transactions, 42).collect()
    used = [r["TransactionID"] for r in rows if r["TransactionID"] is not None]
    assert len(rows) == 6 and sorted(used) == [0, 2, 4, 5]
    assert {r["ieee_cis_isFraud"] for r in rows} == {0, None}


def brute_auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_with_ties_equals_brute_force_and_ignores_monotone_maps(spark):
    rng = random.Random(2)
    pairs = [(round(rng.random(), 2), rng.randrange(2)) for _ in range(500)] + [(0.5, i % 2) for i in range(250)]
    frame = spark.createDataFrame(pairs, "s double, y int").withColumn("cube", F.pow("s", F.lit(3)) * 7 - 1)
    assert metrics.roc_auc(frame, "s", "y").first()["auc"] == pytest.approx(brute_auc(pairs))
    assert metrics.roc_auc(frame, "cube", "y").first()["auc"] == pytest.approx(brute_auc(pairs))


def test_single_class_slices(spark):
    frame = spark.createDataFrame([("benign", 0, 0.2), ("benign", 0, 0.7), ("obvious", 1, 0.9)], "subtlety string, label int, prob double")
    report = {r["slice"]: r for r in metrics.sliced_report(frame, "prob", "label").collect()}
    assert set(report) == {"overall", "obvious"} and report["overall"]["auc"] == 1.0
    assert metrics.roc_auc(frame.filter("label = 0"), "prob", "label").first()["auc"] is None
    assert metrics.false_positive_rate(frame, "prob").first()["fp_rate"] == 0.5
    assert metrics.false_positive_rate(frame.filter("label = 1"), "prob").first()["fp_rate"] is None


def test_confusion_divides_by_zero_as_zero(spark):
    frame = spark.createDataFrame([(0.1, 1), (0.2, 0)], "prob double, y int")
    got = metrics.confusion(frame, "prob", "y").first()
    assert (got["tp"], got["fp"], got["fn"], got["tn"], got["precision"], got["recall"], got["f1"]) == (0, 0, 1, 1, 0.0, 0.0, 0.0)


def test_calibration_numbers(spark):
    half = spark.createDataFrame([(0.5, i % 2) for i in range(10)], "c double, o int")
    got = metrics.calibration(half, "c", "o").first()
    assert got["brier"] == 0.25 and got["ece"] == pytest.approx(0.0)
    top = spark.createDataFrame([(1.0, 1), (0.95, 1)], "c double, o int")
    assert [r["bin"] for r in metrics.calibration_bins(top, "c", "o").collect()] == [9]
    empty = metrics.calibration(half.limit(0), "c", "o").first()
    assert (empty["brier"], empty["ece"]) == (0.0, 0.0)


def test_latency_picks_sorted_elements(spark):
    rng = random.Random(4)
    values = [round(rng.random() * 100, 1) for _ in range(173)] + [5.0] * 90
    got = metrics.latency_summary(spark.createDataFrame([(x,) for x in values], "v double"), "v").first()
    ordered, n = sorted(values), len(values)
    assert got["p50"] == round(ordered[n // 2], 3)
    assert got["p95"] == round(ordered[min(int(n * 0.95), n - 1)], 3)
    assert got["max"] == ordered[-1] and got["mean"] == pytest.approx(sum(values) / n, abs=1e-3) and got["n"] == n


def test_round_trend_and_report(spark):
    rounds = spark.createDataFrame([(1, 0.957), (2, 0.987), (3, 0.985), (4, 0.9)], "round int, recall double")
    assert [r["trend"] for r in metrics.round_trend(rounds).orderBy("round").collect()] == [None, "improved", "flat", "regressed"]
    scored = spark.createDataFrame(
        [("a", "benign", 0, 0.6), ("b", "benign", 0, 0.1), ("c", "subtle", 1, 0.9), ("d", "subtle", 1, 0.2)],
        "agent_id string, subtlety string, label int, prob double",
    )
    new = spark.createDataFrame([("d",)], "agent_id string")
    got = metrics.round_report(scored, "prob", "label", new).first()
    assert (got["n"], got["precision"], got["recall"], got["fp_rate"], got["new_session_recall"]) == (4, 0.5, 0.5, 0.5, 0.0)
    assert metrics.round_report(scored, "prob", "label", new.limit(0)).first()["new_session_recall"] is None


def test_signal_table_and_gate(spark):
    rows = [("benign", 0, 0.1, 0.5), ("benign", 0, 0.2, 0.4), ("obvious", 1, 0.9, 0.9), ("subtle", 1, 0.15, 0.45)]
    frame = spark.createDataFrame(rows, "subtlety string, label int, a double, b double")
    got = {r["signal"]: r for r in metrics.signal_auc_table(frame, ["a", "b"], "label").collect()}
    assert got["a"]["obvious"] == 1.0 and got["a"]["subtle"] == 0.5 and got["a"]["subtle_is_harder"]
    aucs = spark.createDataFrame([(0.9, 0.85), (0.9, 0.65), (0.9, 0.64), (None, 0.99)], "s double, a double")
    assert [r[0] for r in aucs.select(gate_reading(F.col("s"), F.col("a"))).collect()] == ["strong", "partial", "pivot", "lexical only"]


def test_rows_without_a_score_count_nowhere(spark):
    frame = spark.createDataFrame([(0.0, 1), (None, 0), (None, 1), (None, 0)], "c double, o int")
    assert metrics.calibration(frame, "c", "o").first()["brier"] == 1.0
    got = metrics.confusion(frame, "c", "o").first()
    assert got["n"] == 1 == got["tp"] + got["fp"] + got["fn"] + got["tn"]


def test_latest_write_keeps_no_column_that_nobody_reads(spark):
    """whole rows went through the shuffle before; among equal writers all columns come from one row."""
    frame = spark.createDataFrame([(k % 3, f"v{k}", f"w{k}", k // 30) for k in range(60)], "id int, v string, w string, p int").repartition(4)
    latest = ranking.latest_by_key(frame, "id", ["p"])
    assert all(r["v"][1:] == r["w"][1:] and int(r["v"][1:]) >= 30 for r in latest.collect())
    plan = latest.select("id", "v")._jdf.queryExecution().optimizedPlan().toString()
    assert "max_by(v" in plan and "max_by(w" not in plan and "named_struct(v" not in plan
