"""Queries on joins, samples, folds and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from mandatewatch.catalog import views as v
from mandatewatch.catalog.registry import query
from mandatewatch.functions.text import url_domain
from mandatewatch.operators import ranking
from mandatewatch.operators.metrics import round_trend
from mandatewatch.plans.feedback import append_round, resolve_base
from mandatewatch.plans.sessions import legitimate, malicious_domains, pair_with_transactions, with_identity
from mandatewatch.plans.training import hard_cases
from mandatewatch.runtime import scratch_path
from mandatewatch.sources import readers, writers


@query("transactions_with_identity", "SELECT doc_id, lang, source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def transactions_with_identity(spark, sf_dir):
    docs = v.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("TransactionID"), "lang", "source")
    labels = v.table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "TransactionID")
    return with_identity(docs, labels).withColumnRenamed("TransactionID", "doc_id")


@query(
    "paired_sessions",
    f"""
    WITH {v.V_PAIRS}, {v.V_TRANSACTIONS},
    s AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || agent_id), agent_id) AS k FROM v_pairs),
    t AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || TransactionID), TransactionID) AS k FROM v_transactions WHERE isFraud = 0)
    SELECT agent_id, TransactionID, isFraud AS ieee_cis_isFraud, TransactionAmt, ProductCD FROM s JOIN t USING (k)
    """,
)
def paired_sessions(spark, sf_dir):
    pairs = v.conversation_pairs(spark, sf_dir).select("agent_id")
    return pair_with_transactions(pairs, v.transactions(spark, sf_dir), 42).select(
        "agent_id", "TransactionID", "ieee_cis_isFraud", "TransactionAmt", "ProductCD"
    )


@query(
    "legitimate_sample",
    f"""
    WITH {v.V_TRANSACTIONS}
    SELECT TransactionID, TransactionAmt FROM v_transactions WHERE isFraud = 0
    ORDER BY md5('1002:' || TransactionID), TransactionID LIMIT 500
    """,
)
def legitimate_sample(spark, sf_dir):
    rows = legitimate(v.transactions(spark, sf_dir)).select("TransactionID", "TransactionAmt")
    return ranking.hash_sample(rows, "TransactionID", 500, 1002)


@query(
    "session_row_index",
    f"""
    WITH {v.V_SESSIONS}
    SELECT agent_id, row_number() OVER (ORDER BY md5('7:' || agent_id), agent_id) AS rank FROM v_sessions
    """,
)
def session_row_index(spark, sf_dir):
    return ranking.hash_rank(v.sessions(spark, sf_dir).select("agent_id"), "agent_id", 7)


_V_LEGIT = f"""
v_legit AS (SELECT DISTINCT {v.sql_domain("u")} AS domain FROM (SELECT UNNEST(merchant_allowlist) AS u FROM v_sessions)),
v_seen AS (
  SELECT DISTINCT {v.sql_domain("u")} AS domain
  FROM (SELECT UNNEST(list_concat([task_origin_url], content_sources_ingested)) AS u FROM v_sessions WHERE injection_present)
)"""


def legit_domains(sessions):
    allowed = sessions.select(F.explode("mandate_scope.merchant_allowlist").alias("url"))
    return allowed.select(url_domain(F.col("url")).alias("domain")).distinct()


@query(
    "malicious_domains",
    f"WITH {v.V_SESSIONS}, {_V_LEGIT} SELECT domain FROM v_seen WHERE domain <> '' AND domain NOT IN (SELECT domain FROM v_legit)",
)
def malicious(spark, sf_dir):
    sessions = v.sessions(spark, sf_dir)
    return malicious_domains(sessions, legit_domains(sessions)).orderBy("domain")


@query(
    "legit_and_malicious_overlap",
    f"""
    WITH {v.V_SESSIONS}, {_V_LEGIT}, m AS (SELECT domain FROM v_seen EXCEPT SELECT domain FROM v_legit)
    SELECT (SELECT CAST(COUNT(DISTINCT domain) AS BIGINT) FROM m) AS malicious, (SELECT CAST(COUNT(DISTINCT domain) AS BIGINT) FROM v_legit) AS legit,
           (SELECT CAST(COUNT(*) AS BIGINT) FROM (SELECT domain FROM v_seen INTERSECT SELECT domain FROM v_legit)) AS seen_legit,
           (SELECT CAST(COUNT(*) AS BIGINT) FROM (SELECT domain FROM m INTERSECT SELECT domain FROM v_legit)) AS overlap
    """,
)
def legit_and_malicious_overlap(spark, sf_dir):
    sessions = v.sessions(spark, sf_dir)
    legit = legit_domains(sessions)
    count = lambda df, name: df.distinct().agg(F.count(F.lit(1)).alias(name))
    malicious, nothing = malicious_domains(sessions, legit), legit.limit(0)
    seen = malicious_domains(sessions, nothing)
    parts = [
        count(malicious, "malicious"), count(legit, "legit"), count(seen.intersect(legit), "seen_legit"),
        count(malicious.intersect(legit), "overlap"),
    ]
    one = [part.withColumn("one", F.lit(1)) for part in parts]
    return one[0].join(one[1], "one").join(one[2], "one").join(one[3], "one").drop("one")


@query(
    "sessions_of_hijacked_orders",
    f"""
    WITH {v.V_SESSIONS}
    SELECT agent_id FROM v_sessions WHERE TransactionID IN (SELECT TransactionID FROM v_sessions WHERE subtlety = 'obvious')
    """,
)
def sessions_of_hijacked_orders(spark, sf_dir):
    rows = v.session_source(spark, sf_dir)
    hijacked = rows.filter("subtlety = 'obvious'").select("TransactionID")
    return rows.join(hijacked, "TransactionID", "left_semi").select("agent_id")


@query("hard_cases", f"WITH {v.V_SESSIONS}, {v.V_SCORED} SELECT agent_id, prob FROM v_scored WHERE label = 1 AND prob < 0.65")
def hard(spark, sf_dir):
    return hard_cases(v.scored_sessions(spark, sf_dir))


@query(
    "resolved_hard_cases",
    f"""
    WITH {v.V_SESSIONS}, {v.V_SCORED},
    base AS (SELECT agent_id, category FROM v_sessions WHERE agent_registry_status = 'valid')
    SELECT h.agent_id, h.prob, base.category, base.agent_id IS NOT NULL AS resolved
    FROM (SELECT agent_id, prob FROM v_scored WHERE label = 1 AND prob < 0.65) h LEFT JOIN base ON h.agent_id = base.agent_id
    """,
)
def resolved_hard_cases(spark, sf_dir):
    valid = v.sessions(spark, sf_dir).filter("agent_registry_status = 'valid'")
    base = valid.select("agent_id", F.get("mandate_scope.categories", 0).alias("category"))
    found, missing = resolve_base(hard_cases(v.scored_sessions(spark, sf_dir)), base)
    return found.withColumn("resolved", F.lit(True)).unionByName(
        missing.withColumn("resolved", F.lit(False)), allowMissingColumns=True
    )


@query(
    "reference_eval_split",
    """
    SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 2 THEN 'reference' ELSE 'eval' END AS part
    FROM documents
    """,
)
def reference_eval_split(spark, sf_dir):
    docs = v.table(spark, sf_dir, "documents").select("doc_id", "source")
    reference, rest = ranking.reference_eval_split(docs, "source", "doc_id", 2)
    tag = lambda df, name: df.select("doc_id", F.lit(name).alias("part"))
    return tag(reference, "reference").unionByName(tag(rest, "eval"))


@query(
    "stratified_folds",
    f"""
    WITH {v.V_SESSIONS}
    SELECT agent_id, CAST((row_number() OVER (PARTITION BY subtlety ORDER BY md5('42:' || agent_id), agent_id) - 1) % 5 AS INTEGER) AS fold
    FROM v_sessions
    """,
)
def stratified_folds(spark, sf_dir):
    rows = v.sessions(spark, sf_dir).select("agent_id", "subtlety")
    return ranking.stratified_folds(rows, "agent_id", "subtlety").select("agent_id", "fold")


@query(
    "stratified_split",
    """
    SELECT c_custkey, row_number() OVER (PARTITION BY c_acctbal < 0 ORDER BY md5('42:' || c_custkey), c_custkey)
                      <= round(COUNT(*) OVER (PARTITION BY c_acctbal < 0) * 0.3::DOUBLE) AS is_test
    FROM customer
    """,
)
def stratified_split(spark, sf_dir):
    rows = v.table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") < 0).alias("label"))
    return ranking.stratified_split(rows, "c_custkey", "label").select("c_custkey", "is_test")


@query(
    "verdict_sample",
    f"""
    WITH {v.V_SESSIONS}
    SELECT subtlety, agent_id FROM v_sessions
    QUALIFY row_number() OVER (PARTITION BY subtlety ORDER BY md5('0:' || agent_id), agent_id) <= 4
    """,
)
def verdict_sample(spark, sf_dir):
    rows = v.sessions(spark, sf_dir).select("subtlety", "agent_id")
    return ranking.stratified_sample(rows, "agent_id", "subtlety", 4, 0)


@query(
    "appended_rounds",
    f"""
    WITH {v.V_PAIRS}
    SELECT 'doc-' || doc_id AS agent_id, lang, source, quality, 'base' AS origin FROM documents LEFT JOIN labels USING (doc_id)
    UNION ALL SELECT agent_id, NULL, NULL, NULL, 'round 2' FROM v_pairs
    """,
)
def appended_rounds(spark, sf_dir):
    docs = v.table(spark, sf_dir, "documents").join(v.table(spark, sf_dir, "labels"), "doc_id", "left")
    base = docs.select(v.text(F.lit("doc-"), "doc_id").alias("agent_id"), "lang", "source", "quality", F.lit("base").alias("origin"))
    new = v.conversation_pairs(spark, sf_dir).select("agent_id", F.lit("round 2").alias("origin"))
    return append_round(base, new)


@query("missing_sessions", f"WITH {v.V_SESSIONS} SELECT agent_id, subtlety FROM v_sessions WHERE injection_present")
def missing_sessions(spark, sf_dir):
    rows = v.sessions(spark, sf_dir).select("agent_id", "subtlety", "injection_present")
    stored = rows.filter("not injection_present")
    return writers.missing_rows(rows.unionByName(rows), stored, "agent_id").select("agent_id", "subtlety")


@query(
    "appended_sessions",
    f"WITH {v.V_SESSIONS} SELECT agent_id, subtlety FROM v_sessions",
)
def appended_sessions(spark, sf_dir):
    """Benign sessions are stored first; the whole table is then appended twice."""
    path = scratch_path(spark, "sessions")
    rows = v.sessions(spark, sf_dir).select("agent_id", "subtlety", "injection_present")
    rows.filter("not injection_present").write.parquet(path)
    for _ in range(2):
        writers.append_new(rows, "agent_id", path)
    return spark.read.parquet(path).select("agent_id", "subtlety")


@query(
    "sessions_by_category",
    f"""
    WITH {v.V_SESSIONS}
    SELECT category, subtlety, CAST(COUNT(*) AS BIGINT) AS n, MIN(agent_id) AS first_id, MAX(agent_id) AS last_id
    FROM v_sessions GROUP BY ALL
    """,
)
def sessions_by_category(spark, sf_dir):
    rows = v.sessions(spark, sf_dir).select(F.get("mandate_scope.categories", 0).alias("category"), "subtlety", "agent_id")
    return rows.groupBy("category", "subtlety").agg(
        F.count(F.lit(1)).alias("n"), F.min("agent_id").alias("first_id"), F.max("agent_id").alias("last_id")
    )


@query(
    "distinct_values",
    f"""
    WITH {v.V_SESSIONS}
    SELECT 'category' AS field, category AS value FROM v_sessions UNION SELECT 'subtlety', subtlety FROM v_sessions
    UNION SELECT 'domain', {v.sql_domain("task_origin_url")} FROM v_sessions
    """,
)
def distinct_values(spark, sf_dir):
    rows = v.sessions(spark, sf_dir).select(
        F.get("mandate_scope.categories", 0).alias("category"), "subtlety", url_domain(F.col("task_origin_url")).alias("domain")
    )
    return rows.unpivot([], ["category", "subtlety", "domain"], "field", "value").distinct()


@query(
    "table_sizes",
    "SELECT 'embeddings' AS name, CAST(COUNT(*) AS BIGINT) AS n FROM embeddings UNION ALL SELECT 'documents', COUNT(*) FROM documents",
)
def table_sizes(spark, sf_dir):
    sizes = [
        v.table(spark, sf_dir, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        for name in ("embeddings", "documents")
    ]
    return sizes[0].unionByName(sizes[1])


def line_rounds(spark, sf_dir):
    """One metrics row per line number, as if each were a round."""
    rows = v.session_source(spark, sf_dir)
    return rows.groupBy(F.col("line_number").alias("round")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("injection_present").cast("double")), 6).alias("recall")
    )


@query(
    "round_trend",
    f"""
    WITH {v.V_SESSIONS},
    r AS (SELECT line_number AS round, CAST(COUNT(*) AS BIGINT) AS n,
                 round(AVG(CASE WHEN injection_present THEN 1.0 ELSE 0.0 END), 6) AS recall FROM v_sessions GROUP BY 1),
    d AS (SELECT *, recall - LAG(recall) OVER (ORDER BY round) AS delta FROM r)
    SELECT round, n, recall, round(delta, 6) AS recall_delta,
           CASE WHEN delta > 0.01 THEN 'improved' WHEN delta < -0.01 THEN 'regressed' WHEN delta IS NOT NULL THEN 'flat' END AS trend
    FROM d
    """,
)
def trend(spark, sf_dir):
    path = scratch_path(spark, "rounds")
    writers.write_rounds(line_rounds(spark, sf_dir), path)
    rounds = readers.read_mutation_rounds(spark, path).select("round", "n", "recall")
    return round_trend(rounds).withColumn("recall_delta", F.round("recall_delta", 6))


@query(
    "numbered_rounds",
    """
    WITH r AS (SELECT 1 AS round, COUNT(*) AS n, AVG(value) AS recall FROM events WHERE event_type = 'view'
               UNION ALL SELECT 2, COUNT(*), AVG(value) FROM events WHERE event_type = 'refund'
               UNION ALL SELECT 3, COUNT(*), AVG(value) FROM events WHERE event_type = 'click'
               UNION ALL SELECT 4, COUNT(*), AVG(value) FROM events WHERE event_type = 'signup'
               UNION ALL SELECT 5, COUNT(*), AVG(value) FROM events WHERE event_type = 'error'
               UNION ALL SELECT 6, COUNT(*), AVG(value) FROM events WHERE event_type = 'purchase')
    SELECT CAST(round AS INTEGER) AS round, CAST(n AS BIGINT) AS n, round(recall, 6) AS recall FROM r WHERE n > 0
    """,
)
def numbered_rounds(spark, sf_dir):
    events = v.table(spark, sf_dir, "events")
    kinds = ("view", "refund", "click", "signup", "error", "purchase")  # no event is a refund: that round is empty
    rounds = [
        events.filter(F.col("event_type") == kind).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("recall"))
        for kind in kinds
    ]
    return writers.number_rounds(rounds)
