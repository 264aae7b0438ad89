"""Queries on session rows: scans, projections, filters and policy checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from mandatewatch import schemas
from mandatewatch.catalog import views as v
from mandatewatch.catalog.registry import query
from mandatewatch.functions.policy import domains, session_drift, session_flagged, session_rule_reasons, session_source_trust, with_parsed
from mandatewatch.functions.scoring import predicted
from mandatewatch.functions.text import artifact_hash, phrase_overlap, url_domain
from mandatewatch.operators.similar_names import domain_pairs, edit_similarity, typosquat_scores
from mandatewatch.operators.ranking import first_per_group
from mandatewatch.plans.sessions import current_sessions, filter_sessions, flatten, relabel_benign, with_signals
from mandatewatch.plans.training import engineer
from mandatewatch.runtime import scratch_path
from mandatewatch.sources import readers, writers
from mandatewatch.sources.fixed_values import POLICY, REFERENCE_PHRASES


def joined(values):
    return F.array_join(values, "|")


@query(
    "rule_hit_rates",
    f"""
    WITH {v.V_SESSIONS}, {v.V_SIGNALS}
    SELECT CASE WHEN subtlety = 'n/a' THEN 'benign' ELSE subtlety END AS subtlety,
           CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM(CASE WHEN len(reasons) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS flagged,
           round(AVG(CASE WHEN len(reasons) > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate
    FROM v_rules GROUP BY 1
    """,
)
def rule_hit_rates(spark, sf_dir):
    parsed = with_parsed(v.sessions(spark, sf_dir))
    rows = parsed.select(relabel_benign(F.col("subtlety")).alias("subtlety"), session_flagged().alias("flagged"))
    return rows.groupBy("subtlety").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("flagged").alias("flagged"),
        F.round(F.avg(F.col("flagged").cast("double")), 6).alias("hit_rate"),
    )


@query(
    "session_signals",
    f"""
    WITH {v.V_SESSIONS}, {v.V_SIGNALS}
    SELECT agent_id, amount, origin_domain, constraint_drift, trust AS ingestion_source_trust_score FROM v_signals
    """,
)
def session_signals(spark, sf_dir):
    return with_parsed(v.sessions(spark, sf_dir)).select(
        "agent_id",
        F.col("signed_amount").alias("amount"),
        "origin_domain",
        session_drift().alias("constraint_drift"),
        session_source_trust().alias("ingestion_source_trust_score"),
    )


@query(
    "rule_reasons",
    f"""
    WITH {v.V_SESSIONS}, {v.V_SIGNALS}
    SELECT agent_id, len(reasons) > 0 AS flagged, array_to_string(reasons, '|') AS reasons FROM v_rules
    """,
)
def rule_reasons(spark, sf_dir):
    rows = with_parsed(v.sessions(spark, sf_dir)).select("agent_id", session_rule_reasons().alias("reasons"))
    return rows.select("agent_id", (F.size("reasons") > 0).alias("flagged"), joined("reasons").alias("reasons"))


@query(
    "first_flagged_sessions",
    f"""
    WITH {v.V_SESSIONS}, {v.V_SIGNALS}
    SELECT agent_id, subtlety, array_to_string(reasons, '|') AS reasons FROM v_rules
    WHERE len(reasons) > 0 ORDER BY agent_id LIMIT 3
    """,
)
def first_flagged_sessions(spark, sf_dir):
    flagged = with_parsed(v.sessions(spark, sf_dir)).filter(session_flagged()).orderBy("agent_id").limit(3)
    return flagged.select("agent_id", "subtlety", joined(session_rule_reasons()).alias("reasons"))


@query(
    "session_training_rows",
    f"""
    WITH {v.V_SESSIONS}, {v.V_SIGNALS}, {v.sql_divergence("v_div", "v_sessions", "agent_id", "raw_utterance", "signed_artifact_text")}
    SELECT agent_id, agent_registry_status, category AS mandate_categories, amount_cap AS mandate_amount_cap,
           array_to_string(merchant_allowlist, '|') AS mandate_merchant_allowlist, task_origin_url,
           array_to_string(content_sources_ingested, '|') AS content_sources_ingested,
           round(lexical_divergence, 6) AS utterance_artifact_divergence, constraint_drift,
           trust AS ingestion_source_trust_score, hops_since_intent, tool_calls_made, injection_present
    FROM v_signals JOIN v_div USING (agent_id)
    """,
)
def session_training_rows(spark, sf_dir):
    rows = flatten(with_signals(v.sessions(spark, sf_dir)))
    lists = ("mandate_categories", "mandate_merchant_allowlist", "content_sources_ingested")
    return rows.withColumns({c: joined(c) for c in lists}).withColumn(
        "utterance_artifact_divergence", F.round("utterance_artifact_divergence", 6)
    )


@query(
    "session_texts",
    f"""
    WITH {v.V_SESSIONS}
    SELECT agent_id, CASE WHEN subtlety = 'n/a' THEN 'benign' ELSE subtlety END AS subtlety,
           COALESCE(NULLIF(injection_payload_text, ''), raw_utterance) AS content_text,
           sha256(signed_artifact_text)[1:16] AS intent_artifact_hash FROM v_sessions
    """,
)
def session_texts(spark, sf_dir):
    return v.sessions(spark, sf_dir).select(
        "agent_id",
        relabel_benign(F.col("subtlety")).alias("subtlety"),
        writers.content_text().alias("content_text"),
        artifact_hash(F.col("signed_artifact_text")).alias("intent_artifact_hash"),
    )


@query(
    "payload_sessions",
    f"WITH {v.V_SESSIONS} SELECT agent_id, injection_payload_text FROM v_sessions WHERE length(injection_payload_text) > 0",
)
def payload_sessions(spark, sf_dir):
    has_payload = F.coalesce(F.length("injection_payload_text"), F.lit(0)) > 0
    return v.sessions(spark, sf_dir).filter(has_payload).select("agent_id", "injection_payload_text")


@query(
    "session_list_filters",
    f"""
    WITH {v.V_SESSIONS}, {v.V_SIGNALS}
    SELECT agent_id, category, subtlety FROM v_rules WHERE subtlety = 'subtle' AND category = 'PROMO' AND len(reasons) > 0
    """,
)
def session_list_filters(spark, sf_dir):
    rows = with_parsed(v.sessions(spark, sf_dir))
    index = rows.select(
        "agent_id",
        F.get("mandate_scope.categories", 0).alias("category"),
        "subtlety",
        F.struct(session_flagged().alias("rules_flagged")).alias("signals"),
    )
    return filter_sessions(index, "subtle", "PROMO", "flagged").select("agent_id", "category", "subtlety")


@query(
    "session_filter_counts",
    f"""
    WITH {v.V_SESSIONS}, {v.V_SIGNALS}
    SELECT category, subtlety, len(reasons) > 0 AS flagged, CAST(COUNT(*) AS BIGINT) AS n FROM v_rules GROUP BY ALL
    """,
)
def session_filter_counts(spark, sf_dir):
    rows = with_parsed(v.sessions(spark, sf_dir)).select(
        F.get("mandate_scope.categories", 0).alias("category"), "subtlety", session_flagged().alias("flagged")
    )
    return rows.groupBy("category", "subtlety", "flagged").agg(F.count(F.lit(1)).alias("n"))


@query(
    "one_session",
    f"""
    WITH {v.V_SESSIONS}
    SELECT agent_id, raw_utterance, signed_artifact_text FROM v_sessions
    WHERE agent_id = (SELECT MIN(agent_id) FROM v_sessions)
    """,
)
def one_session(spark, sf_dir):
    rows = v.sessions(spark, sf_dir)
    wanted = rows.agg(F.min("agent_id")).scalar()
    return rows.filter(F.col("agent_id") == wanted).select("agent_id", "raw_utterance", "signed_artifact_text")


@query(
    "engineered_features",
    f"""
    WITH {v.V_SESSIONS}, {v.V_SIGNALS}
    SELECT agent_id, CAST(injection_present AS INTEGER) AS label, category AS mandate_category,
           CAST(len(merchant_allowlist) AS INTEGER) AS mandate_allowlist_size, origin_domain AS task_origin_domain,
           CAST(len(content_sources_ingested) AS INTEGER) AS num_content_sources,
           amount_cap AS mandate_amount_cap, agent_registry_status FROM v_signals
    """,
)
def engineered_features(spark, sf_dir):
    rows = flatten(v.sessions(spark, sf_dir)).withColumn("key", F.col("agent_id"))
    return engineer(rows).select(
        F.col("key").alias("agent_id"), "label", "mandate_category", "mandate_allowlist_size", "task_origin_domain",
        "num_content_sources", "mandate_amount_cap", "agent_registry_status",
    )


@query("page_domains", f"SELECT page_id, {v.sql_domain('url')} AS domain FROM pages")
def page_domains(spark, sf_dir):
    return v.table(spark, sf_dir, "pages").select("page_id", url_domain(F.col("url")).alias("domain"))


@query(
    "typosquat_edit_similarity",
    f"""
    WITH {v.V_SESSIONS}, {v.V_SIGNALS}
    SELECT domain, listed, round(1 - levenshtein(domain, listed) / greatest(length(domain), length(listed))::DOUBLE, 6) AS similarity
    FROM (SELECT DISTINCT origin_domain AS domain, UNNEST(allowed) AS listed FROM v_signals)
    """,
)
def typosquat_edit_similarity(spark, sf_dir):
    pairs = domain_pairs(v.sessions(spark, sf_dir), "task_origin_url", "mandate_scope.merchant_allowlist")
    return pairs.withColumn("similarity", F.round(edit_similarity(F.col("domain"), F.col("listed")), 6))


@query("typosquat_similarity")
def typosquat_similarity(spark, sf_dir):
    rows = v.sessions(spark, sf_dir).select(
        "agent_id",
        url_domain(F.col("task_origin_url")).alias("domain"),
        domains(F.col("mandate_scope.merchant_allowlist")).alias("allowlist"),
    )
    return typosquat_scores(rows, "agent_id", "domain", "allowlist")


def _sql_phrase_score(text: str) -> str:
    words = f"list_distinct(regexp_extract_all(lower({text}), '[a-z0-9'']+'))"
    best = []
    for phrase in REFERENCE_PHRASES:
        own = f"list_distinct(regexp_extract_all(lower('{phrase}'), '[a-z0-9'']+'))"
        common = f"len(list_intersect({words}, {own}))"
        best.append(f"{common} / (len({words}) + len({own}) - {common})::DOUBLE")
    return f"greatest({', '.join(best)})"


@query(
    "session_content_scores",
    f"""
    WITH {v.V_SESSIONS}, t AS (SELECT agent_id, COALESCE(NULLIF(injection_payload_text, ''), raw_utterance) AS body FROM v_sessions),
    s AS (SELECT agent_id, {_sql_phrase_score('body')} AS score FROM t)
    SELECT agent_id, round(score, 6) AS content_score, score >= 0.15 AS injection_like FROM s
    """,
)
def session_content_scores(spark, sf_dir):
    score = phrase_overlap(writers.content_text(), REFERENCE_PHRASES)
    rows = v.sessions(spark, sf_dir).select("agent_id", score.alias("score"))
    return rows.select(
        "agent_id", F.round("score", 6).alias("content_score"), (predicted(F.col("score"), 0.15) == 1).alias("injection_like")
    )


_POLICY_VALUES = ", ".join(f"({i}, '{c}', {cap}::DOUBLE, {allow})" for i, (c, cap, allow) in enumerate(POLICY))


@query(
    "policy_lookup",
    f"""
    WITH policy(slot, category, amount_cap, allowlist) AS (VALUES {_POLICY_VALUES})
    SELECT l_orderkey, l_linenumber, category, amount_cap, array_to_string(allowlist, '|') AS merchant_allowlist,
           l_extendedprice > amount_cap AS over_cap
    FROM lineitem JOIN policy ON l_partkey % 10 = slot
    """,
)
def policy_lookup(spark, sf_dir):
    names = F.array(*[F.lit(category) for category, _, _ in POLICY])
    lines = v.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_extendedprice",
        F.element_at(names, (F.col("l_partkey") % 10 + 1).cast("int")).alias("category"),
    )
    # The policy table is a fixed list of ten rows.
    return lines.join(F.broadcast(readers.policy_table(spark)), "category").select(
        "l_orderkey", "l_linenumber", "category", "amount_cap", joined("merchant_allowlist").alias("merchant_allowlist"),
        (F.col("l_extendedprice") > F.col("amount_cap")).alias("over_cap"),
    )


@query(
    "session_json_round_trip",
    f"""
    WITH {v.V_SESSIONS}
    SELECT agent_id, subtlety, category, amount_cap, strftime(expiry, '%Y-%m-%dT%H:%M:%S') AS expiry,
           array_to_string(content_sources_ingested, '|') AS sources, injection_present, injection_payload_text FROM v_sessions
    """,
)
def session_json_round_trip(spark, sf_dir):
    path = scratch_path(spark, "sessions-json")
    writers.write_sessions_json(v.sessions(spark, sf_dir), path)
    return readers.read_sessions(spark, path).select(
        "agent_id", "subtlety", F.get("mandate_scope.categories", 0).alias("category"),
        F.col("mandate_scope.amount_cap").alias("amount_cap"),
        F.date_format("mandate_scope.expiry", "yyyy-MM-dd'T'HH:mm:ss").alias("expiry"),
        joined("content_sources_ingested").alias("sources"), "injection_present", "injection_payload_text",
    )


@query(
    "session_array_round_trip",
    f"""
    WITH {v.V_SESSIONS}
    SELECT agent_id, subtlety, category, amount_cap, strftime(expiry, '%Y-%m-%dT%H:%M:%S') AS expiry,
           array_to_string(content_sources_ingested, '|') AS sources, raw_utterance FROM v_sessions
    """,
)
def session_array_round_trip(spark, sf_dir):
    path = scratch_path(spark, "session-arrays")
    writers.write_session_arrays(v.sessions(spark, sf_dir), path)
    return readers.read_sessions(spark, path, array=True).select(
        "agent_id", "subtlety", F.get("mandate_scope.categories", 0).alias("category"),
        F.col("mandate_scope.amount_cap").alias("amount_cap"),
        F.date_format("mandate_scope.expiry", "yyyy-MM-dd'T'HH:mm:ss").alias("expiry"),
        joined("content_sources_ingested").alias("sources"), "raw_utterance",
    )


@query(
    "quoted_documents_csv",
    "SELECT doc_id, lang, source, text FROM documents WHERE text IS NOT NULL",
)
def quoted_documents_csv(spark, sf_dir):
    """Texts with line ends, quotes and commas through CSV and back."""
    path = scratch_path(spark, "documents-csv")
    rows = v.documents(spark, sf_dir, "doc_id", "lang", "source", "text").filter("text is not null")
    rows.write.csv(path, header=True, escape='"', quoteAll=True)
    return readers.read_table_csv(spark, path, "doc_id bigint, lang string, source string, text string")


def session_rounds(spark, sf_dir):
    """All sessions, and a later version of each hijacked one off its allowlist, from their files."""
    base, changed = scratch_path(spark, "sessions-base"), scratch_path(spark, "sessions-later")
    rows = v.sessions(spark, sf_dir)
    writers.write_sessions_json(rows, base)
    later = rows.filter("injection_present and agent_registry_status = 'revoked'")
    writers.write_session_arrays(later.withColumn("signed_artifact_text", F.concat("signed_artifact_text", F.lit(" (variant)"))), changed)
    return readers.read_session_rounds(spark, base, changed, later_array=True)


@query(
    "current_sessions",
    f"""
    WITH {v.V_SESSIONS}
    SELECT agent_id,
           CASE WHEN injection_present AND agent_registry_status = 'revoked' THEN 'subtle'
                WHEN subtlety = 'n/a' THEN 'benign' ELSE subtlety END AS subtlety,
           CASE WHEN injection_present AND agent_registry_status = 'revoked'
                THEN signed_artifact_text || ' (variant)' ELSE signed_artifact_text END AS signed_artifact_text
    FROM v_sessions
    """,
)
def latest_sessions(spark, sf_dir):
    return current_sessions(session_rounds(spark, sf_dir)).select("agent_id", "subtlety", "signed_artifact_text")


@query(
    "transactions_csv",
    f"WITH {v.V_TRANSACTIONS} SELECT TransactionID, isFraud AS ieee_cis_isFraud, TransactionAmt, ProductCD FROM v_transactions WHERE isFraud = 0",
)
def transactions_csv(spark, sf_dir):
    path = scratch_path(spark, "transactions-csv")
    v.transactions(spark, sf_dir).write.csv(path, header=True)
    rows = readers.read_table_csv(spark, path, schemas.TRANSACTIONS)
    return rows.filter(F.col("isFraud") == 0).withColumnRenamed("isFraud", "ieee_cis_isFraud")


@query(
    "joined_csv_lists",
    f"""
    WITH {v.V_SESSIONS}
    SELECT agent_id, category, CAST(len(merchant_allowlist) AS INTEGER) AS n_allowed,
           array_to_string(content_sources_ingested, '|') AS sources FROM v_sessions
    """,
)
def joined_csv_lists(spark, sf_dir):
    path = scratch_path(spark, "joined-csv")
    lists = ("mandate_categories", "mandate_merchant_allowlist", "content_sources_ingested")
    writers.write_joined(flatten(v.sessions(spark, sf_dir)).select("agent_id", *lists), path, csv=True)
    read = readers.read_table_csv(spark, path, ", ".join(f"{c} string" for c in ("agent_id", *lists)))
    decoded = read.withColumns({c: readers.decode_list(c) for c in lists})
    return decoded.select(
        "agent_id",
        F.get("mandate_categories", 0).alias("category"),
        F.size("mandate_merchant_allowlist").alias("n_allowed"),
        joined("content_sources_ingested").alias("sources"),
    )


def corpus(spark, sf_dir):
    """Documents; English ones carry a source header, as fetched reports do."""
    header = v.text(F.lit("SOURCE: https://"), "source", F.lit(".example.com/report \n"), "text")
    return v.table(spark, sf_dir, "documents").select(
        "doc_id", v.text(F.lit("doc-"), "doc_id", F.lit(".txt")).alias("file_name"),
        F.when(F.col("lang") == "en", header).otherwise(F.col("text")).alias("text"),
    )


_V_CORPUS = """
v_corpus AS (
  SELECT doc_id, CASE WHEN lang = 'en' THEN 'https://' || source || '.example.com/report' ELSE 'doc-' || doc_id || '.txt' END AS source,
         CASE WHEN lang = 'en' THEN 'SOURCE: https://' || source || '.example.com/report ' || chr(10) || text ELSE text END AS text
  FROM documents
)"""


@query("corpus_sources", f"WITH {_V_CORPUS} SELECT doc_id, source, CAST(length(text) AS INTEGER) AS n_chars FROM v_corpus")
def corpus_sources(spark, sf_dir):
    return corpus(spark, sf_dir).select(
        "doc_id",
        readers.document_source(F.col("text"), F.col("file_name")).alias("source"),
        F.length("text").alias("n_chars"),
    )


_V_PAYLOAD_DOCS = """
v_payload_docs AS (
  SELECT 'Domain: ' || category || '. Subtlety: ' || subtlety
         || '. Injection payload (synthetic, LLM-generated for this project''s own red-team dataset): '
         || injection_payload_text AS text, 'synthetic:sessions:' || agent_id AS source
  FROM v_sessions WHERE length(injection_payload_text) > 0
  QUALIFY row_number() OVER (PARTITION BY category, subtlety ORDER BY agent_id) <= 2
)"""


def payload_document_rows(spark, sf_dir):
    rows = v.sessions(spark, sf_dir).filter(F.coalesce(F.length("injection_payload_text"), F.lit(0)) > 0)
    tagged = rows.withColumn("category", F.get("mandate_scope.categories", 0))
    return writers.payload_documents(first_per_group(tagged, ["category", "subtlety"], ["agent_id"], 2), "sessions")


@query("payload_documents", f"WITH {v.V_SESSIONS}, {_V_PAYLOAD_DOCS} SELECT source, text FROM v_payload_docs")
def payload_documents(spark, sf_dir):
    return payload_document_rows(spark, sf_dir).select("source", "text")


@query(
    "discovery_corpus",
    f"""
    WITH {v.V_SESSIONS}, {_V_CORPUS}, {_V_PAYLOAD_DOCS}
    SELECT source, md5(text) AS text_md5 FROM v_corpus UNION ALL SELECT source, md5(text) FROM v_payload_docs
    """,
)
def discovery_corpus(spark, sf_dir):
    docs = corpus(spark, sf_dir).select(
        "text", readers.document_source(F.col("text"), F.col("file_name")).alias("source")
    )
    return docs.unionByName(payload_document_rows(spark, sf_dir)).select("source", F.md5("text").alias("text_md5"))


@query(
    "taxonomy_json_round_trip",
    f"""
    WITH {v.V_TAXONOMY}
    SELECT name, mechanism, delivery_vector, mechanism_type, array_to_string(grounding, '|') AS grounding,
           COALESCE(reviewed, TRUE) AS reviewed FROM v_taxonomy
    """,
)
def taxonomy_json_round_trip(spark, sf_dir):
    path = scratch_path(spark, "taxonomy-json")
    writers.write_taxonomy(v.part_taxonomy(spark, sf_dir).drop("seq", "attack_id"), path)
    return readers.read_taxonomy(spark, path).select(
        "name", "mechanism", "delivery_vector", "mechanism_type", joined("grounding").alias("grounding"), "reviewed"
    )


@query(
    "taxonomy_candidates",
    f"""
    WITH {v.V_SESSIONS}
    SELECT 'Mutator round 2 variant: closer-wording ' || category || ' hijack' AS name,
           'Confidence-guided mutation of a session that evaded Task 5''s detector. Signed artifact: '''
             || signed_artifact_text || '''. Injection payload: ''' || injection_payload_text
             || '''. Unreviewed — flagged by the Mutator, not independently corroborated by external threat-intel.' AS mechanism,
           'mutator:round_2:' || agent_id AS grounding, FALSE AS reviewed
    FROM v_sessions WHERE subtlety = 'subtle'
    """,
)
def taxonomy_candidates(spark, sf_dir):
    subtle = v.sessions(spark, sf_dir).filter("subtlety = 'subtle'")
    return writers.taxonomy_candidates(subtle, 2).select("name", "mechanism", joined("grounding").alias("grounding"), "reviewed")
