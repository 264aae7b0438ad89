"""Queries on texts: divergence, word sets, phrase overlap and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from mandatewatch.catalog import views as v
from mandatewatch.catalog.registry import query
from mandatewatch.functions.text import blended_divergence, lexical_divergence, word_set
from mandatewatch.functions.vectors import cosine, semantic_divergence
from mandatewatch.operators.chunking import CHUNK_OVERLAP, CHUNK_SIZE, recursive_chunks, window_chunks
from mandatewatch.operators.phrase_match import content_scores
from mandatewatch.operators.text_pairs import pair_divergence

_DIVERGENCE = v.sql_divergence("v_div", "v_pairs", "agent_id", "raw_utterance", "signed_artifact_text")


@query(
    "conversation_divergence",
    f"WITH {v.V_PAIRS}, {_DIVERGENCE} SELECT agent_id, round(lexical_divergence, 6) AS lexical_divergence FROM v_div",
)
def conversation_divergence(spark, sf_dir):
    rows = pair_divergence(v.conversation_pairs(spark, sf_dir), "agent_id", "raw_utterance", "signed_artifact_text")
    return rows.withColumn("lexical_divergence", F.round("lexical_divergence", 6))


@query(
    "session_divergence",
    f"""
    WITH {v.V_SESSIONS}, {v.sql_divergence("v_div", "v_sessions", "agent_id", "raw_utterance", "signed_artifact_text")}
    SELECT agent_id, round(lexical_divergence, 6) AS lexical_divergence FROM v_div
    """,
)
def session_divergence(spark, sf_dir):
    score = lexical_divergence(F.col("raw_utterance"), F.col("signed_artifact_text"))
    return v.sessions(spark, sf_dir).select("agent_id", F.round(score, 6).alias("lexical_divergence"))


@query(
    "document_divergence",
    """
    WITH v_docs AS (SELECT a.doc_id, a.text AS l, b.text AS r FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
    """
    + v.sql_divergence("v_div", "v_docs", "doc_id", "l", "r")
    + " SELECT doc_id, round(lexical_divergence, 6) AS lexical_divergence FROM v_div",
)
def document_divergence(spark, sf_dir):
    docs = v.documents(spark, sf_dir, "doc_id", "text")
    following = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next_text"))
    rows = pair_divergence(docs.join(following, "doc_id"), "doc_id", "text", "next_text")
    return rows.filter("lexical_divergence is not null").withColumn("lexical_divergence", F.round("lexical_divergence", 6))


@query(
    "blended_divergence",
    f"""
    WITH {v.V_PAIRS}, {_DIVERGENCE},
    e AS (SELECT a.vec_id, 1 - list_cosine_similarity(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)),
                                                      list_transform(b.embedding, lambda x: CAST(x AS DOUBLE))) AS semantic
          FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
    SELECT p.agent_id, round(semantic, 6) AS semantic_divergence,
           round(CASE WHEN semantic IS NULL THEN lexical_divergence ELSE 0.7 * semantic + 0.3 * lexical_divergence END, 6)
             AS utterance_artifact_divergence
    FROM v_pairs p JOIN v_div USING (agent_id) LEFT JOIN e ON e.vec_id = p.conv_id * 3
    """,
)
def blended(spark, sf_dir):
    pairs = v.conversation_pairs(spark, sf_dir)
    lexical = pair_divergence(pairs, "agent_id", "raw_utterance", "signed_artifact_text")
    vectors = v.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    following = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    semantic = vectors.join(following, "vec_id").select(
        "vec_id", semantic_divergence(F.col("embedding"), F.col("other")).alias("semantic")
    )
    keyed = pairs.select("agent_id", (F.col("conv_id") * 3).alias("vec_id")).join(lexical, "agent_id")
    return keyed.join(semantic, "vec_id", "left").select(
        "agent_id",
        F.round("semantic", 6).alias("semantic_divergence"),
        F.round(blended_divergence(F.col("lexical_divergence"), F.col("semantic")), 6).alias("utterance_artifact_divergence"),
    )


@query(
    "neighbour_cosine",
    """
    SELECT a.vec_id, round(list_cosine_similarity(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)),
                                                  list_transform(b.embedding, lambda x: CAST(x AS DOUBLE))), 6) AS similarity
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
    """,
)
def neighbour_cosine(spark, sf_dir):
    vectors = v.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    following = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    similarity = F.round(cosine(F.col("embedding"), F.col("other")), 6)
    return vectors.join(following, "vec_id").select("vec_id", similarity.alias("similarity"))


@query(
    "document_words",
    """
    SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9'']+'))) AS INTEGER) AS n_words,
           md5(array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9'']+'))), ' ')) AS words_md5
    FROM documents
    """,
)
def document_words(spark, sf_dir):
    docs = v.documents(spark, sf_dir, "doc_id", "text").select("doc_id", word_set(F.col("text")).alias("words"))
    return docs.select("doc_id", F.size("words").alias("n_words"), F.md5(F.array_join(F.array_sort("words"), " ")).alias("words_md5"))


def document_scores(spark, sf_dir):
    """Best overlap of every document with the benchmark passages."""
    docs = v.documents(spark, sf_dir, "doc_id", "text")
    return content_scores(docs, "doc_id", "text", v.table(spark, sf_dir, "benchmark"), "text")


V_CONTENT = """
v_words AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS w FROM documents),
v_phrases AS (SELECT list_distinct(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS p FROM benchmark),
v_content AS (
  SELECT doc_id, MAX(CASE WHEN len(w) = 0 OR len(p) = 0 THEN 0.0
                          ELSE len(list_intersect(w, p)) / (len(w) + len(p) - len(list_intersect(w, p)))::DOUBLE END) AS content_score
  FROM v_words, v_phrases GROUP BY doc_id
)"""


@query("document_content_scores", f"WITH {V_CONTENT} SELECT doc_id, round(content_score, 6) AS content_score FROM v_content")
def document_content_scores(spark, sf_dir):
    return document_scores(spark, sf_dir).withColumn("content_score", F.round("content_score", 6))


@query(
    "window_chunks",
    """
    WITH s AS (SELECT doc_id, text, UNNEST(range(0, greatest(CAST(ceil((length(text) - 100) / 800.0) AS BIGINT), 1))) AS pos FROM documents
               WHERE length(text) > 0)
    SELECT doc_id, pos, md5(substr(text, pos * 800 + 1, 900)) AS text_md5 FROM s
    """,
)
def fixed_chunks(spark, sf_dir):
    chunks = window_chunks(v.documents(spark, sf_dir, "doc_id", "text"), "doc_id", "text")
    return chunks.select("doc_id", "pos", F.md5("text").alias("text_md5"))


def _sql_cut(level: int) -> str:
    """Pieces of the texts of one level of the recursion, cut at the coarsest separator they hold."""
    separator = "CASE s WHEN 0 THEN chr(10) || chr(10) WHEN 1 THEN chr(10) ELSE ' ' END"
    return f"""
    c{level} AS (
      SELECT doc_id, path, body, CASE WHEN k <= 0 AND contains(body, chr(10) || chr(10)) THEN 0 WHEN k <= 1 AND contains(body, chr(10)) THEN 1
                                      WHEN k <= 2 AND contains(body, ' ') THEN 2 ELSE 3 END AS s FROM t{level}),
    l{level} AS (
      SELECT doc_id, path, s, CASE WHEN s = 3 THEN regexp_extract_all(body, '(?s).')
        ELSE list_filter(list_concat([string_split(body, {separator})[1]], list_transform(string_split(body, {separator})[2:], lambda x: {separator} || x)),
                         lambda x: x <> '') END AS pieces FROM c{level}),
    p{level} AS (
      SELECT *, s < 3 AND length(piece) >= {CHUNK_SIZE} AS large,
             SUM(CASE WHEN s < 3 AND length(piece) >= {CHUNK_SIZE} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, path ORDER BY idx) AS run
      FROM (SELECT doc_id, path, s, UNNEST(pieces) AS piece, generate_subscripts(pieces, 1) AS idx FROM l{level})),
    t{level + 1} AS (SELECT doc_id, list_append(path, idx) AS path, piece AS body, s + 1 AS k FROM p{level} WHERE large)"""


_SQL_CHUNKS = f"""
    WITH RECURSIVE t0 AS (SELECT doc_id, CAST([] AS BIGINT[]) AS path, text AS body, 0 AS k FROM documents WHERE length(text) > 0),
    {','.join(_sql_cut(level) for level in range(4))},
    small AS ({' UNION ALL '.join(f'SELECT doc_id, path, run, idx, piece FROM p{level} WHERE NOT large' for level in range(4))}),
    ends AS (SELECT *, SUM(length(piece)) OVER (PARTITION BY doc_id, path, run ORDER BY idx) AS stop FROM small),
    runs AS MATERIALIZED (
      SELECT doc_id, list_append(path, MIN(idx)) AS place, string_agg(piece, '' ORDER BY idx) AS body, list(CAST(stop AS BIGINT) ORDER BY idx) AS stops
      FROM ends GROUP BY doc_id, path, run),
    walk(doc_id, place, start, stop) AS (
      SELECT doc_id, place, 0::BIGINT, list_max(list_filter(stops, lambda x: x <= {CHUNK_SIZE})) FROM runs
      UNION ALL
      SELECT doc_id, place, begins, list_max(list_filter(stops, lambda x: x <= begins + {CHUNK_SIZE})) FROM (
        SELECT doc_id, place, stops, list_min(list_filter(list_concat([0], stops),
                 lambda x: x >= stop - {CHUNK_OVERLAP} AND (x = stop OR (x < stop AND x >= beyond - {CHUNK_SIZE})))) AS begins
        FROM (SELECT w.doc_id, w.place, w.stop, stops, list_min(list_filter(stops, lambda x: x > w.stop)) AS beyond
              FROM walk w JOIN runs r ON w.doc_id = r.doc_id AND w.place = r.place WHERE w.stop < stops[-1]))),
    cut AS (
      SELECT w.doc_id, w.place, w.start, trim(substr(body, start + 1, stop - start), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text
      FROM walk w JOIN runs r ON w.doc_id = r.doc_id AND w.place = r.place)
    SELECT doc_id, source, row_number() OVER (PARTITION BY doc_id ORDER BY place, start) - 1 AS pos, c.text
    FROM cut c JOIN documents USING (doc_id) WHERE c.text <> ''
"""


@query("recursive_chunks", _SQL_CHUNKS)
def separator_chunks(spark, sf_dir):
    return recursive_chunks(v.documents(spark, sf_dir, "doc_id", "source", "text"), "doc_id", "source", "text")
