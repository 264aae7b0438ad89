"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mandatewatch.llm import adaptive_scan, byte_convnet, cover_tree, jaccard_regions, line_dedup, part_codes, piece_lattice, residual_packing, source_mixing, substring_dedup, token_counts, token_files, turn_repair
from mandatewatch.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    found = adaptive_scan.search(rows, rows.filter("vec_id % 50 = 0"), 5)
    return found.select("query_id", "rank", "vec_id", "score")


@query
def op2_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = piece_lattice.Pieces.of(spark, piece_lattice.model_path())
    return piece_lattice.digests(table(spark, sf_dir, "documents"), pieces)


@query
def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_regions.near_duplicates(table(spark, sf_dir, "documents"), 3, 90)
    return found.select("doc_id", "n_shingles", "component_id")


@query
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(table(spark, sf_dir, "documents"), 35)


@query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residual_packing.pack(table(spark, sf_dir, "documents"))


@query
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_shards(table(spark, sf_dir, "documents"))


@query
def op7_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(table(spark, sf_dir, "embeddings"), 0.95)


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents")))


ORACLES["op8_line_dedup"] = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
held AS (
  SELECT k, min(doc_id) AS keeper FROM keyed WHERE length(k) >= 10
  GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT a.doc_id, a.pos, a.line, h.keeper IS NOT NULL AND h.keeper <> a.doc_id AS gone
  FROM keyed a LEFT JOIN held h ON a.k = h.k)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = byte_convnet.predict(docs, byte_convnet.train(docs))
    return found.select("doc_id", byte_convnet.held_out().alias("held_out"), "lang_pred", "score")


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


@query
def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.digests(turn_repair.damaged(table(spark, sf_dir, "conversations")))


@query
def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = source_mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


_TRIALS = range(source_mixing.TRIALS)
_DRAW = "CAST(('0x' || substr(hash, {0} * 8 + 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE"

ORACLES["op12_source_mixing"] = f"""
WITH sized AS (
  SELECT doc_id, source, length(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         sha256('mix:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS hash
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS weight
  FROM sized GROUP BY source),
stepped AS (
  SELECT *, sum(source_size) OVER () AS all_size, sum(weight) OVER () AS all_weight,
         coalesce(sum(4 * source_size) OVER earlier, 0) AS limit_before, coalesce(sum(weight) OVER earlier, 0) AS weight_before
  FROM sources WINDOW earlier AS (ORDER BY source_size * 10 // weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (
  SELECT *, 4 * source_size * (all_weight - weight_before) < weight * (3 * all_size - limit_before) AS held FROM stepped),
plan AS (
  SELECT source, source_size,
         CASE WHEN held THEN CAST(2 * source_size AS DOUBLE)
              ELSE CAST(3 * all_size - coalesce(sum(4 * source_size) FILTER (WHERE held) OVER (), 0) AS DOUBLE) * CAST(weight AS DOUBLE)
                   / CAST(2 * greatest(all_weight - coalesce(sum(weight) FILTER (WHERE held) OVER (), 0), 1) AS DOUBLE) END AS target
  FROM marked),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM plan),
drawn AS (
  SELECT s.doc_id, s.size, r.*, {', '.join(f'{_DRAW.format(t)} < rate - floor(rate) AS more{t}' for t in _TRIALS)}
  FROM sized s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source),
tried AS (
  SELECT source, [{', '.join(f'abs(floor(any_value(rate)) * any_value(source_size) + coalesce(sum(size) FILTER (WHERE more{t}), 0) - any_value(target))' for t in _TRIALS)}] AS off
  FROM drawn GROUP BY source)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CAST([{', '.join(f'more{t}' for t in _TRIALS)}][list_position(off, list_min(off))] AS INTEGER)) AS BIGINT) AS taken
FROM drawn d JOIN tried t ON d.source IS NOT DISTINCT FROM t.source
"""


@query
def op13_part_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = part_codes.with_label_errors(part_codes.compress(table(spark, sf_dir, "embeddings")))
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _assigned(round_number: int) -> str:
    """Every distinct part with its nearest entry, ties to the lower index."""
    return f"""assigned{round_number} AS MATERIALIZED (
  SELECT part, x, n, min(CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) * 16 + entry) AS best
  FROM parts JOIN books{round_number} USING (part) GROUP BY part, x, n)"""


def _moved(round_number: int) -> str:
    """The entries after a round: floored means, or the old entry where no part is nearest."""
    return f"""books{round_number + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM books{round_number} b LEFT JOIN (
    SELECT part, entry, list(v ORDER BY d) AS c FROM (
      SELECT part, best % 16 AS entry, d, CAST(floor(sum(x[d] * n) / sum(n)) AS BIGINT) AS v
      FROM assigned{round_number}, (SELECT unnest(range(1, 1025)) AS d) WHERE d <= len(x) GROUP BY ALL) GROUP BY ALL) m
  ON b.part = m.part AND b.entry = m.entry)"""


ORACLES["op13_part_codes"] = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
cut AS MATERIALIZED (
  SELECT vec_id, label, part, q[part * (len(q) // 8) + 1 : (part + 1) * (len(q) // 8)] AS x FROM kept, (SELECT unnest(range(8)) AS part)),
parts AS MATERIALIZED (SELECT part, x, count(*) AS n FROM cut GROUP BY part, x),
books0 AS MATERIALIZED (
  SELECT part, x AS c, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry FROM cut QUALIFY entry < 16),
{', '.join(f'{_assigned(k)}, {_moved(k)}' for k in range(part_codes.ROUNDS))}, {_assigned(part_codes.ROUNDS)},
hashed AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM books{part_codes.ROUNDS}),
coded AS (
  SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', best % 16), '' ORDER BY part) AS code, CAST(sum(best // 16) AS BIGINT) AS error
  FROM cut JOIN assigned{part_codes.ROUNDS} USING (part, x) GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, hashed
"""
