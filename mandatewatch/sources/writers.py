"""Sinks: sessions, joined tables, graphs, taxonomies, rounds and payloads."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from mandatewatch.functions.scoring import payload_json
from mandatewatch.functions.text import first_non_empty, quoted, quoted_list
from mandatewatch.sources.keyed_table import not_stored


#: Sessions of one compressed file: such a file is read by one task.
ROWS_PER_FILE = 100_000


def write_sessions_json(sessions: DataFrame, path: str) -> None:
    """One JSON object per line with ISO expiry, in compressed files of bounded size."""
    out = sessions.write.mode("overwrite").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]")
    out.options(compression="gzip", maxRecordsPerFile=ROWS_PER_FILE).json(path)


def write_session_arrays(sessions: DataFrame, path: str) -> None:
    """JSON arrays of sessions, one in each file: compressed files of bounded size, one or more a task."""
    per_file = ROWS_PER_FILE

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Every array but a task's last has ``per_file`` elements, so that each file of so many lines is whole.
        held = 0
        for batch in batches:
            lines = []
            for x in batch.column(0).to_pylist():
                # A comma stands before each element but the first, a bracket behind the last.
                lines.append(("," if held else "[") + x + ("]" if held == per_file - 1 else ""))
                held = (held + 1) % per_file
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(["]"], pa.string())], names=["value"])

    record = F.to_json(F.struct(*sessions.columns), {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"})
    made = sessions.select(record.alias("value")).mapInArrow(elements, "value string")
    made.write.mode("overwrite").options(compression="gzip", maxRecordsPerFile=per_file).text(path)


def missing_rows(new: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not stored yet, one per key."""
    return new.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def append_new(new: DataFrame, key: str, path: str) -> None:
    """Idempotent append: a rerun after a failure adds only what is missing. Only files that may hold a key are read."""
    not_stored(new, key, path).write.mode("append").parquet(path)


def write_joined(joined: DataFrame, path: str, csv: bool = False) -> None:
    """The joined table as Parquet, or as CSV with a header and list columns as quoted texts."""
    if not csv:
        joined.write.mode("overwrite").parquet(path)
        return
    flat = [quoted_list(F.col(f.name)).alias(f.name) if isinstance(f.dataType, ArrayType) else F.col(f.name) for f in joined.schema]
    joined.select(*flat).write.mode("overwrite").csv(path, header=True, escape='"')


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def write_taxonomy(taxonomy: DataFrame, path: str) -> None:
    taxonomy.write.mode("overwrite").json(path)


def taxonomy_candidates(sessions: DataFrame, round_num: int) -> DataFrame:
    """Unreviewed taxonomy rows, one per session of a feedback round."""
    # The texts and tags of a candidate row.
    category = F.get(F.col("mandate_scope.categories"), 0)
    mechanism = F.concat(
        F.lit("Confidence-guided mutation of a session that evaded Task 5's detector. Signed artifact: "),
        quoted(F.col("signed_artifact_text")),
        F.lit(". Injection payload: "),
        F.coalesce(quoted(F.col("injection_payload_text")), F.lit("None")),
        F.lit(
            ". Unreviewed — flagged by the Mutator, not independently corroborated by external threat-intel."
        ),
    )
    return sessions.select(
        F.format_string(f"Mutator round {round_num} variant: closer-wording %s hijack", category).alias("name"),
        mechanism.alias("mechanism"),
        F.lit(
            "constraint_drift + ingestion_source_trust_score (currently missed on this wording pattern)"
        ).alias("defend_signal"),
        F.lit("prompt injection").alias("category"),
        F.lit("closer-wording-subtle").alias("delivery_vector"),
        F.lit("pre-signature-corruption").alias("mechanism_type"),
        F.array(F.format_string(f"mutator:round_{round_num}:%s", F.col("agent_id"))).alias("grounding"),
        F.lit(False).alias("reviewed"),
    )


def payload_documents(sessions: DataFrame, cache_name: str) -> DataFrame:
    """(text, source) documents rendered from injection payloads."""
    category = F.get(F.col("mandate_scope.categories"), 0)
    return sessions.select(
        F.concat(
            F.lit("Domain: "), category, F.lit(". Subtlety: "), F.col("subtlety"),
            F.lit(". Injection payload (synthetic, LLM-generated for this project's own red-team dataset): "),
            F.col("injection_payload_text"),
        ).alias("text"),
        F.concat(F.lit(f"synthetic:{cache_name}:"), F.col("agent_id")).alias("source"),
    )


def number_rounds(rounds: list[DataFrame]) -> DataFrame:
    """One table of round metrics; rounds are numbered from 1, empty ones are skipped."""
    numbered = [df.withColumn("round", F.lit(i)) for i, df in enumerate(rounds, start=1)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered).filter(F.col("n") > 0)


def write_rounds(rounds: DataFrame, path: str) -> None:
    rounds.write.mode("overwrite").json(path)


def write_payloads(payloads: DataFrame, record: str, path: str) -> None:
    payloads.select(payload_json(F.col(record)).alias("value")).write.mode("overwrite").text(path)


def content_text():
    return first_non_empty(F.col("injection_payload_text"), F.col("raw_utterance"))
