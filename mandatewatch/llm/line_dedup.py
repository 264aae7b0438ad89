"""Line dedup: lines found in many documents stay only in the one with the smallest id.

Lines are exploded as 128-bit hashes of their normalised form, so the shuffles
carry hashes and never text. Sums per hash are made before the shuffle, so a
line that is in a third of all documents is one row per task. The last pass
reads the documents again, next to the hashes each must drop, and reassembles
what is left in order.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mandatewatch.llm.common import edited, in_batches, written

#: Stripped at both ends of a line.
SPACE = b" \t\n\x0b\x0c\r"
KEYS = pa.schema([("doc_id", pa.int64()), ("key", pa.binary())])


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The hash of the line without outer white space and A-Z in lower case; none for short lines."""
    kept = line.strip(SPACE)
    # A code point has at most four bytes.
    if len(kept) < 4 * min_chars and len(kept.decode()) < min_chars:
        return None
    return xxhash.xxh3_128_digest(kept.lower())


def lines_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split(b"\n")


def repeated_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """(doc_id, keys): for each document the line hashes it must drop.

    A hash counts once for each distinct doc_id that holds it.
    """

    def explode(batches):
        def rows():
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for key in {line_key(line, min_chars) for line in lines_of(text)} - {None}:
                        yield doc_id, key

        yield from in_batches(rows(), KEYS, 16384)

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter("doc_id is not null")
    keys = written(own.mapInArrow(explode, "doc_id long, key binary"), "line-keys")
    if min_docs == 2:
        held = keys.groupBy("key").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last"))
        common = held.filter("last > keeper").select("key", "keeper")
    else:
        held = keys.distinct().groupBy("key").agg(F.min("doc_id").alias("keeper"), F.count("*").alias("n"))
        common = held.filter(F.col("n") >= min_docs).select("key", "keeper")
    # A table of its own: adaptive execution can split a line that many documents hold, or broadcast the other side.
    dropped = keys.join(written(common, "common-lines"), "key").filter("doc_id <> keeper")
    return dropped.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))


def drop_repeated_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """Per input row: its ``doc_id``, ``n_lines``, ``n_dropped`` and ``kept_text``.

    A null or empty text is one empty line. Rows that share a doc_id are one
    document when lines are counted and are reassembled one by one. A row with a
    null doc_id keeps all its lines and counts for none. Lines of fewer than
    ``min_chars`` code points always stay. Other columns are ignored.
    """
    schema = "doc_id long, n_lines long, n_dropped long, kept_text string"
    arrow = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_text", pa.string())])

    def reassemble(batches):
        def rows():
            for batch in batches:
                for doc_id, text, keys in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    lines = lines_of(text)
                    gone = set(keys or ())
                    kept = [x for x in lines if line_key(x, min_chars) not in gone] if gone else lines
                    yield doc_id, len(lines), len(lines) - len(kept), b"\n".join(kept).decode()

        yield from in_batches(rows(), arrow, weigh=lambda r: len(r[3]))

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return own.join(repeated_lines(own, min_chars, min_docs), "doc_id", "left").mapInArrow(reassemble, schema)


def without_repeated_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """``docs``, all rows and columns, without the lines that ``drop_repeated_lines`` drops."""

    def edit(text, keys):
        gone = set(keys)
        return b"\n".join(x for x in lines_of(text) if line_key(x, min_chars) not in gone).decode()

    notes = repeated_lines(docs, min_chars, min_docs).select(F.col("doc_id").alias("key"), F.col("keys").alias("note"))
    return edited(docs, F.col("doc_id").cast("long"), notes, edit)


def digest(df: DataFrame) -> DataFrame:
    """The same rows with the SHA-256 of the kept text in its place."""
    return df.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))

