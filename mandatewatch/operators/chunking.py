"""Corpus chunking: fixed windows (native) and separator-aware pieces."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Chunk length, overlap and separators from coarse to fine.
CHUNK_SIZE = 900
CHUNK_OVERLAP = 100
SEPARATORS = ("\n\n", "\n", " ", "")


def window_chunks(
    docs: DataFrame, key: str, text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, keep: tuple[str, ...] = ()
) -> DataFrame:
    """(key, pos, text) windows of ``size`` characters, each ``overlap`` into the one before."""
    step = size - overlap
    last = F.greatest(F.ceil((F.length(text) - overlap) / F.lit(step)) - 1, F.lit(0))
    starts = F.sequence(F.lit(0).cast("bigint"), last)
    return (
        docs.filter(F.length(text) > 0)
        .select(key, *keep, F.col(text).alias("_text"), F.posexplode(starts).alias("pos", "_start"))
        .select(
            key, *keep, F.col("pos").cast("bigint").alias("pos"),
            F.substring(F.col("_text"), (F.col("_start") * step + 1).cast("int"), F.lit(size)).alias("text"),
        )
    )


def _runs(text: str, start: int, stop: int, size: int, separators: tuple[str, ...]) -> Iterator[np.ndarray]:
    """Borders of neighbouring pieces that are packed together, in order.

    A text is cut before each of the coarsest separator that it holds, which stays
    at the front of its piece; a piece of ``size`` or more is cut further, by the
    finer ones, and ends the run before it.
    """
    at = next((i for i, s in enumerate(separators) if not s or text.find(s, start, stop) >= 0), len(separators) - 1)
    separator, finer = separators[at], separators[at + 1 :] if separators[at] else ()
    if not separator:
        yield np.arange(start, stop + 1)
        return
    cuts = [m.start() for m in re.compile(re.escape(separator)).finditer(text, start, stop)]
    edges = np.unique(np.array([start, *cuts, stop], np.int64))
    large = np.flatnonzero(np.diff(edges) >= size) if finer else ()
    first = 0
    for k in large:
        if k > first:
            yield edges[first : k + 1]
        yield from _runs(text, int(edges[k]), int(edges[k + 1]), size, finer)
        first = k + 1
    if first < len(edges) - 1:
        yield edges[first:]


def _packed(edges: np.ndarray, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """(start, stop) of chunks of whole pieces: as many as fit in ``size``, from at most ``overlap`` before the last one's end.

    Borders are running lengths, so each chunk's end and the next one's start are
    found by binary search, however many pieces lie between.
    """
    first, last = 0, len(edges) - 1
    while True:
        stop = max(int(np.searchsorted(edges, edges[first] + size, "right")) - 1, first + 1)
        yield int(edges[first]), int(edges[stop])
        if stop == last:
            return
        room = int(np.searchsorted(edges, edges[stop + 1] - size, "left"))
        first = max(first, int(np.searchsorted(edges, edges[stop] - overlap, "left")), min(stop, room))


def split_text(
    text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators: tuple[str, ...] = SEPARATORS
) -> list[str]:
    """Chunks of at most ``size`` characters, cut at the coarsest separator that works."""
    spans = (span for run in _runs(text, 0, len(text), size, separators) for span in _packed(run, size, overlap)) if text else ()
    return [c for a, b in spans if (c := text[a:b].strip())]


def recursive_chunks(
    docs: DataFrame, key: str, source: str, text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP
) -> DataFrame:
    """(key, source, pos, text) chunks cut at paragraph, line, word or character."""
    key_type = docs.schema[key].dataType.simpleString()

    def chunk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pieces = batch["text"].map(lambda t: list(enumerate(split_text(t, size, overlap))))
            out = batch.assign(piece=pieces)[["id", "source", "piece"]].explode("piece").dropna(subset=["piece"])
            if not out.empty:
                yield pd.DataFrame(
                    {
                        "id": out["id"].to_numpy(),
                        "source": out["source"].to_numpy(),
                        "pos": [p[0] for p in out["piece"]],
                        "text": [p[1] for p in out["piece"]],
                    }
                )

    rows = docs.filter(F.length(text) > 0).select(
        F.col(key).alias("id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text")
    )
    return rows.mapInPandas(chunk, f"id {key_type}, source string, pos bigint, text string").withColumnRenamed("id", key)
