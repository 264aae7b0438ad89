"""Substring dedup: words covered by a window of words that also stands elsewhere are removed.

Documents are streamed against FM-indexes of shards (``fm_index``). A shard must
hold every place where a window could repeat, so windows are dealt by content:
a window belongs to its anchor, the run of ``GRAM`` words in it with the
smallest hash (the leftmost of equals), which two equal windows have at the same
place. The windows of one anchor form one segment. Then

1. anchors found once in the corpus are put aside, since their windows are unique;
2. of the others each distinct segment is fetched once from an example document,
   with its number of copies as weight, and shards of whole anchors are indexed
   and searched: backward search gives matching statistics, and windows reached
   by two or more copies are reported;
3. reported windows go back to all documents with that segment, as word ranges.

An anchor with many distinct segments (a passage shared by many documents with
different surroundings) is dealt window by window, keyed by the window's outer
words too, after copies are summed, so that no shard gets all of it. A template
with a varying word inside has as many windows with the same outer words as there
are documents, so a part of the window's own hash is in the key as well, dealing
an anchor's windows to as many keys as they fill indexes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mandatewatch.llm.common import Runs, edited, in_batches, mixed, only_ids, signed, word_ids, words_of, written
from mandatewatch.llm.fm_index import repeated_windows

GRAM = 8
#: Words that one index holds; a partition is indexed in several parts if it has more.
SHARD_WORDS = 1 << 18
#: Anchors with more distinct segments than this are dealt by single windows.
HOT_SEGMENTS = 256
_HIGH = np.uint64(0xFFFFFFFF00000000)


def segments(ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, segment, first word, words) of each run of windows with the same anchor."""
    windows = len(ids) - width + 1
    if windows <= 0:
        none = np.empty(0, np.int64)
        return none.view("u8"), none.view("u8"), none, none
    gram = min(GRAM, width)
    runs = Runs(ids)
    hashes = runs.grams(gram)
    # The place breaks ties, so the smallest of a window is its leftmost; minima over powers of two make up the rest.
    least = (hashes & _HIGH) | np.arange(len(hashes), dtype=np.uint64)
    span, reach = width - gram + 1, 1
    while 2 * reach <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    place = (np.minimum(least[:windows], least[span - reach : span - reach + windows]) & ~_HIGH).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
    stop = np.concatenate([first[1:], [windows]]) - 1 + width
    # The anchor's place is part of the segment's identity: copies must line up.
    segment = mixed(runs.hash(first, stop) + (place[first] - first).astype(np.uint64))
    return hashes[place[first]], segment, first, stop - first


def covered(places: list[tuple[int, list[int]]], n_words: int) -> np.ndarray:
    """Which words lie in a range; ranges are (start, stop, ...) lists counted from a place."""
    change = np.zeros(n_words + 1, np.int64)
    for base, edges in places:
        for start, stop in zip(edges[::2], edges[1::2], strict=True):
            change[base + start] += 1
            change[base + stop] -= 1
    return np.cumsum(change)[:n_words] > 0


def ranges(flags: np.ndarray, width: int) -> list[int]:
    """Start and stop of each run of words under the flagged windows."""
    out: list[int] = []
    for s in np.flatnonzero(flags).tolist():
        if out and s <= out[-1]:
            out[-1] = s + width
        else:
            out += [s, s + width]
    return out


def repeated_ranges(own: DataFrame, width: int) -> DataFrame:
    """(doc_id, text_id, places): per document with repeated windows, structs of first word and word ranges.

    ``own`` has doc_id, never null, text and text_id, its hash. Several rows may share a doc_id;
    the hash of the text tells them apart.
    """
    anchored = pa.schema(
        [("doc_id", pa.int64()), ("text_id", pa.int64()), ("anchor", pa.int64()), ("segment", pa.int64()), ("first", pa.int32()), ("words", pa.int32())]
    )

    def anchor(batches):
        for batch in batches:
            ids = word_ids((t or "").encode() for t in batch.column(1).to_pylist())
            for doc_id, identity, words in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), ids, strict=True):
                found = segments(words, width)
                n = len(found[0])
                if n:
                    columns = [pa.array([doc_id] * n, pa.int64()), pa.array(np.full(n, identity))]
                    columns += [pa.array(found[0].view("i8")), pa.array(found[1].view("i8")), pa.array(found[2].astype("i4")), pa.array(found[3].astype("i4"))]
                    yield pa.RecordBatch.from_arrays(columns, schema=anchored)

    rows = own.mapInArrow(anchor, "doc_id long, text_id long, anchor long, segment long, first int, words int")
    rows = written(rows, "anchored")
    again = rows.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
    rows = written(rows.join(written(again, "anchors"), "anchor"), "places")

    # One example of each distinct segment, with its copies.
    example = F.min(F.struct("doc_id", "text_id", "first")).alias("example")
    distinct = written(rows.groupBy("anchor", "segment", "words").agg(F.count("*").alias("copies"), example), "segments")
    # Keys for the windows under the same outer words, 0 for an anchor that is not hot.
    filled = F.floor(F.sum(F.col("words") - (width - 1)) * width / SHARD_WORDS) + 1
    kinds = written(distinct.groupBy("anchor").agg(F.when(F.count("*") > HOT_SEGMENTS, filled).otherwise(0).alias("salts")), "kinds")
    wanted = distinct.join(kinds, "anchor")
    wanted = wanted.groupBy("example.doc_id", "example.text_id").agg(
        F.collect_list(F.struct("anchor", "segment", "words", "copies", "example.first", "salts")).alias("wanted")
    )
    wanted = written(wanted, "wanted")
    texts = only_ids(own, wanted.select("doc_id").distinct(), "doc_id").join(wanted, ["doc_id", "text_id"]).select("text", "wanted")

    piece = pa.schema(
        [("key", pa.int64()), ("piece", pa.int64()), ("copies", pa.int64()), ("anchor", pa.int64()), ("segment", pa.int64()), ("at", pa.int32()), ("content", pa.binary())]
    )

    def fetch(batches):
        def all_rows():
            for batch in batches:
                texts_ids = word_ids(t.encode() for t in batch.column(0).to_pylist())
                for ids, asked in zip(texts_ids, batch.column(1).to_pylist(), strict=True):
                    for a in asked:
                        part = ids[a["first"] : a["first"] + a["words"]]
                        if not a["salts"]:
                            yield a["anchor"], a["segment"], a["copies"], a["anchor"], a["segment"], 0, part.tobytes()
                            continue
                        at = np.arange(len(part) - width + 1)
                        own_ids = Runs(part).grams(width)
                        outer = mixed(mixed(part[at] + np.uint64(a["anchor"] & (2**64 - 1))) + part[at + width - 1])
                        # Equal windows have the same hash, so they keep the same key.
                        outer = mixed(outer + own_ids % np.uint64(a["salts"]))
                        for s in at.tolist():
                            yield signed(int(outer[s])), signed(int(own_ids[s])), a["copies"], a["anchor"], a["segment"], s, part[s : s + width].tobytes()

        yield from in_batches(all_rows(), piece, 4096, lambda r: len(r[6]))

    pieces = texts.mapInArrow(fetch, "key long, piece long, copies long, anchor long, segment long, at int, content binary")
    pieces = written(pieces, "pieces")
    whole = pieces.groupBy("key", "piece").agg(F.sum("copies").alias("copies"), F.first("content").alias("content"))
    volume = pieces.agg(F.sum(F.length("content")) / 8).first()[0] or 0
    shards = max(int(volume // SHARD_WORDS) + 1, pieces.sparkSession.sparkContext.defaultParallelism)
    reported = pa.schema([("key", pa.int64()), ("piece", pa.int64()), ("edges", pa.list_(pa.int32()))])

    def search(batches):
        def index(held):
            flags = repeated_windows([c for _, _, _, c in held], np.array([n for _, _, n, _ in held]), width)
            for (key, name, _, _), good in zip(held, flags, strict=True):
                if good.any():
                    yield key, name, ranges(good, width)

        def all_rows():
            held, load = [], 0
            for batch in batches:
                for key, name, copies, content in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                    if load >= SHARD_WORDS and key != held[-1][0]:
                        yield from index(held)
                        held, load = [], 0
                    held.append((key, name, copies, np.frombuffer(content, "u8")))
                    load += len(held[-1][3])
            if held:
                yield from index(held)

        yield from in_batches(all_rows(), reported)

    dealt = whole.select("key", "piece", "copies", "content").repartition(shards, "key").sortWithinPartitions("key")
    found = written(dealt.mapInArrow(search, "key long, piece long, edges array<int>"), "reported")

    parts = pieces.select("key", "piece", "anchor", "segment", "at").join(found, ["key", "piece"])
    by_segment = parts.groupBy("anchor", "segment").agg(F.collect_list(F.struct("at", "edges")).alias("parts"))
    hits = rows.join(written(by_segment, "hits"), ["anchor", "segment"])
    return hits.groupBy("doc_id", "text_id").agg(F.collect_list(F.struct("first", "parts")).alias("places"))


def keyed(docs: DataFrame) -> DataFrame:
    """(own_id, text, text_id, doc_id): doc_id to meet by; rows without an id take their text's hash."""
    own = docs.select(F.col("doc_id").cast("long").alias("own_id"), F.col("text").cast("string").alias("text"))
    own = own.withColumn("text_id", F.xxhash64("text"))
    return own.withColumn("doc_id", F.coalesce("own_id", "text_id"))


def kept_words(words: list[bytes], places: list[dict]) -> list[bytes]:
    """The words outside the noted ranges."""
    spans = [(p["first"] + q["at"], q["edges"]) for p in places for q in p["parts"]]
    return list(compress(words, (~covered(spans, len(words))).tolist()))


def drop_repeated(docs: DataFrame, width: int = 35) -> DataFrame:
    """Per input row: ``doc_id``, ``n_words``, ``n_removed`` and ``kept_text``.

    Words are ``[^\\x20\\x09-\\x0D]+``; the kept ones are joined by one space. A
    window repeats if its words stand at any other place of any row, the same
    row and rows with the same doc_id included. Rows with a null doc_id are
    streamed like the others. Null, empty and short texts lose nothing.
    """
    return _kept(docs, width, "kept_text", bytes.decode)


def digests(docs: DataFrame, width: int = 35) -> DataFrame:
    """``drop_repeated`` with ``kept_sha256`` in place of the text, hashed where the text is."""
    return _kept(docs, width, "kept_sha256", lambda kept: hashlib.sha256(kept).hexdigest())


def _kept(docs: DataFrame, width: int, name: str, finish: Callable[[bytes], str]) -> DataFrame:
    own = keyed(docs)
    places = repeated_ranges(own.select("doc_id", "text", "text_id"), width)
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), (name, pa.string())])

    def remove(batches):
        def rows():
            for batch in batches:
                for doc_id, text, found in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    words = words_of(text)
                    kept = kept_words(words, found) if found else words
                    yield doc_id, len(words), len(words) - len(kept), finish(b" ".join(kept))

        yield from in_batches(rows(), out, weigh=lambda r: len(r[3]))

    joined = own.join(places, ["doc_id", "text_id"], "left").select("own_id", "text", "places")
    return joined.mapInArrow(remove, f"doc_id long, n_words long, n_removed long, {name} string")


def without_repeats(docs: DataFrame, width: int = 35) -> DataFrame:
    """``docs``, all rows and columns, without the words that ``drop_repeated`` removes.

    A text that loses words is its kept words joined by one space; others stay as they are.
    """

    def edit(text, places):
        words = words_of(text)
        kept = kept_words(words, places)
        return b" ".join(kept).decode() if len(kept) < len(words) else text

    text_id = F.xxhash64(F.col("text").cast("string"))
    key = F.struct(F.coalesce(F.col("doc_id").cast("long"), text_id).alias("doc_id"), text_id.alias("text_id"))
    own = keyed(docs).select("doc_id", "text", "text_id")
    notes = repeated_ranges(own, width).select(F.struct("doc_id", "text_id").alias("key"), F.col("places").alias("note"))
    return edited(docs, key, notes, edit)
