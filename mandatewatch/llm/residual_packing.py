"""Best-fit packing of token pieces by hierarchical residual merging.

Every input partition packs its pieces best-fit, largest first, and emits the
bins that are nearly full. Underfull bins go on as items of their own: they are
dealt to an eighth of the partitions, or to as many as hold ``TASK_BINS`` each,
and packed again, until one partition is left or a round over the same number of
partitions joins next to none any more. So no task gets more than about
``TASK_BINS`` bins, and none leaves before it has met others. Only pieces' places
travel, never their ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mandatewatch.llm.byte_bpe import byte_bpe, vocabulary_path
from mandatewatch.llm.common import in_batches, written

CAPACITY = 2048
#: A bin with at most this share of its room left is emitted at once.
NEARLY_FULL = 0.004
FAN_IN = 8
TASK_BINS = 8192
#: The rounds end when one leaves more than this share of its bins as they were.
STALLED = 63 / 64

#: One piece inside a bin.
MEMBER = np.dtype([("known", "u1"), ("doc_id", "<i8"), ("piece", "<i4"), ("start", "<i8"), ("length", "<i4"), ("crc", "<u4")])
BINS = "fill int, done boolean, members binary"
BINS_ARROW = pa.schema([("fill", pa.int32()), ("done", pa.bool_()), ("members", pa.binary())])
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, offset long, sequence_id long"


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Groups of item numbers, largest item first, each into the open bin with least room left that fits.

    Bins are kept by their room; a bit mask of the rooms in use finds the
    smallest that is large enough.
    """
    by_room: dict[int, list[list[int]]] = {}
    mask = 0
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        fitting = mask >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            held = by_room[room].pop()
            if not by_room[room]:
                mask &= ~(1 << room)
        else:
            room, held = capacity, []
        held.append(k)
        by_room.setdefault(room - size, []).append(held)
        mask |= 1 << (room - size)
    return [held for bins in by_room.values() for held in bins]


def pack_items(items: list[tuple[int, bytes]], capacity: int, last: bool) -> Iterator[tuple[int, bool, bytes]]:
    """Bins of (fill, members) items; nearly full ones are done, and in the last round all."""
    enough = capacity - int(NEARLY_FULL * capacity)
    for held in best_fit(np.array([fill for fill, _ in items], np.int64), capacity):
        fill = sum(items[k][0] for k in held)
        yield fill, last or fill >= enough, b"".join(items[k][1] for k in held)


def cut_pieces(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc): full pieces at the end, what is left over first."""
    total = len(ids) // 4
    at, piece = 0, 0
    step = total % capacity or capacity
    while at < total:
        yield piece, at, step, zlib.crc32(ids[4 * at : 4 * (at + step)])
        at, piece, step = at + step, piece + 1, capacity


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = 0) -> DataFrame:
    """One row per piece of each document, with its sequence and its place there.

    A document's ids are followed by ``end_id``; a null or empty text is that id
    alone. Rows with the same doc_id are packed as separate documents. A null
    doc_id stays null. An empty table gives no rows. Only doc_id and text are read.
    """
    vocabulary = vocabulary or vocabulary_path()
    end = np.array([end_id], "<u4").tobytes()

    def first(batches):
        encoder, items = byte_bpe(vocabulary), []

        def rows():
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for piece, start, length, crc in cut_pieces(encoder.encode(text) + end, capacity):
                        member = np.array([(doc_id is not None, doc_id or 0, piece, start, length, crc)], MEMBER).tobytes()
                        if length == capacity:
                            yield length, True, member
                        else:
                            items.append((length, member))
            yield from pack_items(items, capacity, False)

        yield from in_batches(rows(), BINS_ARROW)

    def again(last):
        def run(batches):
            items = [(f, m) for b in batches for f, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield from in_batches(pack_items(items, capacity, last), BINS_ARROW)

        return run

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    bins = written(own.mapInArrow(first, BINS), "bins")
    done = bins.filter("done")
    left = bins.filter("not done")
    parts, n_left, stalled = bins.select(F.spark_partition_id().alias("p")).distinct().count(), left.count(), False
    while True:
        before, parts = parts, max(-(-parts // FAN_IN), -(-n_left // TASK_BINS), 1)
        last = parts == 1 or stalled
        dealt = left.select("fill", "members").repartition(parts, F.xxhash64("members"))
        merged = written(dealt.mapInArrow(again(last), BINS), "bins")
        done = done.unionByName(merged.filter("done"))
        if last:
            break
        left = merged.filter("not done")
        held, n_left = n_left, left.count()
        stalled = parts >= before and n_left > STALLED * held

    def spread(batches):
        for batch in batches:
            for sequence, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = np.frombuffer(members, MEMBER)
                lengths = rows["length"].astype("i8")
                columns = {
                    "doc_id": pa.array(rows["doc_id"], pa.int64(), mask=rows["known"] == 0),
                    "piece": rows["piece"],
                    "start": rows["start"],
                    "length": lengths,
                    "ids_crc32": rows["crc"].astype("i8"),
                    "offset": np.cumsum(lengths) - lengths,
                    "sequence_id": np.full(len(rows), sequence, "i8"),
                }
                yield pa.RecordBatch.from_pydict(columns)

    numbered = done.select(F.monotonically_increasing_id().alias("sequence_id"), "members")
    return numbered.mapInArrow(spread, PIECES)
