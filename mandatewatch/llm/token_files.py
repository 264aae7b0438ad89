"""Token ids in shard files with Elias-Fano document boundaries.

A shard is one binary value: a header, the boundaries of its documents in
Elias-Fano form, and the ids of all its documents one after another in two or
four bytes each. Boundary k is the number of ids before document k; of its
value the low bits stand in a packed array, the high bits in a bit vector with
one 1 per boundary, at position high + k. ``select`` finds the k-th 1 from a
table of every 64th and a scan of at most a few words, so an offset costs no
64-bit table. Shards are written by Spark as Parquet rows (part, shard,
payload), which any store that Spark reaches can hold.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mandatewatch.llm.byte_bpe import byte_bpe, vocabulary_path
from mandatewatch.llm.common import in_batches
from mandatewatch.runtime import scratch_path

MAGIC = b"EFT1"
HEADER = struct.Struct("<4sBBHQQQ")
#: A shard is closed when it holds this many ids or documents.
SHARD_IDS = 1 << 20
SHARD_DOCS = 1 << 16
SELECT_STEP = 64
SHARDS = "part int, shard int, n_ids long, doc_ids array<long>, payload binary"
SHARDS_ARROW = pa.schema(
    [("part", pa.int32()), ("shard", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("payload", pa.binary())]
)


@dataclass
class EliasFano:
    """A non-decreasing sequence of integers in near-minimal space, with random access."""

    size: int
    low_bits: int
    low: bytes
    high: bytes

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max((top // n).bit_length() - 1, 0) if n else 0
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        spread = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        return cls(n, low_bits, np.packbits(spread.astype(np.uint8), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes())

    def __post_init__(self):
        self._words = np.frombuffer(self.high + bytes(-len(self.high) % 8), "<u8")
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(self._words).astype(np.int64))])
        self._before = before
        self._samples = np.searchsorted(before, np.arange(0, max(self.size, 1), SELECT_STEP), "right") - 1

    def select(self, k: int) -> int:
        """The position of the k-th 1 of the high bits."""
        word = int(self._samples[k // SELECT_STEP])
        while self._before[word + 1] <= k:
            word += 1
        bits, left = int(self._words[word]), k - int(self._before[word])
        for _ in range(left):
            bits &= bits - 1
        return 64 * word + (bits & -bits).bit_length() - 1

    def __getitem__(self, k: int) -> int:
        if not 0 <= k < self.size:
            raise IndexError(k)
        at = k * self.low_bits
        chunk = int.from_bytes(self.low[at // 8 : (at + self.low_bits + 7) // 8], "little") >> (at % 8)
        return ((self.select(k) - k) << self.low_bits) | (chunk & ((1 << self.low_bits) - 1))

    def at(self, k: np.ndarray) -> np.ndarray:
        """The values at places ``k``, each found by select."""
        k = np.asarray(k, np.int64)
        if len(k) and (k.min() < 0 or k.max() >= self.size):
            raise IndexError(k)
        word = self._samples[k // SELECT_STEP] if len(k) else k
        behind = np.flatnonzero(self._before[word + 1] <= k) if len(k) else k
        while len(behind):
            word[behind] += 1
            behind = behind[self._before[word[behind] + 1] <= k[behind]]
        bits, left = self._words[word], k - self._before[word]
        more = np.flatnonzero(left)
        while len(more):
            bits[more] &= bits[more] - np.uint64(1)
            left[more] -= 1
            more = more[left[more] > 0]
        ones = 64 * word + np.bitwise_count((bits & (~bits + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        place = k[:, None] * self.low_bits + np.arange(self.low_bits)
        low = (np.frombuffer(self.low + b"\0", np.uint8)[place >> 3] >> (place & 7).astype(np.uint8)) & 1
        return ((ones - k) << self.low_bits) | (low.astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64)))

    def all(self) -> np.ndarray:
        """Every value, decoded in one pass."""
        if not self.size:
            return np.empty(0, np.int64)
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.size]
        bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.size * self.low_bits]
        low = bits.reshape(self.size, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return ((ones - np.arange(self.size)) << self.low_bits) | low


def shard_bytes(documents: list[bytes]) -> bytes:
    """The payload of documents given as little-endian 32-bit ids."""
    ends = EliasFano.of(np.concatenate([[0], np.cumsum([len(d) // 4 for d in documents])]))
    ids = np.frombuffer(b"".join(documents), "<u4")
    wide = 4 if len(ids) and int(ids.max()) > 0xFFFF else 2
    header = HEADER.pack(MAGIC, wide, ends.low_bits, 0, ends.size, len(ends.low), len(ends.high))
    return b"".join([header, ends.low, ends.high, ids.astype("<u4" if wide == 4 else "<u2").tobytes()])


class Shard:
    """A payload opened for reading: document k is ids[boundary k : boundary k + 1]."""

    def __init__(self, payload: bytes):
        magic, wide, low_bits, _, size, n_low, n_high = HEADER.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = HEADER.size
        self.boundaries = EliasFano(size, low_bits, payload[at : at + n_low], payload[at + n_low : at + n_low + n_high])
        self.ids = np.frombuffer(payload, "<u4" if wide == 4 else "<u2", offset=at + n_low + n_high)

    def __len__(self) -> int:
        return self.boundaries.size - 1

    def document(self, k: int) -> np.ndarray:
        return self.ids[self.boundaries[k] : self.boundaries[k + 1]]


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 0) -> None:
    """Encodes every document, ``end_id`` after it, into shards in ascending doc_id order.

    Null doc_ids come first, equal doc_ids in the order of their texts, and a
    null or empty text is the end id alone. An empty table gives no shard.
    """
    vocabulary = vocabulary or vocabulary_path()
    end = np.array([end_id], "<u4").tobytes()

    def shards(batches):
        encoder, part = byte_bpe(vocabulary), TaskContext.get().partitionId()

        def rows() -> Iterator[tuple]:
            number, doc_ids, held, n_ids = 0, [], [], 0
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    doc_ids.append(doc_id)
                    held.append(encoder.encode(text) + end)
                    n_ids += len(held[-1]) // 4
                    if n_ids >= SHARD_IDS or len(held) >= SHARD_DOCS:
                        yield part, number, n_ids, doc_ids, shard_bytes(held)
                        number, doc_ids, held, n_ids = number + 1, [], [], 0
            if held:
                yield part, number, n_ids, doc_ids, shard_bytes(held)

        yield from in_batches(rows(), SHARDS_ARROW, 1)

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ordered = own.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(shards, SHARDS).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), ids, in no particular order."""
    return _documents(spark, path, "doc_id long, start long, ids array<int>", lambda doc_id, start, ids: (doc_id, start, ids.astype("i4")))


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document, read from the shards: doc_id, start, n_tokens, ids_crc32 (over 32-bit ids)."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return _documents(spark, path, schema, lambda doc_id, start, ids: (doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))


def _documents(spark: SparkSession, path: str, schema: str, row) -> DataFrame:
    shards = spark.read.schema(SHARDS).parquet(path)
    within = Window.partitionBy("part").orderBy("shard")
    counts = shards.select("part", "shard", "n_ids").withColumn("before", F.sum("n_ids").over(within) - F.col("n_ids"))
    # One total per written partition: the driver adds up as many numbers as there were tasks.
    totals = sorted(shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    bases, at = [], 0
    for part, n in totals:
        bases.append((part, at))
        at += n
    bases = F.broadcast(spark.createDataFrame(bases, "part int, base long"))
    starts = counts.join(bases, "part").select("part", "shard", (F.col("base") + F.col("before")).alias("first"))
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "array<int>": pa.list_(pa.int32())}
    arrow = pa.schema([(n, kinds[f.split()[1]]) for n, f in zip(names, schema.split(", "), strict=True)])

    def decode(batches):
        def rows():
            for batch in batches:
                for first, doc_ids, payload in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    shard = Shard(payload)
                    edges = shard.boundaries.at(np.arange(len(shard) + 1)).tolist()
                    for doc_id, a, b in zip(doc_ids, edges, edges[1:], strict=False):
                        yield row(doc_id, first + a, shard.ids[a:b])

        yield from in_batches(rows(), arrow)

    joined = shards.join(starts, ["part", "shard"]).select("first", "doc_ids", "payload")
    return joined.mapInArrow(decode, schema)


def token_shards(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Writes the shards into the shared folder and returns their index."""
    path = scratch_path(docs.sparkSession, "token-shards")
    write_tokens(docs, path, vocabulary)
    return token_index(docs.sparkSession, path)
