"""Helpers of this subpackage: written tables, components, word arrays, Arrow rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mandatewatch.runtime import scratch_path

#: Most distinct strings that a worker's memo holds; later ones are worked out again each time.
MEMO_ENTRIES = 400_000
#: Most ids that are broadcast; a larger side goes through a shuffled join.
BROADCAST_IDS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, readable after executors are lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def only_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is in ``ids``; the ids are broadcast only if counted to be few."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, key, "left_semi")


#: Links of a node that are followed before the others.
DRAWN_LINKS = 3


def components(edges: DataFrame) -> DataFrame:
    """(id, component): for every id in ``edges`` (a, b), the smallest id it reaches.

    A few links of each node, drawn by hash, connect most of any dense group. Of
    the others only those between different groups are followed then, as links
    of the groups, so a dense group's links are joined once and not in every round.
    """
    links = written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    drawn = both.withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy(F.xxhash64("a", "b"), "b")))
    labels = _reached(drawn.filter(F.col("n") <= DRAWN_LINKS).select("a", "b"))
    own = lambda x: labels.select(F.col("id").alias(x), F.col("component").alias(f"of_{x}"))
    between = links.join(own("a"), "a").join(own("b"), "b").filter("of_a <> of_b")
    between = written(between.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).distinct(), "between")
    if between.isEmpty():
        return labels
    joined = _reached(between).select(F.col("id").alias("component"), F.col("component").alias("least"))
    return labels.join(joined, "component", "left").select("id", F.coalesce("least", "component").alias("component"))


def _reached(edges: DataFrame) -> DataFrame:
    """(id, component) by rounds over all edges.

    Each round takes the smallest label among the neighbours, then that label's
    own label, so chains halve. Joins run between written tables, whose hot keys
    adaptive execution can split.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = written(both.filter("a <> b").distinct(), "links")
    labels = written(links.groupBy(F.col("a").alias("id")).agg(F.least("id", F.min("b")).alias("component")), "labels")
    while True:
        near = labels.select(F.col("id").alias("a"), F.col("component").alias("near"))
        offered = links.join(near, "a").groupBy(F.col("b").alias("id")).agg(F.min("near").alias("near"))
        stepped = written(
            labels.join(offered, "id", "left").select(
                "id", F.col("component").alias("old"), F.least("component", "near").alias("near")
            ),
            "stepped",
        )
        jump = stepped.select(F.col("id").alias("near"), F.col("near").alias("jumped"))
        moved = written(
            stepped.join(jump, "near", "left").select("id", "old", F.least("near", "jumped").alias("component")),
            "labels",
        )
        if moved.filter("component < old").isEmpty():
            return moved.select("id", "component")
        labels = moved.select("id", "component")


_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of one text that are hashed at a time, of short texts together, and the longest word that the running sum serves.
CHUNK, GROUP, SHORT_WORD = 1 << 20, 1 << 16, 64
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_LETTERS = mixed(np.arange(1, 257, dtype=np.uint64))


@lru_cache(maxsize=8)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Runs:
    """Hashes of runs of a sequence of 64-bit items, each from two places of one running sum."""

    def __init__(self, items: np.ndarray):
        size = max(1 << max(len(items), 1).bit_length(), 4096)
        self.total = np.zeros(len(items) + 1, np.uint64)
        np.cumsum(items * _powers(_BASE, size)[: len(items)], out=self.total[1:])
        self.back = _powers(_INVERSE, size)

    def hash(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.total[stop] - self.total[start]) * self.back[start] + (stop - start).astype(np.uint64))

    def grams(self, n: int) -> np.ndarray:
        """Hashes of all runs of ``n`` items; none if there are fewer."""
        count = max(len(self.total) - n, 0)
        return mixed((self.total[n : n + count] - self.total[:count]) * self.back[:count] + np.uint64(n))


def _chunks(data: bytes) -> Iterator[bytes]:
    """The text in parts of about ``CHUNK`` bytes, cut at white space."""
    at = 0
    while at < len(data):
        to = min(at + CHUNK, len(data))
        while to < len(data) and not _SPACE[data[to]]:
            to += 1
        yield data[at:to]
        at = to


def _hashed(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of a chunk and where it starts."""
    raw = np.frombuffer(data, np.uint8)
    outside = np.ones(len(raw) + 2, bool)
    outside[1:-1] = _SPACE[raw]
    edges = np.flatnonzero(outside[1:] != outside[:-1])
    start, stop = edges[::2], edges[1::2]
    long = np.flatnonzero(stop - start > SHORT_WORD)
    ids = Runs(_LETTERS[raw]).hash(start, stop)
    # Long words could be made to collide in a running sum.
    for k in long.tolist():
        ids[k] = xxhash.xxh3_64_intdigest(data[start[k] : stop[k]])
    return ids, start


def word_ids(texts: Iterable[bytes]) -> Iterator[np.ndarray]:
    """Per text the 64-bit hashes of its words ``[^\x20\x09-\x0D]+``, in order; short texts are hashed together."""
    group, load = [], 0
    for data in chain(texts, [None]):
        if group and (data is None or load + len(data) > GROUP):
            ids, start = _hashed(b" ".join(group)) if load <= CHUNK else (np.concatenate([_hashed(c)[0] for c in _chunks(group[0])]), None)
            if start is None:
                yield ids
            else:
                ends = np.cumsum([len(d) + 1 for d in group])
                yield from np.split(ids, np.searchsorted(start, ends)[:-1])
            group, load = [], 0
        if data is not None:
            group.append(data)
            load += len(data)


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``: bytes.split() cuts at exactly these six characters."""
    return text.encode().split() if text else []


def runs_of(batches: Iterable[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[np.ndarray]]]:
    """(key, columns) of each run of rows with equal integer keys in sorted batches; lists of equal length become matrices."""

    def plain(column) -> np.ndarray:
        if pa.types.is_list(column.type):
            flat = column.flatten().to_numpy(zero_copy_only=False)
            return flat.reshape(len(column), -1)
        return column.to_numpy(zero_copy_only=False)

    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [plain(c) for c in batch.columns]
        if held is not None:
            columns = [np.concatenate([a, b]) for a, b in zip(held, columns, strict=True)]
        edge = np.zeros(len(columns[0]) - 1, bool)
        for k in columns[:n_keys]:
            edge |= k[1:] != k[:-1]
        starts = [0, *(np.flatnonzero(edge) + 1).tolist()]
        for a, b in zip(starts, starts[1:], strict=False):
            yield tuple(int(k[a]) for k in columns[:n_keys]), [c[a:b] for c in columns[n_keys:]]
        held = [c[starts[-1] :] for c in columns]
    if held is not None:
        yield tuple(int(k[0]) for k in held[:n_keys]), held[n_keys:]


def arrow_rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def in_batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 4096, weigh=None, heavy: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most ``size`` rows, or of about ``heavy`` bytes by ``weigh``."""
    held, load = [], 0
    for row in rows:
        held.append(row)
        load += weigh(row) if weigh else 0
        if len(held) >= size or load >= heavy:
            yield arrow_rows(held, schema)
            held, load = [], 0
    if held:
        yield arrow_rows(held, schema)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Each name, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def edited(docs: DataFrame, key: Column, notes: DataFrame, edit: Callable) -> DataFrame:
    """The rows of ``docs``, all columns, with ``edit(text, note)`` as text where there is a note.

    ``notes`` has the columns (key, note). Where a text changes and there is a
    column ``n_chars``, it takes the new length.
    """
    schema = docs.schema
    own_key, own_note = fresh(docs, "key", "note")
    keyed = docs.withColumn(own_key, key)
    noted = keyed.join(notes.select(F.col("key").alias(own_key), F.col("note").alias(own_note)), own_key, "left")
    text_at = schema.names.index("text")
    count_at = schema.names.index("n_chars") if "n_chars" in schema.names else None

    def run(batches):
        for batch in batches:
            columns = list(batch.columns[:-1])
            texts, new = columns[text_at].to_pylist(), None
            counts = columns[count_at].to_pylist() if count_at is not None else None
            for k, note in enumerate(batch.columns[-1].to_pylist()):
                if note is not None:
                    new = new or list(texts)
                    new[k] = edit(texts[k], note)
                    if counts is not None and new[k] != texts[k]:
                        counts[k] = len(new[k])
            if new is not None:
                columns[text_at] = pa.array(new, columns[text_at].type)
                if counts is not None:
                    columns[count_at] = pa.array(counts, columns[count_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return noted.select(*(F.col(f"`{n}`") for n in schema.names), own_note).mapInArrow(run, schema)


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x
