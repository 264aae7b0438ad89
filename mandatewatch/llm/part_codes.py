"""Vector code compression: each vector as eight codebook entries, found along a lexicographic trie.

Vectors are scaled to integers and cut into parts. The distinct parts of a
position, sorted, are the leaves of a trie with a component per level; going
down depth first, the squared distances to all codebook entries are accumulated,
so parts with a common prefix share them. A leaf takes the nearest entry and adds
its components, by its number of copies, to that entry's sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mandatewatch.llm.common import BROADCAST_IDS, written

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Leaves that are finished level by level, all their nodes of a level at once.
BUNDLE = 8192
#: Distinct parts that make one trie; a prefix on the border of two tries is worked out in both.
TRIE_PARTS = 1 << 16
#: Largest integer component: sums of squared differences then fit a long for vectors of up to 2,048 components.
LARGEST = 1 << 25


def integers(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, q) of the vectors that take part, q as floor(4096 x) per component.

    Left out: null vectors and those with a null or non-finite component. An
    empty vector stays, with empty parts.
    """
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    own = rows.select(F.col(key).alias("vec_id"), F.col(label).alias("label"), x.alias("x")).filter("x is not null")
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return own.filter(F.coalesce(finite, F.lit(False))).select("vec_id", "label", F.transform("x", lambda c: F.floor(c * float(SCALE))).alias("q"))


def borders(dims: int) -> list[int]:
    """Where the parts begin and end: equal parts, or as equal as can be where 8 does not divide the length."""
    return [k * dims // PARTS for k in range(PARTS + 1)]


def _descended(parts: np.ndarray, book: np.ndarray, depth: int, shared: np.ndarray) -> np.ndarray:
    """Distances of sorted distinct parts to all entries, from nodes of each level at once."""
    n, width = parts.shape
    first = np.full(n, depth)  # the first level on which a part leaves the path of the one before
    if n > 1 and depth < width:
        first[1:] = depth + (parts[1:, depth:] != parts[:-1, depth:]).argmax(axis=1)
    held, node = shared[None, :], np.zeros(n, int)
    for level in range(depth, width):
        starts = np.flatnonzero(first <= level)
        held = held[node[starts]] + (parts[starts, level, None] - book[None, :, level]) ** 2
        node = np.zeros(n, int)
        node[starts[1:]] = 1
        node = np.cumsum(node)
    return held[node]


def walk(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest entry, squared distance) of each part, ties to the lower index.

    ``parts`` are distinct and sorted by their components. Depth first: a subtree
    of more than ``BUNDLE`` leaves goes down on its own with its accumulated
    distances; its smaller siblings next to each other are finished together.
    """
    n, width = parts.shape
    entry, far = np.zeros(n, np.int64), np.zeros(n, np.int64)
    stack = [(0, 0, n, np.zeros(len(book), np.int64))]
    while stack:
        depth, low, high, shared = stack.pop()
        if high - low <= BUNDLE or depth == width:
            held = _descended(parts[low:high], book, depth, shared)
            entry[low:high] = held.argmin(axis=1)
            far[low:high] = held.min(axis=1)
            continue
        column = parts[low:high, depth]
        edges = np.append(np.append(0, np.flatnonzero(column[1:] != column[:-1]) + 1), high - low) + low
        start = low
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b - a > BUNDLE:
                if start < a:
                    stack.append((depth, start, a, shared))
                stack.append((depth + 1, a, b, shared + (parts[a, depth] - book[:, depth]) ** 2))
                start = b
            elif b - start > BUNDLE:
                stack.append((depth, start, a, shared))
                start = a
        if start < high:
            stack.append((depth, start, high, shared))
    return entry, far


def _sorted_distinct(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order, and for each row its place among them."""
    n, width = parts.shape
    if not width:
        return parts[: min(n, 1)], np.zeros(n, int)
    order = np.lexsort(parts.T[::-1])
    rows = parts[order]
    new = np.append(True, (rows[1:] != rows[:-1]).any(axis=1))
    at = np.empty(n, int)
    at[order] = np.cumsum(new) - 1
    return rows[new], at


@dataclass(frozen=True)
class Codebooks:
    """Entries of each part's codebook, for vectors of one length."""

    dims: int
    books: list[np.ndarray]

    def sha256(self) -> str:
        """Hash of all components by part, entry and position, as decimals with commas between."""
        return hashlib.sha256(",".join(str(int(x)) for book in self.books for x in book.ravel()).encode()).hexdigest()

    def encode(self, q: DataFrame) -> DataFrame:
        """(vec_id, label, code, error) of vectors of this length; each batch is a trie of its own, so nothing is shuffled."""
        books, cuts, dims = self.books, borders(self.dims), self.dims
        schema = pa.schema([("code", pa.string()), ("error", pa.int64())])
        kept = [f"{f.name} {f.dataType.simpleString()}" for f in q.schema if f.name != "q"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, dims)
                code, error = np.zeros((len(x), PARTS), np.uint8), np.zeros(len(x), np.int64)
                for p, book in enumerate(books):
                    rows, at = _sorted_distinct(x[:, cuts[p] : cuts[p + 1]])
                    entry, far = walk(rows, book)
                    code[:, p] = entry[at]
                    error += far[at]
                columns = [batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error)]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", *schema.names])

        return q.select("vec_id", "label", "q").mapInArrow(run, ", ".join([*kept, "code string", "error long"]))

    def decode(self, coded: DataFrame, code: str = "code") -> DataFrame:
        """The rows with ``approximation`` array<double>: their entries, scaled back. Null codes give null."""
        whole = F.lit(None).cast("array<double>")
        if self.books and len(self.books[0]):
            books = [F.array(*[F.array(*[F.lit(float(v) / SCALE) for v in e]).cast("array<double>") for e in b.tolist()]) for b in self.books]
            at = [F.conv(F.substring(F.col(code), 2 * p + 1, 2), 16, 10).cast("int") for p in range(PARTS)]
            whole = F.when(F.col(code).isNotNull(), F.concat(*[F.get(b, a) for b, a in zip(books, at, strict=True)]))
        return coded.withColumn("approximation", whole)


def distinct_parts(q: DataFrame, dims: int) -> DataFrame:
    """(part, x, n): the distinct parts of each position with their numbers of copies, written in sorted ranges.

    Copies are counted before they are shuffled, so a vector that stands very
    often is one row of each task.
    """
    cuts = borders(dims)
    pieces = F.array(*[F.slice(F.col("q"), cuts[p] + 1, cuts[p + 1] - cuts[p]).cast("array<int>") for p in range(PARTS)])
    counted = q.select(F.posexplode(pieces).alias("part", "x")).filter("size(x) > 0").groupBy("part", "x").agg(F.count("*").alias("n"))
    return written(counted.repartitionByRange("part", "x").sortWithinPartitions("part", "x"), "parts")


def _tries(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(part, rows, copies) of consecutive rows of one part, at most ``TRIE_PARTS`` and a batch of them."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    load, part = 0, None

    def joined():
        return part, np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])

    for batch in batches:
        own = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            if held and (part != own[a] or load >= TRIE_PARTS):
                yield joined()
                held, load = [], 0
            part = int(own[a])
            x = batch.column(1).slice(a, b - a).flatten().to_numpy().reshape(b - a, -1)
            held.append((x.astype(np.int64), batch.column(2).slice(a, b - a).to_numpy()))
            load += b - a
    if held:
        yield joined()


def _round(parts: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one assignment; only sums per entry and component reach the driver."""
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("dim", pa.int32()), ("n", pa.int64()), ("total", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for part, x, n in _tries(batches):
            count, total = sums.setdefault(part, (np.zeros(len(books[part]), np.int64), np.zeros(books[part].shape, np.int64)))
            entry, _ = walk(x, books[part])
            np.add.at(count, entry, n)
            np.add.at(total, entry, x * n[:, None])
        for part, (count, total) in sums.items():
            entry, dim = np.indices(total.shape)
            flat = [np.full(total.size, part), entry.ravel(), dim.ravel(), np.broadcast_to(count[:, None], total.shape).ravel(), total.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(flat, schema, strict=True)], schema=schema)

    found = parts.mapInArrow(run, "part int, entry int, dim int, n long, total long")
    out = [book.copy() for book in books]
    # 16 rows per component at most.
    for r in found.groupBy("part", "entry", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        if r.n:
            out[r.part][r.entry, r.dim] = r.total // r.n
    return out


def seeds(q: DataFrame) -> np.ndarray:
    """The integers of the 16 smallest ids in order, null as the largest; of an id that repeats, the smallest vector."""
    least = q.select("vec_id").distinct().orderBy(F.col("vec_id").asc_nulls_last()).limit(ENTRIES)
    own = q.join(F.broadcast(least.withColumnRenamed("vec_id", "least")), F.col("vec_id").eqNullSafe(F.col("least")))
    rows = own.groupBy("vec_id").agg(F.min("q").alias("q")).collect()
    return np.array([r.q for r in sorted(rows, key=lambda r: (r.vec_id is None, r.vec_id))], np.int64)


def fit(q: DataFrame, dims: int, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of all vectors of one length."""
    cuts, first = borders(dims), seeds(q)
    books = [first.reshape(len(first), dims)[:, cuts[p] : cuts[p + 1]] for p in range(PARTS)]
    if dims:
        parts = distinct_parts(q, dims)
        for _ in range(rounds):
            books = _round(parts, books)
    return Codebooks(dims, books)


def compress(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, code, error, codebooks_sha256) of every vector that takes part.

    Vectors of different lengths have codebooks of their own, fitted one length
    after the other; with fewer than 16 ids there are fewer entries. Repeated
    rows count as often as they stand. Components beyond 8,192 are an error:
    sums of their squares would not fit a long. An empty table gives no rows.
    """
    q = integers(rows, key, vector, label)
    largest = F.max(F.array_max(F.transform("q", lambda c: F.abs(c))))
    lengths = q.groupBy(F.size("q").alias("dims")).agg(largest.alias("largest")).orderBy("dims").collect()
    out = q.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit("").alias("codebooks_sha256")).limit(0)
    for number, r in enumerate(lengths):
        if (r.largest or 0) > LARGEST:
            raise ValueError(f"a component of {r.largest / SCALE} is beyond {LARGEST // SCALE}")
        own = q.filter(F.size("q") == r.dims)
        books = fit(own, r.dims)
        coded = books.encode(own).withColumn("codebooks_sha256", F.lit(books.sha256()))
        out = out.unionByName(coded) if number else coded
    return out


def with_label_errors(coded: DataFrame) -> DataFrame:
    """The rows with the summed error of their label, nulls together; sums are broadcast only if counted to be few."""
    coded = written(coded, "coded")
    sums = written(coded.groupBy(F.col("label").alias("its_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    few = sums.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return coded.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("its_label"))).drop("its_label")
