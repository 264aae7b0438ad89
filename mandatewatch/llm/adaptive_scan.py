"""Nearest neighbours by cosine: adaptive dimension scan of probed lists.

Vectors are scaled to length 1, turned by a random rotation and dealt to the
lists of centroids that were fitted on a bounded sample. Inside a list they lie
in blocks of columns. A query probes the lists of its nearest centroids and
scans a block of columns at a time: a partial distance over d of D rotated
dimensions estimates the whole one, so a candidate whose estimate is too large
for the query's current k-th best, by a hypothesis test with a margin that
shrinks as 1 / sqrt(d), is abandoned. What stays gets its exact cosine on the
original vectors. Copies of one vector are one candidate with their smallest ids.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mandatewatch.llm.common import in_batches, written
from mandatewatch.llm.vectors import cosines, lengths_of, matrix, units, usable

#: The index is fitted on about this many rows, those with the smallest hashes of vec_id.
SAMPLE_ROWS = 16_384
#: A list for this many rows, as far as the sample has ``ROWS_PER_CENTROID`` rows for each.
LIST_ROWS = 160
ROWS_PER_CENTROID = 16
ROUNDS = 8
#: Share of the lists that a query probes, and the fewest. Neighbours among evenly spread vectors lie in many
#: lists; measured recall is in the README.
PROBED_SHARE, PROBED_LEAST = 0.65, 8
COLUMNS = 16
#: The hypothesis test's margin: larger is safer and slower.
MARGIN = 2.1
#: Rows of a list that are scanned in one task, and queries that scan them together.
BLOCK_ROWS, BLOCK_QUERIES = 2048, 512
SEED = 11


def rotation(n: int, seed: int = SEED) -> np.ndarray:
    """A random rotation; it depends on the number of dimensions only."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, n)))
    return q * np.sign(np.diag(r))


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Centroids by a few rounds of k-means on unit vectors; an empty list takes the worst placed row."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(rounds):
        near = sample @ centres.T
        own, best = near.argmax(1), near.max(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        counts = np.bincount(own, minlength=lists)
        for k, row in zip(np.flatnonzero(counts == 0), np.argsort(best), strict=False):
            sums[k] = sample[row]
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def scan(queries: np.ndarray, rows: np.ndarray, allowed: np.ndarray, k: int, columns: int = COLUMNS, margin: float = MARGIN) -> list[np.ndarray]:
    """Per query (rotated unit vectors) the allowed rows that the tests leave, at least the ``k`` nearest estimated."""
    size = rows.shape[1]
    blocks = [(a, min(a + columns, size)) for a in range(0, size, columns)]
    laid = [np.ascontiguousarray(rows[:, a:b]) for a, b in blocks]
    head = queries[:, : blocks[0][1]]
    start = (laid[0] ** 2).sum(1)[None, :] + (head**2).sum(1)[:, None] - 2 * head @ laid[0].T
    out = []
    for q, estimate, mine in zip(queries, start, allowed, strict=True):
        alive = np.flatnonzero(mine)
        partial = estimate[alive]
        bound = math.inf
        if len(alive) > k:
            # The k best estimates are measured in full and give the distance to beat.
            seeds = alive[np.argpartition(partial, k - 1)[:k]]
            bound = ((rows[seeds] - q) ** 2).sum(1).max()
        for j, (a, b) in enumerate(blocks):
            if j:
                part = laid[j][alive] - q[a:b]
                partial = partial + (part * part).sum(1)
            if b < size:
                good = partial <= bound * (b / size) * (1 + margin / math.sqrt(b)) ** 2
                alive, partial = alive[good], partial[good]
        if len(alive) > k:
            # Whole distances now; equal ones all stay, so that ties go by id.
            alive = alive[partial <= np.partition(partial, k - 1)[k - 1] + 1e-9]
        out.append(alive)
    return out


FOUND = "query_id long, vec_id long, score double"


def search(rows: DataFrame, queries: DataFrame, k: int = 5, probed_share: float = PROBED_SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): up to ``k`` nearest rows of each query, itself left out.

    ``queries`` is a part of ``rows``; both have vec_id and embedding. Vectors
    that cannot take part (see ``usable``) neither ask nor answer; the others
    meet those of their own length. Equal scores
    are ranked by vec_id. Repeated rows count once; other vectors under one
    vec_id are candidates of their own, but not for a query with that id, and the
    smallest of them asks for it. Empty tables give no rows.
    """
    good = usable(rows)
    asked = usable(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    out = good.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for number, length in enumerate(lengths_of(good)):
        own = _search(good.filter(F.size("v") == length), asked.filter(F.size("v") == length), k, probed_share)
        out = out.unionByName(own) if number else own
    return out


def _search(good: DataFrame, asked: DataFrame, k: int, probed_share: float) -> DataFrame:
    """The search among vectors of one length; there is one at least."""
    # Copies: only the k + 1 smallest ids of a vector can ever be in a result.
    same = good.groupBy("v").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    several = good.distinct().join(same.filter("copies > 1").select("v"), "v").withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id")))
    ids = several.filter(F.col("n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    items = same.join(ids, "v", "left").select("vec_id", "v", F.coalesce("ids", F.array("vec_id")).alias("ids"))
    items = written(items, "vectors")

    total, k_found = items.count(), k
    share = min(SAMPLE_ROWS / max(total, 1), 1.0)
    picked = items.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy("vec_id").select("v").collect()
    if not picked:  # few rows, none of them drawn
        picked = items.orderBy("vec_id").select("v").limit(1).collect()
    sample = units(np.array([r.v for r in picked]))
    turn = rotation(sample.shape[1])
    lists = max(min(total // LIST_ROWS, len(sample) // ROWS_PER_CENTROID), 1)
    centres = fit_centroids(sample, lists) @ turn
    probed = min(max(math.ceil(probed_share * lists), PROBED_LEAST), lists)

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                turned = units(matrix(batch.column(1))) @ turn
                near = (turned @ centres.T).argmax(1).astype("i4")
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near)], ["vec_id", "v", "ids", "list"])

    placed = written(items.mapInArrow(place, "vec_id long, v array<double>, ids array<long>, list int"), "lists")

    # Lists are scanned in bundles of about ``BLOCK_ROWS`` rows; a list of more rows is cut into blocks.
    bundles = max(total // BLOCK_ROWS, 1)

    def probe(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            turned = units(matrix(batch.column(1))) @ turn
            near = np.argsort(-(turned @ centres.T), axis=1, kind="stable")[:, :probed]
            which, bundle, lists_of = [], [], []
            for k, own in enumerate(near):
                for name in np.unique(own % bundles).tolist():
                    which.append(k)
                    bundle.append(name)
                    lists_of.append(own[own % bundles == name])
            columns = [batch.column(0).take(pa.array(which)), batch.column(1).take(pa.array(which))]
            columns += [pa.array(bundle, pa.int32()), pa.array(lists_of, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "v", "bundle", "lists"])

    probes = asked.mapInArrow(probe, "vec_id long, v array<double>, bundle int, lists array<int>")
    probes = written(probes, "probes")

    # Blocks of rows meet teams of queries; both plans are bounded by the number of lists, and so by the sample.
    at = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cut = placed.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("cut"))
    cut = written(cut.withColumn("bundle", F.col("list") % bundles), "cut")
    most = cut.groupBy("bundle").agg(F.max("cut").alias("blocks"))
    teams = probes.groupBy("bundle").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("teams"))
    plan = F.broadcast(written(most.join(teams, "bundle"), "bundles"))
    candidates = placed.join(F.broadcast(cut), "list").join(plan, "bundle")
    candidates = candidates.select("bundle", at("cut").alias("block"), every("teams").alias("team"), "vec_id", "v", "ids", "list")
    asking = probes.join(plan, "bundle").select("bundle", every("blocks").alias("block"), at("teams").alias("team"), "vec_id", "v", "lists")

    found = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        rows_out: list[tuple] = []
        if left.num_rows and right.num_rows:
            own = matrix(left.column("v").combine_chunks())
            names, ids = right.column("vec_id").to_pylist(), left.column("ids").to_pylist()
            vectors = matrix(right.column("v").combine_chunks())
            place = left.column("list").to_numpy()
            allowed = np.zeros((len(names), lists), bool)
            for k, chosen in enumerate(right.column("lists").to_pylist()):
                allowed[k, chosen] = True
            # One row more than asked, since a query may find itself.
            left_over = scan(units(vectors) @ turn, units(own) @ turn, allowed[:, place], k_found + 1)
            for name, vector, kept in zip(names, vectors, left_over, strict=True):
                scores = cosines(vector, own[kept]).tolist()
                best = sorted((-s, i) for s, r in zip(scores, kept.tolist(), strict=True) for i in ids[r] if i != name)
                rows_out += [(name, i, -s) for s, i in best[:k_found]]
        return pa.Table.from_batches(list(in_batches(rows_out, found)), found)

    key = ("bundle", "block", "team")
    near = candidates.groupBy(*key).cogroup(asking.groupBy(*key)).applyInArrow(meet, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
