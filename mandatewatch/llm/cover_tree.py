"""Exact near-duplicate vectors by a cover tree and its dual traversal.

On unit vectors a cosine of c is a distance of sqrt(2 - 2c). The tree has nested
levels: the children of a node stand for balls of half its radius, their centres
picked farthest-first from a bounded sample of the node's points. Every point
goes to its nearest child, and a ball's covering radius is measured over all its
points, so bounds hold whatever the sample missed. Nodes split until they are
small, in points or in radius.

The traversal starts from the pair (root, root) and opens pairs level by level.
A pair is pruned if the centres are further apart than the threshold plus both
covering radii; if they are nearer than the threshold minus both, all its points
are linked and are counted without being compared. Pairs of leaves left open
meet as blocks, where the same bounds work on smaller balls. Counts are summed
and links leave as spanning stars, so a dense group never becomes a list of pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mandatewatch.llm.common import components, in_batches, written
from mandatewatch.llm.vectors import lengths_of, matrix, units, usable

#: A node of at most this many points is a leaf, and leaves meet in blocks of at most so many.
LEAF_POINTS = 4096
SAMPLE_POINTS = 512
#: Children of a node; a node's number is its parent's times this, plus its own.
FAN = 64
LEVELS = 8
#: Balls inside a block.
BALL_POINTS = 128
ROOT = 1
SLACK = 1e-9
#: Centres are sent to all executors up to this number, else they meet their points in a join.
BROADCAST_CENTRES = 16_384


def net(points: np.ndarray, radius: float, most: int) -> np.ndarray:
    """Farthest-first centres until every point is within ``radius`` of one, or there are ``most``."""
    chosen = [0]
    gap = ((points - points[0]) ** 2).sum(1)
    while len(chosen) < most and gap.max() > radius * radius:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((points - points[chosen[-1]]) ** 2).sum(1))
    return points[chosen]


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of a from all rows of b."""
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0))


def balls(points: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """(members, centre, covering radius) of the balls of a block."""
    centres = net(points[:: max(len(points) // SAMPLE_POINTS, 1)], 0.0, max(-(-len(points) // BALL_POINTS), 1))
    gaps = apart(points, centres)
    own = gaps.argmin(1)
    return [(m, centres[k], float(gaps[m, k].max())) for k in range(len(centres)) if len(m := np.flatnonzero(own == k))]


def linked_rows(a: np.ndarray, b: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows of a reach the cosine with which rows of b, as a matrix; only balls near each other are compared."""
    hits = np.zeros((len(a), len(b)), bool)
    left, right = balls(a), balls(b)
    limit = math.sqrt(max(2 - 2 * cosine, 0))
    gaps = apart(np.array([c for _, c, _ in left]), np.array([c for _, c, _ in right]))
    reach = np.array([r for _, _, r in right])
    for (rows, _, radius), gap in zip(left, gaps, strict=True):
        near = np.flatnonzero(gap <= limit + radius + reach + 1e-6)
        if len(near):
            columns = np.concatenate([right[k][0] for k in near])
            hits[np.ix_(rows, columns)] = a[rows] @ b[columns].T >= cosine
    return hits


def spanning_stars(hits: np.ndarray) -> list[tuple[int, int, bool]]:
    """Edges (seed row, other, other is a column) that connect what the matrix connects."""
    edges = []
    rows_left, columns_left = hits.any(1), np.ones(hits.shape[1], bool)
    for seed in np.flatnonzero(rows_left).tolist():
        if not rows_left[seed]:
            continue
        frontier = np.array([seed])
        rows_left[seed] = False
        while len(frontier):
            columns = np.flatnonzero(hits[frontier].any(0) & columns_left)
            columns_left[columns] = False
            edges += [(seed, c, True) for c in columns.tolist()]
            frontier = np.flatnonzero(hits[:, columns].any(1) & rows_left) if len(columns) else columns
            rows_left[frontier] = False
            edges += [(seed, r, False) for r in frontier.tolist()]
    return edges


def gap_of(a: str, b: str) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(dot)


def chooser(radius: float):
    """Picks the children's centres of a node from its sample, a group of (node, points, id, v)."""

    def centres_of(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        most = min(FAN - 1, max(-(-2 * table.column("points")[0].as_py() // LEAF_POINTS), 2))
        found = net(units(matrix(table.column("v").combine_chunks())), radius, most)
        node = table.column("node")[0].as_py()
        return pa.table({"node": pa.array([node], pa.int64()), "centres": pa.array([found.tolist()], pa.list_(pa.list_(pa.float64())))})

    return centres_of


def grow(points: DataFrame, stop_radius: float) -> tuple[DataFrame, DataFrame]:
    """(points with their leaf, all nodes): points are (id, v, copies); nodes (node, centre, radius, points, leaf)."""
    placed = points.withColumn("node", F.lit(ROOT).cast("long")).withColumn("gap", F.lit(2.0))
    total = points.count()
    spark = points.sparkSession
    seen = [spark.createDataFrame([(ROOT, None, 2.0, total)], "node long, centre array<double>, radius double, points long")]
    counted, level = seen[0], 0
    while level < LEVELS:
        big = counted.filter((F.col("points") > LEAF_POINTS) & (F.col("radius") > stop_radius)).select("node", "points")
        if big.isEmpty():
            break
        level += 1
        radius = 2.0 / 2**level
        chance = F.lit(float(SAMPLE_POINTS)) / F.col("points")
        drawn = placed.join(F.broadcast(big) if level == 1 else big, "node").filter(
            F.pmod(F.xxhash64("id", F.lit(level)), F.lit(1 << 20)) < chance * (1 << 20) + 1
        )

        chosen = drawn.select("node", "points", "id", "v").groupBy("node").applyInArrow(chooser(radius), "node long, centres array<array<double>>")
        chosen = written(chosen, "centres")
        few = (chosen.agg(F.sum(F.size("centres"))).first()[0] or 0) <= BROADCAST_CENTRES

        def descend(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                node, gap = batch.column("node").to_numpy().copy(), batch.column("gap").to_numpy().copy()
                vectors = units(matrix(batch.column("v")))
                groups: dict[int, list[int]] = {}
                for k, number in enumerate(node.tolist()):
                    groups.setdefault(number, []).append(k)
                centres = batch.column("centres")
                for number, members in groups.items():
                    if centres[members[0]].is_valid:
                        gaps = apart(vectors[members], np.array(centres[members[0]].as_py()))
                        own = gaps.argmin(1)
                        node[members] = number * FAN + own + 1
                        gap[members] = gaps[np.arange(len(own)), own]
                columns = [batch.column(c) for c in ("id", "v", "copies")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(node), pa.array(gap)], ["id", "v", "copies", "node", "gap"])

        kind = dict(placed.dtypes)["v"]
        joined = placed.join(F.broadcast(chosen) if few else chosen, "node", "left")
        placed = written(joined.mapInArrow(descend, f"id long, v {kind}, copies long, node long, gap double"), "placed")
        numbered = chosen.select("node", F.posexplode("centres").alias("k", "centre"))
        numbered = numbered.select((F.col("node") * FAN + F.col("k") + 1).alias("node"), "centre")
        sizes = placed.groupBy("node").agg((F.max("gap") + SLACK).alias("radius"), F.count("*").alias("points"))
        counted = written(numbered.join(sizes, "node").select("node", "centre", "radius", "points"), "nodes")
        seen.append(counted)
    nodes = seen[0]
    for more in seen[1:]:
        nodes = nodes.unionByName(more)
    parents = nodes.filter(F.col("node") > ROOT).select(F.floor((F.col("node") - 1) / FAN).cast("long").alias("node")).distinct()
    nodes = nodes.join(parents.withColumn("inner", F.lit(True)), "node", "left").withColumn("leaf", F.col("inner").isNull()).drop("inner")
    return placed, written(nodes, "tree")


def open_pairs(nodes: DataFrame, limit: float) -> DataFrame:
    """(a, b, whole) of leaves, a <= b, that the bounds leave; ``whole`` if all their points are linked."""
    names = ("node", "centre", "radius", "leaf")
    side = lambda x: nodes.select(*(F.col(n).alias(f"{n}_{x}") for n in names))
    child = nodes.filter(F.col("node") > ROOT).withColumn("parent", F.floor((F.col("node") - 1) / FAN).cast("long"))
    below = lambda x: child.select(F.col("parent").alias(x), *(F.col(n).alias(f"{n}_{x}") for n in names))
    own = lambda x: nodes.filter("leaf").select(F.col("node").alias(x), *(F.col(n).alias(f"{n}_{x}") for n in names))
    # The next step of an inner node is its children; a leaf stays.
    step = lambda x: below(x).unionByName(own(x))
    root = nodes.filter(F.col("node") == ROOT).select(F.col("node").alias("a"), F.col("node").alias("b"), F.col("leaf").alias("done"), F.lit(False).alias("whole"))
    done, pairs = root.filter("done").select("a", "b", "whole"), root.filter("not done").select("a", "b")
    for _ in range(LEVELS):
        if pairs.isEmpty():
            break
        both = pairs.join(step("a"), "a").join(step("b"), "b").filter("a <> b OR node_a <= node_b")
        gap = F.when(F.col("node_a") == F.col("node_b"), 0.0).otherwise(gap_of("centre_a", "centre_b"))
        near = both.withColumn("gap", gap).filter(F.col("gap") <= limit + F.col("radius_a") + F.col("radius_b") + 1e-6)
        whole = F.col("gap") + F.col("radius_a") + F.col("radius_b") <= limit - 1e-6
        near = near.select(
            F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"), (F.col("leaf_a") & F.col("leaf_b")).alias("done"), whole.alias("whole")
        )
        near = written(near, "pairs")
        done = done.unionByName(near.filter("done").select("a", "b", "whole"))
        pairs = near.filter("not done").select("a", "b")
    return done


def near_duplicates(rows: DataFrame, cosine: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per input row.

    Vectors are linked if their cosine, in double precision, is ``cosine`` or
    more; only vectors of one length are compared. ``component_id`` is the smallest vec_id reachable over links and
    ``kept`` says whether that is the row itself. Vectors that cannot take part
    (see ``usable``) have no links. Rows with equal vectors, rows sharing a vec_id
    among them, are linked and counted one by one. A null vec_id has no link and
    null in the other columns. An empty table gives no rows.
    """
    good = usable(rows)
    narrow = dict(rows.dtypes)["embedding"] == "array<float>"
    good = good.withColumn("v", F.col("v").cast("array<float>")) if narrow else good
    none = F.lit(0).cast("long")
    taking = good.select("vec_id", none.alias("n_links"), F.col("vec_id").alias("component_id")).limit(0)
    for number, length in enumerate(lengths_of(good)):
        own = _linked(good.filter(F.size("v") == length), cosine)
        taking = taking.unionByName(own) if number else own
    vector = F.transform("embedding", lambda x: x.cast("double")).cast("array<float>" if narrow else "array<double>")
    every = rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("v"))
    out_rows = every.join(good.select("vec_id", "v").distinct().withColumn("takes", F.lit(True)), ["vec_id", "v"], "left")
    outside = out_rows.filter("takes is null").select("vec_id", F.when(F.col("vec_id").isNotNull(), none).alias("n_links"), F.col("vec_id").alias("component_id"))
    return taking.unionByName(outside).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _linked(good: DataFrame, cosine: float) -> DataFrame:
    """(vec_id, n_links, component_id) of vectors of one length."""
    limit = math.sqrt(max(2 - 2 * cosine, 0))
    points = written(good.groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")).select("id", "v", "copies"), "points")
    placed, nodes = grow(points, limit / 4)
    pairs = written(open_pairs(nodes, limit), "leaf-pairs")

    # Blocks of leaves; a leaf of more points than a block, which is narrow then, has several.
    leaves = nodes.filter("leaf").select("node", F.ceil(F.col("points") / LEAF_POINTS).cast("int").alias("blocks"))
    placed = placed.join(leaves, "node").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    placed = written(placed.select("node", "block", "id", "v", "copies"), "leaves")
    compared = pairs.filter("not whole").select("a", "b")
    counts = leaves.select("node", "blocks")
    numbered = compared.join(counts.select(F.col("node").alias("a"), F.col("blocks").alias("n")), "a").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")
    numbered = numbered.join(counts.select(F.col("node").alias("b"), F.col("blocks").alias("n")), "b").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")
    numbered = written(numbered.filter("a <> b OR i <= j").select("a", "i", "b", "j"), "blocks")
    item = ("id", "v", "copies")
    left = numbered.join(placed.select(F.col("node").alias("a"), F.col("block").alias("i"), *item), ["a", "i"])
    right = numbered.join(placed.select(F.col("node").alias("b"), F.col("block").alias("j"), *item), ["b", "j"])
    key = ("a", "i", "b", "j")
    right = right.select(*(F.col(c).alias(c) for c in (*key, *item)))  # columns of its own, for the cogroup
    out = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])

    def compare(keys, one: pa.Table, two: pa.Table) -> pa.Table:
        rows_out: list[tuple] = []
        if one.num_rows and two.num_rows:
            same = keys[0].as_py() == keys[2].as_py() and keys[1].as_py() == keys[3].as_py()
            one = one.sort_by("id")
            two = one if same else two.sort_by("id")
            a, b = units(matrix(one.column("v").combine_chunks())), units(matrix(two.column("v").combine_chunks()))
            hits = linked_rows(a, b, cosine)
            if same:
                np.fill_diagonal(hits, False)
                hits |= hits.T
            id_a, id_b = one.column("id").to_pylist(), two.column("id").to_pylist()
            for ids, n in ((id_a, hits @ two.column("copies").to_numpy()), *(() if same else ((id_b, hits.T @ one.column("copies").to_numpy()),))):
                rows_out += [(ids[k], int(n[k]), None) for k in np.flatnonzero(n).tolist()]
            rows_out += [(id_a[s], 0, (id_b if right_side else id_a)[o]) for s, o, right_side in spanning_stars(hits)]
        return pa.Table.from_batches(list(in_batches(rows_out, out)), out)

    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(compare, "id long, links long, other long")
    found = written(found, "found")

    # Leaves whose points are all linked: counts by node, and a star from the smallest id.
    sure = pairs.filter("whole")
    summary = written(placed.groupBy("node").agg(F.sum("copies").alias("copies"), F.min("id").alias("first")), "summary")
    size = lambda x: summary.select(F.col("node").alias(x), F.col("copies").alias(f"copies_{x}"), F.col("first").alias(f"first_{x}"))
    sure = written(sure.join(size("a"), "a").join(size("b"), "b"), "sure")
    per_node = sure.select(F.col("a").alias("node"), F.col("copies_b").alias("n")).unionByName(
        sure.filter("a <> b").select(F.col("b").alias("node"), F.col("copies_a").alias("n"))
    )
    per_node = per_node.groupBy("node").agg(F.sum("n").alias("n"))
    inner = sure.filter("a = b").select(F.col("a").alias("node"), F.lit(True).alias("inner"))
    # Inside its own leaf a point's copies are taken off here and added for every point below.
    per_point = placed.join(per_node, "node").join(inner, "node", "left")
    per_point = per_point.select("id", (F.col("n") - F.when(F.col("inner"), F.col("copies")).otherwise(0)).alias("links"))
    stars = placed.join(per_node.select("node"), "node").join(summary.select("node", "first"), "node")
    edges = found.filter("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b"))
    edges = edges.unionByName(stars.select(F.col("id").alias("a"), F.col("first").alias("b")))
    edges = edges.unionByName(sure.select(F.col("first_a").alias("a"), F.col("first_b").alias("b")))
    labels = components(edges)
    links = found.select("id", "links").unionByName(per_point).groupBy("id").agg(F.sum("links").alias("links"))
    result = points.join(links, "id", "left").join(labels, "id", "left")
    result = written(
        result.select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")), "result"
    )
    return written(good.join(result, "v").select("vec_id", "n_links", "component_id"), "taking-part")
