"""Exact Jaccard join of documents by their word n-grams, as a metric-space join.

1 - Jaccard is a metric. Unrelated documents all lie at a distance near 1 from
each other, so pivots alone would copy every document into every region; the
first split is therefore an exact one by content: the n-grams are dealt to so
many parts that two linked sets, which differ in fewer members than there are
parts, are equal in one of them. Documents equal in a part form a region. Inside
the regions pivots take over:

1. Equal sets become one node. In the regions of its smallest hashes each node
   meets a pivot; the nearest one within the threshold takes the node into its
   Voronoi cell, at a known distance, and is linked with it.
2. Regions are then joined cell by cell, in blocks. By the triangle inequality
   two cells whose pivots are further apart than the threshold plus both radii
   hold no linked pair. First each cell meets its likeliest partner, then all
   others that are not in its component yet.
3. Cells that are neither pruned nor linked yet are opened: a document goes to
   the other cell only if its distance from its own pivot puts it into the
   window along the border, and the pairs are compared exactly.

A histogram of each set, over hash buckets, bounds the similarity from above
without the sets, so only near pairs ever become rows and are compared. Pivots
that share a region get a finer one: in a family of texts just below the
threshold a coarse bound would let nearly all pairs through. Regions of the same
cells are one. Sets are worked out again from the texts of the documents that
take part, and meet their pivot in a sorted stream; none is collected.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mandatewatch.llm.common import BROADCAST_IDS, Runs, components, fresh, in_batches, mixed, only_ids, runs_of, signed, word_ids, written

#: Sets of sizes from s to this many times s are dealt to the same number of parts.
SIZE_CLASS = 1.5
#: Parts beyond those needed, at least, so that most sets can leave out their empty ones.
EMPTY_PARTS = 3
#: Smallest hashes by which a node looks for a pivot.
SKETCH = 3
BUCKETS = 64
#: Buckets of a pivot in a shared region, a multiple of the others.
FINE_BUCKETS = 256
#: Rows of one pivot that meet in one stream; a pivot with more gets several.
STREAM_ROWS = 512
#: Rows of a region, or of a host cell, that meet at a time.
BLOCK_ROWS = 512
SLACK = 1e-9


def shingles(texts: list[str | None], n: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct n-grams of its words, A-Z in lower case; the whole sequence if it is shorter."""
    for words in word_ids((t or "").encode().lower() for t in texts):
        yield np.unique(Runs(words).grams(min(n, len(words)))) if len(words) else words


def set_id(members: np.ndarray) -> int:
    return signed(xxhash.xxh3_64_intdigest(members.tobytes()))


@lru_cache(maxsize=1)
def size_classes() -> list[int]:
    """The smallest size of each class, and one beyond the last."""
    out = [1]
    while out[-1] < 1 << 48:
        out.append(max(out[-1] + 1, int(out[-1] * SIZE_CLASS)))
    return out


def part_ids(found: np.ndarray, percent: int) -> np.ndarray:
    """The regions of a set: for each part the hash of what it holds, with the part and the class.

    A set is dealt by its own class, and by the one below if a smaller set that
    is linked with it can be there. A pair meets in the class of the smaller. Of
    sizes a and b linked sets differ in at most (a + b)(100 - percent) / (100 +
    percent) members, so with one part more they are equal in one. Parts that
    are empty would bring unrelated sets together: there are some parts beyond
    that, and a set with no more empty ones than those shows none of them.
    """
    size, classes = len(found), size_classes()
    own = bisect_right(classes, size) - 1
    least = -(-percent * size // 100)
    # The share of parts that are empty in the smallest sets of a class, twice.
    slack = 2 * math.exp(-(100 + percent) / (100 - percent) / (1 + 100 / percent) / SIZE_CLASS)
    weight, place, out = mixed(found), found >> np.uint64(32), []
    for k in range(bisect_right(classes, least) - 1, own + 1):
        most = classes[k + 1] - 1
        apart = (most + 100 * most // percent) * (100 - percent) // (100 + percent)
        spare = EMPTY_PARTS + int(slack * apart) if apart else 0
        parts = apart + 1 + spare
        held = np.zeros(parts, np.uint64)
        at = (place * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        np.add.at(held, at, weight)
        ids = mixed(held + mixed(np.arange(parts, dtype=np.uint64) + np.uint64(k << 40)))
        filled = np.bincount(at, minlength=parts) > 0
        out.append(ids[filled] if parts - filled.sum() <= spare else ids)
    return np.concatenate(out)


def sketch(found: np.ndarray) -> list[int]:
    """The smallest hash of the set under each of a few hash functions."""
    return [signed(int(mixed(found ^ np.uint64(k << 8)).min())) for k in range(1, SKETCH + 1)]


def histogram(found: np.ndarray, buckets: int) -> np.ndarray:
    """How many members of the set fall into each bucket."""
    return np.bincount((found & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets).astype("i4")


def described(own: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc_id, text_id, n, node, keys, parts, histogram) per row: its set's size, id, sketch, regions and bucket counts."""
    arrow = pa.schema(
        [("doc_id", pa.int64()), ("text_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64())]
        + [("keys", pa.list_(pa.int64())), ("parts", pa.list_(pa.int64())), ("histogram", pa.list_(pa.int32()))]
    )

    def run(batches):
        def rows():
            for batch in batches:
                sets = shingles(batch.column(1).to_pylist(), n)
                for doc_id, text_id, found in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), sets, strict=True):
                    size = len(found)
                    if not size:
                        yield doc_id, text_id, 0, None, None, None, None
                        continue
                    yield doc_id, text_id, size, set_id(found), sketch(found), part_ids(found, percent).view("i8"), histogram(found, BUCKETS)

        yield from in_batches(rows(), arrow, 512)

    schema = "doc_id long, text_id long, n long, node long, keys array<long>, parts array<long>, histogram array<int>"
    return own.withColumn("text_id", F.xxhash64("text")).mapInArrow(run, schema)


def near_enough(least: Column) -> Column:
    """Whether the bucket counts of a pair allow a similarity of ``least``: shared members of a bucket are at most its smaller count."""
    shared = F.aggregate(F.zip_with("histogram_a", "histogram_b", lambda a, b: F.least(a, b)), F.lit(0), lambda s, x: s + x)
    return shared >= least * (F.col("n_a") + F.col("n_b") - shared) - SLACK


class Nodes:
    """Distinct sets with an example document each, and the distances of pairs of them."""

    def __init__(self, own: DataFrame, nodes: DataFrame, n: int):
        self.own, self.nodes, self.n = own, nodes, n

    def sketched(self, pairs: DataFrame) -> DataFrame:
        pairs = written(pairs, "pairs")
        taking = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        nodes = only_ids(self.nodes.select("node", "n", "histogram"), written(taking, "taking"), "node")
        side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("histogram").alias(f"histogram_{x}"))
        return pairs.join(side("a"), "a").join(side("b"), "b")

    def finer(self, taking: DataFrame) -> DataFrame:
        """(cell, histogram) over ``FINE_BUCKETS`` of each ``cell``, from its pivot's text."""
        few = only_ids(self.nodes.select(F.col("node").alias("cell"), "doc_id"), taking, "cell")
        few = written(few, "finer-cells")
        texts = only_ids(self.own, few.select("doc_id").distinct(), "doc_id").join(few, "doc_id").select("text", "cell")
        n, arrow = self.n, pa.schema([("cell", pa.int64()), ("histogram", pa.list_(pa.int32()))])

        def run(batches):
            def rows():
                for batch in batches:
                    for found, cell in zip(shingles(batch.column(0).to_pylist(), n), batch.column(1).to_pylist(), strict=True):
                        if set_id(found) == cell:  # a doc_id can stand for several rows
                            yield cell, histogram(found, FINE_BUCKETS)

            yield from in_batches(rows(), arrow, 1024)

        found = texts.mapInArrow(run, "cell long, histogram array<int>")
        return written(found.groupBy("cell").agg(F.first("histogram").alias("histogram")), "finer")

    def distances(self, pairs: DataFrame) -> DataFrame:
        """(a, b, shared, n_a, n_b) of distinct (a, b): b's set is sent to each stream of its partners."""
        sizes = pairs.groupBy("b").agg(F.ceil(F.count("*") / STREAM_ROWS).cast("int").alias("streams"))
        dealt = pairs.join(sizes, "b").withColumn("stream", F.pmod(F.xxhash64("a"), F.col("streams")).cast("int"))
        dealt = written(dealt.select("a", "b", "stream"), "dealt")
        guest = dealt.select(F.col("a").alias("node"), F.struct("b", "stream", F.lit(True).alias("guest")).alias("way"))
        host = dealt.select("b", "stream").distinct().select(F.col("b").alias("node"), F.struct("b", "stream", F.lit(False).alias("guest")).alias("way"))
        ways = guest.unionByName(host).groupBy("node").agg(F.collect_list("way").alias("ways"))
        routed = written(ways.join(self.nodes.select("node", "doc_id"), "node"), "routed")
        texts = only_ids(self.own, routed.select("doc_id").distinct(), "doc_id").join(routed, "doc_id")
        n = self.n
        sent = pa.schema([("b", pa.int64()), ("stream", pa.int32()), ("guest", pa.bool_()), ("a", pa.int64()), ("members", pa.binary())])

        def send(batches):
            def rows():
                for batch in batches:
                    found_sets = shingles(batch.column(0).to_pylist(), n)
                    for found, node, to in zip(found_sets, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                        if set_id(found) == node:  # a doc_id can stand for several rows
                            data = found.tobytes()
                            for way in to:
                                yield way["b"], way["stream"], way["guest"], node, data

            yield from in_batches(rows(), sent, 1024, lambda r: len(r[4]))

        met = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("shared", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64())])

        def meet(batches):
            def rows():
                stream, host = None, None
                for batch in batches:
                    for b, number, is_guest, a, data in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                        if (b, number) != stream:
                            stream, host = (b, number), None
                        members = np.frombuffer(data, "u8")
                        if not is_guest:
                            host = members
                        elif host is not None:
                            at = np.minimum(np.searchsorted(host, members), len(host) - 1)
                            yield a, b, int((host[at] == members).sum()), len(members), len(host)

            yield from in_batches(rows(), met)

        rows = texts.select("text", "node", "ways").mapInArrow(send, "b long, stream int, guest boolean, a long, members binary")
        dealt_out = rows.repartition("b", "stream").sortWithinPartitions("b", "stream", "guest")
        return dealt_out.mapInArrow(meet, "a long, b long, shared long, n_a long, n_b long").distinct()


def linked(percent: int) -> Column:
    return 100 * F.col("shared") >= percent * (F.col("n_a") + F.col("n_b") - F.col("shared"))


def distance() -> Column:
    return 1 - F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))


PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def in_blocks(rows: DataFrame, key: str, item: str) -> DataFrame:
    """``rows`` with (i, j): groups of a key in blocks, each pair of blocks of a group a group of its own."""
    counts = rows.groupBy(key).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    large = counts.filter("blocks > 1")
    numbered = rows.join(large, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    numbered = numbered.withColumn("block", F.pmod(F.xxhash64(item), F.col("blocks")).cast("int"))
    numbered = numbered.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    return numbered.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other")


def bounded_pairs(left: np.ndarray, right: np.ndarray, reach) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of ``left`` the rows of ``right`` that the histograms allow a similarity of ``reach(row)``.

    Finer histograms decide where their sums over ``BUCKETS`` leave room.
    """
    total_left, total_right = left.sum(1), right.sum(1)
    coarse_left, coarse_right = (h.reshape(len(h), h.shape[1] // BUCKETS, BUCKETS).sum(1) for h in (left, right))
    for k in range(len(left)):
        least = np.broadcast_to(reach(k), total_right.shape)
        shared = np.minimum(coarse_left[k], coarse_right).sum(1)
        near = np.flatnonzero(shared >= least * (total_left[k] + total_right - shared) - SLACK)
        if left.shape[1] > BUCKETS and len(near):
            shared = np.minimum(left[k], right[near]).sum(1)
            near = near[shared >= least[near] * (total_left[k] + total_right[near] - shared) - SLACK]
        yield k, near


def shared_regions(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """(region, cell, least, most): regions of several cells, with the sizes of each cell's sets there.

    Near copies share most of their regions; those of the same cells are one, named by the hash of their cells.
    """
    few = cells.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    cell_of = cells.select("node", "cell")
    placed = rows.select("node", "n", "parts").join(F.broadcast(cell_of) if few else cell_of, "node")
    shown = placed.select("cell", "n", F.explode("parts").alias("region"))
    several = shown.groupBy("region").agg(F.min("cell").alias("first"), F.max("cell").alias("last")).filter("first < last")
    shown = only_ids(shown, written(several.select("region"), "regions"), "region")
    held = written(shown.groupBy("region", "cell").agg(F.min("n").alias("least"), F.max("n").alias("most")), "held")
    alike = held.groupBy("region").agg(F.bit_xor(F.xxhash64("cell")).alias("cells"))
    return written(held.join(alike, "region").groupBy(F.col("cells").alias("region"), "cell").agg(F.min("least").alias("least"), F.max("most").alias("most")), "alike")


def facing_cells(held: DataFrame, wide: DataFrame, finer: DataFrame, labels: DataFrame, percent: int, best: bool) -> DataFrame:
    """Distinct pairs (a, b) of cells, a < b, of one region and two components, whose bounds leave room for a link.

    Cells of a region meet in blocks; sizes, histograms of the pivots and radii
    decide there, and only what they leave becomes a row. With ``best`` each cell
    of a block names its likeliest partner only.
    """
    own = held.join(labels.select(F.col("id").alias("cell"), "component"), "cell", "left")
    own = own.withColumn("component", F.coalesce("component", "cell"))
    # Regions inside one component hold nothing new.
    mixed_ones = own.groupBy("region").agg(F.min("component").alias("first"), F.max("component").alias("last")).filter("first < last")
    own = own.join(mixed_ones.select("region"), "region")
    pivot = wide.join(finer, "cell")
    own = written(own, "mixed-regions")
    pivot = only_ids(pivot, written(own.select("cell").distinct(), "mixed-cells"), "cell")
    met = in_blocks(own, "region", "cell").join(pivot, "cell")
    radius = 1 - percent / 100

    def meet(batches):
        def pairs():
            for (_, i, j), (block, cell, component, least, most, wide_by, histogram) in runs_of(batches, 3):
                left = np.flatnonzero(block == i)
                right = left if i == j else np.flatnonzero(block == j)
                reach = lambda k: 1 - (radius + wide_by[left[k]] + wide_by[right])  # noqa: B023, E731
                for k, near in bounded_pairs(histogram[left], histogram[right], reach):
                    x, others = left[k], right[near]
                    fits = (100 * most[x] >= percent * least[others]) & (100 * most[others] >= percent * least[x])
                    fits &= component[others] != component[x]
                    if not best and i == j:
                        fits &= cell[others] > cell[x]  # each pair once
                    others = others[fits]
                    if best and len(others):
                        others = others[np.minimum(histogram[x], histogram[others]).sum(1).argmax()][None]
                    for y in others.tolist():
                        yield int(min(cell[x], cell[y])), int(max(cell[x], cell[y]))

        yield from in_batches(pairs(), PAIRS)

    ordered = met.select("region", "i", "j", "block", "cell", "component", "least", "most", "radius", "histogram").repartition("region", "i", "j")
    return ordered.sortWithinPartitions("region", "i", "j").mapInArrow(meet, "a long, b long").distinct()


def border_pairs(opened: DataFrame, cells: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of nodes of opened cells inside each other's windows.

    ``opened``: (cell_a, cell_b, gap, radius_a, radius_b). The wider cell is the
    host; its nodes meet the nodes of all cells opened with it, in blocks.
    """
    swap = F.col("radius_a") >= F.col("radius_b")
    sides = opened.select(
        F.when(swap, F.col("cell_a")).otherwise(F.col("cell_b")).alias("host"),
        F.when(swap, F.col("cell_b")).otherwise(F.col("cell_a")).alias("cell"),
        "gap",
        F.greatest("radius_a", "radius_b").alias("host_radius"),
    )
    radius = 1 - percent / 100
    member = cells.select("cell", "node", "distance")
    guests = sides.join(member, "cell").filter(F.col("distance") >= F.col("gap") - radius - F.col("host_radius") - SLACK)
    guests = guests.select("host", "node", "distance", "gap")
    hosts = sides.select(F.col("host").alias("cell")).distinct().join(member, "cell").select(F.col("cell").alias("host"), "node", "distance")
    rows = guests.withColumn("guest", F.lit(1)).unionByName(hosts.withColumns({"gap": F.lit(0.0), "guest": F.lit(0)}))
    met = in_blocks(rows, "host", "node").join(nodes.select("node", "histogram"), "node")

    def meet(batches):
        def pairs():
            for (_, i, j), (block, guest, node, distance, gap, histogram) in runs_of(batches, 3):
                for one, two in {(i, j), (j, i)}:
                    left = np.flatnonzero((guest == 1) & (block == one))
                    right = np.flatnonzero((guest == 0) & (block == two))
                    for k, near in bounded_pairs(histogram[left], histogram[right], lambda _: percent / 100):
                        x, others = left[k], right[near]
                        fits = (distance[x] + distance[others] >= gap[x] - radius - SLACK) & (node[others] != node[x])
                        for y in others[fits].tolist():
                            yield int(min(node[x], node[y])), int(max(node[x], node[y]))

        yield from in_batches(pairs(), PAIRS)

    ordered = met.select("host", "i", "j", "block", "guest", "node", "distance", "gap", "histogram").repartition("host", "i", "j")
    return ordered.sortWithinPartitions("host", "i", "j").mapInArrow(meet, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, text_id, component) per input row.

    Two documents are linked if 100 * shared >= percent * united of their
    distinct n-grams of words (white space separates words, A-Z count as a-z).
    ``component_id`` is the smallest doc_id reachable over links. Fewer than
    ``n`` words are one shingle; a null or wordless text has none and no link.
    Rows sharing a doc_id are linked as any others. A null doc_id has a null
    component and links nobody. ``text_id`` is xxhash64 of the text, and
    ``component`` names the group by content, null without shingles or doc_id.
    """
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = written(described(own, n, percent), "described")
    taking = rows.filter("node is not null and doc_id is not null")
    same = [F.first(c).alias(c) for c in ("n", "keys", "histogram")]
    nodes = written(taking.groupBy("node").agg(F.min("doc_id").alias("doc_id"), *same), "nodes")
    meet = Nodes(own, nodes, n)
    threshold = percent / 100
    radius = 1 - threshold

    # 1. Pivots and their cells.
    keys = nodes.select("node", F.explode("keys").alias("key"))
    pivots = written(keys.groupBy("key").agg(F.min("node").alias("b"), F.max("node").alias("last")).filter("last <> b").select("key", "b"), "pivots")
    tried = keys.join(pivots, "key").filter("node <> b").select(F.col("node").alias("a"), "b").distinct()
    tried = meet.sketched(tried).filter(near_enough(F.lit(threshold))).select("a", "b")
    found = written(meet.distances(tried).filter(linked(percent)).select("a", "b", distance().alias("distance")), "stars")
    nearest = found.groupBy(F.col("a").alias("node")).agg(F.min(F.struct("distance", "b")).alias("best"))
    celled = nodes.select("node").join(nearest, "node", "left")
    cells = written(celled.select("node", F.coalesce("best.b", "node").alias("cell"), F.coalesce("best.distance", F.lit(0.0)).alias("distance")), "cells")

    # 2. Cells that share a region.
    wide = written(cells.groupBy("cell").agg(F.max("distance").alias("radius")), "radii")
    side = lambda x: wide.select(F.col("cell").alias(x), F.col("radius").alias(f"radius_{x}"))
    reach = F.lit(radius) + F.col("radius_a") + F.col("radius_b")
    held = shared_regions(taking, cells)
    finer = meet.finer(written(held.select("cell").distinct(), "held-cells"))

    def told(facing: DataFrame) -> DataFrame:
        facing = written(facing.join(side("a"), "a").join(side("b"), "b"), "facing")
        return written(meet.distances(facing.select("a", "b")).join(facing, ["a", "b"]), "apart")

    # Likeliest partners first: they connect most of a dense group, and what is connected need not be compared.
    links = found.select("a", "b")
    first = told(facing_cells(held, wide, finer, components(links), percent, True))
    links = links.unionByName(first.filter(linked(percent)).select("a", "b"))
    rest = facing_cells(held, wide, finer, components(links), percent, False).join(first.select("a", "b"), ["a", "b"], "left_anti")
    second = told(rest)
    apart = first.unionByName(second)
    links = links.unionByName(second.filter(linked(percent)).select("a", "b"))
    labels = components(links)

    # 3. Cells near each other whose documents are not connected yet.
    label = lambda x: labels.select(F.col("id").alias(x), F.col("component").alias(f"component_{x}"))
    opened = apart.filter(~linked(percent) & (distance() <= reach + SLACK) & (reach > radius + SLACK)).select("a", "b", distance().alias("gap"), "radius_a", "radius_b")
    opened = opened.join(label("a"), "a", "left").join(label("b"), "b", "left")
    opened = opened.filter(F.coalesce("component_a", "a") != F.coalesce("component_b", "b")).select(F.col("a").alias("cell_a"), F.col("b").alias("cell_b"), "gap", "radius_a", "radius_b")
    opened = written(opened, "opened")
    if not opened.isEmpty():
        border = border_pairs(opened, cells, nodes, percent)
        more = written(meet.distances(border).filter(linked(percent)).select("a", "b"), "border")
        if not more.isEmpty():
            labels = components(links.unionByName(more))

    grouped = nodes.select("node", "doc_id").join(labels.withColumnRenamed("id", "node"), "node", "left")
    grouped = written(grouped.select("node", "doc_id", F.coalesce("component", "node").alias("component")), "grouped")
    least = grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = written(grouped.join(least, "component").select("node", "component_id", "component"), "named")
    joined = rows.select("doc_id", "text_id", F.col("n").alias("n_shingles"), "node").join(named, "node", "left")
    # Only a row without a shingle stands outside every node.
    own_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    group = F.when(F.col("doc_id").isNotNull(), F.col("component"))
    return joined.select("doc_id", "n_shingles", own_id.alias("component_id"), "text_id", group.alias("component"))


def one_per_group(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs``, all columns, with one row of each group: that with the smallest doc_id, then text hash.

    Rows without a shingle or without a doc_id are in no group and stay.
    """
    found = written(near_duplicates(docs, n, percent).filter("component is not null"), "groups")
    keepers = found.groupBy("component").agg(F.min(F.struct("doc_id", "text_id")).alias("keeper"))
    others = found.join(written(keepers, "keepers"), "component").filter(F.struct("doc_id", "text_id") != F.col("keeper"))
    own_id, own_text, again, place = fresh(docs, "own_id", "own_text", "again", "place")
    others = others.select(F.col("doc_id").alias(own_id), F.col("text_id").alias(own_text)).distinct()
    keyed = docs.withColumn(own_id, F.col("doc_id").cast("long")).withColumn(own_text, F.xxhash64(F.col("text").cast("string")))
    kept = keyed.join(others, [own_id, own_text], "left_anti")
    repeats = found.groupBy("doc_id", "text_id").agg(F.count("*").alias("n")).filter("n > 1")
    repeats = written(repeats.select(F.col("doc_id").alias(own_id), F.col("text_id").alias(own_text), F.lit(True).alias(again)), "repeats")
    if not repeats.isEmpty():
        # The same row more than once: the first stays.
        marked = kept.join(repeats, [own_id, own_text], "left")
        order = F.row_number().over(Window.partitionBy(own_id, own_text).orderBy(F.lit(0)))
        kept = marked.withColumn(place, order).filter(F.col(again).isNull() | (F.col(place) == 1))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
