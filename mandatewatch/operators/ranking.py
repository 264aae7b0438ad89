"""Ranks, samples, folds and prefix sums without a single-partition window.

A window over a whole table, or over a stratum that may hold a third of it,
sends that group to one task. These operators rank inside many small buckets
and add per-bucket offsets, so the work spreads whatever the strata look like.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mandatewatch.runtime import cut_lineage

RANK_BUCKET_DIGITS = 4
#: Rows of one range of a running sum.
RANGE_ROWS = 65_536


def seeded_hash(seed: int | str, *keys: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def _with_offsets(bucketed: DataFrame, by: Sequence[str], bucket: str, totals: dict[str, Column]) -> DataFrame:
    """Join each row with the sums of all earlier buckets of its group."""
    sums = bucketed.groupBy(*by, bucket).agg(*[agg.alias(name) for name, agg in totals.items()])
    earlier = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *by, bucket, *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"_{name}_offset") for name in totals]
    )
    return bucketed.join(offsets, [*by, bucket])


def hash_rank(
    df: DataFrame, key: str, seed: int | str, strata: Sequence[str] = (), rank: str = "rank"
) -> DataFrame:
    """1-based rank in seeded hash order of a unique key, per stratum.

    The leading hash digits cut each stratum into equal ranges, so no window
    partition grows with the stratum.
    """
    hashed = df.withColumn("_hash", seeded_hash(seed, key)).withColumn(
        "_bucket", F.substring("_hash", 1, RANK_BUCKET_DIGITS)
    )
    by = list(strata) or ["_all"]
    if not strata:
        hashed = hashed.withColumn("_all", F.lit(0))
    inner = Window.partitionBy(*by, "_bucket").orderBy("_hash", key)
    placed = _with_offsets(hashed, by, "_bucket", {"rows": F.count(F.lit(1))})
    ranked = placed.withColumn(rank, F.row_number().over(inner) + F.col("_rows_offset"))
    return ranked.drop("_hash", "_bucket", "_rows_offset", "_all")


def prefix_sums(
    df: DataFrame, by: Sequence[str], order: str, totals: Sequence[str], maxima: Sequence[str] = ()
) -> DataFrame:
    """Sum of each total, and maximum of each of ``maxima``, over the rows with a smaller order value, per group.

    Expects one row per (group, order value). A scan in two levels: rows are
    dealt by ranges of (group, order value), as many as hold ``RANGE_ROWS`` each,
    so a group has ranges by its own size; ranges are scanned each on its own, and
    what stands before a range comes from the ranges' sums. Without earlier rows
    sums are 0 and maxima null. The rows are read several times, so they are
    checkpointed first.
    """
    grouping = list(by) or ["_all"]
    df = cut_lineage(df if by else df.withColumn("_all", F.lit(0)))
    ranges = max(-(-df.count() // RANGE_ROWS), 1)
    if ranges > 1:
        df = cut_lineage(df.repartitionByRange(ranges, *grouping, order).withColumn("_range", F.spark_partition_id()))
    else:
        df = df.withColumn("_range", F.lit(0))
    folds = [(f"{t}_before", F.sum(t), True) for t in totals] + [(f"{m}_before", F.max(m), False) for m in maxima]
    whole = df.groupBy(*grouping, "_range").agg(*[agg.alias(f"_{name}") for name, agg, _ in folds])
    earlier = Window.partitionBy(*grouping).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = whole.select(
        *grouping, "_range", *[(F.sum if is_sum else F.max)(f"_{name}").over(earlier).alias(f"_{name}") for name, _, is_sum in folds]
    )
    inner = Window.partitionBy(*grouping, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = df.join(offsets, [*grouping, "_range"])
    for name, agg, is_sum in folds:
        here = agg.over(inner)
        both = F.coalesce(here, F.lit(0)) + F.coalesce(f"_{name}", F.lit(0)) if is_sum else F.greatest(here, F.col(f"_{name}"))
        placed = placed.withColumn(name, both)
    return placed.drop("_range", "_all", *[f"_{name}" for name, _, _ in folds])


def hash_sample(df: DataFrame, key: str, n: int, seed: int | str) -> DataFrame:
    """Exactly ``n`` rows (or all, if fewer), the same for every partitioning."""
    return df.withColumn("_hash", seeded_hash(seed, key)).orderBy("_hash", key).limit(n).drop("_hash")


def stratified_sample(df: DataFrame, key: str, stratum: str, n: int, seed: int | str) -> DataFrame:
    """``n`` rows per stratum in seeded hash order.

    ``row_number() <= n`` lets Spark cut every partition to ``n`` rows per
    stratum before the shuffle.
    """
    order = Window.partitionBy(stratum).orderBy("_hash", key)
    return (
        df.withColumn("_hash", seeded_hash(seed, key))
        .withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= n)
        .drop("_hash", "_rank")
    )


def first_per_group(df: DataFrame, group: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """First ``n`` rows of each group by an explicit order."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.filter(F.col("_rank") <= n).drop("_rank")


def reference_eval_split(df: DataFrame, group: str, key: str, n: int) -> tuple[DataFrame, DataFrame]:
    """First ``n`` rows per group as reference set, all other rows as eval set."""
    reference = first_per_group(df, [group], [key], n)
    return reference, df.join(reference.select(key), key, "left_anti")


def stratified_folds(df: DataFrame, key: str, stratum: str, n_folds: int = 5, seed: int = 42) -> DataFrame:
    """Fold number per row; fold sizes differ by at most one inside a stratum."""
    ranked = hash_rank(df, key, seed, [stratum], rank="_rank")
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % n_folds).cast("int")).drop("_rank")


def stratified_split(
    df: DataFrame, key: str, label: str, test_share: float = 0.3, seed: int = 42
) -> DataFrame:
    """Adds ``is_test``: the hash-first share of every label."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_size"))
    ranked = hash_rank(df, key, seed, [label], rank="_rank").join(sizes, label)
    return ranked.withColumn("is_test", F.col("_rank") <= F.round(F.col("_size") * test_share)).drop("_rank", "_size")


def zip_join(left: DataFrame, left_key: str, right: DataFrame, right_key: str, seed: int | str) -> DataFrame:
    """Pair row k of one table with row k of the other, both in seeded hash order.

    The pairing is a fabricated one: no key relates the two tables. Every left
    row is kept; it stays unpaired if the right table is too short.
    """
    # Only keys are ranked; the wide rows meet their partners once.
    ours = hash_rank(left.select(left_key), left_key, seed, rank="pair_rank")
    theirs = hash_rank(right.select(F.col(right_key).alias("_partner")), "_partner", seed, rank="pair_rank")
    pairs = ours.join(theirs, "pair_rank", "left")
    partner = right.withColumn("_partner", F.col(right_key))
    zipped = left.join(pairs, left_key).join(partner, "_partner", "left")
    return zipped.select("pair_rank", *left.columns, *right.columns)


def latest_by_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Last writer wins. An aggregate, so copies of a key collapse before the shuffle.

    Columns are kept one by one, so that those nobody reads are not shuffled. All
    of them see the rows in the same order: among equal writers they take the same.
    """
    return df.groupBy(key).agg(*[F.max_by(c, F.struct(*order)).alias(c) for c in df.columns if c != key])
