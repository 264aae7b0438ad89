"""How far the numbers of two tables lie apart, feature by feature."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mandatewatch.operators.ranking import prefix_sums


def feature_drift(left: DataFrame, right: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, n_left, n_right, ks, wasserstein) of two tables' numeric columns.

    ``ks`` is the largest distance of the two distribution functions, and
    ``wasserstein`` the area between them. Both come from one scan over the
    counts per (feature, value). Nulls and NaN count nowhere; a feature that one
    side lacks has null distances.
    """

    def long(df: DataFrame, a: int, b: int) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("value")) for c in features])
        return df.select(F.explode(cells).alias("cell")).select("cell.feature", "cell.value", F.lit(a).alias("a"), F.lit(b).alias("b"))

    both = long(left, 1, 0).unionByName(long(right, 0, 1)).filter("value is not null and not isnan(value)")
    counts = both.groupBy("feature", "value").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    placed = prefix_sums(counts, ["feature"], "value", ["a", "b"], ["value"])
    # One row per feature.
    sizes = placed.groupBy("feature").agg(F.sum("a").alias("n_left"), F.sum("b").alias("n_right"))
    share = lambda at: F.abs(F.try_divide(at("a"), "n_left") - F.try_divide(at("b"), "n_right"))
    here = share(lambda c: (F.col(f"{c}_before") + F.col(c)).cast("double"))
    before = share(lambda c: F.col(f"{c}_before").cast("double"))
    measured = placed.join(F.broadcast(sizes), "feature").groupBy("feature").agg(
        F.first("n_left").alias("n_left"),
        F.first("n_right").alias("n_right"),
        F.max(here).alias("ks"),
        F.sum(F.coalesce(before * (F.col("value") - F.col("value_before")), F.lit(0.0))).alias("area"),
    )
    names = left.sparkSession.createDataFrame([(c,) for c in features], "feature string")
    return names.join(measured, "feature", "left").select(
        "feature",
        F.coalesce("n_left", F.lit(0)).cast("bigint").alias("n_left"),
        F.coalesce("n_right", F.lit(0)).cast("bigint").alias("n_right"),
        "ks",
        F.when(F.col("ks").isNotNull(), F.col("area")).alias("wasserstein"),
    )
