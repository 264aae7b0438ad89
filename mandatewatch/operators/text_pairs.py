"""Lexical divergence of long text pairs, as grouped sums over their terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mandatewatch.functions.text import SINGLE_SIDE_IDF, divergence_from_sums, terms


#: Pairs whose terms one task counts: the number of tasks follows the number of pairs.
PAIRS_PER_TASK = 1024


def pair_divergence(pairs: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """``lexical_divergence`` per pair for texts of any length.

    One shuffle by the pair key; both groupings then run inside its partitions.
    Pairs without any term come back with a null score.
    """
    tagged = F.concat(
        F.transform(terms(F.col(left)), lambda t: F.struct(t.alias("term"), F.lit(1).alias("l"), F.lit(0).alias("r"))),
        F.transform(terms(F.col(right)), lambda t: F.struct(t.alias("term"), F.lit(0).alias("l"), F.lit(1).alias("r"))),
    )
    cores = pairs.sparkSession.sparkContext.defaultParallelism
    spread = pairs.repartition(max(-(-pairs.count() // PAIRS_PER_TASK), cores), key).select(key, F.explode_outer(tagged).alias("t"))
    counts = spread.groupBy(key, F.col("t.term").alias("term")).agg(F.sum("t.l").alias("l"), F.sum("t.r").alias("r"))
    l, r = F.col("l").cast("double"), F.col("r").cast("double")
    idf = F.when((l > 0) & (r > 0), F.lit(1.0)).otherwise(F.lit(SINGLE_SIDE_IDF))
    sums = counts.groupBy(key).agg(
        F.coalesce(F.sum(l * r), F.lit(0.0)).alias("dot"),
        F.coalesce(F.sum(F.pow(l * idf, F.lit(2.0))), F.lit(0.0)).alias("left_norm"),
        F.coalesce(F.sum(F.pow(r * idf, F.lit(2.0))), F.lit(0.0)).alias("right_norm"),
    )
    return sums.select(
        key, divergence_from_sums(F.col("dot"), F.col("left_norm"), F.col("right_norm")).alias("lexical_divergence")
    )
