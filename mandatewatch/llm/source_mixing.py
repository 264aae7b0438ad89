"""Mixing sources to target weights: whole documents, repeated or left out at their source's rate.

Words are summed per source, each source gets a target, and a document comes
floor(target / size) times plus once more with the fraction as probability. The
draw is a hash of the document's id, so reruns agree. Only DataFrame functions
are used.

Every hash holds ``TRIALS`` independent draws; a source uses the one whose words
come nearest its target, the first of equals. That takes one more sum per source
and no sort of its documents, so a source may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mandatewatch.llm.common import BROADCAST_IDS, written

#: Weights of the sources in order, repeating; the mix's words as half parts of all words; most repeats of a source's words.
WEIGHTS = (5, 2, 1)
HALVES, REPEATS = 3, 2
#: Draws in one hash, of eight hexadecimal digits each.
TRIALS, DIGITS = 8, 8
SPACE = " \t\n\x0b\f\r"


def words_in(text: Column) -> Column:
    """The number of words ``[^\\x20\\x09-\\x0D]+``; 0 for null. Needs no list of the words."""
    return F.length(F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x"), SPACE, "")).cast("long")


def _drawn_by(key: Column, text: Column) -> Column:
    """What a document's draws are a hash of: its id, or its text where it has none."""
    return F.coalesce(key.cast("string"), F.md5(F.coalesce(text, F.lit(""))))


def draw(own: Column, trial: Column) -> Column:
    """Draw number ``trial``, in [0, 1)."""
    digits = F.substring(F.sha2(F.concat(F.lit("mix:"), own), 256), trial * DIGITS + 1, F.lit(DIGITS))
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(16**DIGITS))


def _running(rows: DataFrame, order: list[Column], totals: list[str]) -> DataFrame:
    """Each row with the sum of every total over the rows before it in the order.

    Rows are dealt by ranges; only the sums of the ranges meet in one task.
    """
    dealt = written(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("range").agg(*[F.sum(t).alias(t) for t in totals])
    earlier = sums.select("range", *[F.coalesce(F.sum(t).over(before), F.lit(0)).alias(f"{t}_earlier") for t in totals])
    inside = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # As many rows as ranges, so the size is bounded by the number of partitions.
    out = dealt.join(F.broadcast(earlier), "range")
    for t in totals:
        out = out.withColumn(f"{t}_before", F.coalesce(F.sum(t).over(inside), F.lit(0)) + F.col(f"{t}_earlier"))
    return out.drop("range", *[f"{t}_earlier" for t in totals])


def targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Sources in order of size by weight: each is at its limit if the share that
    the earlier ones leave for its weight is larger, and the rest share what is
    left. This is where repeated resharing of the excess ends.
    """
    sums = written(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.lit(1).alias("one")), "sources")
    ranked = _running(sums, [F.col("source").asc_nulls_last()], ["one"])
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.pmod("one_before", F.lit(len(WEIGHTS))) + 1).cast("int"))
    # In half words, so that everything is whole; wide decimals, since products of two sums pass a long.
    whole = "decimal(38,0)"
    weighed = ranked.select(
        "source", "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * 2 * REPEATS).cast("decimal(20,0)").alias("limit")
    )
    fullness = F.col("source_size") * 10 / F.col("weight")
    ordered = written(_running(weighed, [fullness, F.col("source").asc_nulls_last()], ["weight", "limit"]), "shares")
    total = ordered.agg(F.sum("source_size").cast("decimal(20,0)").alias("size"), F.sum("weight").alias("weight")).first()
    if total.size is None:
        return ordered.select("source", "source_size", F.lit(0.0).alias("target"))
    budget = F.lit(total.size * HALVES).cast("decimal(24,0)")
    left, weights = (budget - F.col("limit_before")).cast("decimal(24,0)"), F.lit(total.weight) - F.col("weight_before")
    full = (F.col("limit") * weights.cast("decimal(12,0)")).cast(whole) < (left * F.col("weight").cast("decimal(2,0)")).cast(whole)
    marked = ordered.withColumn("full", full)
    used = marked.filter("full").agg(F.sum("limit").alias("limit"), F.sum("weight").alias("weight")).first()
    left_over, sharing = int(total.size) * HALVES - int(used.limit or 0), total.weight - (used.weight or 0)
    share = F.lit(float(left_over)) * F.col("weight").cast("double") / F.lit(2.0 * max(sharing, 1))
    return marked.select("source", "source_size", F.when(F.col("full"), F.col("limit").cast("double") / 2).otherwise(share).alias("target"))


def _beside(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with their source's row; broadcast only if the sources are counted to be few."""
    few = plan.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    named = plan.withColumnRenamed("source", "its_source")
    return rows.join(F.broadcast(named) if few else named, F.col("source").eqNullSafe(F.col("its_source")), "left").drop("its_source")


def _rate() -> Column:
    return F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)


def _copies() -> Column:
    rate = _rate()
    extra = draw(F.col("own"), F.col("trial")) < rate - F.floor(rate)
    return F.floor(rate) + extra.cast("long")


def planned(sized: DataFrame) -> DataFrame:
    """(source, source_size, target, trial) from (source, size, own)."""
    shares = written(targets(sized), "targets")
    rate = _rate()
    extra = [
        F.sum(F.when(draw(F.col("own"), F.lit(t)) < rate - F.floor(rate), F.col("size")).otherwise(0)).alias(f"extra{t}")
        for t in range(TRIALS)
    ]
    tried = _beside(sized, shares).groupBy("source", "source_size", "target").agg(*extra)
    off = [
        F.struct(F.abs(F.floor(rate) * F.col("source_size") + F.col(f"extra{t}") - F.col("target")).alias("off"), F.lit(t).alias("trial"))
        for t in range(TRIALS)
    ]
    return written(tried.select("source", "source_size", "target", F.least(*off)["trial"].alias("trial")), "mix-plan")


def sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, own) of every document, written: texts are read once."""
    own = _drawn_by(F.col(key), F.col(text))
    return written(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), words_in(F.col(text)).alias("size"), own.alias("own")), "sizes")


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) of every document.

    A null text, like an empty one, has no words; a null source is a source of
    its own, the last. Rows with the same id draw the same number of copies;
    rows without an id draw by their text. A source without words has target 0
    and no copies. An empty table gives no rows.
    """
    sized = sizes(docs)
    out = _beside(sized, planned(sized)).withColumn("copies", _copies())
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixture(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: the rows of ``docs``, all columns, each as often as it is taken."""
    sized = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(source).alias("source"),
        _drawn_by(F.col(key), F.col(text)).alias("own"),
    )
    rows = _beside(sized, planned(sizes(docs, key, text, source))).withColumn("copies", _copies()).filter("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
