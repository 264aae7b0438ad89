"""Appending rows by key without reading all stored keys.

Beside a Parquet table lies a manifest: each file's smallest and largest key and
Bloom filters of its keys, a row for every ``KEYS_PER_FILTER`` of them, so no
task holds a whole file's or batch's keys. A batch opens only files whose range and
filter may hold one of its keys, so batches of new, ascending keys open none.
A file is entered into the manifest by the first append that finds it missing
there, so a writer that fails in between leaves nothing unseen. The driver holds
the names of the table's files, as any read of it does.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a filter for each key, and places that a key sets: about one wrong hit in 100,000 keys.
BITS_PER_KEY = 24
PLACES = 16
#: Keys of one filter: a file with more has several, its keys dealt to them by hash.
KEYS_PER_FILTER = 1 << 15
#: Files whose filters meet the same keys in one task, keys that meet there, and keys tested at a time.
FILES_PER_SLOT = 512
KEYS_PER_SLOT = 1 << 18
CHUNK_KEYS = 1 << 12
MANIFEST = "_manifest"


def _place(hashes: np.ndarray, bits: int, number: int) -> np.ndarray:
    """The place that each key sets as its ``number``-th."""
    h = hashes.view(np.uint64)
    first, step = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return (first + np.uint64(number) * step) % np.uint64(bits)


def bloom(hashes: np.ndarray) -> bytes:
    """A filter of 64-bit hashes."""
    bits = max(BITS_PER_KEY * len(hashes), 64)
    flags = np.zeros(bits, bool)
    for number in range(PLACES):
        flags[_place(hashes, bits, number)] = True
    return np.uint32(bits).astype("<u4").tobytes() + np.packbits(flags, bitorder="little").tobytes()


def may_hold(filter_: bytes, hashes: np.ndarray) -> np.ndarray:
    """Which hashes the filter may hold; never False for one that it does."""
    bits = int(np.frombuffer(filter_[:4], "<u4")[0])
    packed = np.frombuffer(filter_, np.uint8, offset=4)
    # Half of those left drop out at each place.
    left = np.arange(len(hashes))
    for number in range(PLACES):
        at = _place(hashes[left], bits, number)
        left = left[(packed[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0]
    out = np.zeros(len(hashes), bool)
    out[left] = True
    return out


def _may_hold_any(filter_: bytes, hashes: np.ndarray) -> bool:
    return any(may_hold(filter_, hashes[start : start + CHUNK_KEYS]).any() for start in range(0, len(hashes), CHUNK_KEYS))


def table_files(spark: SparkSession, path: str) -> list[str]:
    """The files of a Parquet table; none where there is no table yet."""
    try:
        return list(spark.read.schema("_none int").parquet(path).inputFiles())
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return []


def _manifest(spark: SparkSession, path: str, key_type: str) -> DataFrame:
    schema = f"file string, low {key_type}, high {key_type}, parts int, part int, filter binary"
    try:
        return spark.read.schema(schema).parquet(f"{path}/{MANIFEST}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def enter_files(spark: SparkSession, files: list[str], key: str, key_type: str, path: str) -> None:
    """Enters files into the manifest; reads their key column once."""
    if not files:
        return
    rows = spark.read.schema(f"`{key}` {key_type}").parquet(*files).select(F.input_file_name().alias("file"), F.col(f"`{key}`").alias("key"))
    parts = F.ceil(F.count("*") / F.lit(KEYS_PER_FILTER))
    # Powers of two, so that files of many sizes have few numbers of parts.
    parts = F.pow(F.lit(2), F.ceil(F.log2(parts))).cast("int").alias("parts")
    ranges = rows.groupBy("file").agg(F.min("key").alias("low"), F.max("key").alias("high"), parts)
    # As many rows as files.
    dealt = rows.join(F.broadcast(ranges.select("file", "parts")), "file").select("file", F.xxhash64("key").alias("hash"), _part("hash", F.col("parts")).alias("part"))

    def filtered(name: tuple, own: pa.Table) -> pa.Table:
        made = {"file": pa.array([name[0].as_py()]), "part": pa.array([name[1].as_py()], pa.int32()), "filter": pa.array([bloom(own.column("hash").to_numpy())])}
        return pa.table(made)

    filters = dealt.groupBy("file", "part").applyInArrow(filtered, "file string, part int, filter binary")
    ranges.join(filters, "file").select("file", "low", "high", "parts", "part", "filter").write.mode("append").parquet(f"{path}/{MANIFEST}")


def _part(hashed: str, parts: Column) -> Column:
    """Which of a file's filters a key belongs to."""
    return F.pmod(F.xxhash64(F.col(hashed)), parts).cast("int")


def files_holding(new: DataFrame, key: str, path: str, files: list[str]) -> list[str]:
    """The files among ``files`` that may hold a key of ``new``; every other file holds none."""
    spark, key_type = new.sparkSession, new.schema[key].dataType.simpleString()
    entered = {r.file for r in _manifest(spark, path, key_type).select("file").distinct().toLocalIterator()}
    enter_files(spark, [f for f in files if f not in entered], key, key_type, path)
    reach = new.agg(F.min(key).alias("low"), F.max(key).alias("high")).first()
    if not files or reach.low is None:
        return []
    near = _manifest(spark, path, key_type).filter((F.col("low") <= F.lit(reach.high)) & (F.col("high") >= F.lit(reach.low)))
    # A filter meets the keys of its own part only, files and keys in bounded groups.
    near = near.withColumns({"parts": F.coalesce("parts", F.lit(1)), "part": F.coalesce("part", F.lit(0))})
    keys = new.select(F.xxhash64(key).alias("hash")).distinct()
    n = keys.count()
    layout = [(r.parts, -(-r.files // FILES_PER_SLOT), max(-(-n // (r.parts * KEYS_PER_SLOT)), 1)) for r in near.groupBy("parts").agg(F.count_distinct("file").alias("files")).collect()]
    if not layout:
        return []
    kinds = F.broadcast(spark.createDataFrame(layout, "parts int, slots int, shares int"))
    share = F.pmod(F.xxhash64("hash", F.lit(1)), F.col("shares")).cast("int").alias("share")
    asked = keys.crossJoin(kinds).select("hash", "parts", _part("hash", F.col("parts")).alias("part"), share, F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"))
    slot = F.pmod(F.xxhash64("file"), F.col("slots")).cast("int").alias("slot")
    held = near.join(kinds, "parts").select("file", "filter", "parts", "part", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), slot)

    def tested(asked: pa.Table, filters: pa.Table) -> pa.Table:
        hit = []
        if asked.num_rows:
            hashes = asked.column("hash").to_numpy()
            hit = [f.as_py() for f, b in zip(filters.column("file"), filters.column("filter"), strict=True) if _may_hold_any(b.as_buffer(), hashes)]
        return pa.table({"file": pa.array(hit, pa.string())})

    group = ("parts", "part", "share", "slot")
    found = asked.groupBy(*group).cogroup(held.groupBy(*group)).applyInArrow(tested, "file string").distinct()
    wanted = {r.file for r in found.collect()}
    return [f for f in files if f in wanted]


def not_stored(new: DataFrame, key: str, path: str, counts: Callable[[str], bool] = lambda file: True) -> DataFrame:
    """Rows of ``new`` whose key no stored file holds, one per key; a null key is no key and stays out.

    ``counts`` says which files of the table to regard.
    """
    spark, key_type = new.sparkSession, new.schema[key].dataType.simpleString()
    rows = new.filter(F.col(key).isNotNull()).dropDuplicates([key])
    hit = files_holding(rows, key, path, [f for f in table_files(spark, path) if counts(f)])
    if not hit:
        return rows
    stored = spark.read.schema(f"`{key}` {key_type}").parquet(*hit)
    return rows.join(stored.select(key), key, "left_anti")
