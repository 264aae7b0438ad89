"""Ratcliff-Obershelp similarity of short names (order of the arguments matters)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from mandatewatch.functions.text import url_domain
from mandatewatch.runtime import cut_lineage

#: Distinct pairs whose ratio a worker remembers; later ones are worked out again.
MEMO_PAIRS = 100_000


def ratio(first: str, second: str) -> float:
    return SequenceMatcher(None, first, second).ratio()


def ratio_bound(first: str, second: str) -> float:
    """What the ratio of two names is at most: the letters both hold, over all their letters."""
    both = sum((Counter(first) & Counter(second)).values())
    return 2.0 * both / (len(first) + len(second)) if first or second else 1.0


def nearest(name: str, listed: list[str], memo=None) -> tuple[float, int]:
    """(best ratio to a listed name, pairs compared): the likeliest first, until no bound passes the best."""
    best, calls = 0.0, 0
    measure = memo or ratio
    for bound, other in sorted(((ratio_bound(name, x), x) for x in set(listed)), key=lambda b: (-b[0], b[1])):
        if bound <= best:
            break
        calls += 1
        best = max(best, measure(name, other))
    return best, calls


def nearest_listed(combos: DataFrame, domain: str, allowlist: str) -> DataFrame:
    """The rows with ``similarity`` to the nearest name of their list, exactly, and ``compared``, the pairs that took.

    Rows with a null name or list have null; an empty list has 0. Nulls in a list
    are nobody's name.
    """
    schema = StructType([*combos.schema.fields, StructField("similarity", DoubleType()), StructField("compared", LongType())])
    at, held = combos.columns.index(domain), combos.columns.index(allowlist)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = lru_cache(MEMO_PAIRS)(ratio)
        for batch in batches:
            found = [
                (None, None) if name is None or listed is None else nearest(name, [x for x in listed if x is not None], memo)
                for name, listed in zip(batch.column(at).to_pylist(), batch.column(held).to_pylist(), strict=True)
            ]
            columns = [pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=schema.names)

    return combos.mapInArrow(run, schema)


def typosquat_scores(sessions: DataFrame, key: str, domain: str, allowlist: str) -> DataFrame:
    """Best similarity of each row's domain to its own allowlist; 0 for an empty list.

    Distinct (domain, allowlist) combinations are scored once, and of their pairs
    only those that can still win.
    """
    sessions = cut_lineage(sessions.select(key, domain, allowlist))  # read twice below
    best = nearest_listed(sessions.select(domain, allowlist).distinct(), domain, allowlist)
    # Written, so that adaptive execution can split a combination that many rows share.
    best = cut_lineage(best.select(domain, allowlist, "similarity"))
    return sessions.join(best, [domain, allowlist], "left").select(key, domain, F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def edit_similarity(first, second):
    """Native variant: 1 - edit distance over the longer length."""
    longest = F.greatest(F.length(first), F.length(second))
    return F.coalesce(1.0 - F.try_divide(F.levenshtein(first, second), longest), F.lit(1.0))


def domain_pairs(sessions: DataFrame, url: str, allowlist: str) -> DataFrame:
    """Distinct (domain, allowlisted domain) pairs."""
    return sessions.select(url_domain(F.col(url)).alias("domain"), F.explode(allowlist).alias("listed")).select(
        "domain", url_domain(F.col("listed")).alias("listed")
    ).distinct()
