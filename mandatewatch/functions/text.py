"""Text, URL and amount expressions (Column in, Column out)."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What an amount, a word and a term are.
AMOUNT_PATTERN = r"(?i)(?:INR\s*\d[\d,]*(?:\.\d+)?)|(?:\d[\d,]*(?:\.\d+)?\s*INR)"
WORD_PATTERN = "[a-z0-9']+"
TERM_PATTERN = r"[\p{L}\p{N}_]{2,}"

# Smoothed inverse document frequency over a two-text corpus: 1 for a term
# both texts hold, ln(3/2) + 1 for a term only one of them holds.
SINGLE_SIDE_IDF = math.log(1.5) + 1.0


def url_domain(url: Column) -> Column:
    """Lower-cased network location without one leading ``www.``."""
    clean = F.when(url.rlike(r"[\x00-\x20]"), F.regexp_replace(url, r"^[\x00-\x20]+|[\t\r\n]", "")).otherwise(url)
    # After an optional scheme and a double slash if a host follows, else from the start; one search for all.
    return F.lower(F.regexp_extract(clean, r"^(?:(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?=[^/?#]))?(?:[wW]{3}\.)?([^/?#]*)", 1))


def largest_inr_amount(text: Column) -> Column:
    """Largest amount written as ``INR n`` or ``n INR``; null when none is."""
    hits = F.regexp_extract_all(text, F.lit(AMOUNT_PATTERN), F.lit(0))
    digits = F.transform(hits, lambda m: F.regexp_replace(m, "[^0-9.]", "").try_cast("double"))
    return F.array_max(digits)


def word_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(0)))


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM_PATTERN), F.lit(0))


def jaccard(left: Column, right: Column) -> Column:
    """Set overlap of two arrays of distinct values; 0 when both are empty."""
    common = F.size(F.array_intersect(left, right))
    union = F.size(left) + F.size(right) - common
    return F.coalesce(F.try_divide(common.cast("double"), union), F.lit(0.0))


def phrase_overlap(text: Column, phrases: Sequence[str]) -> Column:
    """Best Jaccard overlap of a text with a short fixed phrase list.

    The phrases become literals, so the score is a plain expression: no join,
    no shuffle. For a phrase *table* use ``operators.phrase_match``.
    """
    words = F.coalesce(word_set(text), F.array().cast("array<string>"))
    token_lists = [sorted(set(re.findall(WORD_PATTERN, phrase.lower()))) for phrase in phrases]
    scores = [jaccard(words, F.array(*[F.lit(w) for w in tokens])) for tokens in token_lists if tokens]
    return F.greatest(F.lit(0.0), F.lit(0.0), *scores)


def bound(value: Column, body) -> Column:
    """``body`` of a value evaluated once, however often the body refers to it."""
    return F.get(F.transform(F.array(value), body), 0)


def divergence_from_sums(dot: Column, left: Column, right: Column) -> Column:
    """1 - cosine from the dot product and both squared norms."""
    return F.when((left > 0) & (right > 0), 1.0 - dot / (F.sqrt(left) * F.sqrt(right))).when(
        (left > 0) | (right > 0), F.lit(1.0)
    )


def _counted_divergence(utterance_terms: Column, artifact_terms: Column) -> Column:
    """With repeated terms: both sides sorted together, so each term is one run to count."""
    one, none = F.lit(1.0), F.lit(0.0)
    tagged = F.array_sort(
        F.concat(
            F.transform(utterance_terms, lambda t: F.struct(t.alias("term"), one.alias("a"), none.alias("b"))),
            F.transform(artifact_terms, lambda t: F.struct(t.alias("term"), none.alias("a"), one.alias("b"))),
        )
    )

    def state(term: Column, *numbers: Column) -> Column:
        return F.struct(term.alias("term"), *[n.alias(c) for c, n in zip(("a", "b", "dot", "x", "y"), numbers)])

    def closed(s: Column) -> tuple[Column, Column, Column]:
        idf = F.when((s["a"] > 0) & (s["b"] > 0), F.lit(1.0)).otherwise(F.lit(SINGLE_SIDE_IDF))
        return s["dot"] + s["a"] * s["b"], s["x"] + F.pow(s["a"] * idf, F.lit(2.0)), s["y"] + F.pow(s["b"] * idf, F.lit(2.0))

    def step(s: Column, e: Column) -> Column:
        again = state(s["term"], s["a"] + e["a"], s["b"] + e["b"], s["dot"], s["x"], s["y"])
        fresh = state(e["term"], e["a"], e["b"], *closed(s))
        return F.when(F.coalesce(s["term"] == e["term"], F.lit(False)), again).otherwise(fresh)

    def finish(s: Column) -> Column:
        dot, left, right = closed(s)
        return divergence_from_sums(dot, left, right)

    return F.aggregate(tagged, state(F.lit(None).cast("string"), *[none] * 5), step, finish)


def lexical_divergence(utterance: Column, artifact: Column) -> Column:
    """1 - TF-IDF cosine of two short texts, the idf fitted on just these two.

    Row-local; its cost grows with the words as a sort does. Texts that no task
    should hold as one array go through ``operators.text_pairs``.
    """

    a, b = terms(utterance), terms(artifact)
    distinct = (F.size(a) == F.size(F.array_distinct(a))) & (F.size(b) == F.size(F.array_distinct(b)))
    return F.when(distinct, _plain_divergence(a, b, F.size(F.array_intersect(a, b)))).otherwise(_counted_divergence(a, b))


def _plain_divergence(a: Column, b: Column, common: Column) -> Column:
    """Without repeated terms every count is 1 and the sums follow from set sizes."""
    shared = common.cast("double")
    single = F.lit(SINGLE_SIDE_IDF * SINGLE_SIDE_IDF)
    return divergence_from_sums(shared, shared + (F.size(a) - shared) * single, shared + (F.size(b) - shared) * single)


def with_lexical_divergence(rows: DataFrame, utterance: str, artifact: str, name: str) -> DataFrame:
    """``rows`` with ``lexical_divergence`` of two columns; terms and set sizes are columns, so each is worked out once a row."""
    a, b = F.col("_terms_a"), F.col("_terms_b")
    split = rows.withColumns({"_terms_a": terms(F.col(utterance)), "_terms_b": terms(F.col(artifact))})
    sized = split.withColumns(
        {"_size_a": F.size(F.array_distinct(a)), "_size_b": F.size(F.array_distinct(b)), "_common": F.size(F.array_intersect(a, b))}
    )
    distinct = (F.size(a) == F.col("_size_a")) & (F.size(b) == F.col("_size_b"))
    value = F.when(distinct, _plain_divergence(a, b, F.col("_common"))).otherwise(_counted_divergence(a, b))
    return sized.withColumn(name, value).drop("_terms_a", "_terms_b", "_size_a", "_size_b", "_common")


def blended_divergence(
    lexical: Column, semantic: Column, semantic_weight: float = 0.7, lexical_weight: float = 0.3
) -> Column:
    """Weighted blend; lexical alone where no semantic score exists."""
    blend = semantic * F.lit(semantic_weight) + lexical * F.lit(lexical_weight)
    return F.when(semantic.isNull(), lexical).otherwise(blend)


def artifact_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def first_non_empty(*texts: Column) -> Column:
    """First text that is neither null nor empty; the last one as it is."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts[:-1]], texts[-1])


def quoted(text: Column) -> Column:
    """The text in quotes, as a Python string literal shows it."""
    body = text
    for raw, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        body = F.replace(body, F.lit(raw), F.lit(shown))
    single, double = text.contains("'"), text.contains('"')
    escaped = F.replace(body, F.lit("'"), F.lit("\\'"))
    return F.when(single & ~double, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), escaped, F.lit("'"))
    )


def quoted_list(values: Column) -> Column:
    """An array of strings rendered like ``['a', 'b']``."""
    return F.concat(F.lit("["), F.array_join(F.transform(values, quoted), ", "), F.lit("]"))


def grouped_number(value: Column) -> Column:
    """Whole number with thousands commas."""
    return F.format_number(value, 0)
