"""SentencePiece encoding and decoding by folds over word lattices.

Words (a word border and what follows up to the next one) encode alone. A word's
substrings that are pieces are the edges of its lattice. The piece table is
bounded by the vocabulary and goes to every task, where texts become words and
each lattice is met edge by edge and never stored, so no row of a word, an
occurrence or an edge is shuffled. A task remembers a fixed number of words.

- ``viterbi``: the best-scoring path, position by position, for unigram models;
- ``merge``: the best-scoring pair of neighbours becomes one, again and again,
  for BPE models, whose encodings a best path does not give.

The ids of a text, in order, are decoded row by row from the piece table, which
is a constant there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush
from itertools import accumulate, chain
from math import inf

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from mandatewatch.llm.common import MEMO_ENTRIES, written  # noqa: F401  (also read from here)

VOCABULARY = "piece_bpe_32k.model"
BORDER = "▁"
#: Words that a task remembers with their ids, about 100 MB; a word beyond them is merged wherever it stands.
FREQUENT = MEMO_ENTRIES
#: Letters up to which a word's pairs are scanned for the best; longer words keep them in a heap.
SCANNED_LETTERS = 48
#: Ids after which a task passes on its rows.
BATCH_IDS = 1 << 19
#: A border starts a word, unless another one is before it; a line end, which no piece holds, is one of its own.
WORD = re.compile(rf"\n|{BORDER}+[^{BORDER}\n]*|[^{BORDER}\n]+")


@dataclass
class Pieces:
    """The piece table: (id, score) of every piece, bounded by the vocabulary."""

    edges: dict[str, tuple[int, float]]
    longest: int
    first_byte: int
    unknown: int
    spelled: str  # the bytes of every id in hex, parted by commas

    @classmethod
    def of(cls, spark: SparkSession, path: str) -> Pieces:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        rows = []
        for k in range(model.get_piece_size()):
            if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k)):
                rows.append((model.id_to_piece(k), k, float(model.get_score(k))))
        if any(BORDER in p.lstrip(BORDER) or "\n" in p for p, _, _ in rows):
            raise ValueError("pieces with a border or a line end inside are not supported")
        if model.encode("a  b", out_type=str)[0] != BORDER + "a":
            raise ValueError("only models that keep spaces and add a border in front are supported")
        return cls.from_rows(spark, rows, model.piece_to_id("<0x00>"), model.unk_id())

    @classmethod
    def from_rows(cls, spark: SparkSession, rows: list[tuple[str, int, float]], first_byte: int, unknown: int = 0) -> Pieces:
        data = {} if first_byte == unknown else {first_byte + b: f"{b:02X}" for b in range(256)}
        data |= {k: p.encode().hex().upper() for p, k, _ in rows}
        spelled = ",".join(data.get(k, "") for k in range(max(data) + 1))
        return cls({p: (k, score) for p, k, score in rows}, max(len(p) for p, _, _ in rows), first_byte, unknown, spelled)


def words_of(text: str | None) -> list[str]:
    """The words of a text with borders for spaces and one in front; none for a null or empty text."""
    return WORD.findall(BORDER + text.replace(" ", BORDER)) if text else []


def viterbi(word: str, edges: dict[str, tuple[int, float]], longest: int) -> list[int]:
    """Boundaries 0 .. length of the best path; of equal paths, the one with the longest last piece.

    A letter that is no piece has an edge of its own, scored below any piece.
    """
    best, start_of = [0.0], [-1]
    for stop in range(1, len(word) + 1):
        top, at = -inf, -1
        for start in range(max(stop - longest, 0), stop):
            edge = edges.get(word[start:stop])
            if edge is None and stop - start > 1:
                continue
            tried = best[start] + (edge[1] if edge else -1e12)
            if tried > top:
                top, at = tried, start
        best.append(top)
        start_of.append(at)
    bounds = [len(word)]
    while bounds[-1]:
        bounds.append(start_of[bounds[-1]])
    return bounds[::-1]


def merge(word: str, edges: dict[str, tuple[int, float]], longest: int) -> list[int]:
    """Boundaries after merging the best-scoring pair of neighbours, the first of equals, as long as there is one."""
    if len(word) > SCANNED_LETTERS:
        return _merge_by_heap(word, edges)

    return [0, *accumulate(map(len, merged_parts(word, {p: -score for p, (_, score) in edges.items()})))]


def merged_parts(word: str, cost_of: dict[str, float]) -> list[str]:
    """The parts of a short word after all merges; of the pairs that are a piece, the one of least cost merges first."""
    parts, get = list(word), cost_of.get
    costs = [get(a + b, inf) for a, b in zip(parts, parts[1:], strict=False)]
    while costs:
        least = min(costs)
        if least == inf:
            break
        k = costs.index(least)
        joined = parts[k] = parts[k] + parts.pop(k + 1)
        del costs[k]
        if k < len(costs):
            costs[k] = get(joined + parts[k + 1], inf)
        if k:
            costs[k - 1] = get(parts[k - 1] + joined, inf)
    return parts


def _merge_by_heap(word: str, edges: dict[str, tuple[int, float]]) -> list[int]:
    """The same for a long word: neighbours are linked, and pairs wait in a heap."""
    n = len(word)
    after, before = list(range(1, n + 2)), list(range(-1, n))
    queue: list[tuple[float, int, int, int]] = []

    def offer(start: int) -> None:
        middle = after[start]
        stop = after[middle] if middle < n else n + 1
        edge = edges.get(word[start:stop]) if stop <= n else None
        if edge:
            heappush(queue, (-edge[1], start, middle, stop))

    for start in range(n - 1):
        offer(start)
    while queue:
        _, start, middle, stop = heappop(queue)
        # Of an older pair, one of the pieces has grown or is gone.
        if before[middle] != start or after[start] != middle or after[middle] != stop:
            continue
        after[start], before[stop] = stop, start
        after[middle] = before[middle] = -1
        if start:
            offer(before[start])
        offer(start)
    bounds = [0]
    while bounds[-1] < n:
        bounds.append(after[bounds[-1]])
    return bounds


FOLDS = {"viterbi": viterbi, "merge": merge}


class WordIds(dict):
    """The ids of a word; so many words as ``FREQUENT`` are remembered."""

    def __init__(self, pieces: Pieces, fold: str, limit: int):
        super().__init__()
        self.pieces, self.fold, self.limit = pieces, FOLDS[fold], limit
        self.id_of = {p: k for p, (k, _) in pieces.edges.items()}
        self.cost_of = {p: -score for p, (_, score) in pieces.edges.items()}

    def parts(self, word: str) -> list[str]:
        if self.fold is merge and len(word) <= SCANNED_LETTERS:
            return merged_parts(word, self.cost_of)
        bounds = self.fold(word, self.pieces.edges, self.pieces.longest)
        return [word[start:stop] for start, stop in zip(bounds, bounds[1:], strict=False)]

    def __missing__(self, word: str) -> list[int]:
        p, out = self.pieces, []
        for part in self.parts(word):
            known = self.id_of.get(part)
            if known is not None:
                out.append(known)
            elif p.first_byte == p.unknown:
                out.append(p.unknown)
            else:
                out += [p.first_byte + b for b in part.encode()]
        if len(self) < self.limit:
            self[word] = tuple(out)  # not followed by the garbage collector
        return out


def encoded_words(words: DataFrame, pieces: Pieces, fold: str = "merge") -> DataFrame:
    """The rows with ``ids`` of their word; a letter that is no piece gives the ids of its bytes, or the unknown id."""
    schema = StructType([*words.schema.fields, StructField("ids", ArrayType(IntegerType()))])
    limit = FREQUENT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordIds(pieces, fold, limit)
        for batch in batches:
            found = pa.array([known[w] for w in batch.column("word").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=schema.names)

    return words.mapInArrow(run, schema)


def _hashed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    hashes = (F.xxhash64(text).alias("row"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *hashes, text.alias("text"))


def encoded_parts(docs: DataFrame, pieces: Pieces, fold: str = "merge") -> DataFrame:
    """(doc_id, row, text_hash, parts) per row: structs of a word's place and ids, in order.

    A null or empty text has no parts; ``text_hash`` takes null as empty, ``row`` does not.
    """
    limit, batch_ids = FREQUENT, BATCH_IDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordIds(pieces, fold, limit)
        for batch in batches:
            first, texts = 0, batch.column("text")
            ids, ends, places, counts = [], [0], [], [0]
            for k in range(batch.num_rows):
                found = [known[word] for word in words_of(texts[k].as_py())]
                ends += accumulate(map(len, found), initial=ends.pop())
                ids += chain.from_iterable(found)
                places += range(len(found))
                counts.append(len(places))
                if len(ids) >= batch_ids or k == batch.num_rows - 1:
                    held = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                    words = pa.StructArray.from_arrays([pa.array(places, pa.int32()), held], names=["at", "ids"])
                    parts = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), words)
                    own = batch.slice(first, k + 1 - first)
                    yield pa.RecordBatch.from_arrays([*own.columns[:3], parts], names=["doc_id", "row", "text_hash", "parts"])
                    first, ids, ends, places, counts = k + 1, [], [0], [], [0]

    return _hashed(docs).mapInArrow(run, "doc_id long, row long, text_hash long, parts array<struct<at:int,ids:array<int>>>")


def ids_of_parts() -> Column:
    return F.flatten(F.transform("parts", lambda p: p["ids"]))


def encode(docs: DataFrame, pieces: Pieces, fold: str = "merge") -> DataFrame:
    """(doc_id, ids) per distinct (doc_id, text); a null or empty text has no ids. Other columns are ignored."""
    once = encoded_parts(docs, pieces, fold).dropDuplicates(["doc_id", "row", "text_hash"])
    return once.select("doc_id", ids_of_parts().alias("ids"))


def decoded(ids: Column, pieces: Pieces) -> Column:
    """Pieces and bytes end to end, borders as spaces, without the first; empty for no ids."""
    spelled = F.split(F.lit(pieces.spelled), ",")  # worked out once: all of it is constant
    data = F.unhex(F.array_join(F.transform(ids, lambda k: F.get(spelled, k)), ""))
    text = F.replace(F.decode(data, "UTF-8"), F.lit(BORDER), F.lit(" "))
    return F.coalesce(F.regexp_replace(text, "^ ", ""), F.lit(""))


def decode(encoded: DataFrame, pieces: Pieces) -> DataFrame:
    """(doc_id, text) per row of (doc_id, ids)."""
    return encoded.select("doc_id", decoded(F.col("ids"), pieces).alias("text"))


def digests(docs: DataFrame, pieces: Pieces, fold: str = "merge") -> DataFrame:
    """(doc_id, n_pieces, ids_digest, text_sha256, round_trip) per distinct (doc_id, text): encoded, then decoded as a whole.

    ``ids_digest`` is the sum of xxhash64(position of the word, its ids) over the
    document's words, taken modulo 2^31 each, so it depends on every id in order.
    ``text_sha256`` is of the text decoded from the ids; ``round_trip`` tells by
    hash whether that is the text itself (null as empty).
    """
    word = lambda p: F.pmod(F.xxhash64(p["at"], p["ids"]), F.lit(1 << 31).cast("long"))
    summed = F.aggregate("parts", F.lit(0).cast("long"), lambda total, p: total + word(p))
    ids = encoded_parts(docs, pieces, fold).select("doc_id", "row", "text_hash", summed.alias("ids_digest"), ids_of_parts().alias("ids"))
    both = ids.select("*", decoded(F.col("ids"), pieces).alias("decoded"))
    round_trip = F.xxhash64("decoded") == F.col("text_hash")
    found = both.select("doc_id", "row", "text_hash", F.size("ids").cast("long").alias("n_pieces"), "ids_digest", F.sha2("decoded", 256).alias("text_sha256"), round_trip.alias("round_trip"))
    # Equal rows have equal digests, so only those are compared.
    return found.distinct().drop("row", "text_hash")


def model_path(name: str = VOCABULARY) -> str:
    return public_tokenizers.path(name)
