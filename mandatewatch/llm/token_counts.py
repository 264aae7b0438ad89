"""Token counts of a SentencePiece BPE vocabulary by the whole-token shortcut.

No piece of the vocabulary has a word border after its first letter, so words
encode alone. Offline, once per worker, every piece of the form border + word is
encoded by the library; those that come back as themselves alone are proved to
count 1. A document is cut at its spaces and words found in that table are
counted directly; only the rest is merged by the library, each distinct one once
as long as the memo has room.
"""

from __future__ import annotations

from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mandatewatch.llm.common import MEMO_ENTRIES, in_batches

VOCABULARY = "piece_bpe_32k.model"
BORDER = "▁"


class WordCounts(dict):
    """Tokens of a word with one space before it, without that space."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(k) for k in range(self.library.get_piece_size())]
        plain = [k for k, p in enumerate(pieces) if not (self.library.is_control(k) or self.library.is_unknown(k) or self.library.is_byte(k))]
        self.separable = not any(BORDER in pieces[k].lstrip(BORDER) for k in plain)
        words = [pieces[k][1:] for k in plain if pieces[k][:1] == BORDER and len(pieces[k]) > 1 and pieces[k][1] != BORDER]
        # The library puts a border before its input, so a bare word is encoded with its border.
        alone = [w for w, ids in zip(words, self.library.encode(words, num_threads=1), strict=True) if len(ids) == 1]
        self.proved = len(alone)
        super().__init__(dict.fromkeys(alone, 1))
        # Holds only if the library keeps spaces as they are and adds one border in front.
        self.separable &= self.library.encode("a  b c", out_type=str, num_threads=1)[0] == BORDER + "a"

    def __missing__(self, word: str) -> int:
        found = len(self.library.encode(word, num_threads=1))
        if len(self) < MEMO_ENTRIES and "\n" not in word:
            self[word] = found
        return found

    def count(self, text: str | None) -> int:
        """Tokens of the whole text, without added ones."""
        if not text:
            return 0
        # Runs of spaces are merged among themselves, and borders in the text look like spaces.
        if not self.separable or "  " in text or text[0] == " " or text[-1] == " " or BORDER in text:
            return len(self.library.encode(text, num_threads=1))
        return sum(map(self.__getitem__, text.split(" ")))


@lru_cache(maxsize=2)
def word_counts(path: str) -> WordCounts:
    return WordCounts(path)


def count_tokens(docs: DataFrame, limit: int = 4096, vocabulary: str | None = None) -> DataFrame:
    """Per input row: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    A null text counts as empty: no bytes, no tokens. Equal doc_ids give a row each.
    """
    vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)
    arrow = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches):
        counts = word_counts(vocabulary)

        def rows():
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    n = counts.count(text)
                    yield doc_id, len(text.encode()) if text else 0, n, n > limit

        yield from in_batches(rows(), arrow)

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return own.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
