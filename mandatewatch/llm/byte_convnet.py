"""Language ID by a byte convolutional network, trained in numpy.

Filters of several widths slide over the bytes of fixed-length windows; the
largest answer of each filter in a window goes through a softmax layer. The
first layer sees one-hot bytes, so a filter is a table with a number per byte
and place, and an answer is a sum of looked-up numbers. For prediction, the
tables of neighbouring bytes are added up beforehand, one row per byte pair. A
document's class is the one with the largest mean probability over all windows
of its whole text, weighted by their lengths.
"""

from __future__ import annotations

import base64
import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mandatewatch.llm.common import in_batches

UNKNOWN = "und"
#: The class of text that is none: made from training rows, and never a document's language.
NOISE = "\x00noise"
#: Windows from which on a text can be called noise, and the mean probability that takes.
NOISE_WINDOWS, NOISE_SHARE = 4, 0.5
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
#: The fit reads at most this many documents of each language, and of each one window from a hashed place.
SAMPLE_PER_LANGUAGE = 1024
#: Languages that are learned: the most frequent labels.
MAX_LANGUAGES = 256
#: Before that, about so many times the sample are drawn by another hash.
THINNED = 4
STEPS, BATCH, RATE, SEED = 240, 96, 0.02, 7
#: Windows that are scored at a time.
AT_ONCE = 48
PREDICTED = "doc_id long, lang_pred string, score double"


@dataclass
class ByteNet:
    labels: list[str]
    #: Per width: (width, 256, filters) numbers, and a bias per filter.
    tables: list[np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    def key(self) -> str:
        arrays = [*self.tables, self.bias, self.dense, self.dense_bias]
        return hashlib.sha256(b"".join(a.tobytes() for a in arrays) + "\0".join(self.labels).encode()).hexdigest()


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows_of(data: bytes) -> np.ndarray:
    """The bytes as rows of ``WINDOW``, the last one filled up with zeros."""
    n = max(-(-len(data) // WINDOW), 1)
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, WINDOW)


def fit(texts: list[str], labels: list[str], steps: int = STEPS, seed: int = SEED) -> ByteNet:
    """Trains on one window per text with Adam; batches draw the languages evenly."""
    names = sorted(set(labels))
    rng = np.random.default_rng(seed)
    x = np.concatenate([windows_of(t.encode()[:WINDOW]) for t in texts]) if texts else np.zeros((0, WINDOW), np.uint8)
    y = np.array([names.index(v) for v in labels], np.int64)
    n_features = FILTERS * len(WIDTHS)
    net = ByteNet(
        names,
        [rng.normal(0, 0.3, (w, 256, FILTERS)).astype("f4") for w in WIDTHS],
        np.zeros(n_features, "f4"),
        rng.normal(0, 0.3, (n_features, max(len(names), 1))).astype("f4"),
        np.zeros(max(len(names), 1), "f4"),
    )
    if len(names) < 2:
        return net
    weights = [*net.tables, net.bias, net.dense, net.dense_bias]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    members = [np.flatnonzero(y == c) for c in range(len(names))]
    for step in range(1, steps + 1):
        chosen = np.array([rng.choice(members[c]) for c in rng.integers(0, len(names), BATCH)])
        rows, n = x[chosen], np.arange(BATCH)
        pooled, places = [], []
        for w, table in zip(WIDTHS, net.tables, strict=True):
            answers = sum(table[o][rows[:, o : WINDOW - w + 1 + o]] for o in range(w))
            place = answers.argmax(axis=1)
            places.append(place)
            pooled.append(np.take_along_axis(answers, place[:, None, :], 1)[:, 0])
        before = np.concatenate(pooled, axis=1) + net.bias
        hidden = np.maximum(before, 0)
        error = softmax(hidden @ net.dense + net.dense_bias)
        error[n, y[chosen]] -= 1
        error /= BATCH
        back = (error @ net.dense.T) * (before > 0)
        slopes = []
        for k, (w, place) in enumerate(zip(WIDTHS, places, strict=True)):
            slope = np.zeros_like(net.tables[k])
            part = back[:, k * FILTERS : (k + 1) * FILTERS]
            for o in range(w):
                np.add.at(slope[o], (rows[n[:, None], place + o], np.arange(FILTERS)[None, :]), part)
            slopes.append(slope)
        slopes += [back.sum(0), hidden.T @ error, error.sum(0)]
        for weight, slope, m, v in zip(weights, slopes, first, second, strict=True):
            m += 0.1 * (slope - m)
            v += 0.01 * (slope**2 - v)
            weight -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype("f4")
    return net


class Scorer:
    """The network with its tables added up per byte pair."""

    def __init__(self, net: ByteNet):
        self.net = net
        two, three, four = net.tables
        pairs = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
        self.head = np.ascontiguousarray(np.concatenate([pairs(two[0], two[1]), pairs(three[0], three[1]), pairs(four[0], four[1])], 1))
        nothing = np.zeros((256, FILTERS), "f4")
        self.tail = np.ascontiguousarray(np.concatenate([pairs(three[2], nothing), pairs(four[2], four[3])], 1))

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        out = []
        for at in range(0, len(rows), AT_ONCE):
            block = rows[at : at + AT_ONCE].astype(np.int32)
            pair = (block[:, :-1] << 8) | block[:, 1:]
            head = self.head[pair]
            rest = self.tail[pair[:, 2:]]
            pooled = np.concatenate(
                [
                    head[:, :, :FILTERS].max(1),
                    # The third byte's row must not need a fourth: a width of 3 fits one place more.
                    np.maximum(
                        (head[:, :-2, FILTERS : 2 * FILTERS] + rest[:, :, :FILTERS]).max(1),
                        head[:, -2, FILTERS : 2 * FILTERS] + self.net.tables[1][2][block[:, -1]],
                    ),
                    (head[:, :-2, 2 * FILTERS :] + rest[:, :, FILTERS:]).max(1),
                ],
                axis=1,
            )
            out.append(softmax(np.maximum(pooled + self.net.bias, 0) @ self.net.dense + self.net.dense_bias))
        return np.concatenate(out)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, its mean probability) per text; ``und`` with 0 where there is no letter."""
        out = []
        for found in self.means(texts):
            best = int(found[1].argmax()) if found else 0
            out.append((self.net.labels[best], min(max(float(found[1][best]), 0.0), 1.0)) if found else (UNKNOWN, 0.0))
        return out

    def means(self, texts: list[str | None]) -> list[tuple[int, np.ndarray] | None]:
        """(windows, mean probability of each class) per text; None where there is no letter or no class."""
        out: list[tuple[int, np.ndarray] | None] = [None] * len(texts)
        held, owners = [], []
        for k, text in enumerate(texts):
            if self.net.labels and lettered(text):
                data = text.encode()
                held.append((data, windows_of(data)))
                owners.append(k)
            if held and (sum(len(d) for d, _ in held[-64:]) > 1 << 20 or len(held) >= 256 or k == len(texts) - 1):
                self._flush(held, owners, out)
                held, owners = [], []
        if held:
            self._flush(held, owners, out)
        return out

    def _flush(self, held, owners, out) -> None:
        found = self.probabilities(np.concatenate([w for _, w in held])).astype("f8")
        at = 0
        for (data, rows), k in zip(held, owners, strict=True):
            weight = np.full(len(rows), WINDOW, "f8")
            weight[-1] = len(data) - WINDOW * (len(rows) - 1)
            mean = weight @ found[at : at + len(rows)] / weight.sum()
            at += len(rows)
            out[k] = len(rows), mean


def lettered(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


_SCORERS: dict[str, Scorer] = {}


def scorer(net: ByteNet) -> Scorer:
    key = net.key()
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(net)
    return _SCORERS[key]


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def corrupted(text: str, kind: int, rng: np.random.Generator) -> str:
    """Noise of a text's size, made from it: shuffled characters, or its bytes shuffled, as hexadecimal digits, or in base 64."""
    data = text.encode()
    if kind == 0:
        return "".join(rng.permutation(list(text)).tolist())
    if kind == 1:
        return bytes(rng.permutation(np.frombuffer(data, np.uint8)).tolist()).decode(errors="replace")
    return data.hex() if kind == 2 else base64.b64encode(data).decode()


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, seed: int = SEED, noise: bool = False) -> ByteNet:
    """Fits on labelled documents that are not held out, at most ``per_language`` of each of ``MAX_LANGUAGES``.

    The sample is the rows with the smallest hashes of doc_id; of each, one
    window from a place that the hash picks. Rows without doc_id, text or lang
    are left out. Without any labelled row the network knows no language. With
    ``noise`` there is one class more, learned from corrupted training windows.
    """
    place = F.xxhash64("doc_id", F.lit(seed))
    at = F.pmod(place, F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1).cast("int") + 1
    labelled = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    ).filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0) & ~held_out())
    # One window per row from here on, and of those only a few times as many as are wanted of a language.
    pieces = labelled.select("doc_id", "lang", place.alias("place"), F.substring("text", at, F.lit(WINDOW)).alias("piece"))
    sizes = docs.select(F.col("lang").cast("string").alias("lang")).filter("lang is not null").groupBy("lang").agg(F.count("*").alias("rows"))
    sizes = sizes.orderBy(F.desc("rows"), "lang").limit(MAX_LANGUAGES)
    share = F.lit(float(THINNED * per_language)) / F.col("rows")
    thin = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(1 << 30)) < share * (1 << 30)
    drawn = pieces.join(F.broadcast(sizes), "lang").filter(thin).select("lang", "place", "piece")
    order = Window.partitionBy("lang").orderBy("place", "piece")
    sample = drawn.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_language).orderBy("lang", "n").collect()
    texts, labels = [r.piece for r in sample], [r.lang for r in sample]
    if noise and texts:
        rng = np.random.default_rng(seed)
        texts += [corrupted(t, k % 4, rng) for k, t in enumerate(texts)]
        labels += [NOISE] * len(sample)
    return fit(texts, labels, steps=STEPS * (2 if noise else 1), seed=seed)


def predict(docs: DataFrame, net: ByteNet) -> DataFrame:
    """Per input row: doc_id, lang_pred, score. Only doc_id and text are read, doc_id to pass it on.

    ``und`` with score 0 for a null text, one without a letter, or an untrained network.
    """
    arrow = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        model = scorer(net)

        def rows():
            for batch in batches:
                found = model.predict(batch.column(1).to_pylist())
                for doc_id, (lang, score) in zip(batch.column(0).to_pylist(), found, strict=True):
                    yield doc_id, lang, score

        yield from in_batches(rows(), arrow)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PREDICTED)


def keep_known(docs: DataFrame, net: ByteNet, windows: int = NOISE_WINDOWS, share: float = NOISE_SHARE) -> DataFrame:
    """The rows of ``docs``, all columns, without those that are in no language.

    Texts that are null or have no letter go, with or without a trained network.
    Of the others a text goes if it has ``windows`` windows or more and the noise
    class, where the network has one, a mean probability of more than ``share``
    over all of them. Shorter texts stay: there a licence line or a list of names
    weighs as much as the prose.
    """
    schema = docs.schema
    at = schema.names.index("text")

    def run(batches):
        noise = net.labels.index(NOISE) if NOISE in net.labels else None
        model = None if noise is None else scorer(net)
        for batch in batches:
            texts = [None if t is None else str(t) for t in batch.column(at).to_pylist()]
            if model is None:
                yield batch.filter(pa.array([lettered(t) for t in texts], pa.bool_()))
                continue
            found = model.means(texts)
            yield batch.filter(pa.array([m is not None and (m[0] < windows or m[1][noise] <= share) for m in found], pa.bool_()))

    return docs.mapInArrow(run, schema)
