"""Language ID by held-out accuracy, and the pipeline stage by stage."""

import sys
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from mandatewatch.llm import byte_convnet
from mandatewatch.llm.common import written

sys.path.insert(0, str(__import__("pathlib").Path(__file__).parent))
from conftest import brute_components, words  # noqa: E402
from test_tokens import packed_ids  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = __spark_entry__.queries()["op9_language_id"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id")
    rows = found.filter("held_out").collect()
    assert rows and np.mean([r.lang == r.lang_pred for r in rows]) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_texts_have_no_language(spark, docs):
    labelled = spark.createDataFrame([(k, t * 9, v) for k in range(80) for t, v in (("the of and ", "en"), ("der die und ", "de"))], "doc_id long, text string, lang string")
    net = byte_convnet.train(labelled)
    assert net.labels == ["de", "en"]
    found = {(r.doc_id, r.lang_pred, r.score) for r in byte_convnet.predict(docs, net).collect()}
    texts = docs.select("doc_id", "text").collect()
    assert len(found) <= len(texts)
    for r in texts:
        if not any(map(str.isalpha, r.text or "")):
            assert (r.doc_id, "und", 0.0) in found
    assert byte_convnet.keep_known(docs, net).columns == docs.columns
    assert byte_convnet.predict(docs.limit(0), net).count() == 0


def test_training_never_sees_held_out_rows_and_needs_labels(spark):
    rows = [(k, "words here", "xx" if k % 2 else None) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = {r.doc_id for r in docs.filter(byte_convnet.held_out()).collect()}
    poisoned = docs.withColumn("lang", F.when(byte_convnet.held_out(), F.lit("held")).otherwise(F.col("lang")))
    assert held and byte_convnet.train(poisoned).labels == ["xx"]
    nothing = byte_convnet.train(docs.limit(0))
    assert [r.lang_pred for r in byte_convnet.predict(docs, nothing).collect()] == ["und"] * 40


def test_texts_without_a_letter_go_without_labels_too(spark, docs, rows):
    plain = docs.withColumn("lang", F.lit(None).cast("string"))
    net = byte_convnet.train(plain)
    assert not net.labels
    kept = byte_convnet.keep_known(plain, net)
    assert kept.columns == plain.columns
    want = [(d, t) for d, t in rows if any(map(str.isalpha, t or ""))]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str) and len(want) < len(rows)


def test_noise_goes_and_short_clean_texts_stay(spark):
    """Encoded, shuffled and random text of several windows goes; clean texts of any length and short noise stay."""
    import base64
    import random

    rng = random.Random(3)
    source = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = byte_convnet.train(source, noise=True)
    assert net.labels[0] == byte_convnet.NOISE and len(net.labels) == 5
    clean = [r.text for r in source.filter("length(text) > 1500 and lang is not null").orderBy("doc_id").limit(60).collect()]
    shuffled = ["".join(rng.sample(t, len(t))) for t in clean[:20]]
    encoded = [base64.b64encode(t.encode()).decode() for t in clean[20:40]] + [t.encode().hex() for t in clean[40:]]
    noise = shuffled + encoded + ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789/+=") for _ in range(3000)) for _ in range(10)]
    good = clean + [t[: rng.randrange(20, 700)] for t in clean] + [t[:600] for t in noise]
    rows = [(k, t) for k, t in enumerate(good)] + [(1000 + k, t) for k, t in enumerate(noise)]
    kept = {r.doc_id for r in byte_convnet.keep_known(spark.createDataFrame(rows, "doc_id long, text string"), net).collect()}
    assert len([k for k in range(len(good)) if k not in kept]) <= 0.02 * len(good)
    assert len([k for k in kept if k >= 1000]) <= 0.1 * len(noise)


def brute_language(net, text):
    """Every window of a text through a plain convolution, weighed by its bytes."""
    if not net.labels or not any(map(str.isalpha, text or "")):
        return "und", 0.0
    data, total = text.encode(), np.zeros(len(net.labels))
    for at in range(0, len(data), byte_convnet.WINDOW):
        own = data[at : at + byte_convnet.WINDOW]
        row = own + bytes(byte_convnet.WINDOW - len(own))
        best = []
        for w, table in zip(byte_convnet.WIDTHS, net.tables, strict=True):
            best.append(np.max([sum(table[o][row[p + o]].astype("f8") for o in range(w)) for p in range(byte_convnet.WINDOW - w + 1)], axis=0))
        hidden = np.maximum(np.concatenate(best) + net.bias, 0) @ net.dense + net.dense_bias
        e = np.exp(hidden - hidden.max())
        total += len(own) * e / e.sum()
    mean = total / len(data)
    return net.labels[int(mean.argmax())], float(mean.max())


def test_prediction_equals_brute_force(spark, docs):
    """Texts of many windows, of one byte and of two languages, next to the whole odd table."""
    labelled = spark.read.parquet(f"{SF}/documents.parquet")
    net = byte_convnet.train(labelled)
    texts = [r.text for r in docs.select("text").limit(40).collect()] + [r.text for r in labelled.limit(15).collect()]
    one, two = labelled.filter("lang = 'en'").first().text, labelled.filter("lang = 'de'").first().text
    texts += [one[:700] + two[:700], two[:256], one[:257], "a", None, "1" * 300]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: (r.lang_pred, r.score) for r in byte_convnet.predict(rows, net).collect()}
    for k, text in enumerate(texts):
        lang, score = brute_language(net, text)
        assert abs(found[k][1] - score) < 1e-3 and (found[k][0] == lang or score < 0.51), (k, found[k], lang, score)


def test_pair_tables_equal_plain_convolution():
    rng = np.random.default_rng(0)
    net = byte_convnet.fit(["abc def " * 20, "xyz uvw " * 20] * 4, ["a", "b"] * 4, steps=5)
    rows = rng.integers(0, 256, (5, byte_convnet.WINDOW)).astype(np.uint8)
    pooled = []
    for w, table in zip(byte_convnet.WIDTHS, net.tables, strict=True):
        places = byte_convnet.WINDOW - w + 1
        pooled.append(sum(table[o][rows[:, o : o + places]] for o in range(w)).max(1))
    hidden = np.maximum(np.concatenate(pooled, 1) + net.bias, 0)
    want = byte_convnet.softmax(hidden @ net.dense + net.dense_bias)
    assert np.allclose(byte_convnet.Scorer(net).probabilities(rows), want, atol=1e-4)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), name)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] == counts[1] == counts[2] and counts[3] == counts[4] <= counts[2]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == counts[4]
    whole = corpus_pipeline.run(spark, SF)
    assert whole.select("doc_id", "piece", "ids_crc32").exceptAll(pieces.select("doc_id", "piece", "ids_crc32")).count() == 0


def lines_kept(rows, min_chars=10):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(lower)
    holders = defaultdict(set)
    for d, t in rows:
        for x in t.split("\n"):
            if d is not None and len(key(x)) >= min_chars:
                holders[key(x)].add(d)
    gone = lambda d, x: d is not None and len(holders.get(key(x), ())) > 1 and min(holders[key(x)]) != d
    return [(d, "\n".join(x for x in t.split("\n") if not gone(d, x))) for d, t in rows]


def one_of_each_group(rows, n=5, percent=80):
    """Rows take their place by (doc_id, text) as id, so that a group is named by the row that stays."""
    ordered = sorted(r for r in rows if r[0] is not None)
    found = brute_components([(k, t) for k, (_, t) in enumerate(ordered)], n, percent)
    return [r for r in rows if r[0] is None] + [ordered[k] for k, _, component in found if component == k]


def passages_kept(rows, width=35):
    texts = [words(t) for _, t in rows]
    seen = Counter(tuple(w[k : k + width]) for w in texts for k in range(len(w) - width + 1))
    out = []
    for (d, t), w in zip(rows, texts, strict=True):
        gone = {j for k in range(len(w) - width + 1) if seen[tuple(w[k : k + width])] > 1 for j in range(k, k + width)}
        out.append((d, b" ".join(x for k, x in enumerate(w) if k not in gone).decode() if gone else t))
    return out


def test_pipeline_equals_brute_force(spark, docs, rows, monkeypatch, tmp_path):
    """Every row and text after each stage of run(), on the odd table, and the packed ids."""
    docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("xx")).write.parquet(str(tmp_path / "documents.parquet"))
    tables = {}

    def noted(df, name):
        tables[name] = written(df, name)
        return tables[name]

    monkeypatch.setattr(corpus_pipeline, "written", noted)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = [(d, t) for d, t in rows if any(map(str.isalpha, t or ""))]
    for name, brute in (("language_id", list), ("line_dedup", lines_kept), ("ngram_jaccard", one_of_each_group), ("substring_dedup", passages_kept)):
        before, want = want, brute(want)
        assert sorted(((r.doc_id, r.text) for r in tables[name].select("doc_id", "text").collect()), key=str) == sorted(want, key=str), name
        assert name == "language_id" or sorted(want, key=str) != sorted(before, key=str)
    packed_ids(want, packed)


def test_registered_queries():
    names = list(__spark_entry__.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
