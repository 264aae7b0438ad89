"""Tokens against the libraries, round trips and packing."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from mandatewatch.llm import byte_bpe, piece_lattice, residual_packing, token_counts, token_files

BPE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
PIECES = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def ids_of(text):
    return [*BPE.encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_byte_bpe_equals_library(rows):
    encoder = byte_bpe.byte_bpe(byte_bpe.vocabulary_path())
    odd = ["a \n b", "a\n b\n\nc", "it's we'll 1,000.50  x", " lead", "trail ", "a  b", " x y", "é́ z", "a\t b \tc"]
    for text in [*(t for _, t in rows), *odd]:
        assert encoder.encode(text) == np.array(ids_of(text)[:-1], "<u4").tobytes()


def test_byte_bpe_without_memo(rows, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMO_ENTRIES", 0)
    encoder = byte_bpe.ByteBpe(byte_bpe.vocabulary_path())
    assert encoder.encode(rows[0][1] or "some text") == np.array(ids_of(rows[0][1] or "some text")[:-1], "<u4").tobytes()
    assert not encoder.words


def test_counts_equal_library(docs, rows):
    found = token_counts.count_tokens(docs, limit=900)
    got = sorted((tuple(r) for r in found.collect()), key=str)
    want = [(d, len((t or "").encode()), n, n > 900) for d, t in rows for n in [len(PIECES.encode(t or ""))]]
    assert got == sorted(want, key=str)
    assert token_counts.count_tokens(docs.limit(0)).count() == 0


def test_whole_tokens_are_proved():
    counts = token_counts.WordCounts(public_tokenizers.path("piece_bpe_32k.model"))
    assert counts.separable and counts.proved > 10_000
    words = random.Random(1).sample([w for w, n in counts.items() if n == 1], 300)
    assert all(len(PIECES.encode(w)) == 1 for w in words)


def packed_ids(rows, found):
    """Pieces per (doc_id, first crc) are checked against the ids cut by hand."""
    by_doc = defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    want = defaultdict(list)
    for d, t in rows:
        ids = ids_of(t)
        at, piece, step = 0, 0, len(ids) % 2048 or 2048
        while at < len(ids):
            want[d].append((piece, at, step, crc(ids[at : at + step])))
            at, piece, step = at + step, piece + 1, 2048
    assert {d: sorted(x) for d, x in by_doc.items()} == {d: sorted(x) for d, x in want.items()}


def test_packing(docs, rows):
    found = residual_packing.pack(docs).collect()
    packed_ids(rows, found)
    bins = defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in found)
    assert len(bins) <= 1.05 * -(-total // 2048) + 1
    assert residual_packing.pack(docs.limit(0)).count() == 0


def test_no_bin_leaves_before_it_has_met_others(spark, docs, rows, monkeypatch):
    """Tasks of two bins: rounds go on while they join bins, and the packing stays whole and near the bound."""
    monkeypatch.setattr(residual_packing, "TASK_BINS", 2)
    found = residual_packing.pack(docs.repartition(16)).collect()
    packed_ids(rows, found)
    total = sum(r.length for r in found)
    assert len({r.sequence_id for r in found}) <= 1.15 * -(-total // 2048) + 2


def test_best_fit():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 2049, 3000)
    bins = residual_packing.best_fit(sizes, 2048)
    assert sorted(k for b in bins for k in b) == list(range(3000))
    assert all(sizes[b].sum() <= 2048 for b in bins)
    assert len(bins) <= 11 / 9 * sizes.sum() / 2048 + 1
    out = list(residual_packing.pack_items([(1500, b"x")] * 50 + [(2048, b"y")], 2048, False))
    assert len(out) == 51 and sum(not done for _, done, _ in out) == 50


def test_elias_fano_random_access():
    rng = np.random.default_rng(1)
    for values in ([0], [0, 0, 0], [0, 7, 7, 9000], [0, *np.cumsum(rng.integers(0, 3000, 1500)).tolist()]):
        sequence = token_files.EliasFano.of(np.array(values))
        assert [sequence[k] for k in range(len(values))] == values == sequence.all().tolist() == sequence.at(np.arange(len(values))).tolist()
        some = rng.integers(0, len(values), 40)
        assert sequence.at(some).tolist() == [values[k] for k in some]
    wide = token_files.EliasFano.of(np.arange(100_000) * 700)
    assert len(wide.low) + len(wide.high) < 100_000 * 12 / 8 + 16  # about 2 + log2(gap) bits each


def test_token_files_round_trip(spark, docs, rows, monkeypatch, tmp_path):
    monkeypatch.setattr(token_files, "SHARD_DOCS", 7)
    path = str(tmp_path / "shards")
    token_files.write_tokens(docs, path)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, at = [], 0
    for d, t in order:
        ids = ids_of(t)
        want.append((d, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted((tuple(r) for r in token_files.token_index(spark, path).collect()), key=lambda r: r[1]) == want
    back = {(r.doc_id, r.start): r.ids for r in token_files.read_tokens(spark, path).collect()}
    assert all(back[d, a] == ids_of(t) for (d, t), (_, a, _, _) in zip(order, want, strict=True))
    assert token_files.token_shards(docs.limit(0)).count() == 0


def test_wide_ids():
    shard = token_files.Shard(token_files.shard_bytes([np.array([1, 70_000], "<u4").tobytes(), b"", np.array([5], "<u4").tobytes()]))
    assert [shard.document(k).tolist() for k in range(len(shard))] == [[1, 70_000], [], [5]]


def test_lattice_equals_library_and_decodes(spark, docs, rows):
    pieces = piece_lattice.Pieces.of(spark, piece_lattice.model_path())
    small = docs.filter("text is null or length(text) < 600")
    encoded = piece_lattice.written(piece_lattice.encode(small, pieces), "encoded")
    got = {(r.doc_id, tuple(r.ids)) for r in encoded.collect()}
    want = {(d, tuple(PIECES.encode(t or ""))) for d, t in rows if t is None or len(t) < 600}
    assert got == want
    texts = {(r.doc_id, r.text) for r in piece_lattice.decode(encoded, pieces).collect()}
    assert texts == {(d, PIECES.decode(PIECES.encode(t or ""))) for d, t in rows if t is None or len(t) < 600}
    digests = piece_lattice.digests(small, pieces).collect()
    assert sum(r.n_pieces for r in digests) == sum(len(i) for _, i in want)
    assert piece_lattice.digests(docs.limit(0), pieces).count() == 0


def test_query_encodes_and_decodes_whole_texts(spark, rows, monkeypatch):
    """Long texts too, but for a word of 5,000 letters; with words that are not broadcast."""
    monkeypatch.setattr(piece_lattice, "FREQUENT", 50)
    pieces = piece_lattice.Pieces.of(spark, piece_lattice.model_path())
    rows = [(d, t) for d, t in rows if t is None or max(map(len, t.split(" "))) < 600]
    assert max(len(t or "") for _, t in rows) > 20_000
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {(r.doc_id, tuple(r.ids)) for r in piece_lattice.encode(docs, pieces).collect()} == {(d, tuple(PIECES.encode(t or ""))) for d, t in rows}
    found = piece_lattice.digests(docs, pieces).collect()
    want = set()
    for d, t in set(rows):
        ids = PIECES.encode(t or "")
        text = PIECES.decode(ids)
        want.add((d, len(ids), hashlib.sha256(text.encode()).hexdigest(), text == (t or "")))
    assert {(r.doc_id, r.n_pieces, r.text_sha256, r.round_trip) for r in found} == want
    assert len(found) == len(set(rows)) and {r.round_trip for r in found} == {True, False}


def test_viterbi_is_the_best_path(spark):
    rng = random.Random(4)
    letters = "abc"
    table = {piece: -rng.uniform(1, 9) for n in (1, 2, 3, 4) for _ in range(9) for piece in ["".join(rng.choice(letters) for _ in range(n))]}
    table |= {c: -8.0 - k for k, c in enumerate("▁abc")}
    names = sorted(table)
    pieces = piece_lattice.Pieces.from_rows(spark, [(p, k, table[p]) for k, p in enumerate(names)], 1000, 0)
    words = sorted({"▁" + "".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(60)})
    found = {r.word: r.ids for r in piece_lattice.encoded_words(spark.createDataFrame([(w,) for w in words], "word string"), pieces, "viterbi").collect()}

    def best(word):
        cells = [(0.0, ())]
        for stop in range(1, len(word) + 1):
            cells.append(max((cells[s][0] + table[word[s:stop]], cells[s][1] + (names.index(word[s:stop]),)) for s in range(stop) if word[s:stop] in table))
        return cells[-1]

    for word in words:
        assert abs(sum(table[names[k]] for k in found[word]) - best(word)[0]) < 1e-9
        assert "".join(names[k] for k in found[word]) == word


def test_words_are_cut_as_before_and_long_words_merge_alike():
    """A scan of the pairs and the heap give the same boundaries; the library's ids for words of both kinds."""
    assert piece_lattice.words_of("a  b\n\n c ") == ["▁a", "▁▁b", "\n", "\n", "▁c", "▁"] and piece_lattice.words_of(None) == []
    edges = {PIECES.id_to_piece(k): (k, float(PIECES.get_score(k))) for k in range(PIECES.get_piece_size()) if not (PIECES.is_control(k) or PIECES.is_unknown(k) or PIECES.is_byte(k))}
    rng = random.Random(8)
    for length in (1, 2, 3, 9, 30, 48):
        word = "▁" + "".join(rng.choice("abetins1é") for _ in range(length - 1))
        assert piece_lattice.merge(word, edges, 16) == piece_lattice._merge_by_heap(word, edges)
    known = piece_lattice.WordIds(piece_lattice.Pieces(edges, 16, PIECES.piece_to_id("<0x00>"), PIECES.unk_id(), ""), "merge", 1)
    for word in ("information", "zz" * 400, "é中", "aaaaaaaaa"):
        assert known["▁" + word] == PIECES.encode(word)
    assert len(known) == 1


def test_a_task_remembers_more_words_than_are_frequent():
    """op2: CPU: in mixed texts most of the time went to words merged again and again."""
    edges = {PIECES.id_to_piece(k): (k, float(PIECES.get_score(k))) for k in range(PIECES.get_piece_size()) if not (PIECES.is_control(k) or PIECES.is_unknown(k) or PIECES.is_byte(k))}
    known = piece_lattice.WordIds(piece_lattice.Pieces(edges, 16, PIECES.piece_to_id("<0x00>"), PIECES.unk_id(), ""), "merge", piece_lattice.FREQUENT)
    words = [f"w{k}" for k in range(70_000)]
    for again in range(2):
        assert all(list(known["▁" + w]) == PIECES.encode(w) for w in words[again::997])
        assert [len(known["▁" + w]) > 0 for w in words].count(False) == 0
    assert all("▁" + w in known for w in words)


def test_texts_are_encoded_without_rows_of_words(spark, docs):
    """op2: disk: the plan has no row of a word; it had three exchanges of them."""
    pieces = piece_lattice.Pieces.of(spark, piece_lattice.model_path())
    plan = piece_lattice.digests(docs, pieces)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan and plan.count("hashpartitioning") == 1
