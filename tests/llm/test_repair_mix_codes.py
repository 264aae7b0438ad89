"""Turn repair, source mixing and part codes against brute force."""

import hashlib
import heapq
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from mandatewatch.llm import part_codes, source_mixing, turn_repair

SOUND = re.compile("(s?(ua)+)?")
FULL = {"u": "user", "a": "assistant"}
BLANK = " \t\n\x0b\f\r"


def cheapest(codes: str) -> tuple[int, str]:
    """Uniform-cost search over (row, state of a plain automaton), smallest (cost, audit) first."""
    step = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, done = [(0, "", 0, "0")], set()
    while True:
        cost, audit, row, state = heapq.heappop(heap)
        if row == len(codes) and state in "0a":
            return cost, audit
        if (row, state) in done:
            continue
        done.add((row, state))
        for role in "ua":
            if (state, role) in step:
                heapq.heappush(heap, (cost + 2, audit + "I", row, step[state, role]))
        if row < len(codes):
            own, left_in = codes[row].lower(), codes[row].isupper()
            heapq.heappush(heap, (cost + 3, audit + "D", row + 1, state))
            if own != "d":
                if (state, own) in step:
                    heapq.heappush(heap, (cost + left_in, audit + "K", row + 1, step[state, own]))
                for role in "ua":
                    if (state, role) in step:
                        heapq.heappush(heap, (cost + 2 + left_in, audit + "R", row + 1, step[state, role]))


def every_edit(codes: str) -> tuple[int, str]:
    """All edits of each row, and all short insertions in each gap."""
    found = []
    gaps = ["", "u", "a", "ua", "au"]
    for edits in itertools.product(["K", "Ru", "Ra", "D"], repeat=len(codes)):
        if any(c == "d" and e != "D" for c, e in zip(codes, edits)):
            continue
        for between in itertools.product(gaps, repeat=len(codes) + 1):
            roles, audit, cost = between[0], "I" * len(between[0]), 2 * len(between[0])
            for c, e, gap in zip(codes, edits, between[1:], strict=True):
                roles += (c.lower() if e == "K" else e[1:]) + gap
                audit += e[0] + "I" * len(gap)
                cost += {"K": 0, "R": 2, "D": 3}[e[0]] + (e != "D" and c.isupper()) + 2 * len(gap)
            if SOUND.fullmatch(roles):
                found.append((cost, audit))
    return min(found)


def test_parsing_finds_the_cheapest_edits():
    for n in range(4):
        for codes in itertools.product("suaxUAd", repeat=n):
            code = "".join(codes)
            ends = turn_repair.parse(code, turn_repair.START)
            assert min(ends[t] for t in turn_repair.ACCEPTED if t in ends) == every_edit(code) == cheapest(code), code
    rng = random.Random(1)
    for _ in range(300):
        code = "".join(rng.choice("suaxSUAd") for _ in range(rng.randrange(4, 30)))
        ends = turn_repair.parse(code, turn_repair.START)
        assert min(ends[t] for t in turn_repair.ACCEPTED if t in ends) == cheapest(code), code


def test_segments_compose_to_the_whole():
    rng = random.Random(2)
    for _ in range(200):
        code = "".join(rng.choice("suaxSUAd") for _ in range(rng.randrange(0, 40)))
        tops = {turn_repair.START: (0, "")}
        at = 0
        while at < len(code):
            size = rng.randrange(1, 9)
            tops = turn_repair.composed(tops, turn_repair.transfers(code[at : at + size]))
            at += size
        tops = turn_repair.composed(tops, turn_repair.transfers(""))
        assert min(tops[t] for t in turn_repair.ACCEPTED if t in tops) == cheapest(code), code


def conversations():
    rng = random.Random(7)
    rows = []
    texts = ["Hello there.", "What is it?", "no end", "", "   \n", "Fine!  ", "end. \t", None, "é ü 🙂.", "Same text."]
    for conv in range(120):
        for turn in range(rng.randrange(0, 9)):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            role = rng.choice(["system", "tool", "", None, "user"]) if rng.random() < 0.08 else role
            rows.append((conv, turn * rng.choice([1, 1, 1, 2]) if rng.random() < 0.95 else None, role, rng.choice(texts) if rng.random() < 0.5 else f"Text {conv} {turn}."))
    rows += [(500, t, ("user", "assistant")[t % 2], f"Long {t % 50}." if t % 7 else "cut") for t in range(900)]  # one long conversation
    rows += [(501, None, "user", "Same."), (501, None, "assistant", "x" * 200_000 + "."), (None, 1, "user", "No id."), (None, None, None, None)]
    rows += [(502, 3, "user", "Twice."), (502, 3, "user", "Twice."), (502, 3, "assistant", "Twice.")]
    rows += [(600 + k, 0, "user", "Alone.") for k in range(40)]  # some lose their only row
    rng.shuffle(rows)
    return rows


def same(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def brute_repairs(rows, damage=True):
    kept, out = defaultdict(list), {}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        role, text = " " if role is None else role, " " if text is None else text
        held = kept[conv]
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        held += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv, held in kept.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], same(r[1], r[2])))
        n, seen, codes = Counter(), set(), ""
        for _, role, text in held:
            shown = text.rstrip(BLANK)
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
            seen.add((role, text))
            n[fault] += 1
            letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
            codes += "d" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
        n["illegal"] = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(held, held[1:]))
        turns = {t for t, _, _ in held if t is not None}
        cost, audit = cheapest(codes)
        lines, last, left = [], "", list(held)
        for edit in audit:
            row = left.pop(0) if edit != "I" else None
            if edit == "D":
                continue
            last = row[1][:1] if edit == "K" else "a" if last == "u" else "u"
            lines.append((row[1] if edit == "K" else FULL[last]) + ":" + (row[2] if row else ""))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], n["illegal"], cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines)
    return out


TURNS = "conv_id long, turn long, role string, text string, place int, audit string, kind string"
COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.fixture(scope="module")
def turns(spark):
    rows = conversations()
    return rows, spark.createDataFrame([(*r, 1, "x", "y") for r in rows], TURNS).repartition(3)


@pytest.mark.parametrize("bits", [2, 10])
def test_repairs_equal_brute_force(turns, monkeypatch, bits):
    rows, df = turns
    monkeypatch.setattr(turn_repair, "SEGMENT_BITS", bits)
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in turn_repair.digests(turn_repair.damaged(df)).collect()}
    want = brute_repairs(rows)
    assert set(got) == set(want) and len([c for c, w in want.items() if w[6] == "" and w[5] == 0]) > 0
    assert {c: g for c, g in got.items() if g != want[c][:-1]} == {}


def test_repaired_rows(turns):
    rows, df = turns
    got = defaultdict(list)
    for r in turn_repair.repaired(turn_repair.undamaged(df)).collect():
        got[r.conv_id].append((r.position, f"{r.role}:{r.text}"))
    for conv, want in brute_repairs(rows, damage=False).items():
        assert [t for _, t in sorted(got[conv])] == want[-1] and [p for p, _ in sorted(got[conv])] == list(range(len(want[-1])))


def test_no_conversations(turns):
    _, df = turns
    assert turn_repair.digests(turn_repair.damaged(df.limit(0))).count() == 0


# Source mixing


def reshared(sizes: dict) -> dict:
    """Targets by giving out the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(sizes, 0.0), 1.5 * sum(sizes.values()), set(sizes)
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not full:
            return target | share
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return target


def mixed_rows(n_sources, seed, huge=True):
    rng = random.Random(seed)
    names = [None, "é", "Z", "a", "𝄞", "￿", ""] + [f"src{k}" for k in range(n_sources)]
    rows = []
    for k in range(900):
        source = names[-1] if rng.random() < 0.33 else rng.choice(names)
        text = rng.choice([None, "", " \t\n", "one", "a b\x0bc\fd\r\ne  f", "x " * rng.randrange(1, 400)])
        rows.append((k if rng.random() < 0.97 else None, text, source))
    rows += [rows[5], rows[6], (5000, None, "empty source"), (5001, "word " * (30_000 if huge else 3), "src0")]
    return rows


MIXED = "doc_id long, text string, source string, size string, target int, trial int, row string, own string, range int"


def words_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize(("n_sources", "seed"), [(1, 0), (9, 1), (60, 2)])
def test_mix_meets_reshared_targets(spark, n_sources, seed):
    rows = mixed_rows(n_sources, seed, huge=seed != 1)
    df = spark.createDataFrame([(*r, "s", 1, 1, "r", "o", 1) for r in rows], MIXED).repartition(3)
    got = source_mixing.mix(df).collect()
    again = source_mixing.mix(df.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    sizes, longest = Counter(), Counter()
    for _, text, source in rows:
        sizes[source] += words_of(text)
        longest[source] = max(longest[source], words_of(text))
    want = reshared(sizes)
    assert Counter((r.doc_id, r.size, r.source_size) for r in got) == Counter((d, words_of(t), sizes[s]) for d, t, s in rows)
    by_target = defaultdict(set)
    for s, t in want.items():
        by_target[sizes[s]].add(round(t, 6))
    assert all(round(r.target, 6) in by_target[r.source_size] for r in got)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    source_of = {d: s for d, _, s in rows if d is not None}
    taken = Counter()
    for r in got:
        if r.doc_id is not None:
            taken[source_of[r.doc_id]] += r.taken
    for d, t, s in rows:
        if d is None:
            taken[s] += next(r.taken for r in got if r.doc_id is None and r.size == words_of(t) and r.source_size == sizes[s])
    near = [abs(taken[s] - want[s]) <= max(longest[s], 0.15 * want[s]) for s in sizes if sizes[s] > 400]
    assert sum(near) >= 0.9 * len(near)


def test_mixture_holds_whole_rows(spark):
    rows = mixed_rows(9, 1)
    df = spark.createDataFrame([(*r, "s", 1, 1, "r", "o", 1) for r in rows], MIXED).repartition(3)
    out = source_mixing.mixture(df)
    assert out.columns == df.columns
    copies = Counter()
    for r in source_mixing.mix(df).filter("doc_id is not null").collect():
        copies[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in out.filter("doc_id is not null").collect()) == +copies


def test_mix_of_nothing_and_of_no_words(spark):
    df = spark.createDataFrame([(1, None, "a", "s", 1, 1, "r", "o", 1), (2, " ", None, "s", 1, 1, "r", "o", 1)], MIXED)
    assert source_mixing.mix(df.limit(0)).count() == 0
    assert source_mixing.mixture(df.limit(0)).count() == 0
    assert [(r.size, r.source_size, r.target, r.taken) for r in source_mixing.mix(df).collect()] == [(0, 0, 0.0, 0)] * 2


def test_mix_stays_in_dataframe_functions(spark):
    df = spark.createDataFrame([(*r, "s", 1, 1, "r", "o", 1) for r in mixed_rows(3, 0)], MIXED)
    plan = source_mixing.mix(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|MapIn", plan)


# Part codes


def brute_codes(rows, rounds=6):
    """(vec_id, code, error, label_error, digest) by plain loops over integers, for vectors of one length."""
    kept = [(i, lab, [math.floor(4096 * x) for x in v]) for i, v, lab in rows]
    dims = len(kept[0][2])
    ids = sorted({i for i, _, _ in kept}, key=lambda i: (i is None, i))[:16]
    seeds = [min(q for i, _, q in kept if i == own) for own in ids]
    cut = [k * dims // 8 for k in range(9)]
    books = [[s[cut[p] : cut[p + 1]] for s in seeds] for p in range(8)]

    def nearest(p, q):
        own = q[cut[p] : cut[p + 1]]
        return min((sum((a - b) ** 2 for a, b in zip(own, entry)), e) for e, entry in enumerate(books[p]))

    for _ in range(rounds):
        held = defaultdict(list)
        for _, _, q in kept:
            for p in range(8):
                held[p, nearest(p, q)[1]].append(q[cut[p] : cut[p + 1]])
        for (p, e), parts in held.items():
            books[p][e] = [sum(c) // len(parts) for c in zip(*parts)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, by_label = [], Counter()
    for i, label, q in kept:
        found = [nearest(p, q) for p in range(8)]
        by_label[label] += sum(d for d, _ in found)
        out.append((i, label, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    return [(i, code, error, by_label[label], digest) for i, label, code, error in out]


VECTORS = "vec_id long, embedding array<float>, label int, code string, part int, q string, error string"


def vector_rows(dims, n=260, seed=4):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(n, dims)) * rng.choice([0.01, 0.3, 2.0], n)[:, None]).astype("f4")
    x[n // 6 : n // 4] = x[n // 6]
    x[n // 4 : n // 3, : dims // 2] = x[n // 4, : dims // 2]  # common prefixes
    rows = [(3 * k, [float(v) for v in r], int(k % 4) if k % 11 else None) for k, r in enumerate(x)]
    return rows + [rows[2], rows[2], (7 * 3, rows[9][1], 1), (None, rows[11][1], 2)]


def coded(spark, rows):
    df = spark.createDataFrame([(*r, "c", 1, "q", "e") for r in rows], VECTORS).repartition(3)
    out = part_codes.with_label_errors(part_codes.compress(df))
    return sorted((tuple(r) for r in out.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


@pytest.mark.parametrize(("dims", "bundle", "trie"), [(16, 8192, 1 << 16), (16, 3, 40), (64, 16, 1 << 16), (13, 8, 64), (5, 8, 64), (0, 8, 64)])
def test_codes_equal_brute_force(spark, monkeypatch, dims, bundle, trie):
    monkeypatch.setattr(part_codes, "BUNDLE", bundle)
    monkeypatch.setattr(part_codes, "TRIE_PARTS", trie)
    rows = vector_rows(dims)
    bad = [(9000, None, 1), (9001, [None] + [1.0] * 15, 1), (9002, [float("nan")] * 16, 1), (9003, [float("inf")] * 16, None)]
    assert coded(spark, rows + bad) == sorted(brute_codes(rows), key=str)


def test_walk_shares_prefixes_and_breaks_ties_low():
    rng = np.random.default_rng(1)
    parts = np.unique(rng.integers(-3, 4, (5000, 6)), axis=0)
    book = rng.integers(-3, 4, (16, 6))
    book[9] = book[2]
    far = ((parts[:, None] - book[None]) ** 2).sum(2)
    for bundle in (1, 7, 300, 10_000):
        before, part_codes.BUNDLE = part_codes.BUNDLE, bundle
        entry, got = part_codes.walk(parts, book)
        part_codes.BUNDLE = before
        assert (entry == far.argmin(1)).all() and (got == far.min(1)).all()


def test_lengths_have_codebooks_of_their_own(spark):
    short, long = vector_rows(8, 30, 1), [(100_000 + i, v, lab) for i, v, lab in vector_rows(16, 50, 2) if i is not None]
    got = coded(spark, short + long)
    assert len({r[-1] for r in got}) == 2
    errors, label_of = Counter(), {}
    for part in (short, long):
        label_of |= {i: lab for i, _, lab in part}
        for i, code, error, _, digest in brute_codes(part):
            assert any(r[:3] == (i, code, error) and r[4] == digest for r in got)
    few = coded(spark, vector_rows(8, 30, 3)[:5])
    assert len(few) == 5 and all(set(r[1]) <= set("01234") for r in few)


def test_codes_of_nothing_and_their_approximation(spark):
    rows = vector_rows(16)
    df = spark.createDataFrame([(*r, "c", 1, "q", "e") for r in rows], VECTORS)
    assert part_codes.compress(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="beyond 8192"):
        part_codes.compress(df.limit(1).selectExpr("vec_id", "label", "transform(embedding, x -> 9000f) AS embedding"))
    q = part_codes.integers(df)
    books = part_codes.fit(q, 16)
    for r in books.decode(books.encode(q).join(q.select("vec_id", "q").distinct(), "vec_id")).filter("vec_id <> 21").collect():
        assert sum((int(round(a * 4096)) - b) ** 2 for a, b in zip(r.approximation, r.q)) == r.error
