"""Documents with every awkward case, and brute-force twins of the operators."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice("the of and to in that was for with on as by at from".split()) if rng.random() < 0.3 else f"w{rng.randrange(5000)}" for _ in range(n))


def corpus() -> list[tuple[int | None, str | None]]:
    rng = random.Random(5)
    texts: list[str | None] = [prose(rng, rng.choice([3, 20, 60, 120, 400])) for _ in range(60)]
    passage = prose(rng, 60)
    for k in range(8):  # a shared passage among different words
        texts.append(f"{prose(rng, 30)} {passage} {prose(rng, 30)}")
    base = prose(rng, 300).split()
    for k in range(12):  # a family of near copies
        near = list(base)
        for at in rng.sample(range(300), k):
            near[at] = f"edit{k}x{at}"
        texts.append(" ".join(near))
    texts += [texts[3]] * 6 + [texts[-1]] * 3  # exact copies
    texts += ["line one is here\nshort\n  LINE ONE is here \n\nshort", "a line\nline one is here\t\nshort", "short\n\n"]
    texts += [None, "", " ", "\n", "one", "one two", "One  TWO", "12 345 !!", "é" * 12 + "\nÜber ALLES", "x" * 5000, "\t\x0b\x0c tab words \r\n", "a b c"]
    texts += ["la " * 900, prose(rng, 4000), "<|endoftext|> <s> it's  two spaces ", "日本語 テキスト 🙂", "▁ border ▁▁ words"]
    rows: list[tuple[int | None, str | None]] = list(enumerate(texts))
    rows += [(5, texts[5]), (6, texts[9]), (None, texts[2]), (None, None)]  # a repeated row, a second text, no ids
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With columns whose names the operators use for themselves."""
    extra = "doc_id long, text string, n_tokens string, piece string, component_id int, key string, n_lines int"
    return spark.createDataFrame([(d, t, "x", None, 7, "k", 3) for d, t in rows], extra).repartition(5)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)


def words(text):
    return WORD.findall((text or "").encode())


def brute_components(rows, n, percent):
    """(doc_id, n_shingles, component_id) per row, by comparing all rows that share a shingle."""
    sets = []
    for _, text in rows:
        w = [x for x in WORD.findall((text or "").encode().lower())]
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = defaultdict(list)
    for k, ((doc_id, _), own) in enumerate(zip(rows, sets, strict=True)):
        if doc_id is None:
            continue
        shared = Counter(j for g in own for j in held[g])
        for j, both in shared.items():
            if 100 * both >= percent * (len(own) + len(sets[j]) - both):
                parent[find(k)] = find(j)
        for g in own:
            held[g].append(k)
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None and sets[k]:
            least[find(k)] = min(least.get(find(k), doc_id), doc_id)
    return sorted(((d, len(s), None if d is None else least.get(find(k), d) if s else d) for k, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def brute_windows(rows, width):
    """(doc_id, n_words, n_removed, kept_sha256) per row."""
    texts = [words(t) for _, t in rows]
    seen = Counter(tuple(w[k : k + width]) for w in texts for k in range(len(w) - width + 1))
    out = []
    for (doc_id, _), w in zip(rows, texts, strict=True):
        gone = set()
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone.update(range(k, k + width))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((doc_id, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def brute_lines(rows, min_chars=10):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(lower)
    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if doc_id is not None and len(key(line)) >= min_chars:
                holders[key(line)].add(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc_id is None or len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def collected(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
