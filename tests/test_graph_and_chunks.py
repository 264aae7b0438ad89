import random

from mandatewatch.operators import chunking, graph, taxonomy
from mandatewatch.operators.graph import hub_sharing


def random_graph(seed, n=60, m=45):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(n):03d}", f"n{rng.randrange(n):03d}") for _ in range(m)]
    # A hub with a third of all nodes, and a long chain.
    edges += [("n000", f"n{i:03d}") for i in range(1, n // 3)]
    chain = [f"c{i:03d}" for i in range(25)]
    edges += list(zip(chain, chain[1:]))
    return [f"n{i:03d}" for i in range(n)] + chain, edges


def test_components_and_depth(spark):
    nodes, edges = random_graph(1)
    near = {n: set() for n in nodes}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)

    def flood(start):
        depth, frontier = {start: 0}, [start]
        while frontier:
            frontier = [y for x in frontier for y in near[x] if y not in depth and not depth.__setitem__(y, depth[x] + 1)]
        return depth

    ids = spark.createDataFrame([(n,) for n in nodes], "id string")
    links = spark.createDataFrame(edges, "src string, dst string")
    got = {r["id"]: r["component"] for r in graph.connected_components(ids, links).collect()}
    assert got == {n: min(flood(n)) for n in nodes}
    seeds = spark.createDataFrame([("c000",), ("n000",)], "id string")
    depth = {r["id"]: r["depth"] for r in graph.hop_depth(seeds, links).collect()}
    assert depth == {**flood("c000"), **flood("n000")}


def test_ring_features(spark):
    nodes = spark.createDataFrame(
        [("m1", "merchant", True, 10), ("m2", "merchant", True, 20), ("m3", "merchant", False, 1000), ("m4", "merchant", False, 500),
         ("A", "acquirer", None, None), ("B1", "beneficiary", None, None), ("B2", "beneficiary", None, None)],
        "id string, type string, is_fraud_ring_member boolean, registered_days_ago int",
    )
    rows = [("m1", "A", "uses_acquirer"), ("m2", "A", "uses_acquirer"), ("m3", "A", "uses_acquirer"),
            ("m1", "B1", "owned_by"), ("m2", "B1", "owned_by"), ("m3", "B2", "owned_by")]
    edges = spark.createDataFrame(rows, "src string, dst string, relation string")
    owners = {r["id"]: (r["o_peers"], r["o_age_spread"]) for r in hub_sharing(edges, nodes, "owned_by", "o").collect()}
    assert owners == {"m1": (1, 10), "m2": (1, 10), "m3": (0, 0)}
    got = {r["id"]: r for r in graph.ring_features(nodes, edges).collect()}
    assert set(got) == {"m1", "m2", "m3", "m4"}
    assert got["m1"]["community_size"] == 3 and got["m4"]["degree"] == 0 and got["m4"]["mean1_age"] == 0.0
    assert got["m1"]["mean1_is_acquirer"] == 0.5 and got["m3"]["age"] == 1.0
    labels = {r["id"]: r["label"] for r in graph.node_features(nodes).collect()}
    assert labels["A"] == -1 and labels["m1"] == 1 and labels["m3"] == 0
    ages = graph.node_features(nodes.filter("type = 'acquirer'")).first()
    assert ages["age"] == 0.0
    assert {(r["type"], r["ring"]): r["n"] for r in graph.graph_counts(nodes, edges).collect()}[("edge", None)] == 6


def test_attack_graph(spark):
    schema = "attack_id string, name string, category string, delivery_vector string, mechanism_type string, grounding array<string>"
    attacks = spark.createDataFrame(
        [("attack_1", "N", "c", "seo", "spoof", ["http://x:1", "http://x:1"]), ("attack_2", "M", "c", "seo", "other", [])], schema
    )
    edges = [tuple(r) for r in taxonomy.graph_edges(attacks).collect()]
    assert edges.count(("attack_1", "source:http://x:1", "grounded_in")) == 2
    assert ("attack_1", "delivery:seo", "delivered_via") in edges and ("attack_1", "mechanism_type:spoof", "has_mechanism") in edges
    nodes = {r["id"]: (r["type"], r["value"]) for r in taxonomy.graph_nodes(attacks).collect()}
    assert nodes["source:http://x:1"] == ("source", "http://x:1") and nodes["attack_1"] == ("attack", None) and len(nodes) == 6
    probes = spark.createDataFrame([("attack_1", "seo", "spoof"), ("attack_2", "seo", "spoof")], "attack_id string, delivery_vector string, mechanism_type string")
    assert [r["attack_id"] for r in taxonomy.shares_tags(probes, taxonomy.graph_edges(attacks)).collect()] == ["attack_1"]


def test_window_chunks_cover_the_text(spark):
    texts = {i: "".join(chr(97 + (i + k) % 26) for k in range(n)) for i, n in enumerate([0, 1, 99, 100, 101, 899, 900, 901, 1700, 1701, 5000])}
    frame = spark.createDataFrame(list(texts.items()), "id bigint, text string")
    found = {}
    for r in chunking.window_chunks(frame, "id", "text").orderBy("id", "pos").collect():
        found.setdefault(r["id"], []).append(r["text"])
    assert set(found) == {i for i, t in texts.items() if t}
    for i, pieces in found.items():
        assert pieces[0] + "".join(p[100:] for p in pieces[1:]) == texts[i]
        assert all(len(p) <= 900 for p in pieces) and all(len(p) > 100 for p in pieces[1:])


def test_recursive_chunks():
    assert chunking.split_text("short") == ["short"]
    assert chunking.split_text("a" * 10, 4, 1) == ["aaaa", "aaaa", "aaaa"]
    assert chunking.split_text("one two three four", 9, 4) == ["one two", "three", "four"]
    assert chunking.split_text("one two six four", 9, 4) == ["one two", "two six", "six four"]
    assert chunking.split_text("para one\n\npara two\n\nthree", 12, 0) == ["para one", "para two", "three"]
    rng = random.Random(0)
    text = "".join(rng.choice(["word ", "line\n", "para\n\n", "x" * 950, "é "]) for _ in range(900))
    chunks = chunking.split_text(text)
    assert all(0 < len(c) <= 900 for c in chunks)
    assert set("".join(text.split())) == set("".join("".join(chunks).split()))


def plain_split(text, size, overlap, separators=chunking.SEPARATORS):
    """Piece by piece, with the held pieces in a list."""
    at = next((i for i, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    finer = separators[at + 1 :] if separators[at] else ()
    head, *tail = text.split(separators[at]) if separators[at] else (None,)
    pieces = [p for p in [head, *(separators[at] + t for t in tail)] if p] if separators[at] else list(text)
    out, small = [], []

    def flush():
        held = []
        for piece in small:
            if held and len("".join(held)) + len(piece) > size:
                out.append("".join(held).strip())
                while len("".join(held)) > overlap or (held and len("".join(held)) + len(piece) > size):
                    held.pop(0)
            held.append(piece)
        if held:
            out.append("".join(held).strip())
        small.clear()

    for piece in pieces:
        if len(piece) < size or not finer:
            small.append(piece)
        else:
            flush()
            out.extend(plain_split(piece, size, overlap, finer))
    flush()
    return [c for c in out if c]


def test_chunks_equal_the_piecewise_loop():
    rng = random.Random(4)
    for _ in range(400):
        text = "".join(rng.choice(["word ", "line\n", "para\n\n", "x" * rng.randrange(1, 30), "é ", "\n\n\n", " "]) for _ in range(rng.randrange(0, 60)))
        size = rng.randrange(2, 40)
        overlap = rng.randrange(0, size)
        assert chunking.split_text(text, size, overlap) == plain_split(text, size, overlap)


def test_chunks_of_odd_and_long_texts():
    assert chunking.split_text("\n\n \n" * 2000) == []
    plain = "x" * 1_000_000
    chunks = chunking.split_text(plain)
    assert len(chunks) == 1250 and all(len(c) == 900 for c in chunks[:-1]) and sum(len(c) - 100 for c in chunks) + 100 == 1_000_000
    words = "word " * 200_000
    assert len(chunking.split_text(words)) == 1250


def test_recursive_chunks_keep_source_and_order(spark):
    frame = spark.createDataFrame([(1, "s", "a b " * 500), (2, "t", ""), (3, "u", "tiny")], "id bigint, src string, body string")
    rows = chunking.recursive_chunks(frame, "id", "src", "body").orderBy("id", "pos").collect()
    assert {r["id"] for r in rows} == {1, 3} and [r["pos"] for r in rows if r["id"] == 1] == [0, 1, 2]
    assert {r["source"] for r in rows} == {"s", "u"}
