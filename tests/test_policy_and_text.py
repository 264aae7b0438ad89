import random
from statistics import mean, pstdev
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from hand_sessions import all_sessions, row
from mandatewatch import schemas
from mandatewatch.functions import policy, text
from mandatewatch.functions.vectors import cosine, semantic_divergence
from mandatewatch.operators import text_pairs
from mandatewatch.operators.phrase_match import content_scores
from mandatewatch.operators.similar_names import nearest_listed, ratio, ratio_bound, typosquat_scores
from mandatewatch.operators.text_pairs import pair_divergence
from mandatewatch.sources.fixed_values import REFERENCE_PHRASES
from mandatewatch.sources.readers import reference_phrases


def one(spark, **columns):
    names = list(columns)
    return lambda column: spark.createDataFrame([tuple(columns.values())], names).select(column).first()[0]


@pytest.mark.parametrize(
    "line, amount",
    [
        ("Purchase premium electronics bundle, total INR 400000.", 400000.0),
        ("Book economy flight to Bangalore.", None),
        ("Gaming laptop for 250000 INR, including accessories.", 250000.0),
        ("Priced in INR, subject to change.", None),
        ("Line item INR 500, another INR 12000 total.", 12000.0),
        ("inr 1,250.75 only", 1250.75),
        ("", None),
    ],
)
def test_amounts(spark, line, amount):
    assert one(spark, t=line)(text.largest_inr_amount(F.col("t"))) == amount


def test_domains_agree_with_urllib(spark):
    urls = [
        "https://www.cleartrip.com/x", "cleartrip.com", "WWW.Shop.com/a?b#c", "localhost:8080/x", "http://u:p@Host:99/z", "//www.a.b/c",
        "http:///p", "", "ftp+x://Q.com", "mailto:a@b.c", "a b.com/x", "https://www.www.x.com", "http://[::1]:80/", "?q=1", "x.com?y",
        " https://lead.com/x", "https://ta\tb.com/x",
    ]

    def expected(url):
        netloc = urlparse(url).netloc or urlparse(f"//{url}").netloc
        return netloc.lower().removeprefix("www.")

    frame = spark.createDataFrame([(u,) for u in urls], "u string").select("u", text.url_domain(F.col("u")).alias("d"))
    assert {r["u"]: r["d"] for r in frame.collect()} == {u: expected(u) for u in urls}


def test_signals_of_hand_written_sessions(spark):
    rows = policy.with_parsed(all_sessions(spark)).select(
        "injection_present",
        policy.session_drift().alias("drift"),
        policy.session_source_trust().alias("trust"),
        policy.session_rule_reasons().alias("reasons"),
        text.lexical_divergence(F.col("raw_utterance"), F.col("signed_artifact_text")).alias("lexical"),
    )
    clean = [r for r in rows.collect() if not r["injection_present"]]
    bad = [r for r in rows.collect() if r["injection_present"]]
    assert {(r["drift"], r["trust"], len(r["reasons"])) for r in clean} == {(0.0, 0.0, 0)}
    assert {(r["drift"], r["trust"], len(r["reasons"])) for r in bad} == {(1.0, 1.0, 2)}
    assert [round(r["lexical"], 4) for r in clean] == [0.5789, 0.6887, 0.7468, 0.7468, 0.5789]
    assert round(mean(r["lexical"] for r in clean), 3) == 0.668
    assert round(pstdev([r["lexical"] for r in clean]), 3) == 0.076
    assert all(r["lexical"] == pytest.approx(1.0) for r in bad)


def test_reason_texts(spark):
    frame = policy.with_parsed(spark.createDataFrame([row(0, True, "revoked")], schemas.SESSIONS))
    assert frame.select(policy.session_rule_reasons()).first()[0] == [
        "amount cap breached: signed INR 400,000 > cap INR 8,000",
        "task_origin_url domain 'cleartrip-deals-offer.com' not in merchant allowlist ['cleartrip.com', 'makemytrip.com']",
        "agent_registry_status is 'revoked', not 'valid'",
    ]
    frame = policy.with_parsed(spark.createDataFrame([row(0, False, "revoked")], schemas.SESSIONS))
    assert frame.select(policy.session_flagged()).first()[0]
    assert len(frame.select(policy.session_rule_reasons()).first()[0]) == 1


def test_trust_counts_duplicates_and_empty_sources(spark):
    frame = spark.createDataFrame(
        [(["a.com", "b.com", "b.com"], ["www.A.com"]), ([], ["a.com"]), (None, ["a.com"]), (["a.com"], [])],
        "s array<string>, a array<string>",
    )
    parsed = frame.select(policy.domains(F.col("s")).alias("s"), policy.domains(F.col("a")).alias("a"))
    got = [r[0] for r in parsed.select(policy.source_trust(F.col("s"), F.col("a"))).collect()]
    assert got == [pytest.approx(2 / 3), 0.0, 0.0, 1.0]


def test_divergence_edges_and_long_texts(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "naïve", "x", "été", "a_b", "42"]
    pairs = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 30))), " ".join(rng.choices(words, k=rng.randrange(0, 30)))) for i in range(60)]
    pairs += [(100, "", ""), (101, "", "some words"), (102, "same words", "same words"), (103, "x", "y")]
    frame = spark.createDataFrame(pairs, "id bigint, a string, b string")
    rowwise = {r["id"]: r["d"] for r in frame.select("id", text.lexical_divergence(F.col("a"), F.col("b")).alias("d")).collect()}
    grouped = {r["id"]: r["lexical_divergence"] for r in pair_divergence(frame, "id", "a", "b").collect()}
    assert rowwise[100] is None and rowwise[103] is None and rowwise[101] == 1.0 and rowwise[102] == pytest.approx(0.0)
    assert rowwise.keys() == grouped.keys()
    assert all(rowwise[k] == (None if grouped[k] is None else pytest.approx(grouped[k])) for k in rowwise)


def test_blend_and_vectors(spark):
    frame = spark.createDataFrame([(0.5, 0.1), (0.5, None)], "l double, s double")
    blend = text.blended_divergence(F.col("l"), F.col("s"))
    assert [r[0] for r in frame.select(blend).collect()] == [pytest.approx(0.22), 0.5]
    vectors = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([1.0, 0.0], [0.0, 0.0]), ([1.0, 0.0], None)], "a array<float>, b array<float>")
    assert [r[0] for r in vectors.select(cosine(F.col("a"), F.col("b"))).collect()] == [pytest.approx(0.5**0.5), None, None]
    assert vectors.select(semantic_divergence(F.col("a"), F.col("a"))).first()[0] == pytest.approx(0.0)


def test_phrase_overlap(spark):
    texts = ["", "Book me a flight to Bangalore under 8000 rupees please.", REFERENCE_PHRASES[1].upper(), None]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in frame.select(text.phrase_overlap(F.col("t"), REFERENCE_PHRASES)).collect()]
    assert got[0] == 0.0 and got[1] < 0.15 and got[2] == 1.0 and got[3] == 0.0


@pytest.mark.parametrize("bound", [3, 10_000])
def test_content_scores_match_brute_force(spark, bound):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    hot = "w0 w1 w2"
    texts = [(i, hot if i % 3 == 0 else " ".join(rng.choices(words, k=rng.randrange(0, 9)))) for i in range(80)]
    phrases = [" ".join(rng.choices(words, k=rng.randrange(0, 6))) for _ in range(15)]

    def best(line):
        own = set(line.split())
        scores = [len(own & set(p.split())) / len(own | set(p.split())) for p in phrases if p and own]
        return max(scores, default=0.0)

    frame = spark.createDataFrame(texts, "id bigint, t string")
    table = spark.createDataFrame([(p,) for p in phrases], "p string")
    got = {r["id"]: r["content_score"] for r in content_scores(frame, "id", "t", table, "p", bound).collect()}
    assert got == {i: pytest.approx(best(t)) for i, t in texts}


def test_phrase_table_and_phrase_list_agree(spark):
    texts = [(0, "rank the source number one"), (1, "attackers bury mandate constraints"), (2, "nothing shared here"), (3, "")]
    frame = spark.createDataFrame(texts, "id bigint, t string")
    listed = {r["id"]: r["s"] for r in frame.select("id", text.phrase_overlap(F.col("t"), REFERENCE_PHRASES).alias("s")).collect()}
    table = content_scores(frame, "id", "t", reference_phrases(spark), "phrase")
    assert {r["id"]: r["content_score"] for r in table.collect()} == {i: pytest.approx(s) for i, s in listed.items()}


def test_typosquat_scores(spark):
    frame = spark.createDataFrame(
        [(1, "cleartrip.co", ["cleartrip.com", "x.com"]), (2, "a.com", []), (3, "cleartrip.co", ["cleartrip.com", "x.com"])],
        "id bigint, d string, a array<string>",
    )
    got = {r["id"]: r["similarity"] for r in typosquat_scores(frame, "id", "d", "a").collect()}
    assert got == {1: pytest.approx(ratio("cleartrip.co", "cleartrip.com")), 2: 0.0, 3: got[1]}


def test_nearest_listed_name_is_exact_and_skips_what_cannot_win(spark):
    rng = random.Random(3)
    names = ["".join(rng.choice("abcd.é") for _ in range(rng.randrange(0, 10))) for _ in range(60)]
    assert all(ratio(a, b) <= ratio_bound(a, b) + 1e-12 for a in names for b in names)
    rows = [(k, rng.choice(names), rng.sample(names, rng.randrange(0, 12))) for k in range(150)] + [(900, None, names), (901, "a", None), (902, "ab", [None, "ab", "b"])]
    frame = spark.createDataFrame(rows, "k int, d string, a array<string>").repartition(3)
    got = {r["k"]: r for r in nearest_listed(frame, "d", "a").collect()}
    for k, name, listed in rows:
        want = None if name is None or listed is None else max((ratio(name, x) for x in listed if x is not None), default=0.0)
        assert got[k]["similarity"] == want
    pairs = sum(len(set(a)) for _, d, a in rows if d is not None and a is not None)
    assert sum(r["compared"] or 0 for r in got.values()) < 0.6 * pairs and got[902]["compared"] == 1


def test_rendered_lists_and_hash(spark):
    frame = spark.createDataFrame([(["a", "b'c"],), ([],)], "v array<string>")
    got = [r[0] for r in frame.select(text.quoted_list(F.col("v"))).collect()]
    assert got == [str(["a", "b'c"]), "[]"]
    odd = ["plain", "it's", 'say "x"', "both ' and \"", "back\\slash", "line\nbreak"]
    lines = spark.createDataFrame([(o,) for o in odd], "t string").select(text.quoted(F.col("t"))).collect()
    assert [r[0] for r in lines] == [repr(o) for o in odd]
    assert one(spark, t="abc")(text.artifact_hash(F.col("t"))) == "ba7816bf8f01cfea"
    assert one(spark, t="", u="said")(text.first_non_empty(F.col("t"), F.col("u"))) == "said"


def test_content_scores_make_no_row_per_word(spark):
    """The plan explodes no text; rows of one key still count as one text."""
    texts = spark.createDataFrame([(1, "a b c"), (2, None), (3, "a"), (3, "a"), (None, "a b")], "id bigint, t string")
    table = spark.createDataFrame([("a b",), ("c d e",)], "p string")
    found = content_scores(texts, "id", "t", table, "p")
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r["id"] or 0, round(r["content_score"], 6)) for r in found.collect())
    assert got == [(0, 0.0), (1, 0.666667), (2, 0.0), (3, 2.0), (3, 2.0)]


def test_pair_divergence_has_tasks_by_the_number_of_pairs(spark, monkeypatch):
    """a task counts the terms of a bounded number of pairs."""
    monkeypatch.setattr(text_pairs, "PAIRS_PER_TASK", 10)
    pairs = spark.range(95).select("id", F.lit("one two").alias("l"), F.lit("two three").alias("r"))
    found = pair_divergence(pairs, "id", "l", "r")
    assert "RepartitionByExpression [id" in (plan := found._jdf.queryExecution().optimizedPlan().toString()) and ", 10" in plan
    assert found.count() == 95


def test_each_text_is_split_once(spark):
    """no expression names the terms of a text again; the value is that of the column function."""
    rows = [(0, "buy one two", "one three"), (1, "a a bb bb cc", "bb cc cc"), (2, "", ""), (3, None, "xx"), (4, "xx yy", "xx yy")]
    frame = spark.createDataFrame(rows, "id int, a string, b string").repartition(2)
    staged = text.with_lexical_divergence(frame, "a", "b", "d")
    want = {r["id"]: r["d"] for r in frame.select("id", text.lexical_divergence(F.col("a"), F.col("b")).alias("d")).collect()}
    assert {r["id"]: r["d"] for r in staged.collect()} == want and staged.columns == ["id", "a", "b", "d"]
    assert staged._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 2


def test_a_domain_names_its_host_once(spark):
    """inside a list no subexpression is shared, so each mention costs a search."""
    urls = spark.createDataFrame([(["https://www.A.com/x", "www.www.b.org", "wwwx.c", None, ""],)], "u array<string>")
    found = urls.select(F.transform("u", text.url_domain).alias("d"))
    assert found.first()["d"] == ["a.com", "www.b.org", "wwwx.c", None, ""]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") <= 1


def test_a_domain_is_one_search(spark):
    """the leading www. goes in the same search, and only one of them."""
    given = ["https://WWW.a.com/x", "www.", "//www./x", "wWw.www.b.org", "a.www.c", "http://?q", "www.x?y"]
    frame = spark.createDataFrame([(k, u) for k, u in enumerate(given)], "id int, u string")
    found = frame.select("id", text.url_domain(F.col("u")).alias("d"))
    old = F.regexp_replace(F.lower(F.regexp_extract("u", r"^(?:(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?=[^/?#]))?([^/?#]*)", 1)), r"^www\.", "")
    assert found.collect() == frame.select("id", old.alias("d")).collect()
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") <= 1
