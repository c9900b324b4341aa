"""The text router against loops over all aliases, both ways of matching, and pointers against following them."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import routing, text_router

ALIASES = [(1, " Immergasse 26 "), (2, "immergasse 2"), (3, "gasse 26"), (4, "Apt 4B, Rosenhof"), (5, "apt 4b, rosenhof"), (6, ""), (6, None), (7, "  "), (8, "rosenhof garten süd"), (9, "x" * 70), (10, "x" * 69), (11, "Ärzte Haus")]
TEXTS = ["in der Immergasse 26 tropft es", "IMMERGASSE 2", "a gasse 26", "APT 4B, ROSENHOF", "der garten im süd", "rosenhof", "x" * 80, "", None, "ärzte haus!", "nothing known here", "Garten garten GARTEN", "the apt for from"]


def slow(value):
    low = (value or "").lower()
    hits = [(routing.python_score(len(a.lower().strip())), len(a.lower().strip()), n, a) for n, a in ALIASES if a and a.strip() and a.lower().strip() in low]
    if hits:
        best = min(hits, key=lambda h: (-h[0], -h[1], h[2], h[3]))
        return best[2], best[3], None, None
    words, shares = text_router.Matcher.tokens(value or ""), []
    for name in {n for n, a in ALIASES if a}:
        own = set().union(*(text_router.Matcher.tokens(a) for n, a in ALIASES if n == name and a))
        if own and own & words:
            shares.append((-len(own & words) / len(own), name))
    share, name = min(shares, default=(0, None))
    return (None, None, name, -share) if -share >= 0.3 else (None,) * 4


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_matches_either_way(spark, limit):
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "id int, body string")
    aliases = spark.createDataFrame(ALIASES, "name int, alias string")
    got = text_router.property_matches(texts, aliases, "id", "body", "name", "alias", limit=limit)
    assert {r["id"]: tuple(r)[1:] for r in got.collect()} == {i: slow(t) for i, t in enumerate(TEXTS)}
    none = text_router.property_matches(texts, aliases.limit(0), "id", "body", "name", "alias", limit=limit)
    assert {tuple(r)[1:] for r in none.collect()} == {(None,) * 4}


def test_tokens_are_those_of_the_columns(spark):
    values = ["Über die Straße 7a, the APT x yz_ab", "", "ÄÖ ß1 é23 from"]
    got = spark.createDataFrame([(v,) for v in values], "v string").select(text.tokens(F.col("v")).alias("t")).collect()
    assert [set(r["t"]) for r in got] == [text_router.Matcher.tokens(v) for v in values]


def route(spark, bodies, associations=((1,),)):
    events = spark.createDataFrame(list(enumerate(bodies)), "id int, body string")
    out = text_router.route_texts(
        events, spark.createDataFrame([(7, "Rosenhof Garten")], "name int, alias string"), spark.createDataFrame([("haus-12", 3), ("HAUS-12", 3)], "haus_id string, building int"),
        spark.createDataFrame(list(associations), "association int"), "id", "body", "name", "alias",
    )
    return [(r["method"], r["scope"], r["target"]) for r in out.orderBy("id").collect()]


def test_order_of_rules(spark):
    bodies = ["Mahnung for Rosenhof Garten", "Mahnung for Rosenhof Garten, WE 3", "rosenhof", "see Haus-12", "Mahnung HAUS-99 EH-04", "HAUS-99", "schwegen", None]
    want = [("text_weg_keyword", "association", "1"), ("text_alias", "unit", "7"), ("text_tokens", "unit", "7"), ("text_haus", "building", "3"), ("text_weg_keyword", "association", "1"), ("unrouted", None, None), ("unrouted", None, None), ("unrouted", None, None)]
    assert route(spark, bodies) == want
    two = route(spark, bodies, [(1,), (2,)])
    assert two[0] == ("text_alias", "unit", "7") and two[4] == ("unrouted", None, None) and two[1:4] == want[1:4]
    assert route(spark, bodies, []) == two


def test_pointers(spark):
    rng = random.Random(4)
    edges = {f"r{i}": rng.choice([f"r{rng.randrange(300)}", f"r{i + 1}", f"unit:{i}", "lost"]) for i in range(300)}
    edges |= {f"c{i}": f"c{i + 1}" for i in range(200)} | {"c200": "building:1", "self": "self", "a": "b", "b": "a"}

    def follow(ref):
        seen = set()
        while ref in edges and ref not in seen:
            seen.add(ref)
            ref = edges[ref]
        return ref if ":" in ref else None

    rows = [*edges.items(), ("c200", "unit:9"), ("none", None), (None, "x")]
    got = {r["ref"]: r["target"] for r in text_router.resolved(spark.createDataFrame(rows, "ref string, to string")).collect()}
    assert got == {k: t for k in edges if (t := follow(k))} and got["c0"] == "building:1"
    assert text_router.resolved(spark.createDataFrame([], "ref string, to string")).collect() == []


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_many_names_with_common_tokens(spark, limit):
    """Names that a text meets under common tokens only are met as one a class; a rare token still brings its own name."""
    rng = random.Random(3)
    names = [(i, f"garden block{i % 3} door{i}" + (" lift" if i % 5 == 0 else "") + (f" nook{i // 2}" if i % 7 == 0 else "")) for i in range(400)]
    texts = [" ".join(rng.sample(["garden", "block1", "block2", "lift", "nothing", "nook7", "nook84", f"door{rng.randrange(400)}", "door3x"], rng.randint(1, 5))) for _ in range(80)]
    want = {}
    for i, said in enumerate(map(text_router.Matcher.tokens, texts)):
        share, name = min((-len(own & said) / len(own), n) for n, a in names for own in [text_router.Matcher.tokens(a)])
        want[i] = (None, None, name, -share) if -share >= 0.3 else (None,) * 4
    frames = spark.createDataFrame(list(enumerate(texts)), "id int, body string"), spark.createDataFrame(names, "name int, alias string")
    got = text_router.property_matches(*frames, "id", "body", "name", "alias", limit=limit)
    assert {r["id"]: tuple(r)[1:] for r in got.collect()} == want
    if not limit:  # 400 names share a token: far fewer pairs than texts x names are made
        held = text_router.Matcher([(n, a, a.lower()) for n, a in names], 0.3)
        assert len(held.places["garden"]) <= 20 and len(held.places["door5"]) == 1


def test_aliases_that_start_alike(spark):
    """Only texts with the whole alias meet it, whatever number of starts may be broadcast."""
    names = [(i, f"Customer#{i:05d}") for i in range(3000)] + [(5000, "custom"), (5001, "Customer#00007 of old"), (5002, "#")]
    texts = [(1, "a customer#00012, customer#02999"), (2, "CUSTOMER#00007 of old"), (3, "customer#0001"), (4, "cust"), (5, "x#"), (6, None)]
    frames = spark.createDataFrame(texts, "id int, body string"), spark.createDataFrame(names, "name int, alias string")
    for limit in (1 << 16, 50, 1):
        got = routing.alias_matches(*frames, "id", "body", "name", "alias", limit=limit)
        assert {(r["id"], r["name"]) for r in got.collect()} == {(1, 12), (2, 5001), (3, 5000), (5, 5002)}
    low = frames[0].where("id = 4").selectExpr("id", "lower(body) as __text")
    assert routing._pieces(low, "id", [("customer", [14])]).count() == 0


def test_pointers_that_rest_are_left_alone(spark, monkeypatch):
    kept, keep = [], text_router.scratch.keep
    monkeypatch.setattr(text_router.scratch, "keep", lambda df, name: kept.append(out := keep(df, name)) or out)
    edges = [(f"r{i}", f"r{i + 1}") for i in range(63)] + [("r63", "unit:1"), *((f"x{i}", f"unit:{i}") for i in range(1000))]
    got = {r["ref"]: r["target"] for r in text_router.resolved(spark.createDataFrame(edges, "ref string, to string")).collect()}
    assert len(got) == 1064 and got["r0"] == "unit:1" and got["x7"] == "unit:7"
    assert sum(df.count() for df in kept) < 3 * 1064  # each round wrote all of them before


def test_structured_of_one_none_and_several_references(spark):
    cols = ("eh_id", "mie_id", "invoice_ref", "haus_id")
    refs = [(a, b, c, d) for a in ("EH-1", "EH-9", None) for b in ("MIE-1", "MIE-9", None) for c in ("INV-1", None) for d in ("HAUS-1", None)]
    rows = [(i, *r, "other", "none", "bank") for i, r in enumerate(refs)]
    events = spark.createDataFrame(rows, f"n int, {', '.join(c + ' string' for c in cols)}, category string, words string, source string")
    known = {"EH-1": "unit:1", "MIE-1": "unit:2", "INV-1": "building:3", "HAUS-1": "building:4"}
    got = text_router.structured(events, spark.createDataFrame(list(known.items()), "ref string, target string"), "association:1")
    want = {i: next((known[x] for x in r if x in known), None) for i, r in enumerate(refs)}
    assert {r["n"]: r["target"] for r in got.collect()} == want
    # events with one reference are joined once, whatever its kind
    once = [j for j in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join LeftOuter" in j and "__ref" in j]
    assert len(once) == 1
