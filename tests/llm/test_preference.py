import duckdb
import pytest

from ledgerloom.llm import preference as P

SCHEMA = "pair_id long, side string, turn long, role string, text string, block string"


def render(turns):
    return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)


def brute(rows):
    """Expected (prompt, chosen, rejected) by pair, for distinct turn numbers."""
    out = {}
    for pair in {r[0] for r in rows if r[0] is not None}:
        side = {s: [(t, r or "", x or "") for _, _, t, r, x in sorted({(*y[:2], -1 if y[2] is None else y[2], y[3], y[4]) for y in rows if y[0] == pair and y[1] == s})] for s in ("chosen", "rejected")}
        a, b = side["chosen"], side["rejected"]
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        out[pair] = tuple(render((r, x) for _, r, x in part) for part in (a[:n], a[n:], b[n:]))
    return out


ROWS = [
    (1, "chosen", 0, "user", "hi"), (1, "chosen", 1, "assistant", "good"), (1, "rejected", 0, "user", "hi"), (1, "rejected", 1, "assistant", "bad"),
    (1, "chosen", 0, "user", "hi"),  # an exact repeat
    (2, "chosen", 0, "user", "a"), (2, "rejected", 0, "user", "b"), (2, "chosen", 1, "user", "same"), (2, "rejected", 1, "user", "same"),
    (3, "chosen", 0, "user", "alone"),
    (4, "chosen", 0, "user", "x"), (4, "rejected", 0, "user", "x"),
    (5, "chosen", None, None, None), (5, "rejected", None, None, None), (5, "chosen", 1, "assistant", "é<|im_end|>ü"), (5, "rejected", 1, "assistant", ""),
    (6, "chosen", 0, "system", "s"), (6, "rejected", 0, "system", "s"), (6, "chosen", 1, "user", "q"), (6, "rejected", 1, "user", "q"),
    (6, "chosen", 2, "assistant", "1"), (6, "rejected", 2, "assistant", "2"), (6, "chosen", 3, "user", "u"), (6, "chosen", 4, "assistant", "v"),
    (None, "chosen", 0, "user", "lost"), (7, "other", 0, "user", "lost"),
]


def test_pairs_match_brute_force(spark):
    got = P.preference_pairs(spark.createDataFrame([(*r, "extra") for r in ROWS], SCHEMA)).collect()
    want = brute([(a, b, c, d, None if e is None else e.replace("<|", "< |")) for a, b, c, d, e in ROWS if b != "other"])
    assert {r["pair_id"]: (r["prompt"], r["chosen"], r["rejected"]) for r in got if r["block"] >= 0 and r["pair_id"] != 5} == {k: v for k, v in want.items() if k != 5}
    five = sorted((r for r in got if r["pair_id"] == 5), key=lambda r: r["block"])
    assert tuple("".join(r[c] for r in five) for c in ("prompt", "chosen", "rejected")) == want[5]
    for r in got:
        for text, mask in ((r["chosen"], r["chosen_mask"]), (r["rejected"], r["rejected_mask"])):
            learned = [text[int(a) : int(b)] for a, b in (s.split(":") for s in mask.split(",") if s)]
            assert len(learned) == text.count("<|im_start|>assistant")
            assert all(x.endswith("<|im_end|>\n") and "<|im_start|>" not in x for x in learned)
    one = next(r for r in got if r["pair_id"] == 1)
    assert one["n_common"] == 1 and one["chosen"][slice(*map(int, one["chosen_mask"].split(":")))] == "good<|im_end|>\n"


def test_long_conversations_come_in_blocks(spark):
    rows = [(1, s, t, ("user", "assistant")[t % 2], f"{t}{'!' * (s == 'rejected' and t == 500)}", "") for s in ("chosen", "rejected") for t in range(600)]
    got = sorted(P.preference_pairs(spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda r: r["block"])
    assert [r["block"] for r in got] == [0, 1, 2] and sum(r["n_common"] for r in got) == 500
    assert "".join(r["prompt"] for r in got) == render((("user", "assistant")[t % 2], str(t)) for t in range(500))
    assert "".join(r["rejected"] for r in got).startswith("<|im_start|>user\n500!<|im_end|>")


def test_empty_table(spark):
    assert P.preference_pairs(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("extra", [[], [(1, 9, "assistant", None), (None, 0, "user", "x"), (2, None, None, "y"), (3, 0, "assistant", "only")]])
def test_query_equals_its_sql(spark, tmp_path, extra):
    rows = [(c, t, r, x) for c in range(4) for t, r, x in ((0, "user", f"q{c % 2}"), (1, "assistant", f"a{c}"), (2, "user", "more"), (300, "assistant", f"z{c}"))]
    df = spark.createDataFrame(rows + extra, "conv_id long, turn long, role string, text string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = P.op1_preference(spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = db.execute(f"select {', '.join(got.columns)} from ({P.ORACLE})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
