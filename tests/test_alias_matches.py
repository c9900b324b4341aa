"""Alias matches against the rule: every alias that isn't blank after strip(), the best score first."""

from ledgerloom.operators import routing


def slow(texts, aliases):
    out = set()
    for i, text in texts:
        found = []
        for name, alias in aliases:
            low = (alias or "").lower().strip()
            if text is not None and low and low in text.lower():
                found.append((-(0.6 + min(len(low) / 60, 0.39)), -len(low), name, alias))
        if found:
            score, _, name, alias = min(found)
            out.add((i, name, alias, round(-score, 6)))
    return out


def test_short_and_padded_aliases(spark):
    aliases = [(1, "A12"), (2, " W3 "), (3, "\tHaus Nord "), (4, "x"), (5, "   "), (6, None), (7, ""), (8, "Haus"), (9, "ÄÖ"), (3, "a12"), (10, " y" + " " * 30)]
    texts = [(1, "Wohnung A12 kalt"), (2, "an W3"), (3, "das HAUS NORD heute"), (4, "x"), (5, "nichts"), (6, None), (7, ""), (8, "Hausw3"), (9, "äö"), (10, "A1 2 W 3"), (11, "w3 a12"), (12, "only y")]
    got = routing.alias_matches(
        spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(aliases, "name int, alias string"), "id", "text", "name", "alias"
    )
    assert {(r.id, r.name, r.alias, round(r.score, 6)) for r in got.collect()} == slow(texts, aliases)
