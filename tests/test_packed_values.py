import pytest

from siltstone.operators.packed_values import automaton_of, explode_values, split, whole_values


@pytest.mark.parametrize(
    "value, want",
    [
        (None, []), ("", []), (" ", []), ("[]", []), ("-", []), ("Unknown", []), ("n/a", []), ("Go", ["Go"]),
        ('["a, b", "c"]', ["a, b", "c"]), ("['x', 'y']", ["x", "y"]), ("• a\n• b", ["a", "b"]), ("* a\n* a", ["a", "a"]),
        ("1) a 2) b (c, d) 3) e", ["a", "b (c, d)", "e"]), ("a; ;b, c", ["a", "b", "c"]), ("a, b, and c", ["a", "b", "c"]),
        ('a,"so-called ""soft"" b, c",d', ["a", 'so-called "soft" b, c', "d"]), ("1,000-node beds / C/C++ / x", ["1,000-node beds", "C/C++", "x"]),
        ("trust and safety", ["trust and safety"]), ("a (b", ["a (b"]), ('say "x, y', ['say "x', "y"]), ("a\tb", ["a", "b"]),
    ],
)
def test_split(value, want):
    assert split(value) == want


def test_known_values_protect_their_delimiters():
    known = automaton_of(["law; policy", "data, models, and tools"])
    assert split("law; policy, data, models, and tools; Go", known) == ["law; policy", "data, models, and tools", "Go"]
    assert split("law; policy", known) == ["law; policy"]
    assert split("flaw; policy", known) == ["flaw", "policy"]
    assert whole_values('"a, b"; c') == ["a, b"] and whole_values('["a", "b|c"]') == ["b|c"]


def test_very_long_text_is_whole():
    assert len(split("; ".join(["v"] * 20000))) == 20000


def test_explode_on_rows_and_empty_table(spark):
    rows = [("t", 1, "a, b, a"), ("t", 2, None), ("t", 3, "[]"), ("t", 3, "x")]
    df = spark.createDataFrame(rows, "table_name string, row_id bigint, value string")
    got = sorted(map(tuple, explode_values(df).collect()))
    assert got == [("t", 1, 1, "a"), ("t", 1, 2, "b"), ("t", 1, 3, "a"), ("t", 3, 1, "x")]
    assert explode_values(df.limit(0)).count() == 0


def test_join_instead_of_the_automaton_gives_the_same(spark, monkeypatch):
    from siltstone.operators import packed_values

    rows = [("t", i, '["p, q"]') for i in range(3)] + [("t", 9, "p, q; r")]
    df = spark.createDataFrame(rows, "table_name string, row_id bigint, value string")
    one = sorted(map(tuple, explode_values(df).collect()))
    monkeypatch.setattr(packed_values, "AUTOMATON_CHARS", 0)
    assert sorted(map(tuple, explode_values(df).collect())) == one
    assert ("t", 9, 1, "p, q") in one


def test_join_keeps_known_values_of_many_pieces(spark, monkeypatch):
    from siltstone.operators import packed_values

    long = ", ".join("abcdefghij")
    rows = [("t", i, f'["{long}", "p; q"]') for i in range(3)] + [("t", 9, f"x; {long.upper()} ; p; q"), ("t", None, f"{long}; y")]
    df = spark.createDataFrame(rows, "table_name string, row_id bigint, value string")
    one = sorted(map(repr, explode_values(df).collect()))
    monkeypatch.setattr(packed_values, "AUTOMATON_CHARS", 0)
    got = explode_values(df).collect()
    assert sorted(map(repr, got)) == one
    assert [r.item_text for r in sorted(got, key=lambda r: r.item_pos) if r.row_id == 9] == ["x", long.upper(), "p; q"]
