from siltstone.llm.truncation import truncated

BASE = [
    "The harbour office reports that the northern crane could not lift the copper bell before the storm began.",
    "The harbour office reports that the southern crane was repaired in the second week of the long winter.",
    "No public record shows how the small mills handle late payments in the upper valley.",
    "No public record shows how the large mills handle spare parts in the lower valley.",
]


def found(spark, texts):
    rows = [(i, "s", t, True) for i, t in enumerate(texts)]
    return sorted(r.doc_id for r in truncated(spark.createDataFrame(rows, "doc_id bigint, source string, text string, open boolean")).collect())


def test_levels(spark):
    texts = [
        " ".join(BASE), " ".join(BASE[::-1]),
        BASE[0] + " The harbour office reports that the west",  # a sentence that opens like finished ones
        BASE[1] + "\n\n- copper bell\n- northern crane",  # a list
        BASE[2] + "\n\nGrant no. 4711", BASE[3] + "\n\n```\ncode(x)\n```", BASE[0] + " The northern crane…", BASE[0] + " [...]",
        BASE[1] + "\n\n| copper bell | 52 |", BASE[2] + " N", None, "", "  ", BASE[3] + "\n\n“The bell could not lift”", BASE[2] + "\n\n- copper be",
    ]
    assert found(spark, texts) == [2, 6, 9, 14]


def test_whole_text_as_a_prefix_of_a_copy(spark):
    long = "zeta " * 40 + "omega end of it all"
    assert found(spark, [long, long[:150], long[:150], BASE[0]]) == [0, 1, 2] or found(spark, [long + ".", long[:150], long[:150]]) == [1, 2]


def test_finished_prefix_is_not_cut(spark):
    assert found(spark, [" ".join(BASE), BASE[0]]) == []


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, source string, text string")
    assert truncated(df).count() == 0


def test_blanks_make_no_copy_longer(spark):
    text = BASE[0] + "\n\n- copper bell\n- northern crane and all of its copper"
    assert found(spark, [text, text + "\n", text + "  ", text + " --- 12"]) == []


def test_short_text_cut_from_a_longer_one(spark):
    assert found(spark, ["Minutes of the upper valley, part\nZeta omega kappa", "Minutes of the upper valley, part"]) == [1]


def test_many_lengths_of_one_beginning(spark):
    whole = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(4000))
    ends = [i for i, c in enumerate(whole) if c == " "][-1500:]
    assert found(spark, [whole + "."] + [whole[:n] for n in ends]) == list(range(1, 1501))


def test_prefixes_against_brute_force(spark):
    import random

    rng = random.Random(2)
    word = lambda: "".join(rng.choices("ab ", k=rng.randint(1, 9))).strip() or "a"
    asks, answers = sorted({(k, word()) for _ in range(400) for k in (0, 2, 3)}), sorted({(k, word()) for _ in range(250) for k in (0, 2, 4)})
    schema = "kind int, v string"
    from siltstone.llm.truncation import prefixes, shared

    got = {(r.kind, r.v): (r.shared, r.whole) for r in prefixes(spark.createDataFrame(asks, schema).repartition(5), spark.createDataFrame(answers, schema).repartition(3)).collect()}
    for k, v in asks:
        mine = [x for j, x in answers if j == k and x != v]
        want = (max((shared(v, x) for x in mine), default=0) if k == 0 or k == 2 else 0, any(x.startswith(v) for x in mine))
        assert got[k, v] == want, (k, v)
    assert len(got) == len(asks)
    assert prefixes(spark.createDataFrame([], schema), spark.createDataFrame(answers, schema)).count() == 0
