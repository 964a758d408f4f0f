import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import graphs, merging, similarity


def test_jaccard_pairs_against_brute_force(spark):
    random.seed(2)
    base = [random.sample(range(60), 12) for _ in range(12)]
    sets = {i: sorted({x if random.random() > 0.1 else random.randint(0, 90) for x in base[i % 12]}) for i in range(80)}
    sets[80], sets[81] = [], [5]
    df = spark.createDataFrame([(i, "x" if i % 2 else "y", s) for i, s in sets.items()], "id int, area string, elements array<int>")
    for t in (0.5, 0.8, 1.0):
        want = sorted((a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(set(sets[a]) & set(sets[b])) >= t * len(set(sets[a]) | set(sets[b])) - 1e-9)
        distinct = similarity.jaccard_pairs(df, t)
        assert sorted((r.a, r.b) for r in distinct.collect()) == want
        assert sorted((r.a, r.b) for r in similarity.jaccard_pairs(df, t, ["area"]).collect()) == [(a, b) for a, b in want if a % 2 == b % 2]
    assert similarity.jaccard_pairs(df.limit(0), 0.5).count() == 0


def test_jaccard_pairs_at_the_threshold(spark):
    # 0.28 * 25 is more than 7 in binary.
    df = spark.createDataFrame([(1, list(range(7))), (2, list(range(25)))], "id int, elements array<int>")
    assert [(r.a, r.b, r.shared, r.na, r.nb) for r in similarity.jaccard_pairs(df, 0.28).collect()] == [(1, 2, 7, 7, 25)]


def test_jaccard_pairs_moves_few_candidates(spark):
    # 300 sets share their rarest words in pairs of groups, but not the others: 45,000 candidates by prefix, hardly any by signature.
    rng = random.Random(5)
    df = spark.createDataFrame([(i, "x", [f"r{i % 3}", *rng.sample([f"w{j}" for j in range(400)], 15)]) for i in range(300)] + [(300, "x", ["r0"])], "id int, area string, elements array<string>")
    rows = similarity._ordered(df, ["area"])
    assert rows.count() == 301 and similarity._candidates(rows, 0.6).count() < 30
    assert similarity.jaccard_pairs(df, 0.6, ["area"]).count() == 0


def test_jaccard_pairs_of_few_words_are_counted_in_stripes(spark, monkeypatch):
    # Prefixes of 8 of 30 words meet nearly as often as there are pairs, so no candidates are moved.
    from siltstone.operators import stripes

    rng = random.Random(4)
    sets = {i: sorted(f"w{j}" for j in rng.sample(range(30), rng.randint(8, 20))) for i in range(150)}
    sets[150] = sorted(f"w{j}" for j in range(300))
    sets[151] = sorted(f"w{j}" for j in range(1, 301))
    df = spark.createDataFrame([((i, f"n{i}"), "x" if i % 3 else "y", s) for i, s in sets.items()], "id struct<k:int, name:string>, area string, elements array<string>")
    want = {(a, b, len(set(sets[a]) & set(sets[b]))) for a in sets for b in sets if a < b and len(set(sets[a]) & set(sets[b])) >= 0.6 * len(set(sets[a]) | set(sets[b])) - 1e-9}
    for tile, stripe, dense in (((1024, 8192), 16384, 1 / 300), ((7, 11), 40, 0.3)):
        for name, value in (("HIGH", tile[0]), ("WIDE", tile[1]), ("STRIPE", stripe), ("DENSE", dense), ("OUT", 5)):
            monkeypatch.setattr(stripes, name, value)
        assert similarity._striped(df, similarity._order(df, []), 0.6, []) is not None
        assert sorted((r.a.k, r.b.k, r.shared) for r in similarity.jaccard_pairs(df, 0.6).collect()) == sorted(want)
        assert sorted((r.a.k, r.b.k, r.shared) for r in similarity.jaccard_pairs(df, 0.6, ["area"]).collect()) == sorted(w for w in want if (w[0] % 3 > 0) == (w[1] % 3 > 0))


def test_jaccard_pairs_of_evidence_move_no_candidates(spark):
    # About 17 of 1,008 words, of which all are in use: prefixes meet once in about 25 pairs, and the join moved those that its filters left.
    rng = random.Random(6)
    df = spark.createDataFrame([(i, "x", [f"w{int(1008 * j)}" for j in (rng.random() for _ in range(17))]) for i in range(1500)], "id int, area string, elements array<string>")
    df = df.withColumn("elements", F.array_distinct("elements"))
    assert similarity._striped(df, similarity._order(df, ["area"]), 0.6, ["area"]) is not None


def test_token_and_vector_search(spark):
    random.seed(3)
    tokens = {i: random.sample("abcdefghij", random.randint(0, 6)) for i in range(40)}
    df = spark.createDataFrame([(i, 0, t) for i, t in tokens.items()], "id int, block int, tokens array<string>")
    got = {}
    for r in similarity.token_search(df.where("id < 9").withColumnRenamed("id", "qid"), df, 3).collect():
        got.setdefault(r.qid, []).append((r.rank, r.id))
    for q in range(9):
        sims = sorted((-len(set(tokens[q]) & set(t)) / len(set(tokens[q]) | set(t)), i) for i, t in tokens.items() if i != q and set(tokens[q]) & set(t))[:3]
        assert [i for _, i in sorted(got.get(q, []))] == [i for _, i in sims]
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.1]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0])], "id int, vector array<float>")
    near = similarity.vector_search(v.where("id = 0").withColumnRenamed("id", "qid"), v, 2).orderBy("rank").collect()
    assert [r.id for r in near] == [1, 2]


def test_vector_search_takes_the_smallest_ids_of_many_copies(spark):
    rows = [(i, [1.0, 1.0]) for i in range(60, 0, -1)] + [(0, [1.0, 0.0])]
    v = spark.createDataFrame(rows, "id int, vector array<float>").coalesce(1).sortWithinPartitions(F.desc("id"))
    near = similarity.vector_search(v.where("id = 0").withColumnRenamed("id", "qid"), v, 3).orderBy("rank").collect()
    assert [(r.id, r.cosine) for r in near] == [(1, 0.707107), (2, 0.707107), (3, 0.707107)]


def components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return sorted((x, find(x)) for x in list(parent))


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(3, 3), (5, 4), (4, 5), (9, 1), (1, 5)], [(random.Random(7).randint(0, 60), random.Random(i).randint(0, 60)) for i in range(50)]])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a int, b int")
    assert sorted(map(tuple, graphs.components(df).collect())) == components([(a, b) for a, b in edges if a != b])


def test_leaders_equal_the_sequential_loop(spark):
    for seed in range(3):
        rng = random.Random(seed)
        n, edges = 25, {(a, b) for _ in range(35) for a, b in [sorted(rng.sample(range(25), 2))]}
        want, left = {}, list(range(n))
        while left:
            x = left[0]
            group = [x] + [y for y in left[1:] if (x, y) in edges]
            want |= dict.fromkeys(group, x)
            left = [y for y in left if y not in group]
        got = graphs.leaders(spark.createDataFrame([(i,) for i in range(n)], "id int"), spark.createDataFrame(sorted(edges), "a int, b int"))
        assert {r.id: r.leader for r in got.collect()} == want


def test_merges(spark):
    df = spark.createDataFrame([("k", "2024-01-02", "b"), ("k", "2024-01-01", "a"), ("k", None, "z"), ("m", "bad", "q"), ("k", "2024-01-02", "b")], "k string, t string, v string")
    assert sorted(map(tuple, merging.latest(df, ["k"], F.col("t")).collect())) == [("k", "2024-01-02", "b"), ("m", "bad", "q")]
    assert sorted(map(tuple, merging.earliest(df, ["k"], F.coalesce("t", F.lit("9"))).collect())) == [("k", "2024-01-01", "a"), ("m", "bad", "q")]
    old = spark.createDataFrame([("k", "0", "old"), ("n", "0", "stays")], "k string, t string, v string")
    assert sorted(map(tuple, merging.upsert(old, df, ["k"], F.col("t")).collect())) == [("k", "2024-01-02", "b"), ("m", "bad", "q"), ("n", "0", "stays")]
    assert sorted(map(tuple, merging.insert_ignore(old, df, ["k"], F.col("t")).collect())) == [("k", "0", "old"), ("m", "bad", "q"), ("n", "0", "stays")]
    once = merging.upsert(old, df, ["k"], F.col("t"))
    assert sorted(map(tuple, merging.upsert(once, df, ["k"], F.col("t")).collect())) == sorted(map(tuple, once.collect()))
    o = {r.k: r for r in merging.observations(df, "k", "t", ["v"], ["v"], ["v"]).collect()}
    assert (o["k"].observation_count, o["k"].first_v, o["k"].latest_v, o["k"].v_variants) == (4, "a", "z", ["a", "b", "z"])
    sync = merging.sync(spark.createDataFrame([("a", "active"), ("b", "x")], "s string, status string"), spark.createDataFrame([("b",), ("c",)], "s string"), "s")
    assert sorted(map(tuple, sync.collect())) == [("a", "active", "deprecate"), ("b", "x", "update"), ("c", None, "insert")]


def test_near_in_time_connects_what_all_pairs_would(spark):
    import datetime as dt

    from siltstone.plans.similarity import near_in_time

    for seed in range(4):
        rng = random.Random(seed)
        rows = [(rng.choice("kl"), rng.choice("abc"), dt.date(2024, 1, 1) + dt.timedelta(rng.randint(0, 40)), f"r{i:02}") for i in range(30)]
        pairs = [(x[3], y[3]) for x in rows for y in rows if x[3] < y[3] and x[0] == y[0] and x[1] != y[1] and abs((x[2] - y[2]).days) <= 3]
        df = spark.createDataFrame(rows, "key string, source string, day date, rec string")
        got = [(r.a, r.b) for r in near_in_time(df, ["key"], "source", "day", "rec", 3).collect()]
        assert set(got) <= set(pairs) and components(got) == components(pairs)


def test_corroborating_evidence(spark, tmp_path):
    import __spark_entry__ as entry

    rows = [("e1", "alpha beta gamma delta", "Lab", "https://x.org/1", "one"), ("e2", "alpha beta other words", "Company", "https://X.org/2", "two"), ("e3", "alpha beta gamma delta", "Company", "https://x.org/3", "three")]
    rows += [("e4", "alpha beta more things", "Lab", "https://y.org/4", "four"), ("e5", "alpha beta gamma delta", "Lab", None, None), ("e6", "alpha kilo lima mike", "Failure", "https://x.org/1", "one"), ("e7", "alpha beta papa oscar", None, "https://x.org/1", "ONE ")]
    df = spark.createDataFrame([(*r, "esg") for r in rows], "evidence_id string, problem string, layer string, source_url string, title string, research_area string")
    df.write.parquet(f"{tmp_path}/canonical_evidence.parquet")
    got = entry.queries()["corroborating_evidence"](spark, str(tmp_path)).collect()
    # e1 and e7 are an exact duplicate, e1 and e3 soft ones; e4 has another domain, e5 none, e6 shares too little.
    assert sorted((*sorted((r.record_a, r.record_b)), r.similarity) for r in got) == [("e1", "e2", 0.333333), ("e2", "e7", 0.333333), ("e3", "e7", 0.333333)]


def test_undated_links_connect_what_all_pairs_would(spark):
    import datetime as dt
    import random

    from pyspark.sql import functions as F

    from siltstone.operators.graphs import components
    from siltstone.plans.similarity import undated_links

    rng = random.Random(4)
    for trial in range(6):
        rows = [(1, rng.choice("abc"[: 1 + trial % 3]), None if rng.random() < 0.3 else dt.date(2024, 1, 1 + i), f"r{i:02}") for i in range(8)]
        df = spark.createDataFrame(rows, "pair int, src string, day date, rec string")
        pairs = [(x[3], y[3]) for x in rows for y in rows if x[3] < y[3] and x[1] != y[1] and (x[2] is None or y[2] is None)]
        of = lambda e: {frozenset(r.ids) for r in components(e).groupBy("component").agg(F.collect_set("id").alias("ids")).collect()}
        want = of(spark.createDataFrame(pairs, "a string, b string")) if pairs else set()
        assert of(undated_links(df, ["pair"], "src", "day", "rec")) == want


def test_a_long_path_is_one_component(spark):
    from siltstone.operators.graphs import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(600)], "a bigint, b bigint")
    assert {(r.component) for r in components(edges).collect()} == {0}
