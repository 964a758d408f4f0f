import random

from siltstone.llm import leakage
from siltstone.llm.leakage import RUN, leaks, words_of


def brute(docs, items):
    grams = {}
    for i, t in items:
        w = words_of(t)
        for k in range(len(w) - RUN + 1):
            grams.setdefault(tuple(w[k : k + RUN]), set()).add(i)
    out = set()
    for d, t in docs:
        w = words_of(t)
        for k in range(len(w) - RUN + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + RUN]), ())}
    return sorted(out)


def run(spark, docs, items):
    d = spark.createDataFrame([(*x, 5) for x in docs], "doc_id bigint, text string, item_id int")
    i = spark.createDataFrame([(*x, "s") for x in items], "item_id bigint, item_text string, doc_id string")
    return sorted(map(tuple, leaks(d, i).collect()))


def test_against_brute_force(spark, monkeypatch):
    random.seed(5)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(random.choices(vocabulary, k=random.randint(5, 30)))) for i in range(30)] + [(77, None), (78, ""), (79, " ".join(["w1"] * 15)), (80, " ".join(["w1"] * 15))]
    docs = []
    for d in range(60):
        words = random.choices(vocabulary, k=40)
        item = words_of(items[d % 30][1])
        at = random.randint(0, max(0, len(item) - 8))
        words[10:10] = item[at : at + random.randint(8, 16)]
        docs.append((d, random.choice([" ", ", ", "-\n"]).join(words).replace("w1", "W­1")))
    docs += [(100, None), (101, ""), (102, "short"), (103, "w1 " * 5000), (104, docs[0][1])]
    want = brute(docs, items)
    assert want and run(spark, docs, items) == want
    monkeypatch.setattr(leakage, "INDEX_SHINGLES", 0)
    assert run(spark, docs, items) == want


def test_run_of_eleven_is_no_leak(spark):
    words = [f"a{i}" for i in range(20)]
    assert run(spark, [(1, " ".join(words[:11]) + " z"), (2, " ".join(words[3:15]))], [(9, " ".join(words))]) == [(2, 9)]


def test_empty_tables(spark):
    assert run(spark, [(1, "x " * 30)], [(1, "")]) == [] and run(spark, [(1, None)], [(1, "x " * 30)]) == []


def test_many_items_are_joined(spark, monkeypatch):
    monkeypatch.setattr(leakage, "INDEX_SHINGLES", 1_000)
    random.seed(6)
    vocabulary = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(random.choices(vocabulary, k=14))) for i in range(20_000)]
    docs = [(d, " ".join(random.choices(vocabulary, k=30)) + " " + " ".join(items[d * 37][1].split()[d % 3 :]) + " " + " ".join(random.choices(vocabulary, k=9))) for d in range(200)]
    docs += [(900 + d, docs[0][1]) for d in range(50)]
    assert run(spark, docs, items) == brute(docs, items)
