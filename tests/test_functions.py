import pytest
from pyspark.sql import functions as F

from siltstone.functions import areas, ids, text, urls
from siltstone.operators import trends


def one(spark, column, **values):
    kinds = {str: "string", int: "int", type(None): "string", list: "array<string>"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "url, want, key",
    [
        ("HTTP://A.Example:80?utm_source=x&b=2&a=1#top", "http://a.example/?b=2&a=1", "http://a.example?a=1&b=2"), ("https://a.example:443/p/?GCLID=1", "https://a.example/p/", "https://a.example/p"),
        ("https://a.example:8443/p?x", "https://a.example:8443/p?x", "https://a.example:8443/p?x"), ("no url", "no url", "://"), (None, None, None),
    ],
)
def test_urls(spark, url, want, key):
    assert one(spark, urls.canonical(F.col("u")), u=url) == want and one(spark, urls.dedupe_key(F.col("u")), u=url) == key


@pytest.mark.parametrize("url, host, usable", [("https://WWW.a.example:8/x", "a.example", True), ("ftp://u:p@b.example", "b.example", False), ("manual", None, False), (None, None, False), ("", None, False)])
def test_host_and_usable(spark, url, host, usable):
    assert one(spark, urls.host(F.col("u")), u=url) == host and one(spark, urls.usable(F.col("u")), u=url) is usable


def test_text(spark):
    t = F.col("t")
    assert one(spark, text.clean(t), t=" a\n\t b ") == "a b" and one(spark, text.clean(t), t=None) is None
    assert one(spark, text.tokens_a(t), t="The the AB ab1 x-ray") == ["the", "ab1", "ray"]
    assert one(spark, text.tokens_b(t), t="x-ray x-ray _a b") == ["x-ray", "x-ray"] and one(spark, text.tokens_c(t, ["the"]), t="the net net") == ["net"]
    assert one(spark, text.phrase_count(text.padded(t), "audit audit"), t="audit audit audit") == 1 and one(spark, text.phrase_count(text.padded(t), "audit"), t="audit, audit; audits") == 2
    assert one(spark, text.truncated(t, 5), t="abcdefgh") == "abcd…" and one(spark, text.truncated(t, 5), t="abcde") == "abcde"
    assert one(spark, text.first_filled(F.col("a"), t), a=" ", t="b") == "b"
    assert one(spark, text.headings(t), t="# A\nx\n## B b\n") == ["A", "B b"] and one(spark, text.bullets(t), t="- a\n* b\nc") == ["a", "b"]
    assert one(spark, text.numbers(t), t="3 of 4.5") == [3.0, 4.5] and one(spark, text.links(t), t="see https://a.example/x) https://a.example/x") == ["https://a.example/x"]
    assert one(spark, text.jaccard(F.col("a"), F.col("b")), a=["x", "y"], b=["y", "z"]) == pytest.approx(1 / 3) and one(spark, text.jaccard(F.col("a"), F.col("b")), a=[], b=["y"]) == 0


def test_areas_and_ids(spark):
    assert one(spark, areas.area(F.col("a")), a=" zk_iov ") == "ZK-IoV" and one(spark, areas.area(F.col("a")), a="Other") == "Other" and one(spark, areas.area(F.col("a")), a=" ") is None
    assert one(spark, areas.layer_weight(F.col("a")), a="Lab") == 0.8 and one(spark, areas.signal(F.col("a")), a="x") == "general_signal"
    import hashlib

    assert one(spark, ids.short_id(F.col("a"), F.col("b")), a="x", b=None) == hashlib.sha256(b"x|").hexdigest()[:16]


def test_trends(spark):
    rows = [("up", f"2024-0{m}", v) for m, v in ((1, 1), (2, 2), (3, 4), (4, 9))] + [("flat", "2024-01", 5), ("flat", "2024-02", 5), ("flat", "2024-03", 5), ("flat", "2024-04", 5), ("gap", "2024-01", 6)]
    series = trends.dense_months(spark.createDataFrame(rows, "k string, m string, v int"), "k", "m", "v")
    assert series.count() == 12 and [r.v for r in series.where("k = 'gap'").orderBy("m").collect()] == [6, 0, 0, 0]
    got = {r.k: r.direction for r in trends.direction(series, "k", "m", "v").collect()}
    assert got["up"] == "accelerating" and got["flat"] == "stable"
    assert trends.dense_months(spark.createDataFrame([], "k string, m string, v int"), "k", "m", "v").count() == 0


def test_names_and_hashes(spark):
    from pyspark.sql import functions as F

    from siltstone.functions import text

    rows = [("  Ünit & Co. Labs  ", "https://www.big-site.example:80/a/the_new-plan/?q=1", ["A  b", "a B", "", " c ", "d", "e", "f", "g"]), ("—", "https://host.example", None), (None, None, [])]
    df = spark.createDataFrame(rows, "n string, u string, w array<string>")
    got = [tuple(r) for r in df.select(text.slug(F.col("n")), text.title_from_url(F.col("u"), F.lit("-")), text.name_from_url(F.col("u"), F.lit("-")), text.sanitized(F.col("w"), 4), text.canonical_json(b=F.col("n"), a=F.lit(None).cast("string"))).collect()]
    assert got[0] == ("nit-co-labs", "The New Plan", "Big Site", ["A b", "c", "d", "e"], '{"a":"","b":"  Ünit & Co. Labs  "}')
    assert got[1][:4] == ("item", "Host.example", "Host", None) and got[2][:4] == ("item", "-", "-", [])
