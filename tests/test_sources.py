import json
import sqlite3

import pytest

from siltstone.sources import files, robots


def test_markdown(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("# T\nintro\n## One\nbody\n### Deep\nmore\n## Two\n")
    (tmp_path / "sub" / "b.md").write_text("")
    got = sorted((r.section or "", r.subsection or "", r.body) for r in files.markdown(spark, str(tmp_path)).collect())
    assert got == [("", "", "# T\nintro"), ("One", "", "body"), ("One", "Deep", "more"), ("Two", "", "")]


def test_json_and_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"k": 1, "v": "x"}, {"k": 2}]))
    (tmp_path / "b.jsonl").write_text('{"k": 1, "v": "x"}\nbroken\n{"k": 3, "v": null}\n')
    assert sorted(map(tuple, files.json_table(spark, f"{tmp_path}/a.json", "k int, v string").collect())) == [(1, "x"), (2, None)]
    assert [r.k for r in files.json_table(spark, f"{tmp_path}/b.jsonl", "k int, v string", lines=True).orderBy("k").collect()] == [1, 3]


def test_feed(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>A</title><link>https://a.example</link><pubDate>Tue</pubDate><description>&lt;p&gt;hi&lt;/p&gt;</description></item><item><title>B</title></item></channel></rss>")
    rows = files.feed(spark, f"{tmp_path}/f.xml").orderBy("title").collect()
    assert [r.title for r in rows] == ["A", "B"] and rows[0].summary.strip() == "hi" and rows[1].link is None


def test_yaml(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "s.yaml").write_text("labs:\n  eu:\n    - {name: N, url: https://n.example, trust: 0.9}\n  us: {name: M, url: https://m.example}\nother: 3\n")
    assert sorted((r.name, r.source_path, r.trust) for r in files.yaml_sources(spark, f"{tmp_path}/s.yaml").collect()) == [("M", "labs/us", 0.6), ("N", "labs/eu", 0.9)]


def test_sqlite(spark, tmp_path):
    with sqlite3.connect(tmp_path / "d.db") as db:
        db.execute("CREATE TABLE t (a INTEGER, b TEXT)")
        db.executemany("INSERT INTO t VALUES (?, ?)", [(i, None if i % 3 else str(i)) for i in range(20)])
        db.execute("CREATE TABLE empty (a INTEGER)")
    rows = files.sqlite_table(spark, f"{tmp_path}/d.db", "t", "a bigint, b string").collect()
    assert sorted(r.a for r in rows) == list(range(20)) and sum(r.b is None for r in rows) == 13
    assert files.sqlite_table(spark, f"{tmp_path}/d.db", "empty", "a bigint").count() == 0


def _page(n):
    if n == 2:
        raise OSError("no answer")
    return {"items": [{"id": n * 10 + i} for i in range(3)], "total": 9}


def test_paged_api(spark):
    rows, done = files.paged_api(spark, 4, _page, "id bigint")
    assert sorted(r.id for r in rows.collect()) == [0, 1, 2, 10, 11, 12, 30, 31, 32]
    assert [(r.page, r.received, r.error) for r in done.orderBy("page").collect()][2] == (2, 0, "no answer")


def test_publish(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, area string")
    assert files.publish(df, f"file://{tmp_path}/t", ["k"], "area")["rows"] == 2
    with pytest.raises(ValueError):
        files.publish(df.union(df), f"file://{tmp_path}/t", ["k"])
    assert spark.read.parquet(f"file://{tmp_path}/t").count() == 2 and json.loads((tmp_path / "t" / "_MANIFEST.json").read_text())["keys"] == ["k"]


def test_robots(spark):
    text = "User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /private\nAllow: /private/open\nDisallow: /*.pdf$\n"
    rules = spark.createDataFrame([("a", p, ok) for p, ok in robots.parse_robots(text, "bot")], "site string, pattern string, allow boolean")
    urls = spark.createDataFrame([("a", p) for p in ("/", "/private/x", "/private/open/y", "/d.pdf", "/d.pdf?x")] + [("b", "/private")], "site string, path string")
    got = {(r.site, r.path): r.allowed for r in robots.allowed(urls, rules).collect()}
    assert got == {("a", "/"): True, ("a", "/private/x"): False, ("a", "/private/open/y"): True, ("a", "/d.pdf"): False, ("a", "/d.pdf?x"): True, ("b", "/private"): True}
    assert robots.parse_robots(text, "OTHER/1.0") == [("/", False)]


def test_robots_by_the_standard(spark):
    text = "Disallow: /never\nUser-agent: Bot\nUser-agent: Two\nDisallow: /a\nCrawl-delay: 3\n\nUser-agent: robot\nDisallow: /r\n\nuser-agent: BOT\nAllow: /a/\u00e9$\nDisallow:\nno colon\nSitemap: https://x.example/s.xml\nUser-agent: *\nDisallow: /"
    assert robots.parse(text, "bot/2.1 (+x)") == ([("/a", False), ("/a/%C3%A9$", True)], 3.0, ["https://x.example/s.xml"])
    assert robots.parse_robots(text, "robot") == [("/r", False)] and robots.parse_robots(text, "other") == [("/", False)]
    rules = spark.createDataFrame([("s", p, ok) for p, ok in robots.parse_robots(text, "Two") + robots.parse_robots(text, "bot")] + [("s", "/p$$", False), ("s", "/t", False), ("s", "/t", True)], "site string, pattern string, allow boolean")
    paths = ["/a", "/a/\u00e9", "/a/%c3%a9", "/a/\u00e9x", "/p$", "/p", "/t1", "", "/robots.txt", "/robots.txt?x=1"]
    urls = spark.createDataFrame([("s", p) for p in paths], "site string, path string")
    got = {r.path: r.allowed for r in robots.allowed(urls, rules).collect()}
    assert [got[p] for p in paths] == [False, True, True, False, False, True, True, True, True, True]


def test_atom(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<feed><entry><title>T</title><link href='https://a.example/1'/><updated>2024-01-02</updated><summary>&lt;b&gt;x&lt;/b&gt;</summary></entry></feed>")
    assert [tuple(r) for r in files.atom(spark, str(tmp_path / "a.xml")).collect()] == [("T", "https://a.example/1", "2024-01-02", " x ")]


def test_frontier(spark):
    links = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 2.0), ("b", "d", 1.0), ("c", "a", 1.0), ("d", "e", 1.0)], "source string, target string, score double")
    seeds = spark.createDataFrame([("a",)], "url string")
    assert sorted(map(tuple, robots.frontier(seeds, links, 2).collect())) == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    assert sorted(map(tuple, robots.frontier(seeds, links, 9, 1).collect())) == [("a", 0), ("c", 1)]


def test_binary_documents(spark, tmp_path):
    import zipfile

    from siltstone.sources import binary

    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", "<w:document><w:p><w:r><w:t>Hello </w:t><w:t xml:space='preserve'>A&amp;B</w:t></w:r></w:p><w:p></w:p><w:p w:x='1'><w:r><w:t>Second</w:t></w:r></w:p></w:document>")
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>name</t></si><si><r><t>va</t></r><r><t>lue</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", '<sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2"><v>7</v></c><c r="B2" t="inlineStr"><is><t>x</t></is></c></row></sheetData>')
    (tmp_path / "c.docx").write_bytes(b"no archive")
    (tmp_path / "d.txt").write_text("not read")
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.error) for r in binary.documents(spark, str(tmp_path)).collect()}
    assert got["a.docx"] == ("Hello A&B\nSecond", None) and got["b.xlsx"] == ("name\tvalue\n7\tx", None)
    assert {r.truncated for r in binary.documents(spark, str(tmp_path)).collect() if r.error is None} == {False}
    assert got["c.docx"][0] is None and "BadZipFile" in got["c.docx"][1] and len(got) == 3
