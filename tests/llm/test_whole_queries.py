"""Each query over folders of empty tables, of rows of nulls, and of repeated rows with extra columns."""

import pytest

from siltstone.llm.queries import QUERIES

TABLES = {
    "crawl_cache": "url string, final_url string, title string, html string, clean_text string, fetched_at string, site string, line_no int",
    "canonical_evidence": "evidence_id string, evidence_excerpt string, source_url string, text string, lines string",
    "expert_data": "id bigint, expert_name string, affiliation string, name string, entity string",
    "investment_data": "id bigint, investor_or_organization string, name string",
    "documents": "doc_id bigint, text string, source string, body string, ids string, item_id string",
    "eval_items": "item_id bigint, suite string, item_text string, doc_id string",
}


def folder(spark, path, rows):
    for name, schema in TABLES.items():
        spark.createDataFrame(rows.get(name, []), schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, tmp_path, name):
    out = QUERIES[name](spark, folder(spark, tmp_path, {})).collect()
    assert out == []


NULLS = {n: [(None,) * len(s.split(","))] * 2 for n, s in TABLES.items()}
KEEP_ROWS = {"p8_ids": 2, "p8_stats": 0, "p9_items": 1, "p10_sources": 1}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_rows_of_nulls(spark, tmp_path, name):
    out = QUERIES[name](spark, folder(spark, tmp_path, NULLS)).collect()
    assert len(out) == KEEP_ROWS.get(name, 0), out


def test_repeated_rows(spark, tmp_path):
    page = ("https://a.example/1", "https://a.example/1", "T x y z - A", None, "Home\nT x y z\nThe crane of the quay was lifted in the storm of May.", None, "x", 1)
    item = " ".join(f"word{i}" for i in range(14))
    rows = {
        "crawl_cache": [page, page], "canonical_evidence": [("e", "Contact: NaN.", None, "", "")] * 2, "expert_data": [(1, "Ada Lonker", "Lonker Labs", "n", "e"), (2, "LONKER, Ada", "Lonker Laboratories", "n", "e")] * 2,
        "documents": [(1, item + " and more of it.", "s", "b", "i", "t")] * 2, "eval_items": [(7, "s", item, "d")] * 2,
    }
    path = folder(spark, tmp_path, rows)
    run = lambda name: sorted(map(tuple, QUERIES[name](spark, path).collect()))
    assert run("p9_found") == [(1, 7)] and run("p3_found") == [("canonical_evidence", "e")]
    assert run("p6_found") == [("organisation", "Lonker Laboratories", "Lonker Labs"), ("person", "Ada Lonker", "LONKER, Ada")]
    assert len(run("p1_found")) == len(set(run("p1_found"))) and len(run("p8_ids")) == 2
