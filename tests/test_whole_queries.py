"""The general pN queries over empty tables and rows of nulls."""

import pytest

from siltstone.plans.catalog import QUERIES

TABLES = {
    "company_data": "id bigint, keywords string, value string, item_pos string", "expert_data": "id bigint, expertise_themes string", "hackathon_data": "id bigint, required_technology string",
    "funding_data": "id bigint, url string, deadline string, opening_date string, funding_amount string, currency string, requirements string, focus_area string, utc_text string, unit string",
    "failure_data": "id bigint, url string, incident_date string, estimated_loss string, impact string, incident_type string, confidence string",
    "site_zones": "site string, zone string, date_order string", "unit_rates": "unit_code string, eur_value decimal(18,6)",
}
NAMES = ("p4_found", "p5_found", "p5_review", "p7_found")


@pytest.mark.parametrize("rows", [0, 2])
@pytest.mark.parametrize("name", NAMES)
def test_empty_and_null(spark, tmp_path, name, rows):
    for table, schema in TABLES.items():
        kind = spark.createDataFrame([], schema).schema
        spark.createDataFrame([(None,) * len(kind)] * rows, kind).write.parquet(f"{tmp_path}/{table}.parquet")
    assert QUERIES[name](spark, str(tmp_path)).collect() == []
