import datetime as dt

import pytest
from hypothesis import given
from hypothesis import strategies as st

from siltstone.operators.timestamps import components, days_from_civil, normalise


@given(st.dates(min_value=dt.date(1, 1, 1)))
def test_day_arithmetic(day):
    assert days_from_civil(day.year, day.month, day.day) == (day - dt.date(1970, 1, 1)).days


def test_impossible_days():
    assert days_from_civil(2023, 2, 29) is None and days_from_civil(2023, 13, 1) is None


B, NY = "Europe/Berlin", "America/New_York"


@pytest.mark.parametrize(
    "value, zone, order, want",
    [
        ("2025-03-30T02:30", B, "dmy", "2025-03-30T01:30:00Z"), ("29. Oktober 2023, 02:15 Uhr", B, "dmy", "2023-10-29T00:15:00Z"),
        ("March 12, 2023 at 2:30 AM", NY, "mdy", "2023-03-12T07:30:00Z"), ("05/06/2021", NY, "mdy", "2021-05-06"), ("05/06/2021", B, "dmy", "2021-06-05"),
        ("01.10.2023 14:00 GMT", B, "dmy", "2023-10-01T14:00:00Z"), ("1/8/25", B, "dmy", "2025-08-01"), ("2023-12-24 23:59:00-0500", B, "dmy", "2023-12-25T04:59:00Z"),
        ("1634279400936", B, "dmy", "2021-10-15T06:30:00Z"), ("11/2026", B, "dmy", "2026-11"), ("Jun 2021", B, "dmy", "2021-06"), ("2022", B, "dmy", "2022"),
        ("the 19th of July 2023", B, "dmy", "2023-07-19"), ("2 mars 2023 à 16h00", B, "dmy", "2023-03-02T15:00:00Z"), ("closes 02.04.2023 04:00 Uhr", B, "dmy", "2023-04-02T02:00:00Z"),
        ("15:10, 19 Jul 2025", B, "dmy", "2025-07-19T13:10:00Z"), ("July 7, 2021 9:30 am WEST", B, "dmy", "2021-07-07T08:30:00Z"), ("20220815 1206", B, "dmy", "2022-08-15T10:06:00Z"),
        ("2022-12-29 23:59 Europe/Lisbon", B, "dmy", "2022-12-29T23:59:00Z"), ("Tue, 04 May 2021 17:00:00 +0100", B, "dmy", "2021-05-04T16:00:00Z"),
        ("21 June 2024, 11:59 PM (local time)", NY, "mdy", "2024-06-22T03:59:00Z"), ("13/04/2025", None, None, "2025-04-13"), ("05/06/2021", None, None, None),
        ("2024-05-01 10:00 And/Or", B, "dmy", None), ("2024-05-01 10:00 europe/berlin", NY, "dmy", "2024-05-01T08:00:00Z"), ("2024-05-01 10:00", "No/Where", "dmy", None),
        ("2025-01-01 10:00", None, None, None), ("31.04.2023", B, "dmy", None), ("ongoing", B, "dmy", None), ("", B, "dmy", None), (None, B, "dmy", None), ("x" * 5000, B, "dmy", None),
    ],
)
def test_normalise(spark, value, zone, order, want):
    df = spark.createDataFrame([(value, zone, order, "kept")], "v string, z string, o string, utc string")
    row = normalise(df, "v", "z", "o").first()
    assert row.utc_text == want and row.utc == "kept"


def test_components_validate_times():
    assert components("2024-01-01 25:00", None) is None
    assert components("2024-01-01 13:00 PM", None) is None
