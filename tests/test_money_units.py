from decimal import Decimal as D

import pytest

from siltstone.operators.money_units import hint, parse


@pytest.mark.parametrize(
    "value, low, high, code",
    [
        ("€9,600", "9600", "9600", "EUR"), ("35\xa0000 €", "35000", "35000", "EUR"), ("187.000,00 SEK", "187000", "187000", "SEK"),
        ("6.300.000 SEK", "6300000", "6300000", "SEK"), ("39’000 CHF", "39000", "39000", "CHF"), ("CHF 470000.-", "470000", "470000", "CHF"),
        ("₹11,50,00,000", "115000000", "115000000", "INR"), ("Rs 10.3 crore", "103000000", "103000000", "INR"), ("INR 29.2 lakhs", "2920000", "2920000", "INR"),
        ("USD 4.62e6", "4620000", "4620000", "USD"), ("kEUR 230", "230000", "230000", "EUR"), ("110 TEUR", "110000", "110000", "EUR"),
        ("308 k€", "308000", "308000", "EUR"), ("1.03 M€", "1030000", "1030000", "EUR"), ("2,69 Mio. EUR", "2690000", "2690000", "EUR"),
        ("EUR 7.99M–23.97M", "7990000", "23970000", "EUR"), ("₹71-284 million", "71000000", "284000000", "INR"), ("3,437.5 ETH", "3437.5", "3437.5", "ETH"),
        ("from 39,000 to 117,000 EUR", "39000", "117000", "EUR"), ("half a million Swiss francs", "500000", "500000", "CHF"), ("0.541B JPY", "541000000", "541000000", "JPY"),
        ("0.0125k ETH", "12.5", "12.5", "ETH"), ("$173K", "173000", "173000", "USD"), ("2,800", "2800", "2800", None),
    ],
)
def test_parse(value, low, high, code):
    got = parse(value)
    assert (got[0], got[1], got[2]) == (D(low), D(high), code)


@pytest.mark.parametrize("value", [None, "", "n/a", "50 % co-funding", "varies by project", "up to 100% of eligible costs"])
def test_no_sum(value):
    assert parse(value) is None


def test_hints():
    assert hint("Nice. Amounts are stated in thousands of US dollars. More.") == ("USD", 3)
    assert hint("All sums on this page are in kEUR.") == ("EUR", 3)
    assert hint("All sums in CHF million.") == ("CHF", 6)
    assert hint("Figures in thousand pounds.") == ("GBP", 3)
    assert hint("The tower holds 90 receipts.") == (None, 0) and hint(None) == (None, 0)


def _folder(spark, path, funding, failure=()):
    cols = "id bigint, funding_amount string, currency string, requirements string, url string, focus_area string, note string"
    spark.createDataFrame(funding, cols).write.parquet(f"{path}/funding_data.parquet")
    spark.createDataFrame(list(failure), "id bigint, estimated_loss string, impact string, url string, incident_type string").write.parquet(f"{path}/failure_data.parquet")
    rates = [("EUR", D("1")), ("USD", D("0.92")), ("GBP", D("1.17")), ("ETH", D("2150"))]
    spark.createDataFrame(rates, "unit_code string, eur_value decimal(18,6)").write.parquet(f"{path}/unit_rates.parquet")


def test_found_rounds_half_up_and_reads_other_columns(spark, tmp_path):
    from siltstone.operators.money_units import p5_found, p5_review

    u = "https://a.example/1"
    rows = [(i, f"USD {10 ** (2 + i % 5)}", "USD" if i % 2 else None, None, u, "x", "") for i in range(40)]
    rows += [(100 + i, f"{10 ** (2 + i % 5)} EUR", "EUR" if i % 2 else None, None, u, "x", "") for i in range(40)]
    rows += [(900, "2,500", "EUR", None, u, "x", ""), (901, "16", None, "Amounts are stated in thousands of US dollars.", u, "x", ""), (902, "777", None, None, u, "x", "")]
    rows += [(903, "€0.5", None, None, None, None, ""), (903, "€0.5", None, None, None, None, ""), (904, None, "EUR", None, u, "x", "")]
    _folder(spark, tmp_path, rows, [(1, "€5,000-€10,000", None, u, None)])
    got = {(r.table_name, r.row_id): (r.low_eur, r.high_eur) for r in p5_found(spark, str(tmp_path)).collect()}
    assert got[("funding_data", 903)] == (1, 1) and got[("failure_data", 1)] == (5000, 10000)
    assert got[("funding_data", 901)] == (14720, 14720) and got[("funding_data", 900)] == (2500, 2500)
    assert ("funding_data", 902) not in got and ("funding_data", 904) not in got
    assert [r.row_id for r in p5_review(spark, str(tmp_path)).collect()] == [902]


def test_empty_tables(spark, tmp_path):
    from siltstone.operators.money_units import p5_found

    _folder(spark, tmp_path, [])
    assert p5_found(spark, str(tmp_path)).count() == 0


def test_unknown_currencies_and_contradictions_are_reviewed(spark, tmp_path):
    from siltstone.operators.money_units import p5_found, p5_review

    u = "https://a.example/1"
    rows = [(i, f"{('USD', 'EUR', 'GBP')[i % 3]} {(2 + i % 7) * 10 ** (3 + i % 2)}", ("USD", "EUR", "GBP")[i % 3] if i % 2 else None, None, u, "x", "") for i in range(300)]
    rows += [(900, "CAD 150,000", "EUR", None, u, "x", ""), (901, "PLN 2 million", None, None, u, "x", ""), (902, "A$ 3m", None, None, u, "x", ""), (903, "500 Canadian dollars", "EUR", None, u, "x", "")]
    rows += [(904, "40,000", "EUR", "Amounts are stated in pounds sterling.", u, "x", ""), (905, "40,000", None, None, u, "x", ""), (906, "40,000", "GBP", None, u, "x", "")]
    rows += [(907, "40", None, "Amounts are stated in thousands of US dollars.", u, "x", ""), (908, f"EUR {10**19}", None, None, u, "x", ""), (909, "12k", "EUR", None, u, "x", "")]
    _folder(spark, tmp_path, rows)
    got = {r.row_id: r.low_eur for r in p5_found(spark, str(tmp_path)).collect()}
    assert {900, 901, 902, 903, 904, 905, 908} & set(got) == set()
    assert got[906] == 46800 and got[907] == 36800 and got[909] == 12000
    review = {r.row_id: (r.candidate, r.confidence) for r in p5_review(spark, str(tmp_path)).collect()}
    assert set(review) == {900, 901, 902, 903, 904, 905, 908} and review[900] == ("?", 0.0) and 0 < review[904][1] < 0.9


def test_one_labelled_row_is_enough(spark, tmp_path):
    from siltstone.operators.money_units import p5_found, p5_review

    u = "https://a.example/1"
    _folder(spark, tmp_path, [(1, "EUR 5", None, None, u, "x", ""), (2, "7", "USD", None, u, "x", ""), (3, "8", None, "Amounts are stated in thousands of pounds.", u, "x", ""), (4, "9", None, None, u, "x", "")])
    assert {r.row_id: r.low_eur for r in p5_found(spark, str(tmp_path)).collect()} == {1: 5, 2: 6, 3: 9360}
    assert [r.row_id for r in p5_review(spark, str(tmp_path)).collect()] == [4]


def test_scale_and_unit_of_held_out_rows(spark, tmp_path):
    """With every hint hidden the ensemble does better than the commonest unit, and its confidence is honest."""
    from pyspark.sql import functions as F

    from siltstone.operators.money_units import best, candidates, masked, parsed, statistics, trained

    units = [("EUR", 4, "https://a.example/1", "x"), ("USD", 6, "https://b.example/1", "y"), ("GBP", 5, "https://c.example/1", "z")]
    rows = []
    for i in range(900):
        code, size, url, focus = units[(i * 7919) % 3]
        rows.append((i, f"{code} {(1 + i * 31 % 9) * 10**size}", code if i % 2 else None, None, url if i % 5 else None, focus if i % 4 else None, ""))
    _folder(spark, tmp_path, rows)
    named = parsed(spark, str(tmp_path))
    held = F.col("row_id") % 10 == 0
    stats, *shares = statistics(named.where(~held))
    scored = best(trained(named.where(~held), stats, *shares)(candidates(masked(named.where(held), hide_hint=100), stats, *shares)), "code", "true_power").toPandas()
    right = (scored["unit"] == scored["code"]) & (scored["power"] == scored["true_power"])
    assert right.mean() > 0.8 and abs(right.mean() - scored["confidence"].mean()) < 0.2
