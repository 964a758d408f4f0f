"""Sums of money in mixed currencies, scales and notations, brought to euros.

A parser reads what the value itself says: one sum or a range, its notation, scale and currency. Where the value names no
currency, a calibrated tree ensemble decides on currency and scale together: each candidate (unit, power of ten) of a row is
scored from the magnitude it would give, the source, the category and the neighbouring fields (a currency column, a sentence
on how amounts are stated). A random forest is trained on rows whose value does name its unit, with that hidden: the scale
word of half of them, and the hints of a part of them, at random, so that the forest learns what a hint is worth and what
magnitude, source and category say without one. Its scores are calibrated by isotonic regression on rows held out.
Assignments of at least ``CONFIDENT`` are converted; the rest go to the review list (p5_review).

Defined results: null, blank, percentages and words without a number give no row; repeated rows are one row; a named but
unknown currency and a sum from 10^18 euros on are reviewed; with fewer than ``FEW`` labelled rows to learn from, what the
neighbouring fields state alone decides, if they agree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone import session
from siltstone.functions.urls import host
from siltstone.sources.tables import table

#: Rows with a stated currency that the forest is trained on, at most; statistics cover all rows.
LABELLED_ROWS = 6_000
#: Labelled rows from which a forest is trained.
FEW = 200
#: Percent of labelled rows whose scale is hidden, and whose hints on the currency are hidden.
HIDE_SCALE, HIDE_HINT = 50, 40
#: Powers of ten that a value without a scale may stand for.
POWERS = (0, 3, 6)
#: Calibrated probability from which a missing unit is assigned; less goes to review.
CONFIDENT = 0.9

_WORDS = {
    "USDC": r"USDC|dollar tokens?",
    "USD": r"US\$|USD|U\.?S\.? dollars?|dollars?|\$",
    "EUR": r"EUR|€|euros?",
    "GBP": r"GBP|£|pounds? sterling|pounds?",
    "INR": r"INR|₹|Indian rupees?|rupees?|Rs\.?",
    "CHF": r"CHF|Swiss francs?|SFr\.?",
    "JPY": r"JPY|¥|Japanese yen|yen",
    "SEK": r"SEK|Swedish kron(?:or|a)|kronor",
    "ETH": r"ETH|ether tokens?|ether",
}
CODES = list(_WORDS)
# Codes, marks and names of currencies that unit_rates does not have.
_OTHER = (
    "AED ARS AUD BGN BRL CAD CLP CNY COP CZK DKK EGP HKD HUF IDR ILS ISK KES KRW MAD MXN MYR NGN NOK NZD PEN PHP PKR PLN QAR RON RSD RUB SAR SGD "
    "THB TRY TWD UAH UYU VND XAF XOF ZAR BTC USDT"
).split()
_UNKNOWN = re.compile(
    rf"(?<![A-Za-z])(?:{'|'.join(_OTHER)})(?![A-Za-z])|(?<![A-Za-z])(?!US\$)[A-Z]{{1,2}}\$|[₩₽₺₴₦₱฿₫₪]|(?i:\bz[łl]oty|\bzł|\byuan|\brenminbi|\brubles?|\breais|\bpesos?|\brand\b"
    r"|\b(?:canadian|australian|hong kong|singapore|new zealand) dollars?|\b(?:norwegian|danish|czech|icelandic) \w+|\bkroner\b)"
)
_CODE = re.compile("|".join(f"(?P<{c}>{w})" for c, w in _WORDS.items()), re.IGNORECASE)
_CUR = "|".join(_WORDS.values())
_SCALES = (
    (r"thousands?|tsd\.?|mille", 3),
    (r"millions?|mln\.?|mio\.?", 6),
    (r"billions?|bn|mrd\.?|milliards?", 9),
    (r"lakhs?|lacs?", 5),
    (r"crores?|cr\.?", 7),
    (r"[kK]", 3),
    (r"[mM]", 6),
    (r"[bB]", 9),
)
_SCALE = "|".join(w for w, _ in _SCALES)
_NUM = r"\d{1,3}(?:[    '’]\d{3})+(?:[.,]\d{1,2})?(?!\d)|\d[\d.,]*\d(?:[eE]\d+)?|\d(?:[eE]\d+)?"
_SUM = re.compile(
    rf"(?<![\w.,])(?:(?P<pre>[kTM])?(?P<c1>{_CUR})\s*)?(?P<n>{_NUM})(?:\.?[-–—](?![\s\d€$£₹¥A-Z]))?"
    rf"\s*(?P<sc>(?:{_SCALE})(?![A-Za-z0-9]|\s*\d)|[kKMB](?={_CUR}))?\s*(?:(?:of\s+)?(?P<suf>[kTM])?(?P<c2>{_CUR})(?![A-Za-z]))?",
    re.IGNORECASE,
)
_JOIN = re.compile(r"\s*(?:-|–|—|to|and|bis|à|until)\s*", re.IGNORECASE)
_HINT = re.compile(
    rf"\b(?:amounts?|figures?|sums?|values?)\b[^.]{{0,40}}?\bin\s+(?:(?P<s1>thousands?|millions?)\s+(?:of\s+)?)?(?P<pre>k)?(?P<c>{_CUR})(?:\s+(?P<s2>thousands?|millions?))?"
    rf"|\b(?:amounts?|figures?|sums?)\b\s+in\s+(?P<s3>thousands?|millions?)\s+(?P<c3>{_CUR})",
    re.IGNORECASE,
)


_SPELT = {
    **{w: i for i, w in enumerate("one two three four five six seven eight nine ten eleven twelve".split(), 1)},
    "a": 1, "half a": 0.5, "a quarter of a": 0.25, "fifteen": 15, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50,
    "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90, "a hundred": 100, "one hundred": 100, "two hundred": 200,
    "five hundred": 500,
}
_SPELT_SUM = re.compile(
    rf"\b({'|'.join(sorted(_SPELT, key=len, reverse=True))})\s+(?=(?:thousand|million|billion|lakh|crore)s?\b)", re.IGNORECASE
)


def _power(scale: str | None) -> int | None:
    if not scale:
        return None
    return next(p for w, p in _SCALES if re.fullmatch(w, scale, re.IGNORECASE))


def code_of(text: str | None) -> str | None:
    """The currency code that a word, symbol or code names."""
    match = _CODE.search(text) if text else None
    return match.lastgroup if match else None


def number(text: str, scaled: bool, token: bool) -> Decimal:
    """The number of a figure with any usual grouping. scaled: a scale word applies; token: the unit has small fractions."""
    raw = re.sub(r"[    '’]", "", text).rstrip(".,")
    mantissa, _, exponent = raw.lower().partition("e")
    dots, commas = mantissa.count("."), mantissa.count(",")
    if dots and commas:
        decimal = max(mantissa.rfind("."), mantissa.rfind(","))
        mantissa = re.sub("[.,]", "", mantissa[:decimal]) + "." + mantissa[decimal + 1 :]
    elif dots or commas:
        mark = "." if dots else ","
        head, *groups = mantissa.split(mark)
        whole = all(len(g) in (2, 3) for g in groups) and len(groups[-1]) == 3 and 1 <= len(head) <= 3 and head != "0"
        if len(groups) == 1 and (scaled or (token and mark == ".")) and mark == ".":
            whole = False
        mantissa = head + ("" if whole else ".") + ("" if whole else mark).join(groups).replace(",", "")
    return Decimal(mantissa) * (Decimal(10) ** int(exponent) if exponent else 1)


def parse(value: str | None, scaled_by_text: bool = False) -> tuple[Decimal, Decimal, str | None, int | None] | None:
    """(low, high, currency, power of ten of the scale that the value names) of a value that states a sum, else None.

    The currency is None if none is named, and ``?`` if an unknown one is."""
    if not value or "%" in value:
        return None
    value = _SPELT_SUM.sub(lambda m: f"{_SPELT[m.group(1).lower()]} ", value)
    found = list(_SUM.finditer(value))
    if not found:
        return None
    pair = found[:1]
    if len(found) > 1 and _JOIN.fullmatch(value[found[0].end() : found[1].start()]):
        pair = found[:2]
    names = [m.group("c1") or m.group("c2") for m in pair]
    code = next((code_of(n) for n in names if n), None)
    if _UNKNOWN.search(value) and (code is None or not names[0] or _UNKNOWN.search(value[: pair[0].end()])):
        code = "?"
    powers = []
    for m in pair:
        power = _power(m.group("sc"))
        for mark in (m.group("pre"), m.group("suf")):
            if mark:
                power = (power or 0) + (6 if mark == "M" else 3)
        powers.append(power)
    named = next((p for p in powers if p is not None), None)
    out = []
    for m, power in zip(pair, powers):
        use = power if power is not None else named
        out.append(number(m.group("n"), use is not None or scaled_by_text, code == "ETH") * Decimal(10) ** (use or 0))
    return min(out), max(out), code, named


def hint(text: str | None) -> tuple[str | None, int]:
    """(currency, power of ten) that a sentence on how amounts are stated names; (None, 0) without one."""
    match = _HINT.search(text) if text else None
    if not match:
        return None, 0
    scale = match.group("s1") or match.group("s2") or match.group("s3")
    power = 3 if match.group("pre") else _power(scale) if scale else 0
    return code_of(match.group("c") or match.group("c3")), power


_PARSED = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("low", "high", "scaled_low", "scaled_high", "code", "text_code", "column_code")]
    + [T.StructField("raw", T.DoubleType()), T.StructField("own_power", T.IntegerType()), T.StructField("text_power", T.IntegerType())]
)


@F.pandas_udf(_PARSED)
def _parse(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for values, columns, texts in batches:
        rows = []
        for value, column, text in zip(values, columns, texts):
            got = parse(value)
            if got is None:
                rows.append((None,) * len(_PARSED))
                continue
            low, high, code, own = got
            scaled = parse(value, True)
            text_code, power = hint(text)
            size = float(high.log10()) - (own or 0) if high > 0 else 0.0
            rows.append((f"{low:f}", f"{high:f}", f"{scaled[0]:f}", f"{scaled[1]:f}", code, text_code, code_of(column), size, own, power if text_code or power else None))
        out = pd.DataFrame(rows, columns=_PARSED.names)
        yield out.astype({"own_power": "Int32", "text_power": "Int32"})


@F.pandas_udf(T.LongType())
def _euros(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for amounts, rates, scales in batches:
        out = []
        for amount, rate, scale in zip(amounts, rates, scales):
            if amount is None or rate is None:
                out.append(None)
                continue
            euros = Decimal(amount).scaleb(int(scale)) * Decimal(rate)
            out.append(int(euros.quantize(Decimal(1), ROUND_HALF_UP)) if abs(euros) < 10**18 else None)
        yield pd.Series(out, dtype="Int64")


def parsed(spark: SparkSession, folder: str) -> DataFrame:
    """One row per value that holds a figure, with what the value and its neighbours say about the unit."""
    funding = table(spark, folder, "funding_data", "id", "funding_amount", "currency", "requirements", "url", "focus_area").select(
        F.lit("funding_data").alias("table_name"), F.col("id").alias("row_id"), F.col("funding_amount").alias("value"),
        "currency", F.col("requirements").alias("said"), host(F.col("url")).alias("site"), F.col("focus_area").alias("category"),
    )
    failure = table(spark, folder, "failure_data", "id", "estimated_loss", "impact", "url", "incident_type").select(
        F.lit("failure_data").alias("table_name"), F.col("id").alias("row_id"), F.col("estimated_loss").alias("value"),
        F.lit(None).cast("string").alias("currency"), F.col("impact").alias("said"), host(F.col("url")).alias("site"),
        F.col("incident_type").alias("category"),
    )
    rows = funding.unionByName(failure).where(F.col("value").rlike(r"(?i)\d|thousand|million|billion|lakh|crore"))
    rows = rows.withColumn("_p", _parse("value", "currency", "said"))
    return rows.select("table_name", "row_id", "value", "site", "category", "_p.*").where(F.col("low").isNotNull())


FEATURES = ("stated", "others", "hinted", "power_stated", "power", "named_scale", "distance", "site_share", "category_share", "share")


def candidates(rows: DataFrame, stats: DataFrame, by_site: DataFrame, by_category: DataFrame) -> DataFrame:
    """rows, once per candidate unit and power, with the features of that assignment."""
    units = F.array(*[F.lit(c) for c in CODES])
    pairs = F.flatten(F.transform("powers", lambda p: F.transform(units, lambda u: F.struct(u.alias("unit"), p.alias("power")))))
    df = rows.select("*", F.inline(pairs)).join(stats, ["table_name", "unit"], "left")
    df = df.join(by_site, ["site", "unit"], "left").join(by_category, ["category", "unit"], "left")
    is_unit = lambda c: F.coalesce((F.col(c) == F.col("unit")).cast("double"), F.lit(0.0))
    other = lambda c: F.coalesce((F.col(c) != F.col("unit")).cast("double"), F.lit(0.0))
    size = F.abs(F.col("raw") + F.col("power") - F.col("centre")) / F.greatest(F.col("width"), F.lit(0.1))
    return df.withColumns(
        {
            "stated": F.greatest(is_unit("column_hint"), is_unit("text_hint")),
            "others": other("column_hint") + other("text_hint"),
            "hinted": (F.col("column_hint").isNotNull() | F.col("text_hint").isNotNull()).cast("double"),
            "power_stated": F.coalesce(F.when(F.col("power") == F.col("power_hint"), 1.0).when(F.col("power_hint").isNotNull(), -1.0), F.lit(0.0)),
            "named_scale": (F.size("powers") == 1).cast("double"),
            "distance": F.coalesce(F.least(size, F.lit(9.0)), F.lit(9.0)),
            "site_share": F.coalesce(F.col("site_share"), F.lit(0.0)),
            "category_share": F.coalesce(F.col("category_share"), F.lit(0.0)),
            "share": F.coalesce(F.col("share"), F.lit(0.0)),
        }
    )


def _draw(salt: int) -> Column:
    """A number of 0 to 99 that a row draws, the same one in every run."""
    return F.pmod(F.xxhash64("table_name", "row_id", F.lit(salt)), F.lit(10_000)) / 100


def misled(named: DataFrame) -> float:
    """Percent of the currency columns that name another currency than the value beside them, over all rows that name both."""
    both = named.where(F.col("column_code").isNotNull())
    return both.agg(F.coalesce(100 * F.avg((F.col("column_code") != F.col("code")).cast("double")), F.lit(0.0))).first()[0]


def masked(named: DataFrame, hide_hint: int = HIDE_HINT, wrong_hint: float = 0.0) -> DataFrame:
    """Rows whose value names its unit, as if it named none: with true_power, and the hints that stand beside such a row.

    HIDE_SCALE percent are written without their scale, in units, thousands or millions. The currency column, which may be
    wrong itself, and a sentence on amounts are each hidden for hide_hint percent; a sentence names currency and scale, and is
    as often wrong as columns are (wrong_hint percent); a hidden scale is told by a sentence, but as often not.
    """
    own = F.coalesce("own_power", F.lit(0))
    hide = _draw(1) < HIDE_SCALE
    some = lambda salt: F.element_at(F.array(*[F.lit(p) for p in POWERS]), (F.floor(_draw(salt) * 100) % len(POWERS) + 1).cast("int"))
    power = F.when(hide, some(12)).otherwise(own)
    wrong = F.element_at(F.array(*[F.lit(c) for c in CODES]), (F.floor(_draw(2) * 100) % len(CODES) + 1).cast("int"))
    column = F.when(_draw(3) >= hide_hint, F.coalesce("column_code", F.when(_draw(4) < 50, F.col("code"))))
    text = F.when((_draw(5) >= hide_hint) & (_draw(6) < 50), F.when(_draw(7) < wrong_hint, wrong).otherwise(F.col("code")))
    told = F.when(_draw(8) < wrong_hint, some(9)).otherwise(power)
    sentence = hide & ((power > 0) & (_draw(10) >= wrong_hint) | text.isNotNull())
    return named.withColumns(
        {
            "true_power": power,
            "raw": F.when(hide, F.col("raw") + own - power).otherwise(F.col("raw")),
            "powers": F.when(hide | F.col("own_power").isNull(), F.array(*[F.lit(p) for p in POWERS])).otherwise(F.array(power)),
            "column_hint": column,
            "text_hint": text,
            "power_hint": F.when(sentence | ((power == 0) & text.isNotNull()), told),
        }
    )


def trained(named: DataFrame, stats: DataFrame, *shares: DataFrame):
    """Scores candidates: the calibrated forest as a function of a frame of candidates, which gets ``raw_score`` and ``confidence``."""
    n = named.count()
    keep = F.pmod(F.xxhash64("table_name", "row_id"), F.lit(max(1, -(-n // LABELLED_ROWS)))) == 0
    assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    if n < FEW:
        agreed = F.col("stated") * (F.col("others") == 0).cast("double")
        right = F.when(F.col("power_stated") == 0, (F.col("power") == 0) | (F.size("powers") == 1)).otherwise(F.col("power_stated") > 0)
        return lambda df: df.withColumns({"raw_score": agreed, "confidence": agreed * right.cast("double")})
    label = ((F.col("unit") == F.col("code")) & (F.col("power") == F.col("true_power"))).cast("double")
    learn = candidates(masked(named.where(keep), wrong_hint=misled(named)), stats, *shares).withColumn("label", label)
    learn = session.cut(assemble.transform(learn).select("table_name", "row_id", "features", "label"))
    fold = F.pmod(F.xxhash64("row_id", "table_name"), F.lit(5))
    forest = RandomForestClassifier(numTrees=40, maxDepth=9, minInstancesPerNode=2, seed=7, featureSubsetStrategy="all").fit(learn.where(fold > 0))
    raw = lambda df: forest.transform(df).withColumn("raw_score", vector_to_array("probability")[1])
    held = raw(learn.where(fold == 0)).select("label", F.col("raw_score").alias("features"))
    calibrate = IsotonicRegression(labelCol="label").fit(held).setFeaturesCol("raw_score").setPredictionCol("confidence")
    return lambda df: calibrate.transform(raw(assemble.transform(df)).drop("features"))


def best(scored: DataFrame, *more: str) -> DataFrame:
    """The best candidate of each row, with its confidence."""
    order = ("confidence", "raw_score", "stated", "power_stated", "unit", "power")
    one = scored.groupBy("table_name", "row_id", "value").agg(F.max(F.struct(*order, *more)).alias("b"))
    return one.select("table_name", "row_id", "value", "b.*")


def statistics(named: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(magnitudes of a table's units, shares of units by site, by category), over all rows that name their unit."""
    by = lambda *keys: named.groupBy(*keys, F.col("code").alias("unit"))
    size, total = F.col("raw") + F.coalesce("own_power", F.lit(0)), F.sum("n")
    stats = by("table_name").agg(F.avg(size).alias("centre"), F.coalesce(F.stddev(size), F.lit(1.0)).alias("width"), F.count("*").alias("n"))
    stats = stats.join(stats.groupBy("table_name").agg(total.alias("t")), "table_name")
    shares = []
    for key in ("site", "category"):
        counts = by(key).agg(F.count("*").alias("n"))
        shares.append(counts.join(counts.groupBy(key).agg(total.alias("t")), key).select(key, "unit", (F.col("n") / (F.col("t") + 5)).alias(f"{key}_share")))
    return stats.select("table_name", "unit", "centre", "width", (F.col("n") / F.col("t")).alias("share")), *shares


def assigned(spark: SparkSession, folder: str) -> DataFrame:
    """parsed() with ``unit``, ``low``, ``high`` and ``confidence``: what the value names (1.0), else the ensemble's best
    candidate; a unit of ``?`` is a named but unknown currency (0.0)."""
    rows = session.cut(parsed(spark, folder))
    known, missing = rows.where("code IS NOT NULL AND code <> '?'"), rows.where("code IS NULL")
    stats, *shares = statistics(known)
    score = trained(known, stats, *shares)
    powers = F.when(F.col("own_power").isNotNull(), F.array("own_power")).otherwise(F.array(*[F.lit(p) for p in POWERS]))
    asked = missing.withColumns({"powers": powers, "column_hint": F.col("column_code"), "text_hint": F.col("text_code"), "power_hint": F.when(F.col("own_power").isNull(), F.col("text_power"))})
    chosen = best(score(candidates(asked, stats, *shares)), "low", "high", "scaled_low", "scaled_high", "own_power", "others")
    # Where a neighbouring field names another currency than the best candidate, a person decides.
    chosen = chosen.withColumn("confidence", F.when(F.col("others") > 0, F.least("confidence", F.lit(0.5))).otherwise(F.col("confidence")))
    scale = F.when(F.col("own_power").isNull(), F.col("power")).otherwise(0)
    chosen = chosen.withColumns({c: F.when(scale > 0, F.col(f"scaled_{c}")).otherwise(F.col(c)) for c in ("low", "high")}).withColumn("scale", scale)
    columns = ("table_name", "row_id", "value", "unit", "scale", "low", "high", "confidence")
    named = rows.where("code IS NOT NULL").withColumns({"unit": F.col("code"), "scale": F.lit(0), "confidence": F.when(F.col("code") == "?", 0.0).otherwise(1.0)})
    return named.select(*columns).unionByName(chosen.select(*columns))


def _converted(spark: SparkSession, folder: str) -> DataFrame:
    """assigned() with low_eur and high_eur, null where there is no rate or the sum is too large."""
    rates = table(spark, folder, "unit_rates", "unit_code", "eur_value").select(F.col("unit_code").alias("unit"), F.col("eur_value").cast("string").alias("rate"))
    sums = assigned(spark, folder).join(rates, "unit", "left")
    return sums.withColumns({"low_eur": _euros("low", "rate", "scale"), "high_eur": _euros("high", "rate", "scale")})


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every stated sum in whole euros, by unit_rates."""
    sums = _converted(spark, folder).where((F.col("confidence") >= CONFIDENT) & F.col("low_eur").isNotNull() & F.col("high_eur").isNotNull())
    return sums.select("table_name", "row_id", "low_eur", "high_eur").distinct()


def p5_review(spark: SparkSession, folder: str) -> DataFrame:
    """Figures whose unit or scale stays uncertain or has no rate, with the best candidate and its calibrated probability."""
    rows = _converted(spark, folder).where((F.col("confidence") < CONFIDENT) | F.col("low_eur").isNull() | F.col("high_eur").isNull())
    return rows.select("table_name", "row_id", "value", F.col("unit").alias("candidate"), F.col("scale").cast("int").alias("power"), F.round("confidence", 4).alias("confidence")).distinct()
