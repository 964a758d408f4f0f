"""Timestamps in mixed formats and zones, brought to one unambiguous text.

Method: every accepted format is one alternative of a single compiled expression with named groups. A value is
matched once; its parts are checked against the calendar and assembled by integer day arithmetic. Only the zone
offset itself comes from the JVM's zone rules, whose local-to-instant rule is the one wanted here: the earlier
reading of a doubled hour, a skipped hour moved forward by the gap.

Defined results: null, blank and values that state no moment give no row; impossible dates (31 April, month 13) give
no row; a time without zone whose site is unknown, or with the name of no zone, gives no row; a numeric slash date of an unknown site is read only
if one order of day and month is possible.
"""

from __future__ import annotations

import re
import zoneinfo
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.urls import host
from siltstone.sources.tables import table

MONTHS = {
    name: number
    for number, names in enumerate(
        (
            "january jan januar janvier enero ene", "february feb februar février fevrier febrero",
            "march mar märz maerz mars marzo mär", "april apr avril abril abr avr",
            "may mai mayo", "june jun juni juin junio", "july jul juli juillet julio juil",
            "august aug août aout agosto ago", "september sept sep septembre septiembre",
            "october oct oktober octobre octubre okt", "november nov novembre noviembre",
            "december dec dezember décembre decembre diciembre dez dic déc",
        ),
        1,
    )
    for name in names.split()
}
#: Minutes east of UTC of the zone abbreviations that occur in Europe, North America, India, East Asia and Australia.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360,
    "PST": -480, "PDT": -420, "IST": 330, "JST": 540, "KST": 540, "SGT": 480, "HKT": 480, "AEST": 600, "AEDT": 660,
}

#: The regions' zone names by their lower case, as the public time zone database has them.
ZONES = {z.lower(): z for z in zoneinfo.available_timezones() if "/" in z and not z.startswith(("posix/", "right/", "SystemV/"))}

_NAME = r"(?P<mon>[A-Za-zäéèûôÀ-ÿ]{3,10})\.?"
_DAY = r"(?P<d>\d{1,2})"
_CLOCK = r"(?P<h>\d{1,2})[:.](?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,]\d{1,9})?)?(?:\s?(?P<ap>[AaPp])\.?[Mm]\.?)?(?:\s?Uhr)?"
_ZONE = r"(?:\s?(?P<off>[+-]\d{2}:?\d{2}|[+-]\d{2})|\s?\(?(?P<ab>[A-Z]{1,5})\)?|\s(?P<zn>[A-Z][A-Za-z_]+/[A-Za-z_/]+))?"
_LOCAL = r"(?:\s?\(local time\))?"
_TIME = rf"(?:(?:,|\s+at|\s+à|\s+um)?\s+{_CLOCK}{_ZONE}{_LOCAL})?"
_WEEKDAY = r"(?:[A-Za-zäéÀ-ÿ]{2,10}\.?,?\s+)?"
#: One alternative per format. Order matters only where two alternatives could match the same text.
FORMATS = {
    "epoch_ms": r"(?P<ems>\d{13})",
    "epoch_s": r"(?P<es>\d{10})",
    "compact": r"(?P<y>\d{4})(?P<mo>\d{2})(?P<d>\d{2})(?:[ T]?(?P<h>\d{2})(?P<mi>\d{2})(?P<s>\d{2})?(?P<ab>Z)?)?",
    "iso": rf"(?P<y>\d{{4}})-(?P<mo>\d{{2}})-(?P<d>\d{{2}})(?:[T ]{_CLOCK}{_ZONE}{_LOCAL})?",
    "ymd_slash": rf"(?P<y>\d{{4}})/(?P<mo>\d{{1,2}})/(?P<d>\d{{1,2}}){_TIME}",
    "slash": rf"(?P<p>\d{{1,2}})/(?P<q>\d{{1,2}})/(?P<y>\d{{4}}|\d{{2}}){_TIME}",
    "dots": rf"(?P<d>\d{{1,2}})\.(?P<mo>\d{{1,2}})\.(?P<y>\d{{4}}|\d{{2}}){_TIME}",
    "dashes": rf"(?P<d>\d{{1,2}})-{_NAME}-(?P<y>\d{{4}}|\d{{2}}){_TIME}",
    "day_name": rf"{_WEEKDAY}{_DAY}(?:\.|er|st|nd|rd|th)?\s+(?:de\s+)?{_NAME},?\s+(?:de\s+)?(?P<y>\d{{4}}){_TIME}",
    "day_french": rf"{_WEEKDAY}{_DAY}(?:er)?\s+{_NAME}\s+(?P<y>\d{{4}})\s+à\s+(?P<h>\d{{1,2}})\s?h\s?(?P<mi>\d{{2}})?{_ZONE}",
    "day_of": rf"(?:the\s+)?{_DAY}(?:st|nd|rd|th)\s+of\s+{_NAME},?\s+(?P<y>\d{{4}}){_TIME}",
    "name_day": rf"{_WEEKDAY}{_NAME}\s+{_DAY}(?:st|nd|rd|th)?,?\s+(?P<y>\d{{4}}){_TIME}",
    "clock_first": rf"{_CLOCK}{_ZONE},?\s+{_DAY}\.?\s+{_NAME}\s+(?P<y>\d{{4}})",
    "month": r"(?P<y>\d{4})-(?P<mo>\d{2})",
    "month_slash": r"(?P<mo>\d{1,2})/(?P<y>\d{4})",
    "month_name": rf"{_NAME},?\s+(?P<y>\d{{4}})",
    "year": r"(?P<y>(?:19|20)\d{2})",
}
_PREFIX = r"\s*(?:(?:from|by|until|till|before|on|due|opens?|opening|closes?|closing|deadline|ab|bis|le|am|date)\s*:?\s+)*"
EXPRESSION = re.compile(
    _PREFIX
    + "(?:"
    + "|".join(f"(?P<f{i}>" + re.sub(r"\?P<(\w+)>", rf"?P<\1_{i}>", p) + ")" for i, p in enumerate(FORMATS.values()))
    + r")\s*\.?\s*",
    re.IGNORECASE,
)
_PARTS = [[g[: -len(f"_{i}")] for g in EXPRESSION.groupindex if g.endswith(f"_{i}")] for i in range(len(FORMATS))]
_OUT = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("days", "secs", "shape", "epoch", "off")] + [T.StructField("zone", T.StringType())]
)


def days_from_civil(y: int, m: int, d: int) -> int | None:
    """Days since 1970-01-01 of a valid Gregorian date, by integer arithmetic; None if there is no such day."""
    if not (1 <= m <= 12 and 1 <= d <= 31 and 1 <= y <= 9999):
        return None
    leap = y % 4 == 0 and (y % 100 != 0 or y % 400 == 0)
    if d > (31, 29 if leap else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[m - 1]:
        return None
    y -= m <= 2
    era, yoe = y // 400, y % 400
    doy = (153 * (m + (-3 if m > 2 else 9)) + 2) // 5 + d - 1
    return era * 146097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719468


def components(text: str | None, order: str | None) -> tuple | None:
    """(days, second of day or None, shape 3|2|1 for day|month|year, epoch or None, offset minutes or None, zone or None).

    order is the site's reading of numeric slash dates, 'dmy' or 'mdy'; None is unknown. Returns None if text states
    no moment.
    """
    match = EXPRESSION.fullmatch(text) if text else None
    if not match:
        return None
    i = int(match.lastgroup[1:])
    g = {k: v for k in _PARTS[i] if (v := match.group(f"{k}_{i}")) is not None}
    if "ems" in g or "es" in g:
        return None, None, 0, int(g["es"]) if "es" in g else int(g["ems"]) // 1000, None, None
    year = int(g["y"]) + (2000 if len(g["y"]) == 2 else 0)
    day = int(g["d"]) if "d" in g else 0
    if "p" in g:
        p, q = int(g["p"]), int(g["q"])
        reads = [(q, p), (p, q)] if order != "mdy" else [(p, q), (q, p)]
        valid = [x for x in reads if days_from_civil(year, *x) is not None]
        if not valid or (order is None and len(set(valid)) > 1):
            return None
        month, day = valid[0]
    elif "mon" in g:
        month = MONTHS.get(g["mon"].lower(), 0)
    else:
        month = int(g["mo"]) if "mo" in g else 0
    shape = 3 if day else 2 if month or "mon" in g or "mo" in g else 1
    days = days_from_civil(year, month if shape > 1 else 1, day if shape > 2 else 1)
    if days is None:
        return None
    if "h" not in g:
        return days, None, shape, None, None, None
    hour, minute, second = int(g["h"]), int(g.get("mi") or 0), int(g.get("s") or 0)
    if "ap" in g:
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + (12 if g["ap"].lower() == "p" else 0)
    if not (hour < 24 or (hour, minute, second) == (24, 0, 0)) or minute > 59 or second > 59:
        return None
    offset, zone = None, g.get("zn")
    if zone and (zone := ZONES.get(zone.lower())) is None:
        return None
    if "off" in g:
        raw = g["off"].replace(":", "")
        offset = (-1 if raw[0] == "-" else 1) * (int(raw[1:3]) * 60 + int(raw[3:5] or 0))
    elif "ab" in g:
        if (offset := ABBREVIATIONS.get(g["ab"].upper())) is None:
            return None
    return days, hour * 3600 + minute * 60 + second, shape, None, offset, zone


@F.pandas_udf(_OUT)
def _parse(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for text, order in batches:
        rows = [components(t, o) or (None,) * 6 for t, o in zip(text, order)]
        yield pd.DataFrame(
            {
                **{n: pd.array([r[i] for r in rows], dtype="Int64") for i, n in enumerate(("days", "secs", "shape", "epoch", "off"))},
                "zone": np.array([r[5] for r in rows], dtype=object),
            }
        )


def normalise(df: DataFrame, value: str, zone: str, order: str, to: str = "utc_text") -> DataFrame:
    """df with the column to: the unambiguous text of column value, null if it states no moment.

    zone and order are columns with the IANA zone and the slash order of the row's site. A parse runs once per row;
    df keeps its other columns, whatever their names.
    """
    part = df.withColumn("_parts", _parse(F.col(value), F.col(order)))
    p = lambda name: F.col(f"_parts.{name}")
    local = p("days") * 86400 + p("secs")
    # A zone that the JVM does not know would end the query; it is no zone here.
    known = sorted(df.sparkSession._jvm.java.time.ZoneId.getAvailableZoneIds().toArray())
    valid = lambda c: F.when(c.isin(*known) | c.rlike(r"^[+-]\d\d:\d\d$"), c)
    named = F.when(p("zone").isNotNull(), valid(p("zone"))).otherwise(valid(F.col(zone)))
    zoned = F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(local), named))
    instant = F.coalesce(p("epoch"), F.when(p("off").isNotNull(), local - p("off") * 60).otherwise(zoned))
    day = F.date_from_unix_date(p("days").cast("int")).cast("string")
    text = (
        F.when(p("shape").isNull(), F.lit(None))
        .when((p("shape") == 0) | p("secs").isNotNull(), utc_text(instant))
        .when(p("shape") == 3, day)
        .when(p("shape") == 2, F.substring(day, 1, 7))
        .otherwise(F.substring(day, 1, 4))
    )
    return part.withColumn(to, text).drop("_parts")


def utc_text(seconds: Column) -> Column:
    """YYYY-MM-DDTHH:MM:SSZ of seconds since 1970, whatever the session's zone."""
    day = F.floor(seconds / 86400).cast("int")
    rest = F.pmod(seconds, F.lit(86400)).cast("int")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    clock = F.concat(two(F.floor(rest / 3600)), F.lit(":"), two(F.floor(rest / 60) % 60), F.lit(":"), two(rest % 60))
    return F.when(seconds.isNotNull(), F.concat(F.date_from_unix_date(day).cast("string"), F.lit("T"), clock, F.lit("Z")))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every stated moment of funding_data.deadline, opening_date and failure_data.incident_date."""
    fields = (("funding_data", "deadline"), ("funding_data", "opening_date"), ("failure_data", "incident_date"))
    rows = None
    for name, field in fields:
        one = table(spark, folder, name, "id", "url", field).select(
            F.lit(name).alias("table_name"),
            F.col("id").alias("row_id"),
            F.lit(field).alias("field_name"),
            F.col(field).alias("value"),
            host(F.col("url")).alias("site"),
        )
        rows = one if rows is None else rows.unionByName(one)
    zones = table(spark, folder, "site_zones", "site", "zone", "date_order")
    rows = rows.where(F.col("value").rlike(r"\d")).join(zones, "site", "left")
    found = normalise(rows, "value", "zone", "date_order").where(F.col("utc_text").isNotNull())
    return found.select("table_name", "row_id", "field_name", "utc_text").distinct()
