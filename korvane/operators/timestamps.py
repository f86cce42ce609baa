"""Mixed timestamp notations to one UTC instant.

An ordered cascade of anchored patterns, each parsed strictly. A value that states no zone is local time of its source, looked
up in a table of sources. A local time that occurs twice is the earlier instant; one that a clock change skips is read with the
offset in force before the change. Anything else (null, relative, not a date, impossible fields) has no instant.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Month names in English, German and Russian (genitive and nominative), by month number.
MONTHS = {
    "jan": 1, "january": 1, "januar": 1, "jänner": 1, "января": 1, "январь": 1, "янв": 1,
    "feb": 2, "february": 2, "februar": 2, "февраля": 2, "февраль": 2, "фев": 2,
    "mar": 3, "march": 3, "märz": 3, "mär": 3, "марта": 3, "март": 3, "мар": 3,
    "apr": 4, "april": 4, "апреля": 4, "апрель": 4, "апр": 4,
    "may": 5, "mai": 5, "мая": 5, "май": 5,
    "jun": 6, "june": 6, "juni": 6, "июня": 6, "июнь": 6, "июн": 6,
    "jul": 7, "july": 7, "juli": 7, "июля": 7, "июль": 7, "июл": 7,
    "aug": 8, "august": 8, "августа": 8, "август": 8, "авг": 8,
    "sep": 9, "sept": 9, "september": 9, "сентября": 9, "сентябрь": 9, "сен": 9, "сент": 9,
    "oct": 10, "october": 10, "okt": 10, "oktober": 10, "октября": 10, "октябрь": 10, "окт": 10,
    "nov": 11, "november": 11, "ноября": 11, "ноябрь": 11, "ноя": 11, "нояб": 11,
    "dec": 12, "december": 12, "dez": 12, "dezember": 12, "декабря": 12, "декабрь": 12, "дек": 12,
}

# Minutes east of UTC of zone letters that the source's own place does not use.
ZONE_LETTERS = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "IST": 330, "CET": 60, "MEZ": 60, "CEST": 120, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "MSD": 240, "SAMT": 240, "GET": 240, "YEKT": 300, "YEKST": 360, "OMST": 360, "KRAT": 420, "IRKT": 480,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "HST": -600, "JST": 540,
}

_CLOCK = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?"
_AMPM = r"(?:\s*(?P<ap>[AaPp]\.?[Mm]\.?))?"
_ZONE = r"(?:\s*(?P<z>Z|z|(?:UTC|GMT)?\s?[+\-−]\d{1,2}(?::?\d{2})?|[A-Za-z]{2,5}))?"
_DAY_NAME = r"(?:[^\W\d_]{2,10}\.?,?\s+)?"
_NAME = r"(?P<mn>[^\W\d_]{3,9})\.?"

#: In order; the first that matches a whole value decides, and a strict failure of its fields is final.
CASCADE: tuple[tuple[str, re.Pattern[str]], ...] = tuple(
    (name, re.compile(pattern))
    for name, pattern in (
        ("epoch", r"(?P<epoch>[-−]?\d{9,13})(?:\.(?P<ef>\d+))?"),
        ("iso", rf"(?P<y>\d{{4}})-(?P<m>\d{{1,2}})-(?P<d>\d{{1,2}})(?:(?:[Tt]|\s+){_CLOCK}{_AMPM}{_ZONE})?"),
        ("basic", r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})(?:T?(?P<h>\d{2})(?P<mi>\d{2})(?:(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?(?P<z>Z|[+\-]\d{2}(?::?\d{2})?)?)?"),
        ("ymd_slash", rf"(?P<y>\d{{4}})[/.](?P<m>\d{{1,2}})[/.](?P<d>\d{{1,2}})(?:,?\s+{_CLOCK}{_AMPM}{_ZONE})?"),
        ("dotted", rf"(?P<d>\d{{1,2}})\.(?P<m>\d{{1,2}})\.(?P<y>\d{{4}})(?:,?\s+(?:в\s+)?{_CLOCK}{_AMPM}(?:\s+Uhr)?{_ZONE})?"),
        ("slashed", rf"(?P<a>\d{{1,2}})/(?P<b>\d{{1,2}})/(?P<y>\d{{4}})(?:,?\s+{_CLOCK}{_AMPM}{_ZONE})?"),
        ("unix", rf"[^\W\d_]{{2,10}}\.?\s+{_NAME}\s+(?P<d>\d{{1,2}})\s+{_CLOCK}{_ZONE}\s+(?P<y>\d{{4}})"),
        ("day_name_month", rf"{_DAY_NAME}(?P<d>\d{{1,2}})\.?(?:\s+|-){_NAME}(?:\s+|-)(?P<y>\d{{4}})(?:\s*г\.?)?(?:,?\s+(?:(?:в|um|at)\s+)?{_CLOCK}{_AMPM}(?:\s+Uhr)?{_ZONE})?"),
        ("month_day", rf"{_DAY_NAME}{_NAME}\s+(?P<d>\d{{1,2}}),?\s+(?P<y>\d{{4}})(?:,?\s+(?:at\s+)?{_CLOCK}{_AMPM}{_ZONE})?"),
    )
)
_SPACES = re.compile(r"[\s   ]+")
_OFFSET = re.compile(r"(?:UTC|GMT)?\s?([+\-−])(\d{1,2}):?(\d{2})?")
_EPOCH = datetime(1970, 1, 1)


@lru_cache(maxsize=1024)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except (KeyError, ValueError, OSError):
        return None


def _micros(naive: datetime) -> int:
    gap = naive - _EPOCH
    return (gap.days * 86_400 + gap.seconds) * 1_000_000 + gap.microseconds


def _letters_minutes(letters: str, local: datetime, zone: ZoneInfo | None) -> float | None:
    """Minutes east of UTC that the letters mean at the place of zone, else by the fixed table."""
    if zone is not None:
        for fold in (0, 1):
            t = local.replace(tzinfo=zone, fold=fold)
            if t.tzname() == letters:
                return t.utcoffset().total_seconds() / 60
        for month in (1, 7):
            t = datetime(local.year, month, 1, tzinfo=zone)
            if t.tzname() == letters:
                return t.utcoffset().total_seconds() / 60
    return ZONE_LETTERS.get(letters.upper())


def parse_instant(value: str | None, tz: str | None, date_order: str | None = "dmy", default_tz: str = "UTC") -> int | None:
    """Microseconds since 1970-01-01 UTC, finer digits cut off, or None where the value states no instant.

    tz: IANA name of the source's place, default_tz where it is null or unknown; date_order: dmy or mdy, for dates with slashes.
    """
    if value is None:
        return None
    text = _SPACES.sub(" ", value).strip()
    if not text:
        return None
    for name, pattern in CASCADE:
        if (m := pattern.fullmatch(text)) is None:
            continue
        g = m.groupdict()
        if name == "epoch":
            digits, fraction, before = g["epoch"].lstrip("-−"), g["ef"] or "", g["epoch"][0] in "-−"
            unit = 6 if len(digits) <= 10 else 3  # from eleven digits on milliseconds are counted
            us = int(digits) * 10**unit + int((fraction + "000000")[:unit])
            return -us if before else us
        if "mn" in g:
            month = MONTHS.get(g["mn"].lower())
            if month is None:
                continue
            day = int(g["d"])
        elif name == "slashed":
            day, month = (int(g["b"]), int(g["a"])) if date_order == "mdy" else (int(g["a"]), int(g["b"]))
        else:
            day, month = int(g["d"]), int(g["m"])
        hour, minute, second = int(g["h"] or 0), int(g["mi"] or 0), int(g["s"] or 0)
        if half := g.get("ap"):
            if not 1 <= hour <= 12:
                return None
            hour = hour % 12 + (12 if half[0] in "Pp" else 0)
        extra = 0
        if second == 60 and minute == 59:  # a leap second is the next second
            second, extra = 59, 1
        if hour == 24 and minute == second == 0:  # ISO's end of day
            hour, extra = 0, 86_400
        micro = int(((g.get("f") or "") + "000000")[:6])
        try:
            local = datetime(int(g["y"]), month, day, hour, minute, second, micro) + timedelta(seconds=extra)
        except (ValueError, OverflowError):
            return None
        zone = _zone(tz) if tz else None
        if stated := g.get("z"):
            if off := _OFFSET.fullmatch(stated):
                hours, minutes = int(off[2]), int(off[3] or 0)
                if hours > 18 or minutes > 59:
                    return None
                east = (hours * 60 + minutes) * (1 if off[1] == "+" else -1)
            else:
                east = _letters_minutes(stated, local, zone)
                if east is None:
                    return None
            return _micros(local) - round(east * 60_000_000)
        zone = zone or _zone(default_tz) or timezone.utc
        return _micros(local) - round(local.replace(tzinfo=zone, fold=0).utcoffset().total_seconds() * 1_000_000)
    return None


def normalize_instants(df: DataFrame, places: DataFrame, fields: tuple[str, ...], key: str = "article_id", source: str = "source", default_tz: str = "UTC") -> DataFrame:
    """(key, field, utc_us): one row for each value of the named string columns that states an instant.

    places: (source unique, tz, date_order). Sources that it lacks are read in default_tz, day first. Null, empty, relative and
    impossible values give no row; repeated rows give repeated rows; an empty table gives none; further columns are not read.
    """
    look = places.select(F.col("source").alias("_k_source"), F.col("tz").alias("_k_tz"), F.col("date_order").alias("_k_order"))
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))
    rows = (
        df.select(F.col(key).alias("_k_key"), F.col(source).alias("_k_at"), F.explode(pairs).alias("_k_pair"))
        .where(F.col("_k_pair.value").isNotNull())
        .join(look, F.col("_k_at") == F.col("_k_source"), "left")
        .select(F.col("_k_key").alias("key"), F.col("_k_pair.field").alias("field"), F.col("_k_pair.value").alias("value"), F.col("_k_tz").alias("tz"), F.col("_k_order").alias("date_order"))
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [parse_instant(v, t or None, o or "dmy", default_tz) for v, t, o in zip(b["value"], b["tz"], b["date_order"])]
            keep = [x is not None for x in found]
            out = b.loc[keep, ["key", "field"]]
            yield out.assign(utc_us=pd.array([x for x in found if x is not None], dtype="int64"))

    kind = dict(df.dtypes)[key]
    return rows.mapInPandas(run, f"key {kind}, field string, utc_us bigint").withColumnRenamed("key", key)
