"""Japanese public-holiday calendar as a dimension table.

The holiday flag is a join against this table instead of a per-row library
call.  The table is generated from the public holiday law for a year range:
about 16-20 rows a year, so even the whole supported range (1955-2099) stays
around 3,000 rows -- a fixed, proven size that is safe to broadcast.
Users may pass their own ``holidays(date, name)`` table instead.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------------------
# Fixed values (from the public Japanese holiday law and the astronomical
# equinox approximation published for 1980-2099).  Names are the official
# Japanese holiday names.
# ---------------------------------------------------------------------------
NEW_YEAR = "元日"
COMING_OF_AGE = "成人の日"
FOUNDATION = "建国記念の日"
EMPEROR_BIRTHDAY = "天皇誕生日"
VERNAL_EQUINOX = "春分の日"
SHOWA = "昭和の日"
GREENERY = "みどりの日"
CONSTITUTION = "憲法記念日"
CHILDREN = "こどもの日"
MARINE = "海の日"
MOUNTAIN = "山の日"
RESPECT_AGED = "敬老の日"
AUTUMN_EQUINOX = "秋分の日"
SPORTS_OLD = "体育の日"
SPORTS = "スポーツの日"
CULTURE = "文化の日"
LABOR_THANKS = "勤労感謝の日"
SUBSTITUTE = "振替休日"
CITIZENS = "国民の休日"
# One-off holidays by law.
SPECIAL_DAYS = {
    dt.date(1959, 4, 10): "皇太子・明仁親王の結婚の儀",
    dt.date(1989, 2, 24): "昭和天皇の大喪の礼",
    dt.date(1990, 11, 12): "即位礼正殿の儀",
    dt.date(1993, 6, 9): "皇太子・皇太子徳仁親王の結婚の儀",
    dt.date(2019, 5, 1): "天皇の即位の日",
    dt.date(2019, 10, 22): "即位礼正殿の儀",
}
# Equinox day = int(base + 0.242194 * (year - 1980) - int((year - 1980) / 4)).
VERNAL_BASE_1980_2099 = 20.8431
AUTUMN_BASE_1980_2099 = 23.2488
VERNAL_BASE_1900_1979 = 20.8357
AUTUMN_BASE_1900_1979 = 23.2588
EQUINOX_DRIFT = 0.242194
# Olympic-year moves (2020, 2021) of Marine, Sports and Mountain day.
OLYMPIC_MOVES = {
    2020: {MARINE: dt.date(2020, 7, 23), SPORTS: dt.date(2020, 7, 24), MOUNTAIN: dt.date(2020, 8, 10)},
    2021: {MARINE: dt.date(2021, 7, 22), SPORTS: dt.date(2021, 7, 23), MOUNTAIN: dt.date(2021, 8, 8)},
}
SUBSTITUTE_FROM = dt.date(1973, 4, 12)
CITIZENS_FROM = dt.date(1988, 1, 1)


# years that the rules below cover
FIRST_YEAR, LAST_YEAR = 1955, 2099


def _nth_monday(year: int, month: int, n: int) -> dt.date:
    first = dt.date(year, month, 1)
    offset = (0 - first.weekday()) % 7
    return first + dt.timedelta(days=offset + 7 * (n - 1))


def _equinox(year: int, base_new: float, base_old: float) -> int:
    if year >= 1980:
        return int(base_new + EQUINOX_DRIFT * (year - 1980) - int((year - 1980) / 4))
    return int(base_old + EQUINOX_DRIFT * (year - 1980) - int((year - 1983) / 4))


def _named_holidays(y: int) -> dict[dt.date, str]:
    d: dict[dt.date, str] = {}

    def add(day: dt.date, name: str):
        d[day] = name

    add(dt.date(y, 1, 1), NEW_YEAR)
    add(dt.date(y, 1, 15) if y < 2000 else _nth_monday(y, 1, 2), COMING_OF_AGE)
    if y >= 1967:
        add(dt.date(y, 2, 11), FOUNDATION)
    if y <= 1988:
        add(dt.date(y, 4, 29), EMPEROR_BIRTHDAY)
    elif 1989 <= y <= 2018:
        add(dt.date(y, 12, 23), EMPEROR_BIRTHDAY)
    elif y >= 2020:
        add(dt.date(y, 2, 23), EMPEROR_BIRTHDAY)
    add(dt.date(y, 3, _equinox(y, VERNAL_BASE_1980_2099, VERNAL_BASE_1900_1979)), VERNAL_EQUINOX)
    if 1989 <= y <= 2006:
        add(dt.date(y, 4, 29), GREENERY)
    elif y >= 2007:
        add(dt.date(y, 4, 29), SHOWA)
        add(dt.date(y, 5, 4), GREENERY)
    add(dt.date(y, 5, 3), CONSTITUTION)
    add(dt.date(y, 5, 5), CHILDREN)
    moves = OLYMPIC_MOVES.get(y, {})
    if 1996 <= y <= 2002:
        add(dt.date(y, 7, 20), MARINE)
    elif y >= 2003:
        add(moves.get(MARINE, _nth_monday(y, 7, 3)), MARINE)
    if y >= 2016:
        add(moves.get(MOUNTAIN, dt.date(y, 8, 11)), MOUNTAIN)
    if 1966 <= y <= 2002:
        add(dt.date(y, 9, 15), RESPECT_AGED)
    elif y >= 2003:
        add(_nth_monday(y, 9, 3), RESPECT_AGED)
    add(dt.date(y, 9, _equinox(y, AUTUMN_BASE_1980_2099, AUTUMN_BASE_1900_1979)), AUTUMN_EQUINOX)
    if 1966 <= y <= 1999:
        add(dt.date(y, 10, 10), SPORTS_OLD)
    elif 2000 <= y <= 2019:
        add(_nth_monday(y, 10, 2), SPORTS_OLD)
    elif y >= 2020:
        add(moves.get(SPORTS, _nth_monday(y, 10, 2)), SPORTS)
    add(dt.date(y, 11, 3), CULTURE)
    add(dt.date(y, 11, 23), LABOR_THANKS)
    for day, name in SPECIAL_DAYS.items():
        if day.year == y:
            add(day, name)
    return d


def japanese_holidays(start_year: int, end_year: int) -> list[tuple[dt.date, str]]:
    """All holidays in [start_year, end_year], sorted by date."""
    out: dict[dt.date, str] = {}
    for y in range(start_year, end_year + 1):
        named = _named_holidays(y)
        out.update(named)
        # Substitute holidays: a holiday on Sunday moves to the next day that
        # is not a holiday (before 2007: simply the Monday).
        for day in sorted(named):
            if day.weekday() == 6 and day >= SUBSTITUTE_FROM:
                nxt = day + dt.timedelta(days=1)
                if day.year >= 2007:
                    while nxt in named:
                        nxt += dt.timedelta(days=1)
                if nxt not in named:
                    out[nxt] = SUBSTITUTE
        # Citizens' holiday: a non-Sunday, non-holiday day between two holidays.
        for day in sorted(named):
            between = day + dt.timedelta(days=1)
            after = day + dt.timedelta(days=2)
            if (between >= CITIZENS_FROM and after in named and between not in out
                    and between.weekday() != 6):
                out[between] = CITIZENS
    return sorted((d, n) for d, n in out.items() if start_year <= d.year <= end_year)


_ROWS_CACHE: dict[tuple[int, int], list] = {}


def holidays_table(spark: SparkSession, start_year: int = FIRST_YEAR, end_year: int = LAST_YEAR) -> DataFrame:
    """``holidays(date DATE, holiday_name STRING)`` dimension for a year range."""
    key = (start_year, end_year)
    if key not in _ROWS_CACHE:
        _ROWS_CACHE[key] = japanese_holidays(start_year, end_year)
    return spark.createDataFrame(_ROWS_CACHE[key], "date date, holiday_name string")
