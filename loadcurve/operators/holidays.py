"""Public holiday dimension by rule, for the years in the data.

Rules cover New South Wales (NSW) and England and Wales (any other region label, as for London).
They follow the public-holiday acts as they stand; one-off days are listed. A table of one's own
with columns (region, holiday_date) can be passed wherever this one is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadcurve.session import cut_lineage

# One-off holidays.
NSW_ONE_OFF = ["2022-09-22"]
GB_ONE_OFF = [
    "1999-12-31", "2002-06-03", "2011-04-29", "2012-06-05", "2022-06-03", "2022-09-19", "2023-05-08",
]
# GB bank holidays moved in single years, year -> date.
GB_MAY_DAY_MOVED = {1995: "1995-05-08", 2020: "2020-05-08"}
GB_SPRING_MOVED = {2002: "2002-06-04", 2012: "2012-06-04", 2022: "2022-06-02"}


def easter_sunday(year: Column) -> Column:
    """Gregorian Easter by golden number, epact and Sunday letter (integer arithmetic only)."""
    golden = year % 19
    century = F.floor(year / 100)
    leap_skips = F.floor(century / 4)
    moon_shift = F.floor((8 * century + 13) / 25)
    epact = (century - leap_skips - moon_shift + 19 * golden + 15) % 30
    full_moon = epact - F.floor(epact / 28) * (
        1 - F.floor(F.lit(29) / (epact + 1)) * F.floor((21 - golden) / 11)
    )
    weekday = (year + F.floor(year / 4) + full_moon + 2 - century + leap_skips) % 7
    offset = (full_moon - weekday).cast("int")
    return F.date_add(F.make_date(year, F.lit(3), F.lit(28)), offset)


def _nth_weekday(year: Column, month: int, weekday: int, nth: int) -> Column:
    """The nth weekday (Monday = 0) of a month."""
    first = F.make_date(year, F.lit(month), F.lit(1))
    return F.date_add(first, (F.lit(weekday + 7) - F.weekday(first)) % 7 + 7 * (nth - 1))


def _last_weekday(year: Column, month: int, weekday: int) -> Column:
    last = F.last_day(F.make_date(year, F.lit(month), F.lit(1)))
    return F.date_sub(last, (F.weekday(last) + 7 - weekday) % 7)


def _following_monday(day: Column) -> Column:
    """The next Monday when the day is on a weekend, else NULL."""
    return F.when(F.weekday(day) >= 5, F.date_add(day, 7 - F.weekday(day)))


def _moved(year: Column, usual: Column, exceptions: dict[int, str]) -> Column:
    result = F
    for y, d in exceptions.items():
        result = result.when(year == y, F.lit(d).cast("date"))
    return result.otherwise(usual)


def _one_off(year: Column, days: list[str]) -> list[Column]:
    return [F.when(year == int(d[:4]), F.lit(d).cast("date")) for d in days]


def _christmas_substitutes(christmas: Column, boxing: Column) -> list[Column]:
    """Extra days for Christmas and Boxing Day on a weekend: the Monday, and the Tuesday if both need one."""
    return [
        F.when(F.weekday(christmas) == 5, F.date_add(christmas, 2))
        .when(F.weekday(christmas) == 6, F.date_add(christmas, 2)),
        F.when(F.weekday(boxing) == 5, F.date_add(boxing, 2))
        .when(F.weekday(boxing) == 6, F.date_add(boxing, 2)),
    ]


def _nsw_days(year: Column) -> list[Column]:
    easter = easter_sunday(year)
    new_year = F.make_date(year, F.lit(1), F.lit(1))
    australia = F.make_date(year, F.lit(1), F.lit(26))
    christmas = F.make_date(year, F.lit(12), F.lit(25))
    boxing = F.make_date(year, F.lit(12), F.lit(26))
    return [
        new_year,
        _following_monday(new_year),
        australia,
        _following_monday(australia),
        F.date_sub(easter, 2),
        F.date_sub(easter, 1),
        F.when(year >= 2010, easter),
        F.date_add(easter, 1),
        F.make_date(year, F.lit(4), F.lit(25)),
        _nth_weekday(year, 6, 0, 2),
        _nth_weekday(year, 10, 0, 1),
        christmas,
        boxing,
        *_christmas_substitutes(christmas, boxing),
        *_one_off(year, NSW_ONE_OFF),
    ]


def _gb_days(year: Column) -> list[Column]:
    easter = easter_sunday(year)
    new_year = F.make_date(year, F.lit(1), F.lit(1))
    christmas = F.make_date(year, F.lit(12), F.lit(25))
    boxing = F.make_date(year, F.lit(12), F.lit(26))
    return [
        new_year,
        _following_monday(new_year),
        F.date_sub(easter, 2),
        F.date_add(easter, 1),
        _moved(year, _nth_weekday(year, 5, 0, 1), GB_MAY_DAY_MOVED),
        _moved(year, _last_weekday(year, 5, 0), GB_SPRING_MOVED),
        _last_weekday(year, 8, 0),
        christmas,
        boxing,
        *_christmas_substitutes(christmas, boxing),
        *_one_off(year, GB_ONE_OFF),
    ]


def is_holiday_by_rule(calendar: Column, day: Column) -> Column:
    """Whether a date is a holiday of its calendar, worked out from the rules of its year."""
    nsw, gb = (F.array(*days(F.year(day))) for days in (_nsw_days, _gb_days))
    return F.coalesce(F.array_contains(F.array_compact(F.when(calendar == "NSW", nsw).otherwise(gb)), day), F.lit(False))


def _holidays_of(years: DataFrame) -> DataFrame:
    y = F.col("year")
    calendars = F.array(
        F.struct(F.lit("NSW").alias("calendar"), F.array(*_nsw_days(y)).alias("days")),
        F.struct(F.lit("GB").alias("calendar"), F.array(*_gb_days(y)).alias("days")),
    )
    return (
        years.select(F.explode(calendars).alias("c"))
        .select("c.calendar", F.explode("c.days").alias("holiday_date"))
        .where(F.col("holiday_date").isNotNull())
        .distinct()
    )


def calendar_dimension(df: DataFrame, ts: str = "full_timestamp") -> DataFrame:
    """(calendar, holiday_date) for every year from the first to the last in the data.

    `calendar` is NSW or GB. Bounded by years x about 15 days x 2.
    """
    bounds = df.agg(F.min(F.year(ts)).alias("first"), F.max(F.year(ts)).alias("last"))
    years = bounds.where(F.col("first").isNotNull()).select(
        F.explode(F.sequence("first", "last")).alias("year")
    )
    return _holidays_of(years)


#: Years of the standing calendar.
STANDING_YEARS = (1900, 2199)
_standing: dict[tuple[str, int, int], DataFrame] = {}


def standing_calendar(spark: SparkSession, first: int = STANDING_YEARS[0], last: int = STANDING_YEARS[1]) -> DataFrame:
    """(calendar, holiday_date) for a fixed span of years, computed once per application."""
    key = (spark.sparkContext.applicationId, first, last)
    if key not in _standing:
        years = spark.range(first, last + 1, 1, 1).select(F.col("id").cast("int").alias("year"))
        _standing[key] = cut_lineage(_holidays_of(years))
    return _standing[key]


def calendar_of_region(region: Column) -> Column:
    return F.when(F.upper(region) == "NSW", F.lit("NSW")).otherwise(F.lit("GB"))
