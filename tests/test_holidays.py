from datetime import date

from pyspark.sql import functions as F

from loadcurve.operators.holidays import calendar_dimension, easter_sunday, standing_calendar
from loadcurve.operators.joins import join_holiday_calendar
from tests.helpers import column

# Easter Sundays, early and late ones among them.
EASTERS = ["1913-03-23", "1943-04-25", "1981-04-19", "2000-04-23", "2008-03-23", "2011-04-24", "2016-03-27", "2024-03-31", "2038-04-25"]


def test_easter(spark):
    days = [date.fromisoformat(d) for d in EASTERS]
    df = spark.createDataFrame([(d.year,) for d in days], "y int")
    assert column(df.select(easter_sunday(F.col("y")).alias("v"))) == days


def _days(df, calendar, year):
    rows = df.where((F.col("calendar") == calendar) & (F.year("holiday_date") == year)).collect()
    return {r["holiday_date"].isoformat()[5:] for r in rows}


def test_calendars(spark):
    c = standing_calendar(spark)
    assert _days(c, "NSW", 2011) == {
        "01-01", "01-03", "01-26", "04-22", "04-23", "04-24", "04-25", "06-13", "10-03", "12-25", "12-26", "12-27",
    }
    assert _days(c, "GB", 2012) == {"01-01", "01-02", "04-06", "04-09", "05-07", "06-04", "06-05", "08-27", "12-25", "12-26"}
    assert _days(c, "GB", 2020) == {"01-01", "04-10", "04-13", "05-08", "05-25", "08-31", "12-25", "12-26", "12-28"}


def test_dimension_covers_years_of_the_data(spark):
    df = spark.sql("SELECT explode(array(TIMESTAMP_NTZ'2019-05-05 00:00:00', TIMESTAMP_NTZ'2021-01-01 00:00:00')) AS full_timestamp")
    years = {r[0] for r in calendar_dimension(df).select(F.year("holiday_date")).distinct().collect()}
    assert years == {2019, 2020, 2021}
    assert calendar_dimension(df.limit(0)).count() == 0


def test_flag_by_region_and_own_table(spark):
    df = spark.sql(
        "SELECT region, TIMESTAMP_NTZ'2024-01-26 05:00:00' AS full_timestamp FROM VALUES ('NSW'), ('nsw'), ('LCL') AS t(region)"
    )
    flags = {r["region"]: r["is_holiday"] for r in join_holiday_calendar(df).collect()}
    assert flags == {"NSW": 1, "nsw": 1, "LCL": 0}
    own = spark.sql("SELECT 'GB' AS calendar, DATE'2024-01-26' AS holiday_date UNION ALL SELECT 'GB', DATE'2024-01-26'")
    flags = {r["region"]: r["is_holiday"] for r in join_holiday_calendar(df, own).collect()}
    assert flags == {"NSW": 0, "nsw": 0, "LCL": 1}
