from datetime import datetime

import pytest

from loadcurve.functions import timeformats as tf


def _frame(spark, files):
    return spark.createDataFrame([(f, t) for f, texts in files.items() for t in texts], "file string, time string")


FILES = {
    "iso": ["2024-03-04T05:00", "2024-03-04 06:00:00", " 2024-12-31 ", None],
    "day": ["3/4/2024 05:00", "13/4/2024 06:00", "junk", "2024"],
    "month": ["03/04/2024 05:00", "04/13/2024 06:00"],
    "dots": ["4.3.2024 5:00"],
    "compact": ["04MAR2024", "31dec2024 7:30"],
    "digits": ["20240304 0500", "20241231"],
    "same": ["05/05/2024", "06/06/2024"],
    None: ["3-14-2024"],
    "empty": [None, "x"],
}


def test_each_file_by_its_own_values(spark):
    frame = _frame(spark, FILES)
    found = {r["file"]: r["format"] for r in tf.infer_formats(frame, "time", ["file"]).collect()}
    assert found == {
        "iso": "iso", "day": "day_first", "month": "month_first", "dots": "day_first_dots", "compact": "compact", "digits": "digits",
        "same": "day_first", None: "month_first_dashes",
    }
    rows = [(r["file"], r["time"]) for r in tf.coerce_inferred(frame.repartition(5), "time", ["file"]).collect()]
    assert len(rows) == frame.count()
    got = {f: sorted(t for g, t in rows if g == f and t) for f in FILES}
    assert got["day"] == [datetime(2024, 4, 3, 5), datetime(2024, 4, 13, 6)] and got["month"] == [datetime(2024, 3, 4, 5), datetime(2024, 4, 13, 6)]
    assert got["iso"] == [datetime(2024, 3, 4, 5), datetime(2024, 3, 4, 6), datetime(2024, 12, 31)] and got["empty"] == []
    assert got["compact"] == [datetime(2024, 3, 4), datetime(2024, 12, 31, 7, 30)] and got["digits"] == [datetime(2024, 3, 4, 5), datetime(2024, 12, 31)]


def test_undecided_files(spark):
    frame = _frame(spark, {"a": ["3/4/2024", "5/6/2024"], "b": ["13/4/2024"]})
    with pytest.raises(tf.UndecidedFormatError, match="'a'.*may come first"):
        tf.infer_formats(frame, "time", ["file"])
    first = lambda day: {r["file"]: r["time"] for r in tf.coerce_inferred(frame.where("time <> '5/6/2024'"), "time", ["file"], day_first=day).collect()}
    assert first(True)["a"] == datetime(2024, 4, 3) and first(False)["a"] == datetime(2024, 3, 4)
    assert first(True)["b"] == first(False)["b"] == datetime(2024, 4, 13)


def test_several_formats_in_one_file(spark):
    with pytest.raises(tf.UndecidedFormatError, match="no one format"):
        tf.infer_formats(_frame(spark, {"a": ["13/4/2024", "4/13/2024"]}), "time", ["file"])
    with pytest.raises(tf.UndecidedFormatError, match="no one format"):
        tf.coerce_inferred(_frame(spark, {"a": ["2024-01-01", "13/4/2024"]}), "time", ["file"])


def test_one_pass_and_empty_tables(spark):
    frame = _frame(spark, FILES)
    plan = tf.format_counts(frame, "time", ["file"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ") == 1
    assert tf.coerce_inferred(frame.limit(0), "time", ["file"]).count() == 0
    assert tf.coerce_inferred(frame.where("file = 'day'"), "time", []).where("time is not null").count() == 2
