import pytest
from pyspark.sql import functions as F

from loadcurve.operators.reshape import union_sources
from loadcurve.sources import heads, readers

HEADER = "time,apparent_temperature (C),precipitation (mm),is_day ()"


def _write(folder, sizes, preamble="latitude,longitude\n-33.0,151.0\n\n"):
    folder.mkdir(exist_ok=True)
    for i, n in enumerate(sizes):
        body = "".join(f"2020-01-{1 + k // 24 % 28:02d}T{k % 24:02d}:00,{k}.5,0.{i},1\n" for k in range(n))
        (folder / f"part {i}.csv").write_text(preamble + HEADER + "\n" + body)
    return str(folder)


def test_bytes_read_do_not_grow_with_the_files(spark, tmp_path):
    read = []
    for name, sizes in (("small", [200, 300, 400]), ("large", [20_000, 30_000, 40_000])):
        files = heads.files_of(spark, _write(tmp_path / name, sizes))
        rows = heads.first_lines(spark, files, 2048)
        read.append({r["file"].rsplit("/", 1)[1]: r["b"] for r in rows.groupBy("file").agg(F.max("bytes_read").alias("b")).collect()})
    assert read[0] == read[1] == {f"part%20{i}.csv": 2048 for i in range(3)}


def test_lines_of_the_first_block(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("\ufeffone\r\n \r\ntwo\rthree\nfour is cut".encode())
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "_hidden.csv").write_text("no")
    files = heads.files_of(spark, str(tmp_path))
    assert len(files) == 2
    assert [r["value"] for r in heads.first_lines(spark, files, 25).orderBy("line").collect()] == ["one", "two", "three"]
    assert [r["value"] for r in heads.first_lines(spark, files).orderBy("line").collect()] == ["one", "two", "three", "four is cut"]
    assert heads.first_lines(spark, ["nosuchstore://x/y"]) is None
    assert heads.files_of(spark, f"{tmp_path}/none*") == []


def _weather(spark, folder):
    frames = list(readers.scan_weather_skip_preamble(spark, folder))
    return sorted(map(tuple, union_sources(frames).collect()))


def test_weather_is_the_same_with_numbered_lines(spark, tmp_path, monkeypatch):
    folder = _write(tmp_path / "w", [30, 500])
    plans = []
    numbered = readers._lines
    monkeypatch.setattr(readers, "_lines", lambda s, p: plans.append(1) or numbered(s, p))
    by_text = _weather(spark, folder)
    monkeypatch.setattr(readers, "first_lines", lambda *a: None)
    assert _weather(spark, folder) == by_text and len(by_text) == 530


def test_lines_that_could_be_data_are_told_by_number(spark, tmp_path):
    """A line before the header that also stands in the data, which is kept there."""
    row = "2020-01-05T00:00,7.5,0.0,1"
    folder = tmp_path / "w"
    folder.mkdir()
    (folder / "w.csv").write_text(f"{row}\n{HEADER}\n{row}\n2020-01-06T00:00,8.5,0.0,1\n")
    files = heads.files_of(spark, str(folder))
    assert readers._weather_heads(spark, files, "time") is None
    assert [r[0] for r in _weather(spark, str(folder))] == ["2020-01-05T00:00", "2020-01-06T00:00"]


@pytest.mark.parametrize("store", [True, False])
def test_files_by_header(spark, tmp_path, monkeypatch, store):
    if not store:
        monkeypatch.setattr(readers, "first_lines", lambda *a: None)
    (tmp_path / "a b.csv").write_text("x,y\n1,2\n")
    (tmp_path / "c.csv").write_text("y,x\n3,4\n")
    (tmp_path / "d.csv").write_text("x,y\n5,6\n")
    (tmp_path / "none.csv").write_text("")
    (tmp_path / "long.csv").write_text(",".join(f"column_{i}" for i in range(9000)) + "\n")
    frames = list(readers.scan_multi_file(spark, f"{tmp_path}/*.csv"))
    assert sorted(len(f.columns) for f in frames) == [3, 3, 9001]
    rows = {tuple(sorted(r.asDict().items()))[1:] for f in frames if len(f.columns) == 3 for r in f.collect()}
    assert rows == {(("x", "1"), ("y", "2")), (("x", "4"), ("y", "3")), (("x", "5"), ("y", "6"))}
