"""Loading: headers by name, time formats, source order, numeric index, NaN."""

import math

import pytest
from pyspark.sql import functions as F

from sensorlake.operators import browse as br
from sensorlake.operators import corr as cr
from sensorlake.operators import resample as rs
from sensorlake.operators import stats as st
from sensorlake.operators import timewindow as tw
from sensorlake.sources import catalog as cg
from sensorlake.sources import files as fl


def write(folder, name, *lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")


def test_headers_go_by_name(spark, tmp_path):
    """The same columns in another order, a column one file lacks, and file order as row order."""
    src = tmp_path / "in"
    write(src, "a.csv", "timestamp,A,B", "2024-01-01 00:00:00,1,2", "2024-01-01 00:00:00,3,4")
    write(src, "b.csv", "timestamp,B,A", "2024-01-01 00:00:00,20,10")
    write(src, "c.csv", "A,timestamp,C", "7,2024-01-02 00:00:00,n/a")
    rows = fl.read_delimited(spark, str(src) + "/*.csv").orderBy("rid").collect()
    assert [(r["rid"], r["A"], r["B"], r["C"]) for r in rows] == [(0, 1.0, 2.0, None), (1, 3.0, 4.0, None), (2, 10.0, 20.0, None),
                                                               (3, 7.0, None, None)]
    data, row = cg.ingest_file(spark, str(src / "a.csv"), str(tmp_path / "out"))
    assert dict(data.dtypes)["ts"] == "timestamp_ntz" and data.select("rid").distinct().count() == 2
    assert row.first()["row_count"] == 2


def test_first_lines(spark, tmp_path):
    """Odd names, a byte order mark, quotes, an empty file, more files than one job reads."""
    src = tmp_path / "in put"
    write(src, "a b%.csv", '\ufeff"time, local",A  x', '"2024-01-01 00:00:00",1')
    write(src, "quote.csv", 'timestamp,"A', "1,2")
    (src / "empty.csv").write_text("")
    for k in range(fl.HEADER_FILES):
        write(src, f"n{k:03d}.csv", f"timestamp,C{k % 2}", *["2024-01-01 00:00:00,1"] * 5)
    files = spark.read.text(str(src)).inputFiles()
    lines = {p.rsplit("/", 1)[1]: line.lstrip("\ufeff") for p, line in fl.first_lines(spark, files).items()}
    assert lines["a%20b%25.csv"] == '"time, local",A  x' and lines["quote.csv"] == 'timestamp,"A' and "empty.csv" not in lines
    assert len(lines) == 2 + fl.HEADER_FILES and lines["n001.csv"] == "timestamp,C1"
    kinds = fl.headers(spark, [str(src)], ",")
    assert len(kinds["timestamp", "C0"]) == len(kinds["timestamp", "C1"]) == fl.HEADER_FILES // 2 and ("time, local", "A  x") in kinds


def test_rows_numbered_alike_for_any_splits(spark, tmp_path):
    src = tmp_path / "in"
    write(src, "a.csv", "timestamp,A", *[f"2024-01-01 00:00:00,{k}" for k in range(3000)])
    write(src, "b.csv", "A,timestamp", *[f"{k},2024-01-01 00:00:00" for k in range(3000, 5000)])
    setting = "spark.sql.files.maxPartitionBytes"
    for size in ("128m", "8k"):
        spark.conf.set(setting, size)
        try:
            rows = fl.read_delimited(spark, str(src)).where("rid <> A")
        finally:
            spark.conf.unset(setting)
        assert rows.count() == 0


@pytest.mark.parametrize("texts,hours", [
    (["03/01/2020 00:05:00", "13/01/2020 06:00:00"], [0, 6]), (["1/2/2020 7:05", "1/30/2020 8:00"], [7, 8]),
    (["Jan 3 2020 05:00", "Feb 4 2020 06:00"], [5, 6]), (["20200103 0500", "20200104 0600"], [5, 6]),
    (["2020-01-03T05:00:00", "2020-01-03 06:00:00"], [5, 6])])
def test_time_formats(spark, texts, hours):
    df = spark.createDataFrame([(t, "1") for t in texts], "time string, a string")
    frame, kind = fl.load_readings(df)
    assert kind == "datetime" and [r["ts"].hour for r in frame.orderBy("ts").collect()] == hours


def test_no_silent_loss(spark):
    with pytest.raises(ValueError):
        fl.load_readings(spark.createDataFrame([("soon", "1"), ("later", "2")], "time string, a string"))
    frame, kind = fl.load_readings(spark.createDataFrame([("1.5", "1"), ("bad", "2"), ("3", "x")], "time string, a string"))
    assert kind == "numeric" and sorted(map(str, (r["ts"] for r in frame.collect()))) == ["1.5", "3.0", "None"]
    frame, _ = fl.load_readings(spark.createDataFrame([("2020-01-01", math.nan)], "time string, a double"))
    assert frame.first()["a"] is None


def test_nan_in_parquet_is_missing(spark, tmp_path):
    rows = [(float(k), math.nan if k % 5 == 0 else float((k * 7) % 11)) for k in range(50)]
    spark.createDataFrame(rows, "a double, b double").write.parquet(str(tmp_path / "p"))
    df = fl.scan_parquet(spark, str(tmp_path / "p"))
    assert df.where("isnan(b)").count() == 0
    raw = spark.read.parquet(str(tmp_path / "p"))
    want = df.where("b IS NOT NULL").agg(F.corr("a", "b")).first()[0]
    for matrix in (cr.corr_matrix(raw, ["a", "b"]), cr.corr_matrix_wide(raw, ["a", "b"])):
        r = matrix.where("x = 'a' AND y = 'b'").first()
        assert r["r"] == pytest.approx(want) and r["n"] == 40
    assert cr.pair_fit(raw, "a", "b").first()["r"] == pytest.approx(want)


def test_numeric_index(spark):
    df = spark.createDataFrame([("c", float(10 * k), k, float(3 * k)) for k in range(20)] + [("c", 5.0, 99, None)],
                               "channel string, ts double, rid long, value double")
    assert tw.apply_window(df, "7d").count() == 21 and rs.resample(df, "daily", "mean").count() == 21
    assert st.trend_slope(df).first()["slope"] == pytest.approx(3.0)
    assert st.channel_stats(df).first()["slope"] == pytest.approx(3.0)
    assert tw.window_share(df, "24h").first()["share_pct"] == 100.0


def test_custom_ends_in_words(spark):
    df = spark.createDataFrame([(f"2024-01-{d:02d} 12:00:00",) for d in range(1, 31)], "t string").select(
        F.col("t").cast("timestamp_ntz").alias("ts"))
    assert tw.apply_window(df, "custom", *tw.custom_range("Jan 10 2024", "Jan 12, 2024")).count() == 3
    assert tw.apply_window(df, "custom", "10.01.2024", "12.01.2024").count() == 2


def test_search_folds_any_letter(spark):
    df = spark.createDataFrame([("über", 1), ("other", 2)], "a string, b int")
    assert br.row_search(df, "ÜBER").count() == 1 and br.row_search(df, "2").count() == 1


def test_catalog_ties_and_names(spark):
    cat = spark.createDataFrame([("t", "a.csv", "/p/1", "2024-01-01"), ("t", "b.csv", "/p/2", "2024-01-01")],
                                "table_name string, source_filename string, parquet_path string, ingested_at string")
    assert cg.catalog_latest(cat).first()["parquet_path"] == "/p/2"
    assert cg.dataset_name_of(spark, "2024 Röhre--1", "Blatt 1") == "_2024_r_hre_1_blatt_1"
