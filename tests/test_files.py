import datetime as dt

import pytest
from pyspark.sql import functions as F

from forecourt.operators.quality import QualityGateError
from forecourt.plans import nightly
from forecourt.sources import canonical, files, read_listings
from forecourt.sources.listings import read_first_available
from forecourt.streaming import ingest as st

HEADER = ("id,url,region,region_url,price,year,manufacturer,model,condition,cylinders,fuel,odometer,title_status,transmission,"
          "VIN,drive,size,type,paint_color,image_url,description,county,state,lat,long,posting_date")


def line(i, price=9000, make="kia", text="clean"):
    return (f"{i},u,r,ru,{price},{2005 + i % 10},{make},rio,good,4,gas,{10000 + i},clean,manual,V{i},fwd,mid,sedan,red,img,"
            f"{text},,ca,34.0,-118.0,2021-05-{1 + i % 28:02d}T23:30:00-0700")


def write_csv(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join([HEADER, *lines]) + "\n")
    return str(path)


def test_csv_and_parquet(spark, tmp_path):
    path = write_csv(tmp_path / "a.csv", [line(1), line(2).replace("9000", "cheap", 1)])
    raw = read_listings(spark, path)
    rows = {r.id: r for r in raw.collect()}
    assert rows[1].posting_date.astimezone(dt.timezone.utc).replace(tzinfo=None) == dt.datetime(2021, 5, 3, 6, 30) or rows[1].posting_date == dt.datetime(2021, 5, 3, 6, 30)
    assert rows[2].price is None and "cheap" in rows[2]._corrupt_record
    named = canonical(raw)
    assert {"original_id", "vin", "latitude", "longitude"} <= set(named.columns)
    files.write_listings(named.drop("_corrupt_record"), str(tmp_path / "b.parquet"))
    files.append_listings(named.drop("_corrupt_record"), str(tmp_path / "b.parquet"))
    assert read_listings(spark, str(tmp_path / "b.parquet")).count() == 4
    with pytest.raises(ValueError):
        read_listings(spark, str(tmp_path / "c.xlsx"))


def test_fallback_order(spark, tmp_path):
    path = write_csv(tmp_path / "a.csv", [line(1)])
    found = read_first_available(spark, [str(tmp_path / "none.csv"), str(tmp_path / "none.parquet"), path])
    assert found.count() == 1
    with pytest.raises(FileNotFoundError):
        read_first_available(spark, [str(tmp_path / "none.csv"), "no_such_table"])


def test_snapshot_is_written_once(spark, tmp_path):
    place = str(tmp_path / "ref")
    files.write_snapshot_once(spark.range(3), place)
    files.write_snapshot_once(spark.range(9), place)
    assert spark.read.parquet(place).count() == 3


def test_results_as_csv_and_json(spark, tmp_path):
    files.write_results({"makes": spark.createDataFrame([("kia", 2)], "m string, n int")}, str(tmp_path))
    assert spark.read.json(f"{tmp_path}/makes.json").first().n == 2
    assert spark.read.option("header", True).csv(f"{tmp_path}/makes.csv").first().m == "kia"


def test_results_keep_their_order_in_one_file(spark, tmp_path):
    rows = spark.range(1000).repartition(7).orderBy("id")
    files.write_results({"ids": rows}, str(tmp_path))
    files.write_results({"more": rows}, str(tmp_path), rows_per_file=400)
    one, more = (sorted((tmp_path / name).glob("part-*")) for name in ("ids.csv", "more.csv"))
    assert len(one) == 1 and [int(x) for x in one[0].read_text().split()[1:]] == list(range(1000))
    assert sorted(int(x) for f in more for x in f.read_text().split()[1:]) == list(range(1000))


def test_nightly_run(spark, tmp_path):
    lines = [line(i, price=8000 + 37 * (i % 90)) for i in range(1200)]
    lines += [line(1200, price=5, text="entrada de 1000 e 12x 700"), line(1201, price=1), line(1202, price=0)]
    source = write_csv(tmp_path / "in.csv", lines)
    report = nightly.run(spark, source, str(tmp_path / "out"), dt.date(2021, 6, 1))
    kept = spark.read.parquet(f"{tmp_path}/out/listings")
    gone = spark.read.parquet(f"{tmp_path}/out/removed")
    assert report["input_rows"] == 1203 and kept.count() + gone.count() == 1202 and report["rows"] == kept.count()
    assert report["removed_rows"] == gone.count()
    priced = kept.unionByName(gone.drop("reject_reason"), allowMissingColumns=True).where("original_id = 1200").first()
    assert priced.price == 9400.0 and priced.price_original == 5.0
    assert gone.where("original_id = 1201").first().reject_reason == "outside_make_limits"
    assert spark.read.parquet(f"{tmp_path}/out/market_stats").agg(F.sum("priced")).first()[0] == kept.count()


def test_clean_gate_stops_the_run(spark, tmp_path):
    source = write_csv(tmp_path / "in.csv", [line(i, price=8000 + i) for i in range(60)])
    with pytest.raises(QualityGateError, match="row_count"):
        nightly.run(spark, source, str(tmp_path / "out"), dt.date(2021, 6, 1))
    assert not (tmp_path / "out" / "listings").exists()


def test_streamed_ingest_equals_batch(spark, tmp_path):
    write_csv(tmp_path / "in" / "a.csv", [line(i, price=1000 + i) for i in range(20)])
    args = (spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), ["manufacturer"])
    st.ingest(*args).awaitTermination()
    write_csv(tmp_path / "in" / "b.csv", [line(i, price=2000 + i, make="ford" if i % 2 else "kia") for i in range(10)])
    st.ingest(*args).awaitTermination()
    st.ingest(*args).awaitTermination()
    listings = spark.read.parquet(f"{tmp_path}/out/listings")
    assert listings.count() == 30
    got = st.merged_stats(spark.read.parquet(f"{tmp_path}/out/stats"), ["manufacturer"])
    want = st.merged_stats(st.partial_stats(listings, ["manufacturer"]), ["manufacturer"])
    assert got.exceptAll(want).count() == 0 and {r.manufacturer: r.total_listings for r in got.collect()} == {"kia": 25, "ford": 5}
