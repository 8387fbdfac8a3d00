"""Streams against the batch form of the same operator."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from streammart import schemas
from streammart.operators import stats, visitors
from streammart.sources import readers, writers
from streammart.streaming import jobs
from streammart.streaming import visitors as streams

PAGES = "mid string, page_id string, last_page_id string, is_new string, ts timestamp, vc string, ch string, ar string, during_time int"
DATA = [
    ("101", "home", None, 10), ("102", "home", None, 12), ("102", "good_list", "home", 15), ("102", "good_list", "detail", 30),
    ("103", "home", "", 100_000), ("103", "home", "", 100_005), ("104", "home", "", 190_000),
]


def seconds(s):
    return dt.datetime.fromtimestamp(s, dt.timezone.utc).replace(tzinfo=None)


def pages(spark, data):
    return spark.createDataFrame([(m, p, b, "1", seconds(s), "v", "c", "a", 5) for m, p, b, s in data], PAGES)


def stream(spark, tmp_path, *parts):
    """Each part is one micro-batch."""
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i:03d}")
    schema = parts[0].schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")


def collected(query_rows, tmp_path, name="out"):
    out = f"{tmp_path}/{name}"
    query = jobs.append(query_rows, lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}"), f"{tmp_path}/ck-{name}")
    query.awaitTermination(120)
    assert not query.isActive
    return query_rows.sparkSession.read.parquet(out)


@pytest.fixture(autouse=True)
def one_partition(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_bounces(spark, tmp_path):
    end = [("zzz", "x", "x", 1_000_000)]
    rows = stream(spark, tmp_path, pages(spark, DATA), pages(spark, end)).withWatermark("ts", "0 seconds")
    got = collected(streams.bounces(rows), tmp_path).select("mid", (F.col("ts_ms") / 1000).cast("int")).collect()
    want = visitors.bounces(pages(spark, DATA), "10 SECONDS", "ts").select("mid", F.unix_seconds("ts").cast("int")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) == [("101", 10), ("103", 100_005), ("104", 190_000)]


def test_repair_and_unique(spark, tmp_path):
    first, second = pages(spark, DATA[:4]), pages(spark, DATA[4:])
    rows = stream(spark, tmp_path, first, second).withWatermark("ts", "1 day")
    whole = pages(spark, DATA)
    fixed = collected(streams.repair_new_visitors(rows), tmp_path, "fixed")
    keys = ["mid", "ts", "is_new"]
    assert sorted(map(tuple, fixed.select(*keys).collect())) == sorted(map(tuple, visitors.repair_new_visitors(whole, "ts").select(*keys).collect()))
    unique = collected(streams.unique_visits(rows), tmp_path, "unique")
    assert sorted(map(tuple, unique.select("mid", "ts").collect())) == sorted(map(tuple, visitors.unique_visits(whole, "ts").select("mid", "ts").collect()))


def test_joins_and_window_statistics(spark, tmp_path):
    orders = spark.createDataFrame([(1, seconds(10)), (2, seconds(20)), (9, seconds(5000))], "id long, ts timestamp")
    details = spark.createDataFrame([(11, 1, seconds(15)), (12, 1, seconds(16)), (13, 2, seconds(18)), (19, 9, seconds(5000))], "id long, order_id long, ts timestamp")
    a = stream(spark, tmp_path / "a", orders).withWatermark("ts", "0 seconds")
    b = stream(spark, tmp_path / "b", details).withWatermark("ts", "0 seconds")
    joined = collected(jobs.order_wide(a, b), tmp_path, "wide")
    assert sorted(r[0] for r in joined.select("detail_id").collect()) == [11, 13, 19]

    rows = stream(spark, tmp_path / "p", pages(spark, DATA), pages(spark, [("zzz", "x", "x", 900_000)])).withWatermark("ts", "3 seconds")
    got = collected(stats.visitor_stats(stats.visitor_rows(rows, rows.filter("false"), rows.filter("false")), "10 seconds"), tmp_path, "stats")
    empty = pages(spark, DATA).filter("false")
    want = stats.visitor_stats(stats.visitor_rows(pages(spark, DATA), empty, empty), "10 seconds")
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_routing_to_sinks(spark, tmp_path):
    config = spark.createDataFrame([("t", "insert", "kafka", "dwd_t", "id", "id", ""), ("d", "insert", "hbase", "dim_d", "id,name", "id", ""), ("d", "update", "hbase", "dim_d", "id,name", "id", "")], schemas.TABLE_PROCESS)
    lines = [
        {"table": "t", "type": "insert", "ts": 1, "data": {"id": "7", "x": "1"}},
        {"table": "d", "type": "insert", "ts": 1, "data": {"id": "1", "name": "one"}},
        {"table": "d", "type": "update", "ts": 2, "data": {"id": "1", "name": "uno"}},
        {"table": "d", "type": "insert", "ts": 1, "data": {"id": "2", "name": "two"}},
    ]
    source = tmp_path / "lines"
    source.mkdir()
    (source / "0.txt").write_text("\n".join(map(json.dumps, lines)))
    for _ in range(2):  # the second run finds nothing new
        jobs.route_changes(spark, str(source), config, str(tmp_path / "facts"), str(tmp_path / "dims"), str(tmp_path / "ck")).awaitTermination(120)
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/facts").collect()] == ['{"id":"7"}']
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/dims/dim_d").collect())) == [("1", "uno"), ("2", "two")]
    writers.truncate(spark, f"{tmp_path}/dims/dim_d")
    assert spark.read.parquet(f"{tmp_path}/dims/dim_d").count() == 0


def test_day_partitions(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:00:00", 1, 0), ("2024-01-02 00:00:00", 2, 0)], "stt string, v int, internal int")
    writers.partitioned(rows, f"{tmp_path}/t", ["v"], drop=("internal",))
    one = readers.day(spark, f"{tmp_path}/t", 20240102)
    assert [(r["v"], r["dt"]) for r in one.collect()] == [(2, 20240102)] and "internal" not in one.columns
    assert "PartitionFilters: [isnotnull(dt" in one._jdf.queryExecution().toString()
    assert readers.lookup(spark, one, v=2)["stt"] == "2024-01-02 00:00:00"


def test_keyword_and_product_statistics(spark, tmp_path):
    data = [("good_list", "Red Phone", 10), ("good_list", "red tv", 12), ("home", "red", 13), ("good_list", None, 14), ("good_list", "tv", 25)]
    rows = spark.createDataFrame([({"page_id": p, "item": i}, seconds(s)) for p, i, s in data], "page map<string,string>, ts timestamp")
    end = spark.createDataFrame([({"page_id": "good_list", "item": "zzz"}, seconds(900))], rows.schema)
    source = stream(spark, tmp_path / "k", rows, end).withWatermark("ts", "3 seconds")
    got = collected(jobs.keyword_stats(source), tmp_path, "words").select("stt", "keyword", "ct").collect()
    assert sorted(map(tuple, got)) == [("1970-01-01 00:00:10", "phone", 1), ("1970-01-01 00:00:10", "red", 2), ("1970-01-01 00:00:10", "tv", 1), ("1970-01-01 00:00:20", "tv", 1)]

    orders = spark.createDataFrame([(seconds(s), 1, 10, 2, o) for s, o in ((10, 5), (11, 5), (12, 6), (25, 7))], "ts timestamp, sku_id int, amount int, sku_num int, order_id long")
    late = spark.createDataFrame([(seconds(900), 9, 0, 0, 9)], orders.schema)
    source = stream(spark, tmp_path / "o", orders, late).withWatermark("ts", "3 seconds")
    out = collected(stats.product_stats(stats.order_rows(source), "10 seconds"), tmp_path, "products")
    want = stats.product_stats(stats.order_rows(orders), "10 seconds")
    columns = ["stt", "sku_id", "order_ct", "order_sku_num", "paid_order_ct"]
    assert sorted(map(tuple, out.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
