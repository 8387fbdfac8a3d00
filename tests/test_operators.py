"""Operators on literal fixtures."""

import datetime as dt
import random

from pyspark.sql import functions as F

from streammart import schemas, synth
from streammart.functions import scalars as S
from streammart.functions import tokenize
from streammart.operators import grouping, ingest, promotions, routing, serving, stats, tables, visitors, wide


def at(text):
    return dt.datetime.fromisoformat(text)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_bounce_golden_rows(spark):
    data = [("101", "home", None, 10), ("102", "home", None, 12), ("102", "good_list", "home", 15), ("102", "good_list", "detail", 30)]
    pages = spark.createDataFrame(data, "mid string, page_id string, last_page_id string, s int").withColumn("ts", F.timestamp_seconds("s"))
    assert rows(visitors.bounces(pages, "10 SECONDS", "ts").select("mid", "s"), "mid") == [("101", 10)]


def test_bounce_boundary_and_contiguity(spark):
    data = [("a", "home", "", 0), ("a", "x", "home", 10), ("b", "home", "", 0), ("b", "x", "home", 9), ("c", "home", "", 0), ("c", None, "", 5)]
    pages = spark.createDataFrame(data, "mid string, page_id string, last_page_id string, s int").withColumn("ts", F.timestamp_seconds("s"))
    assert rows(visitors.bounces(pages, "10 SECONDS", "ts").select("mid", "s"), "mid", "s") == [("a", 0), ("c", 5)]


def test_new_visitor_repair(spark):
    data = [(1, "a", "1", "2024-01-01"), (2, "a", "1", "2024-01-01"), (3, "a", "1", "2024-01-02"), (4, "a", "1", "2024-01-03"), (5, "b", "0", "2024-01-01"), (6, "b", "1", "2024-01-02")]
    pages = spark.createDataFrame([(n, m, f, at(d)) for n, m, f, d in data], "n int, mid string, is_new string, ts timestamp")
    fixed = visitors.repair_new_visitors(pages, "n").select("n", "is_new")
    assert rows(fixed, "n") == [(1, "1"), (2, "1"), (3, "0"), (4, "0"), (5, "0"), (6, "1")]


def test_new_visitor_repair_against_a_model(spark):
    rng = random.Random(3)
    data = [(i, rng.choice("abc"), rng.choice("01"), at(f"2024-01-0{rng.randint(1, 4)}")) for i in range(60)]
    want, first = [], {}
    for i, mid, flag, ts in data:
        day = ts.date()
        if flag == "1":
            flag = "1" if first.setdefault(mid, day) == day else "0"
        want.append((i, flag))
    pages = spark.createDataFrame(data, "n int, mid string, is_new string, ts timestamp")
    assert rows(visitors.repair_new_visitors(pages, "n").select("n", "is_new"), "n") == want


def test_unique_visit(spark):
    data = [(1, "", "2024-01-01"), (2, None, "2024-01-01"), (3, "home", "2024-01-02"), (4, "", "2024-01-02")]
    pages = spark.createDataFrame([(n, "a", p, at(d)) for n, p, d in data], "n int, mid string, last_page_id string, ts timestamp")
    assert rows(visitors.unique_visits(pages, "ts", "n").select("n"), "n") == [(1,), (4,)]


def test_parse_and_quarantine(spark):
    lines = spark.createDataFrame([('{"table": "t", "type": "insert", "data": {"id": "1234"}}',), ("{broken",)], "value string")
    parsed = ingest.parse_json(lines, schemas.CHANGE_EVENT)
    assert ingest.good(parsed).count() == 1
    assert ingest.quarantined(parsed).select(ingest.BAD).first()[0] == "{broken"
    assert ingest.etl_filter(ingest.good(parsed)).count() == 1


def test_log_split(spark):
    text = [
        '{"ts": 1, "common": {"mid": "m"}, "start": {"entry": "icon"}}',
        '{"ts": 2, "common": {"mid": "m"}, "page": {"page_id": "home"}, "displays": [{"item": "7", "item_type": "sku_id"}, {"item": "8", "item_type": "activity_id"}]}',
    ]
    log = ingest.log_events(spark.createDataFrame([(x,) for x in text], "value string"))
    assert ingest.split_start(log).count() == 1 and ingest.split_page(log).count() == 1
    assert rows(ingest.split_display(log).select("ts", "mid", "page_id", "item"), "item") == [(2, "m", "home", "7"), (2, "m", "home", "8")]


def test_routing(spark):
    config = spark.createDataFrame([("t", "insert", "kafka", "f", "id,b", "id", ""), ("d", "insert", "hbase", "dim_d", "", "id", "")], schemas.TABLE_PROCESS)
    data = [("t", "bootstrap-insert", {"id": "1", "a": "x", " b": "y"}), ("d", "insert", {"id": "2", "a": "x"}), ("t", "delete", {"id": "3"})]
    routed = routing.route(spark.createDataFrame(data, "table string, type string, data map<string,string>"), config)
    assert [r["data"] for r in routing.fact_rows(routed).collect()] == [{"id": "1"}]
    assert [r["data"] for r in routing.dimension_rows(routed).collect()] == [{"id": "2", "a": "x"}]


def test_interval_join_bounds(spark):
    orders = spark.createDataFrame([(1, at("2024-01-01T00:00:10"))], "id int, o timestamp")
    details = spark.createDataFrame([(1, s, at(f"2024-01-01T00:00:{s:02d}")) for s in (4, 5, 15, 16)], "order_id int, s int, d timestamp")
    joined = wide.interval_join(orders, details, orders["id"] == details["order_id"], orders["o"], details["d"], "-5 SECONDS", "5 SECONDS")
    assert rows(joined.select("s"), "s") == [(5,), (15,)]


def test_lookup_misses_stay(spark):
    facts = spark.createDataFrame([(1, 10), (2, None), (3, 99)], "n int, k int")
    dim = spark.createDataFrame([(10, "ten")], "id int, name string")
    assert rows(wide.enrich(facts, dim, "k", "id", {"name": "label"}), "n") == [(1, 10, "ten"), (2, None, None), (3, 99, None)]


def test_merge_engines(spark):
    data = [("2020-06-01", 101, "sku_001", 1000, 1), ("2020-06-01", 102, "sku_002", 2000, 1), ("2020-06-01", 102, "sku_004", 2500, 2), ("2020-06-01", 102, "sku_002", 2000, 3), ("2020-06-01", 102, "sku_002", 12000, 4), ("2020-06-02", 102, "sku_002", 600, 5)]
    t = spark.createDataFrame([(*x, i) for i, x in enumerate(data)], "day string, id int, sku string, amount int, version int, n int")
    keys = ["day", "id", "sku"]
    assert rows(tables.replacing(t, keys, "version", F.desc("n")).select("id", "sku", "day", "amount"), *keys) == [(101, "sku_001", "2020-06-01", 1000), (102, "sku_002", "2020-06-01", 12000), (102, "sku_004", "2020-06-01", 2500), (102, "sku_002", "2020-06-02", 600)]
    assert [r[3] for r in rows(tables.summing(t, keys, ["amount"]), *keys)] == [1000, 16000, 2500, 600]


def test_upsert(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    changes = spark.createDataFrame([(2, "c", "update", 1), (2, "d", "update", 2), (3, "e", "insert", 1), (1, "a", "delete", 1)], "id int, v string, type string, t int")
    assert rows(tables.upsert(table, changes, "id", F.desc("t")), "id") == [(2, "d"), (3, "e")]
    assert len(rows(tables.upsert(table, changes, "id", F.desc("t"), keep_deletes=True), "id")) == 3


def test_grouping_sets(spark):
    t = spark.createDataFrame([(i, f"s{i % 3}", 1) for i in range(4)], "id int, sku string, v int")
    total = F.sum("v").alias("v")
    assert grouping.rollup(t, ["id", "sku"], total).count() == 9
    assert grouping.cube(t, ["id", "sku"], total).count() == 12
    assert grouping.totals(t, ["id", "sku"], total).filter("level = 3").first()["v"] == 4


def test_allocation_takes_up_the_rest(spark):
    t = spark.createDataFrame([(1, n, v) for n, v in ((1, 10.0), (2, 20.0), (3, 40.0))], "k int, n int, v double").withColumn("v", F.col("v").cast("decimal(16,2)"))
    out = promotions.allocate(t, "k", F.lit(50).cast("decimal(16,2)"), "v", "part", "n")
    assert [float(r[0]) for r in rows(out.select("part", "n"), "n")] == [7.14, 14.29, 28.57]


def test_rates(spark):
    t = spark.createDataFrame([(1, 3, 7, 10000), (0, 0, 0, 0)], "uj_ct long, sv_ct long, pv_ct long, dur_sum long")
    assert rows(serving.rates(t).select("uj_rate", "dur_per_sv", "pv_per_sv"), "uj_rate") == [(0.0, 0.0, 0.0), (33.33, 3.3, 2.33)]


def test_single_row_windows_count_orders(spark):
    t = spark.createDataFrame([(at("2024-01-01"), 1, 5, 2, 9)], "ts timestamp, sku_id int, amount int, sku_num int, order_id long")
    out = stats.product_stats(stats.order_rows(t), "10 seconds").first()
    assert (out["order_ct"], out["order_sku_num"], out["stt"], out["edt"]) == (1, 2, "2024-01-01 00:00:00", "2024-01-01 00:00:10")


def test_distinct_orders_per_set(spark):
    data = [(1, 7, 1, None), (1, 7, 1, 1), (1, 8, 2, 1), (1, 8, None, None), (2, 5, None, 3)]
    t = spark.createDataFrame([(at("2024-01-01"), *x) for x in data], "ts timestamp, sku_id int, amount int, a long, b long")
    rows_ = stats.product_rows(t, F.col("sku_id"), order_amount=F.col("amount"), order_id=F.col("a"), paid_order_id=F.col("b"))
    out = stats.product_stats(rows_, "1 day").select("sku_id", F.col("order_amount").cast("int"), "order_ct", "paid_order_ct", "refund_order_ct")
    assert rows(out, "sku_id") == [(1, 30, 2, 1, 0), (2, 5, 0, 1, 0)]


def test_tokens(spark):
    t = spark.createDataFrame([("Red-Phone 5G",), ("今天天气",), (None,)], "t string")
    assert [r[0] for r in t.select(tokenize.words(F.col("t"))).collect()] == [["red", "phone", "5g"], ["今天", "天天", "天气"], None]
    tokenize.register(spark)
    t.createOrReplaceTempView("texts")
    assert spark.sql("select k.word from texts, lateral ik_analyze(t) k where t = 'Red-Phone 5G'").count() == 3


def test_scalars(spark):
    t = spark.createDataFrame([("2024-01-02 03:04:05", 12345.0)], "s string, x double")
    out = t.select(S.millis("s"), S.significant("x"), S.age(F.lit("1990-01-01").cast("date"), F.lit("2020-01-01").cast("date")), S.brand(F.lit("Xiaomi 10")), S.empty(F.lit(None))).first()
    assert tuple(out) == (1704164645000, 12000.0, 30, "Xiaomi", True)
    assert schemas.table_schema("id,name").fieldNames() == ["id", "name"]


def test_generators(spark):
    log = synth.log_events(spark, 40, 1_700_000_000_000)
    assert log.filter("start is not null").count() == 40
    assert log.filter("page is not null and step = 0 and page.last_page_id is not null").count() == 0
    parsed = ingest.log_events(log.select(F.to_json(F.struct("ts", "common", "page", "start", "displays", "actions", "err")).alias("value")))
    assert parsed.count() == log.count()
    made = synth.business(spark, 30, "2024-01-01 00:00:00")
    assert made["order_status_log"].filter("step = 0 and order_status != '1001'").count() == 0
    assert made["payment_info"].join(made["order_info"], F.col("order_id") == F.col("id"), "left_anti").count() == 0
    assert synth.drifted_users(made["user_info"], 2).count() == 30
    assert (synth.rate("30"), synth.ratios("1:2", 2), synth.flag("True"), synth.names("a, b")) == (30, [1, 2], True, ["a", "b"])
