"""The star-schema tables seen as the entities of the engine: page log, orders, dimensions, changes.

``SQL`` holds the same views as common table expressions for the oracle engine.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from streammart.functions.scalars import second_text

GAP = "6 HOURS"


class Entities:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events").select(
            "event_id",
            F.col("user_id").cast("string").alias("mid"),
            "user_id",
            F.col("event_type").alias("page_id"),
            F.col("ts").cast("timestamp").alias("ts"),
            F.floor(F.coalesce("value", F.lit(0.0)) * 10).cast("long").alias("during_time"),
            F.from_json("props", "k int").alias("p"),
        ).select("*", F.col("p.k").alias("k")).drop("p")

    @cached_property
    def pages(self) -> DataFrame:
        """A page has no predecessor if the user was away for longer than GAP."""
        w = W.partitionBy("user_id").orderBy("ts", "event_id")
        away = F.lag("ts").over(w).isNull() | (F.col("ts") - F.lag("ts").over(w) > F.expr(f"INTERVAL {GAP}"))
        return self.events.select(
            "*",
            F.when(away, "").otherwise(F.lag("page_id").over(w)).alias("last_page_id"),
            (F.col("event_id") % 2).cast("string").alias("is_new"),
            F.concat(F.lit("v"), F.col("k") % 4).alias("vc"),
            F.concat(F.lit("c"), F.col("k") % 7).alias("ch"),
            F.concat(F.lit("a"), F.col("user_id") % 8).alias("ar"),
        )

    @cached_property
    def log(self) -> DataFrame:
        """Nested log events: sign-ups are starts; views display two products; purchases are product pages."""
        item = F.col("k").cast("string")
        shown = F.array(
            *(
                F.struct(
                    F.when(F.col("k") % 3 == i, "activity_id").otherwise("sku_id").alias("item_type"),
                    (F.col("k") + i).cast("string").alias("item"),
                    F.lit("query").alias("display_type"),
                    F.lit(i + 1).alias("order"),
                    F.lit(i).alias("pos_id"),
                )
                for i in range(2)
            )
        )
        kind = F.when(F.col("page_id") == "purchase", "good_detail").when(F.col("page_id") == "click", "good_list").otherwise("home")
        return self.events.select(
            "event_id",
            "ts",
            F.struct("mid").alias("common"),
            F.when(F.col("page_id") != "signup", F.struct(kind.alias("page_id"), F.when(F.col("k") % 5 != 0, item).alias("item"))).alias("page"),
            F.when(F.col("page_id") == "signup", F.struct(F.lit("icon").alias("entry"))).alias("start"),
            F.when(F.col("page_id") == "view", shown).alias("displays"),
        )

    @cached_property
    def orders(self) -> DataFrame:
        users = self.table("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").cast("long").alias("province_id"))
        orders = self.table("orders").select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("user_id"),
            F.col("o_orderstatus").alias("order_status"),
            F.col("o_totalprice").cast("decimal(16,2)").alias("total_amount"),
            F.col("o_orderdate").cast("timestamp").alias("ts"),
            F.col("o_orderpriority").alias("priority"),
        )
        return orders.join(users, "user_id", "left")

    @cached_property
    def order_facts(self) -> DataFrame:
        """Orders by themselves, without their province."""
        return self.table("orders").select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("user_id"),
            F.col("o_orderstatus").alias("order_status"),
            F.col("o_totalprice").cast("decimal(16,2)").alias("total_amount"),
            F.col("o_orderdate").cast("timestamp").alias("ts"),
        )

    @cached_property
    def details(self) -> DataFrame:
        money = lambda c: F.col(c).cast("decimal(16,2)")
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("sku_id"),
            F.col("l_suppkey").alias("supplier_id"),
            F.col("l_linenumber").cast("long").alias("line"),
            F.col("l_quantity").cast("long").alias("sku_num"),
            money("l_extendedprice").alias("amount"),
            money("l_discount").alias("discount"),
            money("l_tax").alias("tax"),
            F.col("l_returnflag").alias("flag"),
            F.col("l_linestatus").alias("status"),
            F.col("l_shipdate").cast("timestamp").alias("ts"),
        )

    @cached_property
    def skus(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("id"),
            F.col("p_name").alias("sku_name"),
            F.col("p_brand").alias("tm_id"),
            F.col("p_type").alias("category3_id"),
            F.col("p_size").cast("long").alias("spu_id"),
            F.col("p_retailprice").cast("decimal(16,2)").alias("price"),
        )

    @cached_property
    def spus(self) -> DataFrame:
        return self.skus.filter("spu_id < 25").groupBy(F.col("spu_id").alias("id")).agg(F.min("sku_name").alias("spu_name"))

    @cached_property
    def trademarks(self) -> DataFrame:
        return self.skus.select(F.col("tm_id").alias("id")).distinct().withColumn("tm_name", F.upper("id"))

    @cached_property
    def categories(self) -> DataFrame:
        return self.skus.select(F.col("category3_id").alias("id")).distinct().withColumn("name", F.lower("id"))

    @cached_property
    def users(self) -> DataFrame:
        return self.table("customer").filter("c_custkey % 10 != 0").select(
            F.col("c_custkey").alias("id"),
            F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("M").alias("gender"),
            F.date_add(F.to_date(F.lit("1970-01-01")), (F.col("c_custkey") % 12000).cast("int")).alias("birthday"),
        )

    @cached_property
    def provinces(self) -> DataFrame:
        region = self.table("region")
        nation = self.table("nation")
        return nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(
            F.col("n_nationkey").cast("long").alias("id"),
            F.col("n_name").alias("name"),
            F.col("r_name").alias("area_code"),
            F.concat(F.lit("N"), "n_nationkey").alias("iso_code"),
            F.concat(F.lit("X-"), "n_nationkey").alias("iso_3166_2"),
        )

    @cached_property
    def changes(self) -> DataFrame:
        """Change events of orders, as JSON text in ``value``."""
        o = self.table("orders")
        n = F.col("o_orderkey")
        row = F.create_map(
            F.lit("id"), n.cast("string"), F.lit("status"), F.col("o_orderstatus"), F.lit("user_id"), F.col("o_custkey").cast("string"),
            F.lit(" status"), F.lit("x"),
        )
        data = F.when(n % 11 == 0, F.lit(None)).when(n % 13 == 0, F.create_map().cast("map<string,string>")).otherwise(row)
        kind = F.when(n % 3 == 0, "insert").when(n % 3 == 1, "update").otherwise(F.when(n % 2 == 0, "delete").otherwise("bootstrap-insert"))
        table = F.when(n % 10 == 0, "").when(n % 4 == 0, "order_info").when(n % 4 == 1, "base_trademark").otherwise("user_info")
        event = F.struct(F.lit("mart").alias("database"), table.alias("table"), kind.alias("type"), n.alias("xid"), data.alias("data"))
        return o.select(F.when(n % 97 == 0, F.lit("{broken")).otherwise(F.to_json(event)).alias("value"))

    @cached_property
    def config(self) -> DataFrame:
        rows = [
            ("order_info", "insert", "kafka", "dwd_order_info", "id,status", "id", 1),
            ("order_info", "insert", "kafka", "dwd_order_info", "id,user_id", "id", 2),
            ("order_info", "update", "kafka", "dwd_order_update", "", "id", 1),
            ("base_trademark", "insert", "hbase", "dim_base_trademark", "id, status", "id", 1),
            ("user_info", "update", "hbase", "dim_user_info", "id,user_id,status", "id", 3),
        ]
        names = "source_table string, operate_type string, sink_type string, sink_table string, sink_columns string, sink_pk string, version int"
        return self.spark.createDataFrame(rows, names)


SQL = """
ev AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS mid, user_id, event_type AS page_id, ts,
    CAST(floor(coalesce(value, 0) * 10) AS BIGINT) AS during_time, CAST(json_extract(props, '$.k') AS INTEGER) AS k
  FROM events
), pages_ AS (
  SELECT *, CASE WHEN p IS NULL OR ts - p > INTERVAL 6 HOURS THEN '' ELSE q END AS last_page_id,
    CAST(event_id % 2 AS VARCHAR) AS is_new, 'v' || (k % 4) AS vc, 'c' || (k % 7) AS ch, 'a' || (user_id % 8) AS ar
  FROM (SELECT *, lag(ts) OVER w AS p, lag(page_id) OVER w AS q FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
), o AS (
  SELECT o_orderkey AS id, o_custkey AS user_id, o_orderstatus AS order_status, CAST(o_totalprice AS DECIMAL(16,2)) AS total_amount,
    o_orderdate AS ts, CAST(c_nationkey AS BIGINT) AS province_id, o_orderpriority AS priority
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
), d AS (
  SELECT l_orderkey AS order_id, l_partkey AS sku_id, l_suppkey AS supplier_id, CAST(l_linenumber AS BIGINT) AS line,
    CAST(trunc(l_quantity) AS BIGINT) AS sku_num, CAST(l_extendedprice AS DECIMAL(16,2)) AS amount,
    CAST(l_discount AS DECIMAL(16,2)) AS discount, CAST(l_tax AS DECIMAL(16,2)) AS tax, l_returnflag AS flag, l_linestatus AS status,
    l_shipdate AS ts
  FROM lineitem
), sku AS (
  SELECT p_partkey AS id, p_name AS sku_name, p_brand AS tm_id, p_type AS category3_id, CAST(p_size AS BIGINT) AS spu_id,
    CAST(p_retailprice AS DECIMAL(16,2)) AS price
  FROM part
), spu AS (SELECT spu_id AS id, min(sku_name) AS spu_name FROM sku WHERE spu_id < 25 GROUP BY spu_id),
prov AS (
  SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, r_name AS area_code, 'N' || n_nationkey AS iso_code, 'X-' || n_nationkey AS iso_3166_2
  FROM nation JOIN region ON n_regionkey = r_regionkey
), usr AS (
  SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
    DATE '1970-01-01' + CAST(c_custkey % 12000 AS INTEGER) AS birthday
  FROM customer WHERE c_custkey % 10 != 0
), ch AS (
  SELECT o_orderkey AS n, CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS st, CAST(o_custkey AS VARCHAR) AS uid,
    CASE WHEN o_orderkey % 10 = 0 THEN '' WHEN o_orderkey % 4 = 0 THEN 'order_info' WHEN o_orderkey % 4 = 1 THEN 'base_trademark' ELSE 'user_info' END AS tab,
    CASE WHEN o_orderkey % 3 = 0 THEN 'insert' WHEN o_orderkey % 3 = 1 THEN 'update' WHEN o_orderkey % 2 = 0 THEN 'delete' ELSE 'bootstrap-insert' END AS kind,
    o_orderkey % 11 != 0 AND o_orderkey % 13 != 0 AS filled, o_orderkey % 97 = 0 AS broken
  FROM orders
), clean AS (SELECT * REPLACE (CASE WHEN kind = 'bootstrap-insert' THEN 'insert' ELSE kind END AS kind) FROM ch WHERE filled AND NOT broken AND tab != '')
"""
