"""Ingest, routing, change data and visitor-state queries."""

from pyspark.sql import functions as F

from streammart import schemas
from streammart.functions import scalars as S
from streammart.operators import ingest, routing, tables, visitors
from streammart.plans.registry import register


def _changes(e):
    return ingest.change_events(e.changes)


@register("json_extract_fields", "SELECT CAST(count(*) FILTER (WHERE NOT broken) AS BIGINT) AS good, CAST(count(*) FILTER (WHERE broken) AS BIGINT) AS bad, CAST(sum(CASE WHEN NOT broken THEN n END) AS BIGINT) AS xid_sum FROM ch")
def _(e):
    parsed = ingest.parse_json(e.changes, schemas.CHANGE_EVENT)
    bad = F.col("_corrupt").isNotNull()
    return parsed.agg(F.count_if(~bad).alias("good"), F.count_if(bad).alias("bad"), F.sum(F.when(~bad, F.col("xid"))).alias("xid_sum"))


@register("etl_filter", "SELECT n AS xid, tab AS \"table\", kind AS \"type\" FROM ch WHERE filled AND NOT broken AND tab != ''")
def _(e):
    return ingest.etl_filter(_changes(e)).select("xid", "table", "type")


@register("log_split_start", "SELECT event_id, mid, 'icon' AS entry FROM ev WHERE page_id = 'signup'")
def _(e):
    return ingest.split_start(e.log).select("event_id", "common.mid", "start.entry")


_PAGE = "CASE page_id WHEN 'purchase' THEN 'good_detail' WHEN 'click' THEN 'good_list' ELSE 'home' END"


@register("log_split_page", f"SELECT event_id, {_PAGE} AS page_id, CASE WHEN k % 5 != 0 THEN CAST(k AS VARCHAR) END AS item FROM ev WHERE page_id != 'signup'")
def _(e):
    return ingest.split_page(e.log).select("event_id", "page.page_id", "page.item")


@register(
    "log_split_display",
    """SELECT mid, 'home' AS page_id, CASE WHEN k % 3 = i THEN 'activity_id' ELSE 'sku_id' END AS item_type, CAST(k + i AS VARCHAR) AS item,
    CAST(i AS BIGINT) AS pos_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at
    FROM ev, (SELECT unnest([0, 1]) AS i) WHERE page_id = 'view'""",
)
def _(e):
    shown = ingest.split_display(e.log)
    return shown.select("mid", "page_id", "item_type", "item", F.col("pos_id").cast("long").alias("pos_id"), S.second_text("ts").alias("at"))


def _routed(e):
    rules = routing.config_latest(e.config, F.desc("version"))
    return routing.route(ingest.etl_filter(_changes(e)), rules)


@register(
    "route_dim",
    """SELECT n AS xid, sink_table, kept FROM (
      SELECT n, 'dim_user_info' AS sink_table, 'id=' || id || ',status=' || st || ',user_id=' || uid AS kept FROM clean WHERE tab = 'user_info' AND kind = 'update'
      UNION ALL SELECT n, 'dim_base_trademark', ' status=x,id=' || id FROM clean WHERE tab = 'base_trademark' AND kind = 'insert')""",
)
def _(e):
    return _kept(routing.dimension_rows(_routed(e)))


def _kept(rows):
    entries = F.array_sort(F.transform(F.map_entries("data"), lambda x: F.concat(x["key"], F.lit("="), x["value"])))
    return rows.select("xid", "sink_table", F.array_join(entries, ",").alias("kept"))


@register(
    "route_fact",
    """SELECT n AS xid, sink_table, kept FROM (
      SELECT n, 'dwd_order_info' AS sink_table, 'id=' || id || ',user_id=' || uid AS kept FROM clean WHERE tab = 'order_info' AND kind = 'insert'
      UNION ALL SELECT n, 'dwd_order_update', ' status=x,id=' || id || ',status=' || st || ',user_id=' || uid FROM clean WHERE tab = 'order_info' AND kind = 'update')""",
)
def _(e):
    return _kept(routing.fact_rows(_routed(e)))


@register("dynamic_projection", "SELECT n AS xid, CASE WHEN n % 2 = 0 THEN 'id=' || id ELSE ' status=x,id=' || id || ',status=' || st || ',user_id=' || uid END AS kept FROM clean")
def _(e):
    columns = F.when(F.col("xid") % 2 == 0, "id,absent").otherwise("")
    rows = ingest.etl_filter(_changes(e)).withColumn("data", routing.project(F.col("data"), columns))
    return _kept(rows.withColumn("sink_table", F.lit(""))).drop("sink_table")


@register(
    "config_latest",
    """SELECT * FROM (VALUES ('order_info', 'insert', 'id,user_id', 2), ('order_info', 'update', '', 1),
      ('base_trademark', 'insert', 'id, status', 1), ('user_info', 'update', 'id,user_id,status', 3)) t(source_table, operate_type, sink_columns, version)""",
)
def _(e):
    return routing.config_latest(e.config, F.desc("version")).select("source_table", "operate_type", "sink_columns", "version")


@register("parse_create_ts", "SELECT id, strftime(ts, '%Y-%m-%d') AS create_date, strftime(ts, '%H') AS create_hour, CAST(epoch_ms(ts) AS BIGINT) AS create_ts FROM o")
def _(e):
    rows = e.order_facts.select("id", S.second_text("ts").alias("create_time"))
    return ingest.with_create_ts(rows).drop("create_time")


_OP = "CASE WHEN n % 3 = 0 THEN 'c' WHEN n % 3 = 1 THEN 'u' ELSE 'd' END"


def _records(e):
    n = F.col("o_orderkey")
    image = F.create_map(F.lit("id"), n.cast("string"), F.lit("status"), F.col("o_orderstatus"))
    op = F.when(n % 3 == 0, "c").when(n % 3 == 1, "u").otherwise("d")
    record = F.struct(
        op.alias("op"),
        F.struct(F.lit("mart").alias("db"), F.lit("order_info").alias("table")).alias("source"),
        F.when(op != "c", image).alias("before"),
        F.when(op != "d", image).alias("after"),
        (F.unix_millis(F.col("o_orderdate").cast("timestamp")) + n).alias("ts_ms"),
    )
    return ingest.good(ingest.parse_json(e.table("orders").select(F.to_json(record).alias("value")), schemas.CHANGE_RECORD))


@register(
    "cdc_decode",
    f"""SELECT 'mart' AS "database", 'order_info' AS "table", CASE {_OP} WHEN 'c' THEN 'insert' WHEN 'u' THEN 'update' ELSE 'delete' END AS "type",
    CAST(epoch_ms(ts) + n AS BIGINT) AS ts, CASE WHEN {_OP} = 'd' THEN 0 ELSE 2 END AS n_fields, CASE WHEN {_OP} != 'd' THEN CAST(n AS VARCHAR) END AS id
    FROM (SELECT *, id AS n FROM o)""",
)
def _(e):
    rows = ingest.decode_changes(_records(e))
    return rows.select("database", "table", "type", "ts", F.size("data").alias("n_fields"), F.col("data")["id"].alias("id"))


def _user_changes(e):
    """Orders as changes of their user's row."""
    kind = F.when(F.col("id") % 3 == 0, "insert").when(F.col("id") % 3 == 1, "update").otherwise("delete")
    return e.order_facts.select(F.col("user_id").alias("id"), "order_status", F.col("id").alias("xid"), kind.alias("type"))


_LAST = "SELECT user_id, order_status, id AS xid FROM o QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY id DESC) = 1"


@register("cdc_latest_state", f"SELECT user_id AS id, order_status, xid FROM ({_LAST}) WHERE xid % 3 != 2")
def _(e):
    return ingest.latest_state(_user_changes(e), ["id"], F.desc("xid")).select("id", "order_status", "xid")


@register(
    "dim_upsert_latest",
    f"""SELECT user_id AS id, order_status FROM ({_LAST}) WHERE xid % 3 != 2
    UNION ALL SELECT c_custkey, 'old' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""",
)
def _(e):
    old = e.table("customer").select(F.col("c_custkey").alias("id"), F.lit("old").alias("order_status"))
    return tables.upsert(old, _user_changes(e), "id", F.desc("xid"))


@register(
    "new_visitor_repair",
    """SELECT event_id, CASE WHEN is_new = '1' AND CAST(ts AS DATE) != first THEN '0' ELSE is_new END AS is_new FROM (
      SELECT *, first_value(CASE WHEN is_new = '1' THEN CAST(ts AS DATE) END IGNORE NULLS) OVER (PARTITION BY mid ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS first FROM pages_)""",
)
def _(e):
    return visitors.repair_new_visitors(e.pages, "ts", "event_id").select("event_id", "is_new")


_UNIQUE = "SELECT * FROM pages_ WHERE last_page_id = '' QUALIFY row_number() OVER (PARTITION BY mid, CAST(ts AS DATE) ORDER BY ts, event_id) = 1"
_BOUNCED = """SELECT * EXCLUDE (n) FROM (SELECT *, lead(ts) OVER (PARTITION BY mid ORDER BY ts, event_id) AS n FROM pages_)
  WHERE last_page_id = '' AND (n IS NULL OR n >= ts + INTERVAL 6 HOURS)"""


@register("unique_visit", f"SELECT event_id, mid FROM ({_UNIQUE})")
def _(e):
    return visitors.unique_visits(e.pages, "ts", "event_id").select("event_id", "mid")


@register("bounce_detail", f"SELECT event_id, mid FROM ({_BOUNCED})")
def _(e):
    return visitors.bounces(e.pages, "6 HOURS", "ts", "event_id").select("event_id", "mid")
