"""Window statistics, keywords, serving, grouping sets, merge engines."""

from pyspark.sql import functions as F

from streammart.functions import scalars as S
from streammart.operators import grouping, keywords, serving, stats, tables, visitors
from streammart.plans.ingest_queries import _BOUNCED, _UNIQUE
from streammart.plans.registry import register

_V = ("uv_ct", "pv_ct", "sv_ct", "uj_ct", "dur_sum")
_KEYS = "vc, ch, ar, is_new"
_UNITED = f"""SELECT ts, {_KEYS}, 0 AS uv_ct, 1 AS pv_ct, CASE WHEN last_page_id = '' THEN 1 ELSE 0 END AS sv_ct, 0 AS uj_ct, during_time AS dur_sum FROM pages_
  UNION ALL SELECT ts, {_KEYS}, 1, 0, 0, 0, 0 FROM ({_UNIQUE}) UNION ALL SELECT ts, {_KEYS}, 0, 0, 0, 1, 0 FROM ({_BOUNCED})"""
_SUM_V = ", ".join(f"CAST(sum({m}) AS BIGINT) AS {m}" for m in _V)


def _windows(size: str) -> str:
    text = "strftime(time_bucket(INTERVAL {0}, ts){1}, '%Y-%m-%d %H:%M:%S') AS {2}".format
    return text(size, "", "stt") + ", " + text(size, f" + INTERVAL {size}", "edt")


def visitor_rows(e):
    order = ("ts", "event_id")
    return stats.visitor_rows(e.pages, visitors.unique_visits(e.pages, *order), visitors.bounces(e.pages, "6 HOURS", *order))


@register("union_three_streams", f"SELECT is_new, CAST(count(*) AS BIGINT) AS n, {_SUM_V} FROM ({_UNITED}) GROUP BY is_new")
def _(e):
    return visitor_rows(e).groupBy("is_new").agg(F.count("*").alias("n"), *(F.sum(m).alias(m) for m in _V))


@register("visitor_stats_window", f"SELECT {_windows('1 hour')}, {_KEYS}, {_SUM_V} FROM ({_UNITED}) GROUP BY ALL")
def _(e):
    return stats.visitor_stats(visitor_rows(e), "1 hour")


_CLICK = """SELECT ts, CAST(k AS BIGINT) AS sku_id, 'click_ct' AS m FROM ev WHERE page_id = 'purchase' AND k % 5 != 0
  UNION ALL SELECT ts, k + i, 'display_ct' FROM ev, (SELECT unnest([0, 1]) AS i) WHERE page_id = 'view' AND k % 3 != i"""


@register("product_click_display", f"SELECT sku_id, CAST(count(*) FILTER (WHERE m = 'click_ct') AS BIGINT) AS click_ct, CAST(count(*) FILTER (WHERE m = 'display_ct') AS BIGINT) AS display_ct FROM ({_CLICK}) GROUP BY sku_id")
def _(e):
    return stats.click_and_display(e.log).groupBy("sku_id").agg(F.sum("click_ct").alias("click_ct"), F.sum("display_ct").alias("display_ct"))


def product_rows(e):
    """Seven sources: clicks and displays, favours, carts, orders, payments, refunds, comments."""
    signed = e.events.select("ts", F.col("k").cast("long").alias("sku_id"), "page_id")
    line = e.details
    return stats.union_all(
        stats.click_and_display(e.log),
        stats.favor_rows(signed.filter("page_id = 'signup'")),
        stats.cart_rows(signed.filter("page_id = 'error'")),
        stats.order_rows(line),
        stats.payment_rows(line.filter("flag = 'N'")),
        stats.refund_rows(line.filter("flag = 'R'")),
        stats.comment_rows(line.filter("flag = 'A'").withColumn("appraise", F.when(F.col("status") == "F", "1201").otherwise("1204"))),
    )


_C = ("display_ct", "click_ct", "favor_ct", "cart_ct", "order_sku_num", "comment_ct", "good_comment_ct")
_A = ("order_amount", "payment_amount", "refund_amount")
_S = ("order_id", "paid_order_id", "refund_order_id")


def _sparse(source: str, sku: str, where: str = "true", **m: str) -> str:
    columns = [f"CAST({m.get(c, '0')} AS BIGINT) AS {c}" for c in _C] + [f"CAST({m.get(c, '0')} AS DECIMAL(16,2)) AS {c}" for c in _A]
    columns += [f"CAST({m.get(c, 'NULL')} AS BIGINT) AS {c}_" for c in _S]
    return f"SELECT ts, CAST({sku} AS BIGINT) AS sku_id, {', '.join(columns)} FROM {source} WHERE {where}"


_SPARSE = " UNION ALL ".join(
    [
        _sparse(f"({_CLICK})", "sku_id", click_ct="CASE WHEN m = 'click_ct' THEN 1 ELSE 0 END", display_ct="CASE WHEN m = 'display_ct' THEN 1 ELSE 0 END"),
        _sparse("ev", "k", "page_id = 'signup'", favor_ct="1"),
        _sparse("ev", "k", "page_id = 'error'", cart_ct="1"),
        _sparse("d", "sku_id", order_sku_num="sku_num", order_amount="amount", order_id="order_id"),
        _sparse("d", "sku_id", "flag = 'N'", payment_amount="amount", paid_order_id="order_id"),
        _sparse("d", "sku_id", "flag = 'R'", refund_amount="amount", refund_order_id="order_id"),
        _sparse("d", "sku_id", "flag = 'A'", comment_ct="1", good_comment_ct="CASE WHEN status = 'F' THEN 1 ELSE 0 END"),
    ]
)
_P_AGG = ", ".join(
    [f"CAST(sum({c}) AS BIGINT) AS {c}" for c in _C]
    + [f"CAST(sum({c}) AS DOUBLE) AS {c}" for c in _A]
    + [f"CAST(count(DISTINCT {c}_) AS BIGINT) AS {n}" for c, n in zip(_S, ("order_ct", "paid_order_ct", "refund_order_ct"), strict=True)]
)


def _doubles(rows, *columns):
    return rows.withColumns({c: F.col(c).cast("double") for c in columns})


@register("union_sparse_metrics", f"SELECT CAST(count(*) AS BIGINT) AS n, {_P_AGG} FROM ({_SPARSE})")
def _(e):
    rows = product_rows(e)
    sets = [F.count_distinct(c).alias(n) for n, c in stats.PRODUCT_SETS.items()]
    return _doubles(rows.agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in [*_C, *_A]), *sets), *_A)


@register("product_stats_window", f"SELECT {_windows('1 day')}, sku_id, {_P_AGG} FROM ({_SPARSE}) GROUP BY stt, edt, sku_id")
def _(e):
    return _doubles(stats.product_stats(product_rows(e), "1 day"), *_A)


@register("agg_then_enrich", f"SELECT stt, p.sku_id, order_amount, sku_name, spu_name, upper(tm_id) AS tm_name FROM (SELECT {_windows('1 day')}, sku_id, CAST(sum(order_amount) AS DOUBLE) AS order_amount FROM ({_SPARSE}) GROUP BY stt, edt, sku_id) p LEFT JOIN sku ON p.sku_id = sku.id LEFT JOIN spu ON sku.spu_id = spu.id")
def _(e):
    from streammart.operators import wide

    rows = stats.product_stats(product_rows(e), "1 day").select("stt", "sku_id", "order_amount")
    return _doubles(wide.with_product(rows, e.skus, e.spus, e.trademarks, e.categories).select("stt", "sku_id", "order_amount", "sku_name", "spu_name", "tm_name"), "order_amount")


_PO = "SELECT d.ts, d.order_id, d.amount, province_id, name AS province_name, area_code, iso_code, iso_3166_2 FROM d JOIN o ON d.order_id = o.id LEFT JOIN prov ON province_id = prov.id"


def province_rows(e):
    from streammart.operators import wide

    orders = e.orders.select(F.col("id").alias("order_id"), "province_id")
    columns = {"name": "province_name", "area_code": "area_code", "iso_code": "iso_code", "iso_3166_2": "iso_3166_2"}
    rows = wide.enrich(e.details.join(orders, "order_id"), e.provinces, "province_id", "id", columns)
    return rows.withColumn("split_total_amount", F.col("amount"))


@register("province_stats_window", f"SELECT {_windows('1 day')}, province_id, province_name, area_code, iso_code, iso_3166_2, CAST(sum(amount) AS DOUBLE) AS order_amount, CAST(count(DISTINCT order_id) AS BIGINT) AS order_count FROM ({_PO}) GROUP BY ALL")
def _(e):
    return _doubles(stats.province_stats(province_rows(e), "1 day"), "order_amount")


# Keywords: product names searched for on list pages


def searches(e):
    names = e.skus.select(F.col("id").alias("k"), "sku_name")
    pages = e.events.join(names, "k", "left")
    page = F.create_map(F.lit("page_id"), F.when(F.col("page_id") == "click", "good_list").otherwise("home"), F.lit("item"), F.when(F.col("k") % 4 != 0, F.col("sku_name")))
    return pages.select("ts", page.alias("page"))


_SEARCH = "SELECT ts, sku_name AS fullword FROM ev JOIN sku ON ev.k = sku.id WHERE page_id = 'click' AND k % 4 != 0"
_WORDS = f"SELECT ts, unnest(regexp_extract_all(lower(fullword), '[\\p{{L}}\\p{{N}}]+')) AS keyword FROM ({_SEARCH})"


@register("keyword_filter", f"SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, fullword FROM ({_SEARCH})")
def _(e):
    return keywords.searched(searches(e)).select(S.second_text("ts").alias("at"), "fullword")


@register("lateral_tokenize", f"SELECT keyword, CAST(count(*) AS BIGINT) AS n FROM ({_WORDS}) GROUP BY keyword")
def _(e):
    return keywords.tokenized(keywords.searched(searches(e))).groupBy("keyword").agg(F.count("*").alias("n"))


@register("keyword_stats_window", f"SELECT {_windows('1 day')}, keyword, CAST(count(*) AS BIGINT) AS ct, 'SEARCH' AS source FROM ({_WORDS}) GROUP BY ALL")
def _(e):
    return stats.keyword_stats(keywords.tokenized(keywords.searched(searches(e))), "1 day")


_KS = f"""SELECT keyword, ct, ['SEARCH', 'ORDER', 'CART', 'CLICK', 'OTHER'][1 + ct % 5] AS source FROM
  (SELECT date_trunc('day', ts) AS w, keyword, count(*) AS ct FROM ({_WORDS}) GROUP BY ALL)"""


@register("keyword_weighted_topn", f"SELECT keyword, CAST(ct AS BIGINT) AS ct FROM (SELECT keyword, sum(ct * CASE source WHEN 'SEARCH' THEN 10 WHEN 'ORDER' THEN 3 WHEN 'CART' THEN 2 WHEN 'CLICK' THEN 1 ELSE 0 END) AS ct, sum(ct) AS n FROM ({_KS}) GROUP BY keyword) ORDER BY n DESC, keyword LIMIT 8")
def _(e):
    rows = stats.keyword_stats(keywords.tokenized(keywords.searched(searches(e))), "1 day")
    source = F.element_at(F.array(*map(F.lit, ("SEARCH", "ORDER", "CART", "CLICK", "OTHER"))), (F.col("ct") % 5 + 1).cast("int"))
    return keywords.weighted(rows.withColumn("source", source), 8)


# Serving: sales by day of shipping


def sales(e):
    """Product sales with the window's start, for the day the dashboards ask for."""
    rows = e.details.join(e.skus.withColumnRenamed("id", "sku_id"), "sku_id")
    return rows.select(F.col("ts").alias("stt"), "sku_name", "tm_id", "category3_id", "spu_id", F.col("amount").alias("order_amount"), "order_id")


_SALES = "SELECT d.ts AS stt, sku_name, tm_id, category3_id, spu_id, amount AS order_amount, order_id FROM d JOIN sku ON d.sku_id = sku.id"
_DAY, _ON = 19990404, "strftime(stt, '%Y%m%d') = '19990404'"


@register("gmv", f"SELECT CAST(sum(order_amount) AS DOUBLE) AS order_amount FROM ({_SALES}) WHERE {_ON}")
def _(e):
    return _doubles(serving.gmv(serving.on_day(sales(e), _DAY)), "order_amount")


def _top(key: str, more: str = "") -> str:
    return f"SELECT {key}, CAST(sum(order_amount) AS DOUBLE) AS order_amount{more} FROM ({_SALES}) GROUP BY {key} HAVING sum(order_amount) > 0 ORDER BY sum(order_amount) DESC, {key} LIMIT 20"


@register("gmv_by_trademark", _top("tm_id"))
def gmv_by_trademark(e):
    return _doubles(serving.top_groups(sales(e), "tm_id", 20), "order_amount")


@register("gmv_by_category", _top("category3_id"))
def _(e):
    return _doubles(serving.top_groups(sales(e), "category3_id", 20), "order_amount")


@register("gmv_by_spu", _top("spu_id", ", CAST(count(DISTINCT order_id) AS BIGINT) AS order_ct"))
def _(e):
    return _doubles(serving.top_groups(sales(e), "spu_id", 20, F.count_distinct("order_id").alias("order_ct")), "order_amount")


@register("gmv_by_province", f"SELECT province_name, CAST(sum(amount) AS DOUBLE) AS order_amount FROM ({_PO}) GROUP BY province_name")
def _(e):
    return _doubles(serving.by_province(province_rows(e).withColumnRenamed("amount", "order_amount")), "order_amount")


@register("visitor_by_is_new", f"SELECT is_new, {_SUM_V} FROM ({_UNITED}) GROUP BY is_new")
def _(e):
    return serving.visitors_by_flag(visitor_rows(e))


def _hourly(e):
    return serving.visitors_by_hour(visitor_rows(e).withColumnRenamed("ts", "stt"))


_HOUR = f"SELECT CAST(hour(ts) AS INTEGER) AS hr, CAST(sum(uv_ct) AS BIGINT) AS uv_ct, CAST(sum(pv_ct) AS BIGINT) AS pv_ct, CAST(sum(CASE WHEN is_new = '1' THEN uv_ct ELSE 0 END) AS BIGINT) AS new_uv FROM ({_UNITED}) GROUP BY hour(ts)"


@register("visitor_by_hour", _HOUR)
def _(e):
    return _hourly(e)


@register("hour_zero_fill", f"SELECT lpad(CAST(r.hr AS VARCHAR), 2, '0') AS hr, coalesce(uv_ct, 0) AS uv_ct, coalesce(pv_ct, 0) AS pv_ct, coalesce(new_uv, 0) AS new_uv FROM (SELECT unnest(range(24)) AS hr) r LEFT JOIN ({_HOUR}) h ON r.hr = h.hr AND h.hr % 5 != 0")
def _(e):
    return serving.every_hour(_hourly(e).filter("hr % 5 != 0"))


_RATES = """CASE WHEN sv_ct = 0 THEN 0 ELSE round(CAST(uj_ct * 100 AS DECIMAL(20,6)) / sv_ct, 2) END::DOUBLE AS uj_rate,
  CASE WHEN sv_ct = 0 THEN 0 ELSE round(round(CAST(dur_sum AS DECIMAL(20,6)) / sv_ct, 0) / 1000, 1) END::DOUBLE AS dur_per_sv,
  CASE WHEN sv_ct = 0 THEN 0 ELSE round(CAST(pv_ct AS DECIMAL(20,6)) / sv_ct, 2) END::DOUBLE AS pv_per_sv"""


@register("visitor_rates", f"SELECT vc, ch, uj_ct, sv_ct, pv_ct, dur_sum, {_RATES} FROM (SELECT vc, ch, {_SUM_V} FROM ({_UNITED}) GROUP BY vc, ch)")
def _(e):
    rows = visitor_rows(e).groupBy("vc", "ch").agg(*(F.sum(c).alias(c) for c in ("uj_ct", "sv_ct", "pv_ct", "dur_sum")))
    return serving.rates(rows)


@register(
    "visitor_pivot",
    f"""SELECT measure, coalesce(max(value) FILTER (WHERE is_new = '1'), 0) AS new_visitors, coalesce(max(value) FILTER (WHERE is_new = '0'), 0) AS old_visitors FROM (
      SELECT is_new, unnest(['uv', 'pv', 'bounce', 'dwell', 'pages']) AS measure, unnest([uv_ct::DOUBLE, pv_ct::DOUBLE, uj_rate, dur_per_sv, pv_per_sv]) AS value FROM (
        SELECT *, {_RATES} FROM (SELECT is_new, {_SUM_V} FROM ({_UNITED}) GROUP BY is_new))) GROUP BY measure""",
)
def _(e):
    return serving.visitor_pivot(visitor_rows(e))


# Replies of the dashboard, as JSON


def _list(fields: str, order: str) -> str:
    return f"'[' || string_agg({fields}, ',' ORDER BY {order}) || ']'"


def _json(data: str, source: str) -> str:
    return f"SELECT '{{\"status\":0,\"data\":' || {data} || '}}' AS json FROM {source}"


def _named(key: str, *more: str) -> str:
    """SQL text of one object: name, then further numbers."""
    fields = "".join(f" || ',\"{n}\":' || {c}" for n, c in (m.split("=") for m in more))
    return f"'{{\"name\":\"' || {key} || '\"'{fields} || '}}'"


def _best(key: str) -> str:
    grouped = f"SELECT {key} AS k, sum(order_amount) AS v, count(DISTINCT order_id) AS c FROM ({_SALES}) GROUP BY {key} HAVING sum(order_amount) > 0"
    return f"(SELECT * FROM ({grouped}) ORDER BY v DESC, k LIMIT 20)"


@register("reply_gmv", _json("sum(order_amount)", f"({_SALES})"))
def _(e):
    return serving.scalar_json(serving.gmv(sales(e)), "order_amount")


_NAMES = _list("'\"' || k || '\"'", "v DESC, k")


@register("reply_trademark", _json(f"'{{\"categories\":' || {_NAMES} || ',\"series\":[{{\"name\":\"tm_id\",\"data\":' || {_list('v', 'v DESC, k')} || '}}]}}'", _best("tm_id")))
def _(e):
    return serving.series_json(serving.top_groups(sales(e), "tm_id", 20), "tm_id")


@register("reply_category", _json(_list(_named("k", "value=v"), "v DESC, k"), _best("category3_id")))
def _(e):
    return serving.pairs_json(serving.top_groups(sales(e), "category3_id", 20), "category3_id", "order_amount")


_COLUMNS = '[{"name":"name","id":"name"},{"name":"amount","id":"amount"},{"name":"orders","id":"ct"}]'


@register("reply_spu", _json(f"'{{\"columns\":{_COLUMNS},\"rows\":' || {_list(_named('k', 'amount=v', 'ct=c'), 'v DESC, CAST(k AS VARCHAR)')} || '}}'", _best("spu_id")))
def _(e):
    return serving.table_json(serving.top_groups(sales(e), "spu_id", 20, F.count_distinct("order_id").alias("order_ct")), "spu_id")


@register("reply_province", _json(f"'{{\"mapData\":' || {_list(_named('province_name', 'value=v'), 'province_name')} || '}}'", f"(SELECT province_name, sum(amount) AS v FROM ({_PO}) GROUP BY province_name)"))
def _(e):
    return serving.map_json(serving.by_province(province_rows(e).withColumnRenamed("amount", "order_amount")))


@register(
    "reply_visitor",
    _json(
        "'{\"columns\":[{\"name\":\"measure\",\"id\":\"measure\"},{\"name\":\"new_visitors\",\"id\":\"new_visitors\"},{\"name\":\"old_visitors\",\"id\":\"old_visitors\"}],\"rows\":' || "
        + _list("'{\"measure\":\"' || measure || '\",\"new_visitors\":' || a || ',\"old_visitors\":' || b || '}'", "measure")
        + " || '}'",
        f"""(SELECT measure, coalesce(max(value) FILTER (WHERE is_new = '1'), 0) AS a, coalesce(max(value) FILTER (WHERE is_new = '0'), 0) AS b FROM (
      SELECT is_new, unnest(['uv', 'pv', 'bounce', 'dwell', 'pages']) AS measure, unnest([uv_ct::DOUBLE, pv_ct::DOUBLE, uj_rate, dur_per_sv, pv_per_sv]) AS value FROM (
        SELECT *, {_RATES} FROM (SELECT is_new, {_SUM_V} FROM ({_UNITED}) GROUP BY is_new))) GROUP BY measure)""",
    ),
)
def _(e):
    return serving.visitor_json(serving.visitor_pivot(visitor_rows(e)))


_EACH_HOUR = f"(SELECT lpad(CAST(r.hr AS VARCHAR), 2, '0') AS hr, coalesce(uv_ct, 0) AS uv, coalesce(pv_ct, 0) AS pv, coalesce(new_uv, 0) AS nu FROM (SELECT unnest(range(24)) AS hr) r LEFT JOIN ({_HOUR}) h ON r.hr = h.hr)"
_LABELS = _list("'\"' || hr || '\"'", "hr")
_SERIES = " || ',' || ".join(f"'{{\"name\":\"{n}\",\"data\":' || {_list(c, 'hr')} || '}}'" for n, c in (("uv", "uv"), ("pv", "pv"), ("new", "nu")))


@register("reply_hour", _json(f"'{{\"categories\":' || {_LABELS} || ',\"series\":[' || {_SERIES} || ']}}'", _EACH_HOUR))
def _(e):
    return serving.hours_json(serving.every_hour(_hourly(e)))


_COUNTED = f"(SELECT keyword AS k, 10 * count(*) AS v FROM ({_WORDS}) GROUP BY keyword ORDER BY count(*) DESC, keyword LIMIT 20)"


@register("reply_keyword", _json(_list(_named("k", "value=v"), "v DESC, k"), _COUNTED))
def _(e):
    counted = stats.keyword_stats(keywords.tokenized(keywords.searched(searches(e))), "1 day")
    return serving.pairs_json(keywords.weighted(counted, 20), "keyword", "ct")


# Grouping sets and merge engines


def _grouped(how):
    return lambda e: _doubles(how(e.details, ["flag", "status"], F.sum("amount").alias("total_amount"), F.count("*").alias("n")), "total_amount")


_G = "SELECT flag, status, CAST(sum(amount) AS DOUBLE) AS total_amount, CAST(count(*) AS BIGINT) AS n, CAST(grouping(flag) * 2 + grouping(status) AS BIGINT) AS level FROM d GROUP BY {}".format
register("agg_rollup", _G("ROLLUP (flag, status)"))(_grouped(grouping.rollup))
register("agg_cube", _G("CUBE (flag, status)"))(_grouped(grouping.cube))
register("agg_totals", _G("GROUPING SETS ((flag, status), ())"))(_grouped(grouping.totals))


@register("summing_merge", "SELECT strftime(ts, '%Y%m%d') AS dt, sku_id, CAST(sum(amount) AS DOUBLE) AS amount, min(flag) AS flag FROM d GROUP BY dt, sku_id")
def _(e):
    rows = e.details.withColumn("dt", S.day_key("ts"))
    return _doubles(tables.summing(rows, ["dt", "sku_id"], ["amount"], ["flag"]), "amount")


@register("replacing_merge", "SELECT strftime(ts, '%Y%m%d') AS dt, user_id, page_id, event_id FROM ev QUALIFY row_number() OVER (PARTITION BY CAST(ts AS DATE), user_id, page_id ORDER BY ts DESC, event_id DESC) = 1")
def _(e):
    rows = e.events.withColumn("dt", S.day_key("ts"))
    return tables.replacing(rows, ["dt", "user_id", "page_id"], "ts", F.desc("event_id")).select("dt", "user_id", "page_id", "event_id")


@register("delete_where", "SELECT id, order_status FROM o WHERE NOT coalesce(order_status = 'F' AND id % 2 = 0, false)")
def _(e):
    return tables.delete_where(e.order_facts, "order_status = 'F' and id % 2 = 0").select("id", "order_status")
