"""Joins, wide facts, promotions."""

from pyspark.sql import functions as F

from streammart.functions import scalars as S
from streammart.operators import ingest, promotions, wide
from streammart.plans.registry import register

_DOUBLE = "CAST({} AS DOUBLE)".format


@register("interval_join_symmetric", "SELECT o.id, d.sku_id, d.line, CAST(d.amount AS DOUBLE) AS amount FROM o JOIN d ON o.id = d.order_id AND d.ts BETWEEN o.ts - INTERVAL 30 DAYS AND o.ts + INTERVAL 30 DAYS")
def _(e):
    left, right = e.order_facts, e.details
    joined = wide.interval_join(left, right, left["id"] == right["order_id"], left["ts"], right["ts"], "-30 DAYS", "30 DAYS")
    return joined.select("id", "sku_id", "line", F.col("amount").cast("double").alias("amount"))


@register("interval_join_lookback", "SELECT o.id, d.sku_id, d.line FROM d JOIN o ON o.id = d.order_id AND o.ts BETWEEN d.ts - INTERVAL 30 DAYS AND d.ts")
def _(e):
    left, right = e.details, e.order_facts
    joined = wide.interval_join(left, right, left["order_id"] == right["id"], left["ts"], right["ts"], "-30 DAYS", "0 DAYS")
    return joined.select("id", "sku_id", "line")


@register("dim_lookup_left", "SELECT order_id, sku_id, line, amount::DOUBLE AS amount, s.sku_name FROM d LEFT JOIN (SELECT * FROM sku WHERE spu_id < 25) s ON sku_id = s.id")
def _(e):
    facts = wide.enrich(e.details, e.skus.filter("spu_id < 25"), "sku_id", "id", {"sku_name": "sku_name"})
    return facts.select("order_id", "sku_id", "line", F.col("amount").cast("double").alias("amount"), "sku_name")


@register("dim_user_age", "SELECT o.id, gender AS user_gender, CAST(floor(date_diff('day', birthday, CAST(o.ts AS DATE)) / 365) AS INTEGER) AS user_age FROM o LEFT JOIN usr ON o.user_id = usr.id")
def _(e):
    return wide.with_user(e.order_facts, e.users, F.col("ts")).select("id", "user_gender", "user_age")


_CHAIN = """d LEFT JOIN sku ON d.sku_id = sku.id LEFT JOIN spu ON sku.spu_id = spu.id"""


@register("dim_snowflake_chain", f"SELECT d.order_id, d.line, d.sku_id, sku.sku_name, spu.spu_name, upper(sku.tm_id) AS tm_name, lower(sku.category3_id) AS category3_name FROM {_CHAIN}")
def _(e):
    facts = wide.with_product(e.details, e.skus, e.spus, e.trademarks, e.categories)
    return facts.select("order_id", "line", "sku_id", "sku_name", "spu_name", "tm_name", "category3_name")


@register("dim_province", "SELECT o.id, prov.name AS province_name, area_code, iso_code, iso_3166_2 FROM o LEFT JOIN prov ON o.province_id = prov.id")
def _(e):
    columns = {"name": "province_name", "area_code": "area_code", "iso_code": "iso_code", "iso_3166_2": "iso_3166_2"}
    return wide.enrich(e.orders, e.provinces, "province_id", "id", columns).select("id", *columns.values())


def order_wide(e):
    orders, details = e.orders.withColumnRenamed("ts", "order_ts"), e.details
    facts = wide.interval_join(orders, details, orders["id"] == details["order_id"], orders["order_ts"], details["ts"], "-30 DAYS", "30 DAYS")
    columns = {"name": "province_name", "area_code": "area_code", "iso_code": "iso_code", "iso_3166_2": "iso_3166_2"}
    facts = wide.enrich(facts, e.provinces, "province_id", "id", columns)
    facts = wide.with_user(facts, e.users, F.col("order_ts"))
    return wide.with_product(facts, e.skus, e.spus, e.trademarks, e.categories)


_WIDE = f"""SELECT o.id AS order_id, d.line, d.sku_id, CAST(d.amount AS DOUBLE) AS amount, strftime(o.ts, '%Y-%m-%d') AS create_date, prov.name AS province_name,
  gender AS user_gender, CAST(floor(date_diff('day', birthday, CAST(o.ts AS DATE)) / 365) AS INTEGER) AS user_age, sku.sku_name, spu.spu_name
  FROM o JOIN {_CHAIN.replace("d LEFT JOIN sku ON", "d ON o.id = d.order_id AND d.ts BETWEEN o.ts - INTERVAL 30 DAYS AND o.ts + INTERVAL 30 DAYS LEFT JOIN sku ON")}
  LEFT JOIN prov ON o.province_id = prov.id LEFT JOIN usr ON o.user_id = usr.id"""


@register("order_wide", _WIDE)
def _(e):
    return order_wide(e).select(
        "order_id", "line", "sku_id", F.col("amount").cast("double").alias("amount"), F.date_format("order_ts", "yyyy-MM-dd").alias("create_date"),
        "province_name", "user_gender", "user_age", "sku_name", "spu_name",
    )


@register(
    "payment_wide",
    """SELECT d.line AS payment_id, o.id AS order_id, d.supplier_id AS user_id, CAST(d.amount AS DOUBLE) AS total_amount, o.order_status
    FROM d JOIN o ON o.id = d.order_id AND o.ts BETWEEN d.ts - INTERVAL 30 DAYS AND d.ts""",
)
def _(e):
    """Payments within 30 days after the order; where both have a column, the payment's is kept."""
    pay = e.details.select(F.col("line").alias("payment_id"), "order_id", F.col("supplier_id").alias("user_id"), F.col("amount").alias("total_amount"), F.col("ts").alias("callback_ts"))
    orders = e.order_facts.select(F.col("id").alias("order_id"), "user_id", "total_amount", "order_status", F.col("ts").alias("order_ts"))
    both = wide.merge_preferring(orders, pay, ["order_id"])
    near = both.filter(F.col("order_ts").between(F.col("callback_ts") - F.expr("INTERVAL 30 DAYS"), F.col("callback_ts")))
    return near.select("payment_id", "order_id", "user_id", F.col("total_amount").cast("double").alias("total_amount"), "order_status")


@register(
    "coalesce_merge",
    """SELECT coalesce(a.k, b.k) AS k, coalesce(a.total, b.total) AS total, a.n AS n FROM
      (SELECT user_id AS k, CAST(count(*) AS BIGINT) AS n, CASE WHEN count(*) > 10 THEN CAST(sum(total_amount) AS DOUBLE) END AS total FROM o GROUP BY user_id) a
      FULL JOIN (SELECT c_custkey AS k, -1.0::DOUBLE AS total FROM customer) b ON a.k = b.k""",
)
def _(e):
    grouped = e.order_facts.groupBy(F.col("user_id").alias("k")).agg(
        F.count("*").alias("n"), F.when(F.count("*") > 10, F.sum("total_amount").cast("double")).alias("total")
    )
    users = e.table("customer").select(F.col("c_custkey").alias("k"), F.lit(-1.0).alias("total"))
    return wide.merge_coalescing(grouped, users, ["k"]).select("k", "total", "n")


_COUPON = "(SELECT c_custkey AS user_id, c_custkey AS coupon_id, ['3301', '3302', '3303'][1 + c_custkey % 3] AS range_type FROM customer)"


def _coupons(e):
    """Each user holds a coupon for one category, trademark or spu."""
    n = F.col("c_custkey")
    kind = F.element_at(F.array(*map(F.lit, ("3301", "3302", "3303"))), (n % 3 + 1).cast("int"))
    target = F.when(n % 3 == 0, "ECONOMY").when(n % 3 == 1, F.concat(F.lit("Brand#"), n % 25 + 1)).otherwise((n % 50).cast("string"))
    return e.table("customer").select(n.alias("user_id"), n.alias("coupon_id"), kind.alias("range_type"), target.alias("range_id"))


def _user_details(e):
    orders = e.order_facts.select(F.col("id").alias("order_id"), "user_id")
    wide_rows = wide.enrich(e.details, e.skus, "sku_id", "id", {"tm_id": "tm_id", "category3_id": "category3_id", "spu_id": "spu_id"})
    return wide_rows.join(orders, "order_id").withColumn("spu_id", F.col("spu_id").cast("string"))


_MATCHED = f"""SELECT d.*, o.user_id, coupon_id, range_type FROM d JOIN o ON d.order_id = o.id JOIN sku ON d.sku_id = sku.id
  JOIN {_COUPON} c ON c.user_id = o.user_id
  AND ((range_type = '3301' AND category3_id = 'ECONOMY') OR (range_type = '3302' AND tm_id = 'Brand#' || (o.user_id % 25 + 1))
    OR (range_type = '3303' AND CAST(spu_id AS VARCHAR) = CAST(o.user_id % 50 AS VARCHAR)))"""


@register("theta_coupon_match", f"SELECT order_id, sku_id, line, coupon_id, range_type FROM ({_MATCHED})")
def _(e):
    return promotions.matching_coupons(_user_details(e), _coupons(e)).select("order_id", "sku_id", "line", "coupon_id", "range_type")


@register("activity_match", "SELECT d.order_id, d.line, sku_id, id % 7 AS activity_id FROM d JOIN sku ON sku_id = id WHERE id % 3 = 0")
def _(e):
    skus = e.skus.filter("id % 3 = 0").select(F.col("id").alias("sku_id"), (F.col("id") % 7).alias("activity_id"))
    return promotions.matching_activities(e.details, skus).select("order_id", "line", "sku_id", "activity_id")


_SUMS = f"SELECT coupon_id, sum(amount) AS amount, sum(sku_num) AS quantity, list_sort(list_distinct(list(sku_id))) AS items FROM ({_MATCHED}) GROUP BY coupon_id"


@register("promo_group_sums", f"SELECT coupon_id, CAST(amount AS DOUBLE) AS amount, CAST(quantity AS BIGINT) AS quantity, array_to_string(items, ',') AS items FROM ({_SUMS})")
def _(e):
    sums = promotions.promotion_sums(promotions.matching_coupons(_user_details(e), _coupons(e)), "coupon_id", "amount", "sku_num", "sku_id")
    items = F.array_join(F.col("items").cast("array<string>"), ",")
    return sums.select("coupon_id", F.col("amount").cast("double").alias("amount"), "quantity", items.alias("items"))


@register(
    "argmax_rule",
    f"""SELECT coupon_id, rule_id, benefit_level FROM ({_SUMS}) s, (SELECT unnest(range(1, 7)) AS rule_id) r, LATERAL (SELECT rule_id // 2 AS benefit_level, 20000 * (rule_id // 2) AS need) x
    WHERE amount >= need AND quantity >= 10 * benefit_level QUALIFY row_number() OVER (PARTITION BY coupon_id ORDER BY benefit_level DESC, rule_id DESC) = 1""",
)
def _(e):
    sums = promotions.promotion_sums(promotions.matching_coupons(_user_details(e), _coupons(e)), "coupon_id", "amount", "sku_num", "sku_id")
    level = F.floor(F.col("rule_id") / 2).cast("long")
    rules = e.table("customer").select(F.col("c_custkey").alias("coupon_id"), F.explode(F.expr("sequence(1L, 6L)")).alias("rule_id"))
    rules = rules.select("*", level.alias("benefit_level"), (level * 20000).alias("condition_amount"), (level * 10).alias("condition_num"))
    return promotions.best_rule(sums, rules, "coupon_id").select("coupon_id", "rule_id", "benefit_level")


_LINES = "line, sku_id, amount, sku_num, supplier_id, ts, discount, tax"


@register(
    "proportional_allocation",
    f"""SELECT order_id, sku_id, line, CAST(CASE WHEN n = c THEN 50 - coalesce(before, 0) ELSE share END AS DOUBLE) AS part, CAST(amount AS DOUBLE) AS amount FROM (
      SELECT *, sum(share) OVER (PARTITION BY order_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (
        SELECT *, CAST(round(CAST(50 * amount AS DECIMAL(30,8)) / s, 2) AS DECIMAL(16,2)) AS share FROM (
          SELECT *, sum(amount) OVER (PARTITION BY order_id) AS s, count(*) OVER (PARTITION BY order_id) AS c,
            row_number() OVER (PARTITION BY order_id ORDER BY {_LINES}) AS n FROM d)))""",
)
def _(e):
    rows = promotions.allocate(e.details, "order_id", F.lit(50).cast("decimal(16,2)"), "amount", "part", *_LINES.split(", "))
    return rows.select("order_id", "sku_id", "line", F.col("part").cast("double").alias("part"), F.col("amount").cast("double").alias("amount"))


@register(
    "order_total_rollup",
    """SELECT order_id, CAST(sum(amount * sku_num) AS DOUBLE) AS original, CAST(sum(discount) AS DOUBLE) AS activity, CAST(sum(tax) AS DOUBLE) AS freight,
    CAST(sum(amount * sku_num) - sum(discount) - sum(discount) + sum(tax) AS DOUBLE) AS total FROM d GROUP BY order_id""",
)
def _(e):
    rows = e.details.select("order_id", F.col("amount").alias("order_price"), "sku_num", F.col("discount").alias("activity_amount"), F.col("discount").alias("coupon_amount"), F.col("tax").alias("freight"))
    totals = promotions.order_totals(rows)
    names = {"original_total_amount": "original", "activity_reduce_amount": "activity", "feight_fee": "freight", "total_amount": "total"}
    return totals.select("order_id", *(F.col(c).cast("double").alias(n) for c, n in names.items()))


@register("order_subject", f"SELECT order_id, min_by(sku_name, ({_LINES.replace('ts', 'd.ts')})) || ' and others, ' || sum(sku_num) || ' pieces' AS subject FROM d JOIN sku ON d.sku_id = sku.id GROUP BY order_id")
def _(e):
    rows = wide.enrich(e.details, e.skus, "sku_id", "id", {"sku_name": "sku_name"}).filter("sku_name is not null")
    return promotions.order_subjects(rows, *_LINES.split(", "))


@register("even_spacing", "SELECT event_id, CAST(epoch_us(ts) // 1000 + n * floor(during_time / (c + 1)) AS BIGINT) AS action_ts FROM (SELECT *, row_number() OVER (PARTITION BY mid, CAST(ts AS DATE) ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY mid, CAST(ts AS DATE)) AS c FROM pages_)")
def _(e):
    rows = e.events.select("event_id", "ts", "during_time", F.unix_millis("ts").alias("start"), F.concat("mid", F.lit("/"), S.day_key("ts")).alias("page"))
    return promotions.spaced_times(rows, "page", "start", "during_time", "ts", "event_id").select("event_id", "action_ts")


@register("nest_order_details", f"SELECT id, CAST(n AS BIGINT) AS n, skus FROM (SELECT o.id, count(order_id) AS n, coalesce(string_agg(CAST(d.sku_id AS VARCHAR), ',' ORDER BY {_LINES.replace('ts', 'd.ts')}), '') AS skus FROM o LEFT JOIN d ON o.id = d.order_id GROUP BY o.id)")
def _(e):
    columns = _LINES.split(", ")
    nested = wide.nest(e.order_facts, e.details.select("order_id", *columns), "id", "order_id", "details", *columns)
    skus = F.array_join(F.transform("details", lambda x: x["sku_id"].cast("string")), ",")
    return nested.select("id", F.size("details").cast("long").alias("n"), skus.alias("skus"))


@register("nest_coupon_info", "SELECT c_custkey AS coupon_id, n_name AS info, CAST((SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS BIGINT) AS n_ranges FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def _(e):
    coupons = e.table("customer").select(F.col("c_custkey").alias("coupon_id"), "c_nationkey")
    one = wide.enrich(coupons, e.table("nation"), "c_nationkey", "n_nationkey", {"n_name": "info"})
    many = e.order_facts.select(F.col("user_id").alias("coupon_id"), F.col("id").alias("range_id"))
    return wide.nest(one, many, "coupon_id", "coupon_id", "ranges", "range_id").select("coupon_id", "info", F.size("ranges").cast("long").alias("n_ranges"))


@register("cart_merge", "SELECT user_id, sku_id, CAST(sum(sku_num) AS BIGINT) AS sku_num FROM d JOIN o ON d.order_id = o.id GROUP BY user_id, sku_id")
def _(e):
    rows = e.details.join(e.order_facts.select(F.col("id").alias("order_id"), "user_id"), "order_id").select("user_id", "sku_id", "sku_num", "line")
    return wide.cart_merge(rows.filter("line <= 3").drop("line"), rows.filter("line > 3").drop("line"))


@register("distinct_filtered", "SELECT DISTINCT user_id FROM o WHERE order_status = 'O'")
def _(e):
    return e.order_facts.filter("order_status = 'O'").select("user_id").distinct()


@register("relational_scan", "SELECT id, user_id FROM o WHERE order_status = 'F' AND id % 5 IN (1, 2) ORDER BY id LIMIT 20")
def _(e):
    return e.order_facts.filter((F.col("order_status") == "F") & (F.col("id") % 5).isin(1, 2)).orderBy("id").limit(20).select("id", "user_id")


@register("row_counts", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT user_id) AS BIGINT) AS users FROM o")
def _(e):
    return e.order_facts.agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@register(
    "scalar_functions",
    """SELECT id, strftime(ts, '%Y%m%d') AS day_key, CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS day_number, lpad(CAST(id % 24 AS VARCHAR), 2, '0') AS hour_label,
    split_part(priority, '-', 1) AS head, strftime(ts + INTERVAL 15 MINUTES, '%Y-%m-%d %H:%M:%S') AS expires, strftime(ts + INTERVAL 20 SECONDS, '%Y-%m-%d %H:%M:%S') AS called,
    strftime(ts - INTERVAL 24 MONTHS, '%Y-%m-%d') AS earlier, strftime(to_timestamp(epoch(ts) + id), '%Y-%m-%d %H:%M:%S') AS rowtime,
    CASE WHEN total_amount >= 100000 THEN round(total_amount / 10000.0, 0) * 10000 END AS two_digits, upper(priority) AS up, url_encode(priority) AS encoded
    FROM (SELECT *, length(CAST(trunc(total_amount) AS BIGINT)::VARCHAR) AS l FROM o)""",
)
def _(e):
    rows = e.orders
    return rows.select(
        "id",
        S.day_key("ts").alias("day_key"),
        S.day_number("ts").alias("day_number"),
        S.hour_label(F.col("id") % 24).alias("hour_label"),
        F.split_part("priority", F.lit("-"), F.lit(1)).alias("head"),
        S.second_text(S.plus_minutes("ts", 15)).alias("expires"),
        S.second_text(S.plus_seconds("ts", 20)).alias("called"),
        F.date_format(F.add_months("ts", -24), "yyyy-MM-dd").alias("earlier"),
        S.second_text(S.rowtime_from_millis(F.unix_millis("ts") + F.col("id") * 1000 + 999)).alias("rowtime"),
        F.when(F.col("total_amount") >= 100000, S.significant("total_amount")).alias("two_digits"),
        F.upper("priority").alias("up"),
        F.replace(S.query_argument("priority"), F.lit("+"), F.lit("%20")).alias("encoded"),
    )
