"""Synthetic logs and business rows as DataFrames, deterministic for a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from streammart.functions.scalars import brand

# Session paths, device attributes and search words, with their weights.
PATHS = (
    (("home", "good_list", "good_detail", "cart", "trade", "payment"), 20),
    (("home", "search", "good_list", "good_detail", "login", "good_detail", "cart", "trade", "payment"), 50),
    (("home", "mine", "orders_unpaid", "trade", "payment"), 10),
    (("home", "mine", "orders_unpaid", "good_detail", "good_spec", "comment", "trade", "payment"), 5),
    (("home", "mine", "orders_unpaid", "good_detail", "good_spec", "comment", "home"), 5),
    (("home", "good_detail"), 70),
    (("home",), 10),
)
AREAS = (("110000", 30), ("310000", 20), ("230000", 10), ("370000", 10), ("420000", 5), ("440000", 20), ("500000", 5), ("530000", 5))
MODELS = (
    ("Xiaomi 9", 30), ("Xiaomi 10 Pro", 30), ("Xiaomi Mix2", 30), ("iPhone X", 20), ("iPhone 8", 20), ("iPhone Xs", 20), ("iPhone Xs Max", 20),
    ("Huawei P30", 10), ("Huawei Mate 30", 10), ("Redmi k30", 10), ("Honor 20s", 5), ("vivo iqoo3", 20), ("Oneplus 7", 5), ("Sumsung Galaxy S20", 3),
)
CHANNELS = (("xiaomi", 30), ("wandoujia", 10), ("web", 10), ("huawei", 5), ("oppo", 20), ("vivo", 5), ("360", 5))
SYSTEMS = (("11.0", 70), ("10.0", 20), ("9.0", 5), ("8.1", 5))
APPLE_SYSTEMS = (("13.3.1", 30), ("13.2.9", 10), ("13.2.3", 10), ("12.4.1", 5))
VERSIONS = (("2.1.134", 70), ("2.1.132", 20), ("2.1.111", 5), ("2.0.1", 5))
DISPLAYS = (("promotion", 30), ("query", 60), ("recommend", 10))
SEARCH_WORDS = ("图书", "小米", "iphone11", "电视", "口红", "ps5", "苹果手机", "小米盒子")
# Order states.
UNPAID, PAID, CANCELLED, FINISHED, REFUNDING, REFUNDED = "1001", "1002", "1003", "1004", "1005", "1006"


def uniform(seed: int, *keys) -> Column:
    """A number in [0, 1) that depends on the keys and the seed alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 40)) / float(1 << 40)


def weighted_choice(options: tuple[tuple, ...], u: Column) -> Column:
    """The option whose share of the weights holds u."""
    total, upto, picked = sum(w for _, w in options), 0, None
    for value, weight in options:
        upto += weight
        lit = F.array(*map(F.lit, value)) if isinstance(value, tuple) else F.lit(value)
        picked = F.when(u < upto / total, lit) if picked is None else picked.when(u < upto / total, lit)
    return picked.otherwise(lit)


def pick(options: tuple, u: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (F.floor(u * len(options)) + 1).cast("int"))


def sample(n: int, most: int, seed: int, *keys) -> Column:
    """n distinct numbers of 1..most."""
    ranked = F.transform(F.sequence(F.lit(1), F.lit(most)), lambda i: F.struct(F.xxhash64(F.lit(seed), i, *keys).alias("h"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(ranked), 1, n), lambda x: x["i"])


def increasing_times(rows: DataFrame, key: str, order: str, start_ms: int, mean_ms: int, seed: int) -> DataFrame:
    """Adds ts: steps uniform in [0, 2 * mean) summed along ``order`` within each key."""
    step = F.floor(uniform(seed, key, order) * 2 * mean_ms)
    return rows.withColumn("ts", F.lit(start_ms) + F.sum(step).over(W.partitionBy(key).orderBy(order)))


def log_events(spark: SparkSession, sessions: int, start_ms: int, seed: int = 1, devices: int = 20, users: int = 50, skus: int = 10) -> DataFrame:
    """Session logs: one start event, then the pages of a weighted path. All rows of a session share its time."""
    s = spark.range(sessions).withColumnRenamed("id", "session")
    u = lambda k, *more: uniform(seed * 1000 + k, "session", *more)
    model = weighted_choice(MODELS, u(11))
    apple = brand(model) == "iPhone"
    common = F.struct(
        F.concat(F.lit("mid_"), F.floor(u(1) * devices) + 1).alias("mid"),
        (F.floor(u(2) * users) + 1).cast("string").alias("uid"),
        F.concat(F.lit("v"), weighted_choice(VERSIONS, u(3))).alias("vc"),
        F.when(apple, "Appstore").otherwise(weighted_choice(CHANNELS, u(4))).alias("ch"),
        F.when(apple, F.concat(F.lit("iOS "), weighted_choice(APPLE_SYSTEMS, u(12)))).otherwise(F.concat(F.lit("Android "), weighted_choice(SYSTEMS, u(12)))).alias("os"),
        weighted_choice(AREAS, u(5)).alias("ar"),
        model.alias("md"),
        brand(model).alias("ba"),
        F.when(u(6) < 0.5, "1").otherwise("0").alias("is_new"),
    )
    base = s.select("session", (F.lit(start_ms) + F.col("session") * 100).alias("ts"), common.alias("common"), weighted_choice(PATHS, u(7)).alias("path"))
    starts = base.select("session", F.lit(-1).alias("step"), "ts", "common", F.struct(pick(("icon", "notice", "install"), u(8)).alias("entry"), (F.floor(u(9) * 20) + 1).alias("open_ad_id"), F.floor(u(10) * 20000).cast("int").alias("loading_time")).alias("start"))
    pages = base.select("session", "ts", "common", "path", F.posexplode("path").alias("step", "page_id"))
    v = lambda k, *more: uniform(seed * 1000 + k, "session", "step", *more)
    sku = lambda x: (F.floor(x * skus) + 1).cast("string")
    shown = F.transform(
        F.sequence(F.lit(1), (F.floor(v(21) * 6) + 4).cast("int")),
        lambda i: F.struct(
            F.when(v(22, i) < 0.3, "activity_id").otherwise("sku_id").alias("item_type"), sku(v(23, i)).alias("item"),
            weighted_choice(DISPLAYS, v(24, i)).alias("display_type"), i.alias("order"), (F.floor(v(25, i) * 5) + 1).cast("int").alias("pos_id"),
        ),
    )
    acts = F.filter(
        F.transform(F.array(F.lit("favor_add"), F.lit("cart_add"), F.lit("get_coupon")), lambda a: F.struct(a.alias("action_id"), F.lit("sku_id").alias("item_type"), sku(v(26)).alias("item"), v(27, a).alias("u"))),
        lambda a: a["u"] < 0.25,
    )
    duration = (F.floor(v(28) * 19000) + 1000).cast("int")
    paged = pages.select(
        "session",
        "step",
        "ts",
        "common",
        F.struct(
            F.when(F.col("step") > 0, F.expr("path[step - 1]")).alias("last_page_id"), "page_id",
            F.when(F.col("page_id").isin("good_detail", "good_spec", "comment"), "sku_id").when(F.col("page_id") == "good_list", "keyword").alias("item_type"),
            F.when(F.col("page_id").isin("good_detail", "good_spec", "comment"), sku(v(29))).when(F.col("page_id") == "good_list", pick(SEARCH_WORDS, v(30))).alias("item"),
            duration.alias("during_time"),
        ).alias("page"),
        F.when(F.col("page_id").isin("home", "good_list", "good_detail"), shown).alias("displays"),
        F.transform(acts, lambda a, i: F.struct(a["action_id"].alias("action_id"), a["item_type"].alias("item_type"), a["item"].alias("item"), (F.col("ts") + (i + 1) * F.floor(duration / (F.size(acts) + 1))).alias("ts"))).alias("actions"),
        F.when(v(31) < 0.1, F.struct((F.floor(v(32) * 3000) + 1001).cast("int").alias("error_code"), F.lit("trace").alias("msg"))).alias("err"),
    )
    return starts.unionByName(paged, allowMissingColumns=True)


def business(spark: SparkSession, users: int, start: str, seed: int = 1, skus: int = 10) -> dict[str, DataFrame]:
    """Users, favours, carts, orders, details, payments, refunds, comments and the states orders pass through."""
    at = F.to_timestamp(F.lit(start))
    u = lambda k, *keys: uniform(seed * 1000 + k, *keys)
    people = spark.range(1, users + 1).select("id", F.when(u(1, "id") < 0.5, "M").otherwise("F").alias("gender"), F.add_months(at, (-12 * (F.floor(u(2, "id") * 40) + 15)).cast("int")).alias("birthday"), email("id", seed).alias("email"))
    wanted = people.select(F.col("id").alias("user_id"), F.explode(sample(3, skus, seed, "id")).alias("sku_id"))
    favours = wanted.filter(u(3, "user_id", "sku_id") < 0.5)
    carts = wanted.filter(u(4, "user_id", "sku_id") < 0.7).withColumn("sku_num", (F.floor(u(5, "user_id", "sku_id") * 3) + 1).cast("long"))
    orders = people.filter(u(6, "id") < 0.8).select(F.col("id"), F.col("id").alias("user_id"), at.alias("create_time"), (at + F.expr("INTERVAL 15 MINUTES")).alias("expire_time"))
    details = orders.select(F.col("id").alias("order_id"), "user_id").join(carts, "user_id").withColumn("order_price", F.col("sku_id") * 100)
    paid = orders.filter(u(7, "id") < 0.7)
    payments = paid.select(F.col("id").alias("order_id"), "user_id", (F.col("create_time") + F.expr("INTERVAL 20 SECONDS")).alias("callback_time"), F.when(u(8, "id") < 0.6, "1101").otherwise("1102").alias("payment_type"))
    refunds = paid.filter(u(9, "id") < 0.3).select(F.col("id").alias("order_id"), "user_id")
    comments = paid.select(F.col("id").alias("order_id"), "user_id", weighted_choice((("1201", 6), ("1202", 2), ("1203", 1), ("1204", 1)), u(10, "id")).alias("appraise"))
    state = F.array(F.lit(UNPAID), F.when(u(7, "id") < 0.7, PAID), F.when(u(7, "id") >= 0.7, None).when(u(9, "id") < 0.3, REFUNDING).when(u(9, "id") >= 0.3, FINISHED))
    log = orders.select(F.col("id").alias("order_id"), F.posexplode(F.filter(state, lambda x: x.isNotNull())).alias("step", "order_status"))
    return {"user_info": people, "favor_info": favours, "cart_info": carts, "order_info": orders, "order_detail": details, "payment_info": payments, "order_refund_info": refunds, "comment_info": comments, "order_status_log": log}


def email(key, seed: int) -> Column:
    return F.concat(F.substring(F.md5(F.concat_ws("/", F.lit(seed), key)), 1, 8), F.lit("@"), pick(("example.com", "example.net", "example.org"), uniform(seed, key)))


def drifted_users(people: DataFrame, seed: int) -> DataFrame:
    """Each user may change: the draw's divisibility by 2, 3, 5 and 7 picks the columns."""
    r = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(210))
    return people.select(
        "id",
        F.when(r % 2 == 0, F.when(F.col("gender") == "M", "F").otherwise("M")).otherwise(F.col("gender")).alias("gender"),
        F.when(r % 5 == 0, F.date_add("birthday", 1)).otherwise(F.col("birthday")).alias("birthday"),
        F.when(r % 3 == 0, email("id", seed + 1)).otherwise(F.col("email")).alias("email"),
    )


# Parameters of generators, as text


def rate(text: str) -> int:
    """A whole percentage, 0 to 100."""
    value = int(text)
    if not 0 <= value <= 100:
        raise ValueError(f"not a rate from 0 to 100: {text}")
    return value


def ratios(text: str, n: int) -> list[int]:
    """n colon-separated whole ratios."""
    values = [int(x) for x in text.split(":")]
    if len(values) != n:
        raise ValueError(f"{n} ratios wanted: {text}")
    return values


def flag(text: str) -> bool:
    if text.lower() in ("1", "true"):
        return True
    if text.lower() in ("0", "false"):
        return False
    raise ValueError(f"neither true nor false: {text}")


def names(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]
