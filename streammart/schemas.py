"""Row contracts of every layer, in declared column order."""

from pyspark.sql.types import (
    ArrayType,
    DecimalType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

MONEY = DecimalType(16, 2)


def _row(text: str) -> StructType:
    """``name:type`` pairs; s string, i int, l long, m money, t timestamp."""
    kinds = {"s": StringType(), "i": IntegerType(), "l": LongType(), "m": MONEY, "t": TimestampType()}
    return StructType([StructField(n, kinds[k]) for n, k in (x.split(":") for x in text.split())])


COMMON = _row("mid:s uid:s vc:s ch:s os:s ar:s md:s ba:s is_new:s")
PAGE = _row("last_page_id:s page_id:s item_type:s item:s during_time:i extend1:s extend2:s source_type:s")
START = _row("entry:s open_ad_id:l open_ad_ms:i open_ad_skip_ms:i loading_time:i")
DISPLAY = _row("item_type:s item:s display_type:s order:i pos_id:i")
ACTION = _row("action_id:s item_type:s item:s extend1:s extend2:s ts:l")
ERROR = _row("error_code:i msg:s")
NOTICE = _row("notice_id:l")

LOG_EVENT = StructType(
    [
        StructField("ts", LongType()),
        StructField("common", COMMON),
        StructField("page", PAGE),
        StructField("err", ERROR),
        StructField("notice", NOTICE),
        StructField("start", START),
        StructField("displays", ArrayType(DISPLAY)),
        StructField("actions", ArrayType(ACTION)),
    ]
)

CHANGE_EVENT = StructType(
    [
        StructField("database", StringType()),
        StructField("table", StringType()),
        StructField("type", StringType()),
        StructField("xid", LongType()),
        StructField("xoffset", LongType()),
        StructField("ts", LongType()),
        StructField("data", MapType(StringType(), StringType())),
    ]
)

#: A change record as change-data-capture connectors write it.
CHANGE_RECORD = StructType(
    [
        StructField("op", StringType()),
        StructField("source", StructType([StructField("db", StringType()), StructField("table", StringType())])),
        StructField("before", MapType(StringType(), StringType())),
        StructField("after", MapType(StringType(), StringType())),
        StructField("ts_ms", LongType()),
    ]
)

TABLE_PROCESS = _row("source_table:s operate_type:s sink_type:s sink_table:s sink_columns:s sink_pk:s sink_extend:s")

ORDER_INFO = _row(
    "id:l province_id:l order_status:s user_id:l total_amount:m activity_reduce_amount:m coupon_reduce_amount:m"
    " original_total_amount:m feight_fee:m expire_time:s create_time:s operate_time:s create_date:s create_hour:s create_ts:l"
)
ORDER_DETAIL = _row(
    "id:l order_id:l sku_id:l order_price:m sku_num:l sku_name:s create_time:s"
    " split_total_amount:m split_activity_amount:m split_coupon_amount:m create_ts:l"
)
PAYMENT_INFO = _row("id:l order_id:l user_id:l total_amount:m subject:s payment_type:s create_time:s callback_time:s")

VISITOR_STATS = _row("stt:s edt:s vc:s ch:s ar:s is_new:s uv_ct:l pv_ct:l sv_ct:l uj_ct:l dur_sum:l ts:l")
PRODUCT_STATS = _row(
    "stt:s edt:s sku_id:l sku_name:s sku_price:m spu_id:l spu_name:s tm_id:l tm_name:s category3_id:l category3_name:s"
    " display_ct:l click_ct:l favor_ct:l cart_ct:l order_sku_num:l order_amount:m order_ct:l payment_amount:m"
    " paid_order_ct:l refund_order_ct:l refund_amount:m comment_ct:l good_comment_ct:l ts:l"
)
PROVINCE_STATS = _row(
    "stt:s edt:s province_id:l province_name:s area_code:s iso_code:s iso_3166_2:s order_amount:m order_count:l ts:l"
)
KEYWORD_STATS = _row("stt:s edt:s keyword:s source:s ct:l ts:l")


def table_schema(sink_columns: str, primary_key: str | None = None) -> StructType:
    """A dimension table's schema from a routing rule: its columns, all strings; the key isn't null."""
    key = primary_key or "id"
    return StructType([StructField(c, StringType(), c != key) for c in sink_columns.split(",")])
