"""Dashboard replies over HTTP, and log lines landing as files."""

import datetime as dt
import json
import threading
import urllib.error
import urllib.parse
import urllib.request

import pytest

from streammart import api
from streammart.sources import readers


@pytest.fixture
def base(spark, tmp_path):
    at = [dt.datetime(2024, 1, 2, 3), dt.datetime(2024, 1, 3, 3)]
    product = spark.createDataFrame([(at[0], "T1", "C1", "S1", 10.0, 2), (at[0], "T2", "C1", "S2", 30.0, 1), (at[0], "T3", "C2", "S3", 0.0, 0), (at[1], "T1", "C1", "S1", 5.0, 1)], "stt timestamp, tm_name string, category3_name string, spu_name string, order_amount double, order_ct long")
    province = spark.createDataFrame([(at[0], "north", 7.0)], "stt timestamp, province_name string, order_amount double")
    visitor = spark.createDataFrame([(at[0], "1", 2, 7, 3, 1, 10000)], "stt timestamp, is_new string, uv_ct long, pv_ct long, sv_ct long, uj_ct long, dur_sum long")
    keyword = spark.createDataFrame([(at[0], "x", "SEARCH", 2), (at[0], "x", "CLICK", 5), (at[0], "y", "ORDER", 8), (at[0], "z", "OTHER", 9)], "stt timestamp, keyword string, source string, ct long")
    board = api.Dashboard({"product_stats": product, "province_stats": province, "visitor_stats": visitor, "keyword_stats": keyword}, lambda: dt.date(2024, 1, 3))
    server = api.server(board, f"{tmp_path}/landing")
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", tmp_path
    server.shutdown()


def get(url):
    with urllib.request.urlopen(url, timeout=60) as r:
        return r.read().decode()


def test_replies(base):
    url = base[0] + "/api/sugar/{}?date=20240102"
    data = lambda path: json.loads(get(url.format(path)))["data"]
    assert data("gmv") == 40.0
    assert json.loads(get(base[0] + "/api/sugar/gmv"))["data"] == 5.0  # today
    assert data("trademark")["categories"] == ["T2", "T1"]
    assert data("category3") == [{"name": "C1", "value": 40.0}]
    assert [r["name"] for r in data("spu")["rows"]] == ["S2", "S1"]
    assert data("province")["mapData"] == [{"name": "north", "value": 7.0}]
    assert {r["measure"]: (r["new_visitors"], r["old_visitors"]) for r in data("visitor")["rows"]}["bounce"] == (33.33, 0.0)
    hours = data("hour")
    assert len(hours["categories"]) == 24 and hours["series"][0]["data"][3] == 2 and sum(hours["series"][1]["data"]) == 7
    assert {r["name"]: r["value"] for r in data("keyword")} == {"x": 25, "y": 24, "z": 0}
    with pytest.raises(urllib.error.HTTPError):
        get(base[0] + "/api/sugar/nothing")


def test_landing(spark, base):
    url, tmp_path = base
    assert get(f"{url}/applog?param=" + urllib.parse.quote('{"ts": 1}')) == "success"
    assert [r["value"] for r in readers.lines(spark, f"{tmp_path}/landing").collect()] == ['{"ts": 1}']
