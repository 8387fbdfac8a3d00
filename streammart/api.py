"""The HTTP surface: dashboard replies over statistics tables, and the landing of log lines."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streammart.operators import keywords, serving

LIMIT = 20


class Dashboard:
    """Answers by path. ``tables`` has product_stats, province_stats, visitor_stats, keyword_stats.

    Parameters: ``date`` as yyyyMMdd (0 or absent: today), ``limit`` (default 20).
    """

    def __init__(self, tables: dict[str, DataFrame], today: Callable[[], dt.date] = dt.date.today):
        self.tables, self.today = tables, today

    def _day(self, name: str, date: int) -> DataFrame:
        return serving.on_day(self.tables[name], int(date) or int(self.today().strftime("%Y%m%d")))

    def reply(self, path: str, date: int = 0, limit: int = LIMIT) -> str:
        """The JSON text of one endpoint; KeyError for an unknown one."""
        limit = int(limit)
        top = lambda key, *more: serving.top_groups(self._day("product_stats", date), key, limit, *more)
        build = {
            "gmv": lambda: serving.scalar_json(serving.gmv(self._day("product_stats", date)), "order_amount"),
            "trademark": lambda: serving.series_json(top("tm_name"), "tm_name"),
            "category3": lambda: serving.pairs_json(top("category3_name"), "category3_name", "order_amount"),
            "spu": lambda: serving.table_json(top("spu_name", F.sum("order_ct").alias("order_ct")), "spu_name"),
            "province": lambda: serving.map_json(serving.by_province(self._day("province_stats", date))),
            "visitor": lambda: serving.visitor_json(serving.visitor_pivot(self._day("visitor_stats", date))),
            "hour": lambda: serving.hours_json(serving.every_hour(serving.visitors_by_hour(self._day("visitor_stats", date)))),
            "keyword": lambda: serving.pairs_json(keywords.weighted(self._day("keyword_stats", date), limit), "keyword", "ct"),
        }
        return build[path]().first()["json"]


def land(folder: str, line: str) -> None:
    """One log line as a file of its own, complete when it appears: a file stream reads it once."""
    place = Path(folder)
    place.mkdir(parents=True, exist_ok=True)
    hidden = place / f".{uuid.uuid4().hex}"
    hidden.write_text(line + "\n")
    hidden.rename(place / f"{hidden.name[1:]}.txt")


def server(dashboard: Dashboard | None, landing: str | None, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """``/api/sugar/<endpoint>`` and ``/applog?param=``; call ``serve_forever`` on the result."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            url = urlsplit(self.path)
            query = {k: v[0] for k, v in parse_qs(url.query).items()}
            status, body = 404, ""
            if url.path == "/applog" and landing and "param" in query:
                land(landing, query["param"])
                status, body = 200, "success"
            elif url.path.startswith("/api/sugar/") and dashboard:
                try:
                    status, body = 200, dashboard.reply(url.path.rpartition("/")[2], query.get("date", 0), query.get("limit", LIMIT))
                except (KeyError, ValueError):
                    status = 404
            data = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_POST = do_GET  # noqa: N815

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer((host, port), Handler)
