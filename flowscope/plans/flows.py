"""A flow table derived from an event stream and a page table, for data without a sensor log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscope.functions.net import long_to_ipv4

FLOW_COLUMNS = (
    "timestamp", "xff", "protocol", "method", "host", "params", "status", "size",
    "src_ip", "src_port", "dest_ip", "dest_port",
)


def flows_from_events(events: DataFrame, pages: DataFrame) -> DataFrame:
    """Each event requests one page: event types give method and status, users sources, pages destinations."""
    pattern = "^https?://([^/]+)(.*)$"
    page = pages.select(
        "page_id",
        "url",
        F.regexp_extract("url", pattern, 1).alias("_h"),
        F.regexp_extract("url", pattern, 2).alias("_q"),
    )
    number = F.lit(pages.count())
    e = F.col("event_id")
    kind = F.col("event_type")
    source = F.when(e % 101 == 0, F.lit(16943009) + e).otherwise(F.lit(16843009) + F.col("user_id"))
    dest = long_to_ipv4(F.lit(3405803776) + F.col("page_id") % 7)
    path = F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(F.col("_q"))
    tail = (
        F.when(e % 13 == 0, F.lit("/../../../../../../etc/passwd"))
        .when(e % 19 == 0, F.lit("?q=%3Cscript%3Ealert(1)%3C/script%3E"))
        .otherwise(F.lit(""))
    )
    joined = events.withColumn("page_id", e % number).join(page, "page_id")
    return joined.select(
        e.alias("seq"),
        F.date_format("ts", "MM/dd/yy-HH:mm:ss.SSSSSS").alias("timestamp"),
        F.lit("-").alias("xff"),
        F.when(e % 17 == 0, "-").otherwise("HTTP/1.1").alias("protocol"),
        F.when(kind == "purchase", "POST").when(kind == "signup", "CONNECT").otherwise("GET").alias("method"),
        F.when(F.col("page_id") % 10 == 0, dest).otherwise(F.col("_h")).alias("host"),
        F.concat(path, tail).alias("params"),
        F.when(kind == "click", "302").when(kind == "error", "404").when(kind == "signup", "-").otherwise("200")
        .alias("status"),
        F.when(e % 11 == 0, "-").otherwise(F.floor(F.col("value") * 100).cast("string")).alias("size"),
        long_to_ipv4(source).alias("src_ip"),
        (F.lit(1024) + e % 60000).cast("int").alias("src_port"),
        dest.alias("dest_ip"),
        F.when(e % 23 != 0, F.lit(8000) + e % 3).cast("int").alias("dest_port"),
    )
