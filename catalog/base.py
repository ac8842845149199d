"""Registry of queries, their inputs and the SQL text shared by the oracles."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowscope.functions.net import long_to_ipv4
from flowscope.operators.clean import clean_basic, clean_domain, clean_webscan
from flowscope.plans.flows import flows_from_events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SURVEY_IDS: dict[str, str] = {}


class Tables:
    """The given tables and what Spark derives from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def flows(self) -> DataFrame:
        return flows_from_events(self.read("events"), self.read("pages"))

    @cached_property
    def basic(self) -> DataFrame:
        return clean_basic(self.flows)

    @cached_property
    def webscan(self) -> DataFrame:
        return clean_webscan(self.flows)

    @cached_property
    def domain(self) -> DataFrame:
        return clean_domain(self.flows)

    @cached_property
    def owner(self) -> DataFrame:
        """Addresses of every fifth user and of the even destinations belong to the owner."""
        users = self.read("events").filter("user_id % 5 = 0").select((F.lit(16843009) + F.col("user_id")).alias("ipint"))
        dests = self.read("pages").filter("page_id % 7 % 2 = 0").select(
            (F.lit(3405803776) + F.col("page_id") % 7).alias("ipint")
        )
        return users.unionByName(dests).distinct().select("ipint", long_to_ipv4("ipint").alias("ip"))

    @cached_property
    def geo(self) -> DataFrame:
        """Locations of all users but every seventh and of the destinations, from nation and region."""
        users = self.read("events").filter("user_id % 7 <> 0").select(
            (F.lit(16843009) + F.col("user_id")).alias("ipint"), (F.col("user_id") % 25).alias("n_nationkey")
        )
        dests = self.read("pages").select(
            (F.lit(3405803776) + F.col("page_id") % 7).alias("ipint"), (F.col("page_id") % 7).alias("n_nationkey")
        )
        places = self.read("nation").join(self.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return (
            users.unionByName(dests).distinct().join(places, "n_nationkey")
            .select(long_to_ipv4("ipint").alias("ip"), F.col("n_name").alias("country"), F.col("r_name").alias("area"))
        )


FLOWS = """flows AS (
  SELECT e.event_id AS seq, strftime(e.ts, '%m/%d/%y-%H:%M:%S.%f') AS timestamp, '-' AS xff,
    CASE WHEN e.event_id % 17 = 0 THEN '-' ELSE 'HTTP/1.1' END AS protocol,
    CASE event_type WHEN 'purchase' THEN 'POST' WHEN 'signup' THEN 'CONNECT' ELSE 'GET' END AS method,
    CASE WHEN page_id % 10 = 0 THEN '203.0.113.' || (page_id % 7)::VARCHAR
         ELSE regexp_extract(url, '^https?://([^/]+)(.*)$', 1) END AS host,
    (CASE WHEN page_id % 3 = 0 THEN url ELSE regexp_extract(url, '^https?://([^/]+)(.*)$', 2) END)
      || (CASE WHEN e.event_id % 13 = 0 THEN '/../../../../../../etc/passwd'
               WHEN e.event_id % 19 = 0 THEN '?q=%3Cscript%3Ealert(1)%3C/script%3E' ELSE '' END) AS params,
    CASE event_type WHEN 'click' THEN '302' WHEN 'error' THEN '404' WHEN 'signup' THEN '-' ELSE '200' END AS status,
    CASE WHEN e.event_id % 11 = 0 THEN '-' ELSE floor(value * 100)::BIGINT::VARCHAR END AS size,
    CASE WHEN e.event_id % 101 = 0 THEN
      ((16943009 + e.event_id) // 16777216)::VARCHAR || '.' || ((16943009 + e.event_id) // 65536 % 256)::VARCHAR || '.'
        || ((16943009 + e.event_id) // 256 % 256)::VARCHAR || '.' || ((16943009 + e.event_id) % 256)::VARCHAR
    ELSE
      ((16843009 + user_id) // 16777216)::VARCHAR || '.' || ((16843009 + user_id) // 65536 % 256)::VARCHAR || '.'
        || ((16843009 + user_id) // 256 % 256)::VARCHAR || '.' || ((16843009 + user_id) % 256)::VARCHAR
    END AS src_ip,
    (1024 + e.event_id % 60000)::INTEGER AS src_port,
    '203.0.113.' || (page_id % 7)::VARCHAR AS dest_ip,
    CASE WHEN e.event_id % 23 <> 0 THEN (8000 + e.event_id % 3)::INTEGER END AS dest_port
  FROM events e JOIN pages p ON p.page_id = e.event_id % (SELECT count(*) FROM pages)
)"""

BASIC = """basic0 AS (
  SELECT * FROM flows WHERE protocol IS DISTINCT FROM '-' AND method IS DISTINCT FROM '-'
    AND status IS DISTINCT FROM '-'
), basic AS (
  SELECT * FROM basic0 WHERE src_ip IN (SELECT src_ip FROM basic0 GROUP BY src_ip HAVING count(*) > 1)
)"""

WEBSCAN = """webscan0 AS (
  SELECT * FROM flows WHERE protocol IS DISTINCT FROM '-' AND method IS DISTINCT FROM '-'
    AND dest_ip IS NOT NULL AND dest_port IS NOT NULL
), webscan AS (
  SELECT * FROM webscan0 WHERE src_ip IN (SELECT src_ip FROM webscan0 GROUP BY src_ip HAVING count(*) > 1)
)"""

DOMAIN = """domain AS (
  SELECT * FROM flows WHERE protocol IS DISTINCT FROM '-' AND method IS DISTINCT FROM '-'
    AND method IS DISTINCT FROM 'CONNECT' AND host IS DISTINCT FROM '-'
    AND dest_ip IS NOT NULL AND dest_port IS NOT NULL
)"""

OWNER = """owner AS (
  SELECT ipint, (ipint // 16777216)::VARCHAR || '.' || (ipint // 65536 % 256)::VARCHAR || '.'
    || (ipint // 256 % 256)::VARCHAR || '.' || (ipint % 256)::VARCHAR AS ip
  FROM (SELECT DISTINCT 16843009 + user_id AS ipint FROM events WHERE user_id % 5 = 0
        UNION SELECT DISTINCT 3405803776 + page_id % 7 FROM pages WHERE page_id % 7 % 2 = 0)
)"""

GEO = """geo AS (
  SELECT (ipint // 16777216)::VARCHAR || '.' || (ipint // 65536 % 256)::VARCHAR || '.'
    || (ipint // 256 % 256)::VARCHAR || '.' || (ipint % 256)::VARCHAR AS ip, n_name AS country, r_name AS area
  FROM (SELECT DISTINCT 16843009 + user_id AS ipint, user_id % 25 AS k FROM events WHERE user_id % 7 <> 0
        UNION SELECT DISTINCT 3405803776 + page_id % 7, page_id % 7 FROM pages)
  JOIN nation ON n_nationkey = k JOIN region ON r_regionkey = n_regionkey
)"""

PARTS = {"FLOWS": FLOWS, "BASIC": BASIC, "WEBSCAN": WEBSCAN, "DOMAIN": DOMAIN, "OWNER": OWNER, "GEO": GEO}


def with_parts(names: str, body: str) -> str:
    """``WITH`` the named parts in front of a body, which may add its own (starting with a comma)."""
    return "WITH " + ",\n".join(PARTS[n] for n in names.split()) + "\n" + body


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits, so that the order of a sum does not show."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            c = (F.round(c, digits) + F.lit(0.0)).alias(f.name)
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.DoubleType):
            c = F.transform(c, lambda x: F.round(x, digits) + F.lit(0.0)).alias(f.name)
        out.append(c)
    return df.select(*out)


def query(name: str, ids: str, sql: str | None = None):
    """Register ``fn(tables)`` under a name, with the inventory lines it covers and its SQL."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(Tables(spark, sf_dir)))
        SURVEY_IDS[name] = ids
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register
