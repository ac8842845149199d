import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("flowscope-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="run-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


FLOW_SCHEMA = (
    "seq bigint, timestamp string, protocol string, method string, host string, params string, status string, "
    "size string, src_ip string, src_port int, dest_ip string, dest_port int"
)


def flow(seq, src="192.0.2.1", dest="198.51.100.1", second=0, status="200", size="10", params="/", method="GET",
         host="www.example.com", protocol="HTTP/1.1", port=80, micros=0):
    stamp = f"01/20/19-{second // 3600:02d}:{second // 60 % 60:02d}:{second % 60:02d}.{micros:06d}"
    return (seq, stamp, protocol, method, host, params, status, size, src, 1000 + seq, dest, port)


@pytest.fixture(scope="session")
def flows(spark):
    def make(rows):
        return spark.createDataFrame(rows, FLOW_SCHEMA)

    return make
