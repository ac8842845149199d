"""Readers of sensor logs, access logs, corpora and feature files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowscope.functions.text import query_string
from flowscope.operators.sequence import number_lines
from flowscope.plans.flows import FLOW_COLUMNS

# The eleven fields of the older log and the columns of labelled feature and domain files.
FLOW_COLUMNS_11 = tuple(c for c in FLOW_COLUMNS if c != "xff")
DOMAIN_TRUTH_COLUMNS = ("daccount", "dip", "dp", "hostname", "sum_count", "sum_count_invalid")
LABELLED_COLUMNS = (
    "Sum_sec_flow", "Feq_sec_flow", "Sum_xss", "Feq_xss", "Sum_dir", "Feq_dir", "Sum_404_error",
    "Feq_404_error", "H_status", "src_ip", "dest_ip", "Malics_urls", "label",
)


def read_flow_log(spark: SparkSession, path, columns: Sequence[str] = FLOW_COLUMNS) -> DataFrame:
    """Tab-separated flow log with line numbers ``seq``: text columns, no quoting, empty fields as nulls.

    Short rows are padded with nulls; rows with a wrong number of fields keep their line in ``_corrupt_record``.
    Empty lines do not count.
    """
    parts = F.split("value", "\t", -1)
    fields = [F.nullif(F.get(parts, F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(columns)]
    broken = F.when(F.size(parts) != len(columns), F.col("value")).alias("_corrupt_record")
    rows = number_lines(spark.read.text(path).filter("value <> ''"), *fields, broken)
    return rows.select("seq", *columns, "_corrupt_record")


def typed_flows(log: DataFrame) -> DataFrame:
    """Ports as numbers; everything else stays text, with ``-`` for unresolved fields."""
    ports = {c: F.col(c).try_cast("int") for c in ("src_port", "dest_port") if c in log.columns}
    return log.withColumns(ports)


def within_error_budget(log: DataFrame, max_errors: int = 100, max_share: float = 0.5) -> DataFrame:
    """The good rows of a log; fails when more than ``max_errors`` rows and more than ``max_share`` of all are bad.

    The share is taken over the whole input, in one pass before the rows are used.
    """
    bad, total = log.agg(F.count("_corrupt_record"), F.count(F.lit(1))).first()
    if bad > max_errors and bad > max_share * total:
        raise ValueError(f"{bad} of {total} rows do not fit the format")
    return log.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def quarantined(log: DataFrame) -> DataFrame:
    """The raw text of the rows which do not fit the format."""
    return log.filter(F.col("_corrupt_record").isNotNull()).select("seq", "_corrupt_record")


def read_flow_log_11(spark: SparkSession, path) -> DataFrame:
    """Whitespace-separated log of eleven fields; the destination port is the last field of the line."""
    fields = F.split(F.trim("value"), r"\s+")
    parts = [F.get(fields, F.lit(i)).alias(n) for i, n in enumerate(FLOW_COLUMNS_11[:-1])]
    last = F.element_at(fields, -1).alias(FLOW_COLUMNS_11[-1])
    rows = number_lines(spark.read.text(path).filter(F.trim("value") != ""), *parts, last)
    return rows.select("seq", *FLOW_COLUMNS_11)


def read_access_log(spark: SparkSession, path) -> DataFrame:
    """Lines of a space-separated access log which are GET requests with a query: ``(seq, line, url)``."""
    lines = number_lines(spark.read.text(path)).withColumn("_f", F.split("value", " "))
    url = F.get("_f", F.lit(5))
    asked = F.coalesce(F.get(F.split(url, r"\?"), F.lit(1)) != "", F.lit(False))
    wanted = (F.get("_f", F.lit(3)) == "GET") & (url != "-") & asked
    return lines.filter(wanted).select("seq", F.col("value").alias("line"), url.alias("url"))


def read_indexed_urls(spark: SparkSession, path) -> DataFrame:
    """``(seq, url, query)`` of the lines with a query; the line number is kept."""
    lines = number_lines(spark.read.text(path))
    first = F.get(F.split("value", r"\?"), F.lit(1))
    return lines.filter(F.coalesce(first != "", F.lit(False))).select(
        "seq", F.col("value").alias("url"), query_string("value").alias("query")
    )


def read_corpus(spark: SparkSession, good, bad) -> DataFrame:
    """``(text, label)`` from a file of good lines (0) and a file of bad lines (1)."""
    def lines(path, label):
        return spark.read.text(path).select(F.col("value").alias("text"), F.lit(label).alias("label"))

    return lines(good, 0).unionByName(lines(bad, 1))


def read_domain_truth(spark: SparkSession, path) -> DataFrame:
    schema = T.StructType(
        [T.StructField(n, T.LongType() if n.startswith("sum_") else T.StringType()) for n in DOMAIN_TRUTH_COLUMNS]
    )
    return spark.read.csv(path, schema=schema)


def read_labelled_features(
    spark: SparkSession, path, columns: Sequence[str] = LABELLED_COLUMNS, header: bool = False
) -> DataFrame:
    """Tab-separated labelled feature table; ``header`` says whether each file starts with a line of names."""
    text = {"src_ip", "dest_ip", "Malics_urls"}
    kinds = {"label": T.IntegerType()}
    schema = T.StructType(
        [T.StructField(n, T.StringType() if n in text else kinds.get(n, T.DoubleType())) for n in columns]
    )
    return spark.read.csv(path, schema=schema, sep="\t", header=header)


def read_triplets(spark: SparkSession, path) -> DataFrame:
    """Distance triplets ``i j d`` separated by blanks."""
    schema = T.StructType(
        [T.StructField("i", T.LongType()), T.StructField("j", T.LongType()), T.StructField("d", T.DoubleType())]
    )
    return spark.read.csv(path, schema=schema, sep=" ")


def owner_addresses(spark: SparkSession, path) -> DataFrame:
    """All addresses of the owner dimension; only that column is read."""
    return spark.read.parquet(path).select("ip")
