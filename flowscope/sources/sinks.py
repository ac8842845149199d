"""Writers of feature tables, attack lists, cluster results and cached maps."""

from __future__ import annotations

import posixpath
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowscope.functions.text import percent_decode


def write_flow_log(flows: DataFrame, path: str, columns) -> None:
    """Tab-separated log without header or quoting."""
    flows.select(*columns).write.csv(path, sep="\t", quote="", escape="", nullValue="", emptyValue="")


def append_labelled(scan: DataFrame, normal: DataFrame, path: str, header: bool = False) -> None:
    """Scan rows with label 1 and normal rows with label 0, appended as tab-separated files, on request with headers."""
    columns = [c for c in scan.columns if c in normal.columns]
    both = scan.select(*columns, F.lit(1).alias("label")).unionByName(normal.select(*columns, F.lit(0).alias("label")))
    both.write.mode("append").csv(path, sep="\t", header=header)


def attack_lines(scored: DataFrame, column: str = "line", prediction: str = "prediction") -> DataFrame:
    """Decoded text of the rows with an attack prediction, without line breaks."""
    text = F.translate(percent_decode(column), "\r\n", "")
    return scored.filter(F.col(prediction) != 0).select(text.alias("value"))


def write_attack_lines(scored: DataFrame, path: str, column: str = "line") -> None:
    attack_lines(scored, column).write.text(path)


def result_path(input_path: str, root: str) -> str:
    """Where the results of an input file go: ``<root>/<file name without its ending>``."""
    name = posixpath.basename(input_path.rstrip("/"))
    return posixpath.join(root, name.rsplit(".", 1)[0])


def write_decision_graph(scores: DataFrame, path: str) -> None:
    """Density and delta of every point, for choosing the thresholds."""
    scores.select(F.format_string("%.2f", "rho"), F.format_string("%.2f", "delta")).write.csv(path, sep=" ")


def write_assignment(marked: DataFrame, path: str) -> None:
    """Point, cluster and cluster with halo control."""
    marked.select("id", "cluster", "halo").write.csv(path, sep=" ")


def load_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A cached table: read when it is there, else built and stored; built once. Nothing that is there is overwritten."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        build().write.parquet(path)
        return spark.read.parquet(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
