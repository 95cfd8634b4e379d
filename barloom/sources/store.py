"""Frozen panels, tagged auxiliary data and run tables on a shared file system."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.schema import PANEL_COLUMNS, PANEL_SCHEMA


def write_panel(panel: DataFrame, path: str) -> None:
    """Freeze a panel, clustered so that scans prune by asset and date."""
    (
        panel.select(*PANEL_COLUMNS)
        .repartitionByRange("asset", "date")
        .sortWithinPartitions("asset", "date")
        .write.mode("overwrite")
        .parquet(path)
    )


def load_panel(spark: SparkSession, path: str) -> DataFrame:
    """Read a frozen panel; Spark raises when the path is missing."""
    return spark.read.schema(PANEL_SCHEMA).parquet(path)


def write_aux(sources: dict[str, DataFrame], path: str) -> None:
    """One dataset for all auxiliary sources, partitioned by the source tag."""
    frames = [df.withColumn("_source", F.lit(name)) for name, df in sources.items()]
    stacked = frames[0]
    for df in frames[1:]:
        stacked = stacked.unionByName(df, allowMissingColumns=True)
    stacked.write.mode("overwrite").partitionBy("_source").parquet(path)


def read_aux(spark: SparkSession, path: str, source: str, columns=None) -> DataFrame:
    """One source, read through partition pruning, without the tag."""
    df = spark.read.parquet(path).filter(F.col("_source") == source).drop("_source")
    return df.select(*columns) if columns else df


def config_hash(config: dict) -> str:
    """Stable ten-character id of a configuration."""
    text = json.dumps(config, sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:10]


def write_run(tables: dict[str, DataFrame], base: str, run_id: str) -> None:
    """Write each table of a run into its own dataset, replacing only this run."""
    for name, df in tables.items():
        (
            df.withColumn("run_id", F.lit(run_id))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("run_id")
            .parquet(f"{base}/{name}")
        )


def append_run_index(spark: SparkSession, base: str, entry: dict) -> None:
    """Append one completed run to the ``runs`` table."""
    row = spark.createDataFrame(
        [(entry["run_id"], entry["target"], ",".join(entry["models"]), int(entry["n_rows"]))],
        "run_id string, target string, models string, n_rows bigint",
    ).withColumn("timestamp", F.current_timestamp())
    row.coalesce(1).write.mode("append").parquet(f"{base}/runs")


def latest_run(spark: SparkSession, base: str) -> DataFrame:
    """The newest completed run, by its recorded time rather than file times."""
    return spark.read.parquet(f"{base}/runs").orderBy(F.desc("timestamp"), F.desc("run_id")).limit(1)


def load_run(spark: SparkSession, base: str, run_id: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{table}").filter(F.col("run_id") == run_id).drop("run_id")
