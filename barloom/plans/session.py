"""Session settings for local runs; a cluster session is used as it comes."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int = 8, name: str = "barloom", memory: str = "8g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the session names.

    Without one, a session inside a single process takes a temporary folder; on a cluster no executor could
    read it, so that is an error.
    """
    named, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    if not named and not re.match(r"local(\[|$)", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-ckpt-"))


def cut_lineage(df, eager: bool = True):
    """Reliable checkpoint: survives lost executors, unlike a local one."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


_kept: dict[tuple, tuple] = {}


def remembered(spark: SparkSession, key: tuple, build):
    """``build()``, a tuple with a materialised DataFrame first, once per session; again if its files are gone."""
    key = (spark.sparkContext.applicationId, *key)
    if key in _kept:
        try:
            _kept[key][0].isEmpty()
        except Exception:  # the shared folder was cleaned between two queries
            del _kept[key]
    if key not in _kept:
        _kept[key] = build()
    return _kept[key]
