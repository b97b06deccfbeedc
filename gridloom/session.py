"""Session builder and the few session-level rules the library relies on."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "gridloom", cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the library expects: UTC, AQE, Arrow.

    On a cluster the caller's own session is used as it is; nothing in the
    library needs a setting beyond a UTC session time zone.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("GRIDLOOM_DRIVER_MEMORY", "8g"),
    } | conf
    spark = SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, default: str) -> str:
    """The folder all executors share: spark.checkpoint.dir, or ``default`` where that is unset (tests, local runs)."""
    return spark.conf.get("spark.checkpoint.dir", None) or default


def cached(spark: SparkSession, name: str, params: dict, build: Callable[[], DataFrame], default: str) -> DataFrame:
    """A table written once per set of parameters in the shared folder and read from there, which also cuts its lineage.

    Its place is named by the parameters, so that another lag or window never
    reads it. A table that was not wholly written has no success mark and is built again.
    """
    key = hashlib.sha256(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:16]
    path = f"{shared_dir(spark, default)}/{name}-{key}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
