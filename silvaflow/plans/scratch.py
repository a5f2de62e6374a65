"""A folder for files that a query writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below spark.checkpoint.dir, which all executors share; a local session without the setting gets a folder of its own."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not given:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        given = _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="silvaflow-"))
    return f"{given.rstrip('/')}/queries/{label}-{uuid.uuid4().hex}"
