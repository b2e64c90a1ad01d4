"""Folders that every executor can reach."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
WAREHOUSE_SETTING = "spark.sql.warehouse.dir"


def new_shared_folder(spark: SparkSession) -> str:
    """A new path under ``spark.checkpoint.dir``, or under the warehouse where that is unset.

    The rule is the same for every master. A cluster must name one of the two, and share it:
    without either, Spark's default warehouse is a folder that only one machine sees.
    """
    base = spark.conf.get(CHECKPOINT_SETTING, None) or spark.conf.get(WAREHOUSE_SETTING)
    return f"{base.rstrip('/')}/tallyfold-{uuid.uuid4().hex}"
