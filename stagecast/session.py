"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def get_session(app: str = "stagecast", **extra: str) -> SparkSession:
    """A session with the settings the operators rely on; the cluster supplies the rest."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path for checkpoints and landed tables, below the cluster's shared folder.

    The folder is the one named in ``spark.checkpoint.dir``. Only where that is unset (a test
    or a laptop in local mode) is a temporary folder used; a cluster must name a shared one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="stagecast-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialise(df, label: str):
    """Write a DataFrame used many times to a table in the shared folder and read it back.

    Lineage ends at the table, so a lost executor costs a re-read and not a recomputation.
    """
    path = scratch(df.sparkSession, label)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
