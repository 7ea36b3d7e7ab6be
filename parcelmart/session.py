"""Session settings the jobs are written for."""

from __future__ import annotations

import hashlib
import re
import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(app_name: str = "parcelmart", master: str | None = None, **extra: str) -> SparkSession:
    """Session with the settings above; ``extra`` keys use ``__`` for the dots of a setting name."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """Folder for written intermediates, below the one the cluster names in spark.checkpoint.dir.

    Only in local mode (tests, a laptop) may that setting be missing; then a fresh local folder is used. On a
    cluster every machine would write to its own disk, so a missing setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        return tempfile.mkdtemp(prefix=f"parcelmart-{purpose}-")
    token = hashlib.sha256(f"{spark.sparkContext.applicationId}/{purpose}".encode()).hexdigest()[:16]
    return f"{base.rstrip('/')}/parcelmart/{purpose}-{token}"
