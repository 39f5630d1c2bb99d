"""Session settings and scratch space shared by every query."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SCRATCH_CONF = "spark.checkpoint.dir"

# Fallback folders of local sessions, by application id.
_local_scratch: dict[str, str] = {}


def build_session(app_name: str = "aerovox", master: str | None = None, **conf: str) -> SparkSession:
    """A UTC session with adaptive execution on; ``conf`` overrides any setting.

    Keys in ``conf`` use ``__`` for the dots, e.g. ``spark__sql__shuffle__partitions="64"``.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return use_utc(builder.getOrCreate())


def use_utc(spark: SparkSession) -> SparkSession:
    """Every timestamp here is UTC, so the session has to render and cast in UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables and stream state.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session may fall back to
    a temporary folder: on a cluster that folder would be lost together with its executor.
    """
    root = spark.conf.get(SCRATCH_CONF, None)
    if root:
        return root.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError(f"{SCRATCH_CONF} must name a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="aerovox-")
    return _local_scratch[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, not yet existing path below the shared folder."""
    return os.path.join(scratch_root(spark), f"{label}-{uuid.uuid4().hex}")


def store(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Runs ``df`` once, writes it to the shared folder and returns the written table.

    For results that several branches of a plan read: they share one run, and losing an
    executor costs neither the result nor a second, possibly different, run.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
