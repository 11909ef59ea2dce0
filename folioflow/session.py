"""Session bootstrap and the few cluster settings the engine reads."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "folioflow", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; `master` only for local runs and tests."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by the session in spark.checkpoint.dir.

    Only a local session may name none (tests, a laptop): then a local folder is made and set. On a cluster a folder of one
    machine would lose rows, so there a missing name is an error.
    """
    sc = spark.sparkContext
    where = spark.conf.get(CHECKPOINT_KEY, None) or sc.getConf().get(CHECKPOINT_KEY)
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        where = "file://" + os.path.join(tempfile.gettempdir(), "folioflow-checkpoint")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows are written once to the shared folder and read from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
