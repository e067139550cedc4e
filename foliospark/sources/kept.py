"""Tables that are read several times: written once, which also keeps later plans short."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """The rows of df from a checkpoint in spark.checkpoint.dir. A session on this machine alone (tests) gets a temporary folder
    where that is unset; any other an error."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="foliospark-"))
    return df.checkpoint()
