"""Tables written on the way: the end of a lineage, in storage that all executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df written to the folder that spark.checkpoint.dir names and read back; a local folder only where that is unset, and never on a cluster. The tables stay until that folder is cleared."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("a cluster needs spark.checkpoint.dir: a folder that all executors share")
        folder = "/tmp/weftline-checkpoints"
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
