"""Where plans may write: the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in ``spark.checkpoint.dir`` and cut its lineage and its estimated size there.

    Spark estimates a size from compressed files, whatever is made of their
    rows, and keeps it across a checkpoint: a log of gigabytes would be sent
    through the driver as a small table. Without it a join is broadcast only
    when Spark has counted the bytes of a side. A session without the setting gets a temporary folder if it is one local
    JVM; on a cluster the setting is required.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="braidlog-"))
    spark, kept = df.sparkSession, df.checkpoint()
    rows = kept._jdf.queryExecution().toRdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, kept._jdf.schema(), False), spark)
