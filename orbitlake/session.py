"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "orbitlake", **conf) -> SparkSession:
    """A session with the settings this library relies on (UTC, adaptive execution)."""
    builder = (SparkSession.builder.appName(app)
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.adaptive.coalescePartitions.enabled", "true"))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it from there.

    Used where several later branches (bounds, histograms, the picture itself) would
    otherwise recompute an expensive merge.  The folder is ``spark.checkpoint.dir``; only a
    local session may fall back to a private folder, because a cluster's executors could not
    reach it.
    """
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The same for the cells of pictures, as compressed columns: steps read those they name.

    A checkpoint keeps whole rows, uncompressed, which for pictures is most of what is written.
    """
    spark = df.sparkSession
    folder = f"{_shared_folder(spark)}/columns-{uuid.uuid4()}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def _shared_folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("Set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()
