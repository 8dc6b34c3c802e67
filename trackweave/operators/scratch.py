"""Tables between the rounds of iterative operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def materialize(df: DataFrame) -> DataFrame:
    """Writes to the folder that executors share (spark.checkpoint.dir, else the warehouse) and reads back.

    Cuts the lineage, so a round's plan doesn't hold those before it.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that materialize() wrote, once nothing reads it."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
