"""Tables written to the folder all executors share, where lineage is to end or a result is read several times."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: A side is broadcast only if it was counted and has no more rows.
BROADCAST_ROWS = 50_000


def few(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if a count that ends early finds few rows; else as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session without it gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written there and read back. Files stay: results that read them are computed later."""
    path = f"{shared_root(df.sparkSession)}/corpusloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table of this module that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def forgotten(df: DataFrame) -> None:
    """Delete the files of a table that `written` made and nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        removed(df.sparkSession, folder)


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> tuple[DataFrame, Callable[[], None]]:
    """df as `written`, but dealt out by key: joined by it with a table of so many parts it is not shuffled. And what deletes it."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_root(spark)}/corpusloom/{table}"
    df.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(table)

    def drop() -> None:
        spark.sql(f"DROP TABLE IF EXISTS {table}")  # the catalog's entry; the path is the caller's, so its files stay
        removed(spark, path)

    return spark.table(table), drop
