"""Session defaults for local use; on a cluster pass your own session."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tessera")
    settings = {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.sql.adaptive.enabled": "true"} | conf
    return builder.config(map=settings).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Drops an execution's shuffle files when it has ended, rather than when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only a local master, where both are one process, may leave it unset."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return "file:///tmp/checkpoints/tessera"


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """Cuts the lineage: the frame as a table at a path in the shared folder, read again."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, rows: int, each: int = 1 << 20) -> DataFrame:
    """The frame in no more partitions than so many rows call for, or than there are cores: small tables make few tasks and few files."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table under a name of its own in the shared folder, read again."""
    return written(df, shared_path(df.sparkSession, name))


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table that is read no more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def dealt_anew(key: str) -> Column:
    """A 64-bit key of an aggregate that is joined next, as an expression that Spark doesn't know the rows to be dealt by.

    It deals the few aggregated rows once more, and so both sides of the join are
    exchanges of its own, which it can split where a key is hot."""
    return F.col(key).bitwiseXOR(F.lit(0).cast("long")).alias(key)
