"""Tables that are computed once and read several times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share. Where that is unset, a folder of this machine in local mode and
    an error on a cluster, whose executors would not see it."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and sc.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="sablegrid-"))
    return sc.getCheckpointDir()


#: Folders that this process has written and not deleted yet.
_kept: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder; so the plan before it is cut and a lost executor costs nothing.

    The table stays until `sweep`, for results read it whenever they are asked for.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _kept.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of files that one task of a shuffle by transaction takes.
TASK_BYTES = 4 << 20


def tasks(table: DataFrame) -> int:
    """Tasks for a shuffle of a table of files: more as the table grows, so that none of them does. For rows whose size
    Spark doesn't know (it takes them for endless), those of the session."""
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES) if size < 1 << 60 else 1)


def dealt(df: DataFrame, name: str, key: str, owners: int, placed: bool = False) -> DataFrame:
    """df as a table in the shared folder whose files are dealt by key: grouping or joining it by key needs no shuffle.
    placed: df is dealt by key to as many owners already, so it need not move again; otherwise files would be many."""
    spark, name = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    _kept.append(path)
    (df if placed else df.repartition(owners, key)).write.format("parquet").option("path", path).bucketBy(owners, key).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name alone goes: the files are not the catalog's
    return out


def sweep(spark: SparkSession) -> int:
    """Delete all tables that this process has written; how many there were. For a session whose results are saved."""
    found = list(_kept)
    _kept.clear()
    for path in found:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return len(found)
