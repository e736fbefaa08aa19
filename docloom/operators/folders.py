"""The folder that driver and executors share, for written tables and checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which is set on the context if need be. A local one is made where a local session has none."""
    sc = spark.sparkContext
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        if not conf and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        sc.setCheckpointDir(conf or "file://" + tempfile.mkdtemp(prefix="docloom-"))
    return (conf or sc.getCheckpointDir()).rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: computed once, however often it is read, and safe from lost executors."""
    path = f"{shared(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Takes the files of tables from written() away; nothing may read them any more."""
    for t in tables:
        for folder in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
