"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of words in a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share, from ``spark.checkpoint.dir``.

    Only a local session, where that setting is missing, gets a temporary folder.
    """
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def settle(df: DataFrame) -> DataFrame:
    """Compute a DataFrame once, to reliable storage, and cut its lineage there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


class Tables:
    """Tables written into a folder of the shared one and read again.

    Unlike a checkpoint, whose estimated size is that of the plan behind it and in a
    loop of joins grows with every round, a table is known by its true size.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def put(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.folder}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.parquet(path)

    def drop(self, *but: DataFrame) -> None:
        """Delete all tables but those given."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        files = [df.inputFiles() for df in but]
        if not all(files):
            return
        kept = {f[0].rsplit("/", 2)[-2] for f in files}
        for i in range(1, self.count + 1):
            if str(i) not in kept:
                path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{i}")
                path.getFileSystem(conf).delete(path, True)


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
