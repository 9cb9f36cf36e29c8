"""Session factory, table access and lineage cuts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Settings every result of this library relies on; cluster sizing stays with the cluster.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above; ``master`` only for local runs."""
    b = SparkSession.builder.appName("tallyforge")
    if master:
        b = b.master(master)
    for k, v in {**BASE_CONF, **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """Table ``name`` of the data folder ``base`` (one Parquet file or folder)."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, for work in Python that a few small files would leave to few.

    Tables of more partitions than that, as all large ones are, stay as they are: nothing is shuffled.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one only where it is unset and the session is local.

    On a cluster an unset folder is an error: what one machine keeps for itself, the others can't read.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not (sc.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tallyforge-", dir=os.environ.get("TMPDIR")))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder, so that a lost executor costs a re-read and no re-run.

    Its size is unknown to the planner.  A checkpoint alone hands on the size guessed from the files below, which knows
    nothing of what Python makes of the rows or of exploded lists: joins would send tables many times the broadcast
    threshold through the driver.  Adaptive execution still broadcasts what it has measured to be small.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    cut = df.checkpoint(eager=True)._jdf
    rows = cut.queryExecution().analyzed().rdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, cut.schema(), False), spark)
