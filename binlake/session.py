"""Session settings shared by jobs, tests and the bench."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build(master: str | None = None, app: str = "binlake", shuffle_partitions: int | None = None,
          **conf: str) -> SparkSession:
    """Session with the settings every operator assumes; cluster settings win where given."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": STATE_STORE,
        "spark.ui.enabled": "false",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf)
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def spread(scan: DataFrame) -> DataFrame:
    """A scan with fewer splits than cores, dealt out to all cores; any larger scan unchanged.

    Only for plain scans in front of costly expressions: one small file must not keep the cluster on one core.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.isStreaming or scan.rdd.getNumPartitions() > cores else scan.repartition(cores)


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can write, from ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting (tests) gets a fresh folder below its warehouse.
    """
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints/{uuid.uuid4().hex}"
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise an iteration's frame in the shared checkpoint folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)
