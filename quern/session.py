"""Session helpers: configuration defaults and the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Settings the engine relies on; a caller's own value always wins.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def build(master: str | None = None, app: str = "quern", **conf: str) -> SparkSession:
    """A session with DEFAULTS, then `conf` (keys with `__` for `.`)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: what the cluster names in spark.checkpoint.dir.

    Only a single-machine `local` session without that setting gets a folder of
    its own; on a cluster a missing setting is an error, because a machine-local
    folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if named:
            sc.setCheckpointDir(named)
        elif sc.master.split("[")[0] == "local":
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="quern-checkpoint-"))
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and read on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test or production table by name under `sf_dir` (a file or a folder)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
