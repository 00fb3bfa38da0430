"""Session settings this package relies on."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings; none of them fixes a cluster size.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# transformWithState needs a provider that can hold several state variables.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def tune(spark: SparkSession, streaming: bool = False) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    _let_local_workers_import(spark)
    for key, value in {**SETTINGS, **(STATE_STORE if streaming else {})}.items():
        spark.conf.set(key, value)
    return spark


def _let_local_workers_import(spark: SparkSession) -> None:
    """Python workers of a local master find this package; a cluster gets it with ``--py-files``."""
    context = spark.sparkContext
    home = str(Path(__file__).resolve().parents[1])
    paths = [p for p in context.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if context.master.startswith("local") and home not in paths:
        context.environment["PYTHONPATH"] = os.pathsep.join([home, *paths])


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "roompulse",
                  **extra: str) -> SparkSession:
    """A session for tests and for ``bench.py``; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in {**SETTINGS, **STATE_STORE, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    _let_local_workers_import(spark)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder for checkpoints, streaming progress and staged tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master may leave that unset: its
    executors live in this process and a temporary folder, one per application, serves them all.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = context.applicationId
        if app not in _own_folder:
            _own_folder[app] = tempfile.mkdtemp(prefix="roompulse-")
        folder = _own_folder[app]
    return folder.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a Parquet table in the shared folder, and read again.

    This cuts the lineage, survives lost executors, and tells the optimizer the true size. The tables of
    an application lie in one folder, which goes when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{staging_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staging_folder(spark: SparkSession) -> str:
    """The application's own folder for intermediate data in the shared folder."""
    home = f"{shared_folder(spark)}/staged-{spark.sparkContext.applicationId}"
    if home not in _staged:
        _staged.add(home)
        atexit.register(_remove, spark, home)
    return home


_staged: set[str] = set()


def _remove(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
