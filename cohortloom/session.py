"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot key even where that costs one more exchange downstream
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
}


def build_session(master: str, app: str = "cohortloom", **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    settings = {
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        **RUNTIME_CONF,
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tune(spark: SparkSession) -> SparkSession:
    """Apply the adaptive-execution settings to a session somebody else built."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="cohortloom-")
        atexit.register(shutil.rmtree, _LOCAL_DIRS[app], ignore_errors=True)
    return _LOCAL_DIRS[app]


class TableStore:
    """Writes a frame once and hands back the written table.

    A step that several later steps read is stored here: lineage ends at the
    files (so a lost executor costs a re-read, not a re-run) and the planner sees
    the real size when it picks join strategies.

    Tables saved by a key are dealt into ``buckets`` by it, so that joins and groups of any
    of them by that key need no exchange.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.root = root or f"{shared_dir(spark)}/cohortloom-{uuid.uuid4().hex}"
        self.buckets = buckets or spark.sparkContext.defaultParallelism

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, key: str | None = None) -> DataFrame:
        path = self.path(name)
        if key is None:
            df.write.mode("overwrite").parquet(path)
            return self.spark.read.schema(df.schema).parquet(path)
        table = re.sub(r"\W", "_", f"{os.path.basename(self.root)}_{name}")
        # no second exchange where df is dealt like this already
        (df.repartition(self.buckets, key).write.mode("overwrite").format("parquet")
         .bucketBy(self.buckets, key).option("path", path).saveAsTable(table))
        return self.spark.table(table)


def lazy(df: DataFrame, name: str, key: str | None = None) -> DataFrame:
    """The do-nothing counterpart of :meth:`TableStore.save`."""
    return df
