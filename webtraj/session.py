"""Session defaults and the shared folder that survives the loss of an executor."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


DEFAULTS = {
    "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "webtraj", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on; settings of the cluster and of ``conf`` win over these."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    given = spark.sparkContext.getConf()
    for key, value in DEFAULTS.items():
        if not given.contains(key):
            spark.conf.set(key, value)
    return spark


_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a fresh local one only on a local master that sets none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN_DIRS:
            _OWN_DIRS[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        path = _OWN_DIRS[app]
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other job writes to."""
    run = spark.sql("SELECT uuid()").first()[0]
    return f"{shared_dir(spark)}/webtraj-{name}-{run}"


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def cut_lineage(df, name: str):
    """Write ``df`` once to the shared folder and read it back, so several sinks share one computation.

    The folder goes with the application, or when ``release`` is told that nothing reads it any more.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    at, files = _file_system(df.sparkSession, path)
    files.deleteOnExit(at)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def release(*frames) -> None:
    """Remove the folders of ``cut_lineage`` frames; only for frames that nothing unevaluated reads."""
    for df in frames:
        path = getattr(df, "scratch", None)
        if path:
            at, files = _file_system(df.sparkSession, path)
            files.delete(at, True)
