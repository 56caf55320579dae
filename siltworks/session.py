"""Session and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def make_session(app: str = "siltworks", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this library expects; any of them can be overridden."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in (defaults | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table, a parquet file or a folder of them."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, set to a local one only where it is unset."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        configured = "file://" + os.path.join(tempfile.gettempdir(), f"siltworks-{os.getuid()}")
        spark.conf.set("spark.checkpoint.dir", configured)
    if not context.getCheckpointDir():
        context.setCheckpointDir(configured)
    return configured.rstrip("/")


def job_folder(spark: SparkSession) -> str:
    """The part of the shared folder that belongs to this application alone."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder; it outlives any executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def ship_package(spark: SparkSession) -> None:
    """Give this package to the workers once a session, so that they need not have it installed."""
    import io
    import pathlib
    import zipfile

    context = spark.sparkContext
    if getattr(context, "siltworks_shipped", False):
        return
    root = pathlib.Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    context.addPyFile(write_shared(spark, "siltworks.zip", packed.getvalue()))
    context.siltworks_shipped = True


def write_shared(spark: SparkSession, name: str, payload: bytes) -> str:
    """Write bytes into the shared folder, under a name of their own, through Hadoop's file system; returns the URI."""
    uri = f"{job_folder(spark)}/files/{uuid.uuid4().hex}-{name}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(uri)
    stream = path.getFileSystem(conf).create(path, True)
    try:
        stream.write(bytearray(payload))
    finally:
        stream.close()
    return uri


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """The rows written once as parquet into the shared folder and read from there: lineage is cut, columns stay prunable."""
    path = f"{job_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sweep_shared(spark: SparkSession) -> None:
    """Remove the tables and files that operators of this application wrote into the shared folder; call it once their results are stored."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in ("tables", "files"):
        path = jvm.org.apache.hadoop.fs.Path(f"{job_folder(spark)}/{name}")
        path.getFileSystem(conf).delete(path, True)
