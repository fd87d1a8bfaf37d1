"""Session helpers: local sessions, table access and the shared folder in which lineage is cut."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, app: str = "corpusloom", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("CORPUSLOOM_DRIVER_MEMORY", "12g"))
    )
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Makes this package importable by Python workers wherever they run: once per session, as an archive in the shared
    folder."""
    sc = spark.sparkContext
    if getattr(sc, "_corpusloom_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    name = fresh_path(spark, "corpusloom") + ".zip"
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    stream.write(out.getvalue())
    stream.close()
    sc.addPyFile(name)
    sc._corpusloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Where the setting is absent (tests, one machine) a temporary folder is set, once per session.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        conf = sc.getConf().get("spark.checkpoint.dir")
        if conf is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
            conf = tempfile.mkdtemp(prefix="corpusloom-")
        sc.setCheckpointDir(conf)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, by the file system that its path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p)
    out.write(text.encode())
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, as text."""
    return spark.read.text(path, wholetext=True).first()[0]
