"""Session, table and scratch-folder helpers shared by all operators."""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
import uuid
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle: int = 8, app: str = "weftline") -> SparkSession:
    """A local session for tests and benches; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("WEFTLINE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none and runs in one process (tests, a laptop)
    a temporary folder is made and set; on a cluster that is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set("spark.checkpoint.dir", named)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def hadoop(spark: SparkSession, path: str):  # noqa: ANN202
    """(file system, path) of the JVM."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def scratch(spark: SparkSession, kind: str = "weftline") -> str:
    """A new path in the application's own folder of the shared one, which goes when the driver ends."""
    own = f"{shared_dir(spark).rstrip('/')}/weftline-{spark.sparkContext.applicationId}"
    if own not in _OWN:
        fs, at = hadoop(spark, own)
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _OWN.add(own)
    return f"{own}/{kind}-{uuid.uuid4().hex}"


_OWN: set[str] = set()
_STAGED: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def stage(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch(spark)
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _STAGED[out] = path
    return out


def unstage(*staged: DataFrame) -> None:
    """Delete the tables of frames that ``stage`` returned and that nothing reads any more."""
    for df in staged:
        path = _STAGED.pop(df, None)
        if path is not None:
            fs, at = hadoop(df.sparkSession, path)
            fs.delete(at, True)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the session's Python workers this package, once, wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    package = Path(__file__).resolve().parent
    sources = sorted(package.rglob("*.py"))
    name = "weftline-" + hashlib.sha256(b"".join(p.read_bytes() for p in sources)).hexdigest()[:12] + ".zip"
    shared = shared_dir(spark)
    # The driver serves the file to the executors from where it stands.
    folder = Path(shared.removeprefix("file://")) if shared.startswith(("file:", "/")) else Path(tempfile.mkdtemp())
    folder.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(folder / name, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sources:
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(str(folder / name))
