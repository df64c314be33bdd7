"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("codestrata")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor; call it once per session.

    Functions of operators run inside tasks and are found there by import. A wheel installed on every
    machine or ``--py-files`` does the same.
    """
    package = os.path.dirname(os.path.abspath(__file__))
    archive = f"{os.path.basename(package)}.zip"
    if any(str(f).endswith(f"/{archive}") for f in spark.sparkContext.listFiles):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="codestrata-ship-"), archive)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    spark.sparkContext.addPyFile(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster a
    machine-local path would lose its blocks together with the executor.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if sc.getCheckpointDir():
            return sc.getCheckpointDir()
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="codestrata-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


_KEPT: set[str] = set()  # applications whose intermediate files go when the driver ends


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    own = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"
    if own not in _KEPT:
        _KEPT.add(own)
        atexit.register(release, spark)
    return own


def release(spark: SparkSession) -> None:
    """Delete the intermediate files of this application; results that were not written elsewhere cannot be read any more.

    Operators are lazy, so their files must last as long as the frames that read them: the driver's end calls this, and
    a long session may call it between jobs.
    """
    sc = spark.sparkContext
    if sc._jsc is None or sc._jsc.sc().isStopped():
        return
    target = sc._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def dropped(df: DataFrame) -> None:
    """Delete the files of a result of ``cut`` that nothing reads any more."""
    sc = df.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that later plans start from the files.

    Unlike a checkpoint the plan keeps no constraints or statistics of the rows' past,
    which would grow with every round of an iterative operator.
    """
    spark = df.sparkSession
    path = f"{own_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
