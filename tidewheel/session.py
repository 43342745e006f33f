"""Session helpers: conservative defaults and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session as used by the tests and the benchmark."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Point ``checkpoint()`` at the folder that the cluster names.

    ``spark.checkpoint.dir`` of the session wins, as it is shared by all
    executors.  Only where it is unset (tests, a laptop) a temporary folder is
    used, and only if the master is plain ``local``: the executors of
    ``local-cluster`` count as machines of their own.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidewheel-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """``checkpoint()`` into the shared folder: survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def written(df: DataFrame) -> DataFrame:
    """Cuts the lineage as ``cut_lineage``, by a parquet table in the same folder.

    Smaller than a checkpoint of rows, and later readers take only the columns
    they need.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/written-{uuid.uuid4()}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_counted(df: DataFrame, path: str | None = None) -> tuple[DataFrame, int]:
    """As ``written``, with the number of rows, counted while writing; ``is_empty`` knows it of the result."""
    spark, seen = df.sparkSession, Observation()
    path = path or f"{ensure_checkpoint_dir(spark)}/written-{uuid.uuid4()}"
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._rows = int(seen.get["n"])
    return out, out._rows


def is_empty(df: DataFrame) -> bool:
    """Whether there is no row; costs a job only where the rows were not counted when written."""
    n = df.__dict__.get("_rows")
    return df.isEmpty() if n is None else n == 0


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def delete_path(spark: SparkSession, path: str) -> None:
    """Removes a folder of any file system that Spark can write to, if it is there."""
    fs, where = _file_system(spark, path)
    fs.delete(where, True)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if it is not there."""
    fs, where = _file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
