"""Session plumbing shared by every module: code shipping, the shared scratch folder, written tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: What each application wrote: (table or None, path).
_WRITTEN: dict[str, list[tuple[str | None, str]]] = {}


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever the driver was started from."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(os.path.realpath(tempfile.mkdtemp(prefix="tessaline-"))) / "tessaline.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path("tessaline") / p.relative_to(root)))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in spark.checkpoint.dir. Only where that is unset (tests, a laptop) a
    machine-local folder is made, which is then also the checkpoint directory, and only on a local master:
    the driver of a cluster could not read there what executors wrote.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not named:
        current = sc._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not (sc.master.startswith("local") and not sc.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = current.get() if current.isDefined() else "file://" + tempfile.mkdtemp(prefix="tessaline-shared-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def written(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Cut the lineage of `df`: write it once to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessaline-{label}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append((None, path))
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_by_key(df: DataFrame, label: str, key: str, buckets: int) -> DataFrame:
    """Like `written`, but laid out in hash buckets of `key`: later joins on it don't shuffle this side."""
    spark = df.sparkSession
    name = f"tessaline_{label}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append((name, path))
    df.write.mode("errorifexists").format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(name)
    return spark.table(name)


def clean_up(spark: SparkSession) -> int:
    """Drop the tables and delete the folders that this session's jobs wrote so far; results that still read them are lost. Returns how many."""
    gone = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for name, path in gone:
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return len(gone)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
