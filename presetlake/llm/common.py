"""Small helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``); a local one only where that is unset and the master local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="presetlake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark context, so that they need no installed copy."""
    context = spark.sparkContext
    if getattr(context, "_presetlake_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="presetlake-")) / "presetlake.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, Path(package.name) / file.relative_to(package))
    context.addPyFile(str(archive))
    context._presetlake_shipped = True


def _own_path(spark: SparkSession) -> str:
    """A new path in the shared folder; what is written there goes when the driver's JVM ends, if not by ``discard``."""
    path = f"{shared_dir(spark)}/presetlake-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts lineage so that a lost executor costs one stage at most.
    """
    spark = df.sparkSession
    path = _own_path(spark)
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._presetlake_path = path
    return made


def store_by(df: DataFrame, key: str) -> DataFrame:
    """``store`` in buckets by the column ``key``: joins on it deal out the other side only, however often.

    There are as many buckets as shuffle partitions. The name that the table needs for this is dropped at once.
    """
    spark = df.sparkSession
    path, buckets = _own_path(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = "presetlake_" + uuid.uuid4().hex
    df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(name)
    made = spark.table(name)
    made.schema  # resolves the table while it has its name
    spark.sql(f"DROP TABLE {name}")
    made._presetlake_path = path
    return made


def discard(*stored: DataFrame) -> None:
    """Delete what ``store`` has written, once nothing will read it any more."""
    for df in stored:
        spark = df.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(df._presetlake_path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it is read in half as many splits or fewer, as a single small file is.

    Costs a shuffle of what then is little for each core, and changes no row. What is read in more splits stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def fold(column: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; a null id falls into fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string")), F.lit(modulus)), F.lit(0)).cast("int")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
