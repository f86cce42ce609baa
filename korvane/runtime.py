"""Session helpers shared by all operators: the shared folder, written intermediate tables, partition counts."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Where the session names none (tests on local[n]) a folder of this machine is made and set; a cluster always names one.
    """
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="korvane-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_WRITTEN: list[str] = []


def mark() -> int:
    """What `clean` may go back to."""
    return len(_WRITTEN)


def clean(spark: SparkSession, since: int = 0, until: int | None = None) -> int:
    """Delete the tables that this session has written so far, or from one mark to another, and say how many. Call it once their results
    are stored: frames that read them cannot be run again afterwards."""
    n, until = 0, len(_WRITTEN) if until is None else until
    for name in _WRITTEN[since:until]:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        n += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    del _WRITTEN[since:until]
    return n


def folder(spark: SparkSession, name: str) -> str:
    """A new name in the shared folder, which `clean` deletes like a written table."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return int(at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength())


def written(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage, survives the loss of any executor."""
    path = folder(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    """Number of groups for packed shuffles: follows spark.sql.shuffle.partitions, which the cluster sizes to the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


#: Bytes from which a table in fewer partitions than there are cores is spread over them.
SPREAD_BYTES = 1 << 20


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files are too few for that; as it is where they are enough, which large tables always are."""
    wide = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(wide) if size > SPREAD_BYTES and df.rdd.getNumPartitions() < wide else df


#: Bits of a bitmap of keys: a fixed size, whatever the number of keys.
BITMAP = 1 << 24


def bitmap(keys: DataFrame, key: str) -> bytes:
    """Bitmap of a column of 64-bit hashes, built by Spark in parts of 32,768 bits: 2 MB at most reach the driver.

    It only holds rows back before a join; a key that shares its bit with another passes, and the join decides.
    """
    at = F.pmod(F.col(key), F.lit(BITMAP))
    parts = keys.where(F.col(key).isNotNull()).groupBy(F.floor(at / 32768).alias("part")).agg(F.bitmap_construct_agg(F.pmod(at, F.lit(32768))).alias("bits")).collect()
    out = bytearray(BITMAP // 8)
    for r in parts:
        out[r["part"] * 4096 : (r["part"] + 1) * 4096] = r["bits"]
    return bytes(out)


def in_bitmap(bits: bytes, keys: np.ndarray) -> np.ndarray:
    """Whether the bit of each 64-bit hash is set."""
    at = np.mod(keys.astype(np.int64), BITMAP)
    return (np.frombuffer(bits, dtype=np.uint8)[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
