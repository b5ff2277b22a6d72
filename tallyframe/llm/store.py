"""Intermediate tables in the folder that driver and executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir`` and reading it
back, so a lost executor costs a re-read and never a recomputation of the whole
plan.  A folder of our own is chosen only where the session names none (tests).
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, without a trailing slash."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"{tempfile.gettempdir()}/tallyframe-shared"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of a few MB instead of the default of 64, since texts are long; a setting of the session's own stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "64MB") in ("67108864b", "64MB"):
        spark.conf.set(key, "4MB")


#: Every page of a table carries a checksum that its readers verify, on any file system.  The checksum file that
#: file:// would add beside each costs its writer several process launches, so it is left out.
_WRITES = {"parquet.page.write-checksum.enabled": "true", "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
_READS = {"parquet.page.verify-checksum.enabled": "true"}


def spare(columns: list[str], name: str) -> str:
    """``name``, with underscores behind it as long as a column has that name (in any case of letters)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """``df`` as a table in the shared folder: computed once, whatever is lost later."""
    small_batches(df.sparkSession)
    path = fresh_path(df.sparkSession, tag)
    df.write.options(**_WRITES).parquet(path, compression=compression)
    return df.sparkSession.read.options(**_READS).schema(df.schema).parquet(path)


def drop(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete tables made by ``written`` which nothing will read again."""
    for df in frames:
        for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def settle(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps: it does when the driver's garbage, here and in the JVM, is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
