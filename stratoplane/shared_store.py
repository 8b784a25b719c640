"""Intermediate tables in the folder that all executors and the driver share."""

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_TABLES: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one of this process only where the setting is missing (local mode)."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if "at" not in _OWN:
        _OWN["at"] = tempfile.mkdtemp(prefix="stratoplane-")
        atexit.register(shutil.rmtree, _OWN["at"], True)
    return f"file://{_OWN['at']}"


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df written once as Parquet into the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    _TABLES.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the tables that this process has written so far, once no result that reads them is needed; gives their number."""
    jvm, conf, n = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), len(_TABLES)
    for path in _TABLES:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    _TABLES.clear()
    return n
