"""Table access, lineage cuts and the word split that the operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Space and the five control characters from tab to carriage return part words.
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of this machine only in a local session that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="gradecube-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def stored(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """df written once to the shared folder and read again, which cuts its lineage."""
    path = f"{shared_folder(df.sparkSession)}/gradecube-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by stored() that nothing will read again."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if folder.getName().startswith("gradecube-"):
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    freed(df)


def freed(df: DataFrame) -> None:
    """Let the context cleaner remove the shuffle files of tables that are stored by now."""
    gc.collect()
    df.sparkSession._jvm.System.gc()


def words(text: Column) -> Column:
    """Words of a text; null gives none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def in_train(doc_id: Column) -> Column:
    """True for rows labels may be learnt from: crc32(doc_id as text) mod 3 is not 1."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1
